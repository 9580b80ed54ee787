"""Array helpers for expressions that run inside one document row.

The row-level operators are written as SQL expression text: every function here and in the
modules built on it takes and returns such text.
"""

from __future__ import annotations

# Appending to an array copies it. Folding in blocks keeps a long fold near linear.
BLOCK = 256


def quoted(value: str) -> str:
    """A string literal, taken as it is written."""
    if "'" in value:
        raise ValueError("a literal may not contain a quote")
    return f"r'{value}'"


def text_literal(value: str) -> str:
    """A string literal for any value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` any number of times in `body`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def let_array(value: str, name: str, body: str, element: str) -> str:
    """`let` for a body that is an array of `element`. It is handed on as it is, where `let` copies it with all it holds."""
    return f"aggregate(array({value}), {empty_array(element)}, (_none, {name}) -> {body})"


def empty_array(element: str) -> str:
    return f"cast(array() as array<{element}>)"


def one_of(value: str, table: dict[str, str], otherwise: str = "cast(null as string)") -> str:
    """Look `value` up in a small fixed table."""
    cases = " ".join(f"when {text_literal(k)} then {text_literal(v)}" for k, v in table.items())
    return f"case {value} {cases} else {otherwise} end"


def among(value: str, names: tuple[str, ...]) -> str:
    return f"{value} in ({', '.join(text_literal(n) for n in names)})" if names else "false"


def fold_to_array(
    items: str, element: str, state: str, item: str, step: str, block: int = BLOCK
) -> str:
    """Left fold whose state is a growing array of which only the last element is read.

    `step` is the new state in terms of the names `state` and `item`; it may append to the
    state or replace its last element. Each block of items starts from the last element left
    by the block before.
    """
    none, no_blocks = empty_array(element), empty_array(f"array<{element}>")
    seed = f"if(size(done) = 0, {none}, slice(try_element_at(done, -1), -1, 1))"
    one_block = (
        f"array_append(done, aggregate(slice(all_items, block_no * {block} + 1, {block}), {seed}, "
        f"({state}, {item}) -> {step}))"
    )
    blocks = (
        f"aggregate(sequence(0, cast((size(all_items) - 1) div {block} as int)), {no_blocks}, "
        f"(done, block_no) -> {one_block})"
    )
    # The last element of a block opens the next one, so it is dropped from its own.
    joined = (
        "flatten(transform(parts, (part, part_no) -> "
        "if(part_no < size(parts) - 1, slice(part, 1, size(part) - 1), part)))"
    )
    short = f"aggregate(all_items, {none}, ({state}, {item}) -> {step})"
    long = let(blocks, "parts", joined)
    folded = f"if(size(all_items) <= {block}, {short}, {long})"
    return let_array(items, "all_items", folded, element)


def characters(text: str) -> str:
    """One element per code point; none for empty text."""
    return f"if(length({text}) = 0, {empty_array('string')}, split({text}, ''))"


def keyed_draw(text: str, place: str, n: int, salt: str) -> str:
    """A repeatable draw from 0..n-1 that depends on the salt, the text and a place in it."""
    digest = f"sha2(concat({text_literal(salt + ':')}, {text}, ':', {place}), 256)"
    return f"(cast(conv(substring({digest}, 1, 8), 16, 10) as bigint) % {n})"


def pick(values: tuple[str, ...], draw: str) -> str:
    listed = ", ".join(text_literal(v) for v in values)
    return f"get(array({listed}), cast({draw} as int))"
