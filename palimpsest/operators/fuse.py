"""Context scores, overlap merge and threshold, all inside the document row."""

from __future__ import annotations

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import among, fold_to_array, let, let_array, text_literal
from palimpsest.operators.scan import FINDING, finding


def context_window(text: str, start: str, end: str, size: int = C.CONTEXT_WINDOW) -> str:
    """Lower-case text around a span, cut at the ends of the text."""
    first = f"greatest({start} - {size}, 0)"
    return (
        f"lower(substring({text}, {first} + 1, least({end} + {size}, length({text})) - {first}))"
    )


# A text of up to so many characters is looked through once for all findings that have all of it around.
WHOLE_CHARS = 4 * C.CONTEXT_WINDOW


def boost(category: str, near: str) -> str:
    """Support by the words of a category in a text."""
    boosts = ", ".join(f"{v}D" for v in C.CONTEXT_BOOST)
    hits = " + ".join(f"cast(contains({near}, {text_literal(w)}) as int)" for w in C.CONTEXT_KEYWORDS[category])
    return f"get(array({boosts}), {hits})"


def context_score(text: str, f: str, window: str | None = None, whole: str | None = None) -> str:
    """Support for finding `f` from words of its label's category near the span (or in a `window` cut before).

    `whole` names the supports by a text as a whole, by category, for findings that have all of it around.
    """
    window = window or context_window(text, f"{f}.start", f"{f}.end")
    tests = {c: among(f"{f}.label", labels) for c, labels in C.CONTEXT_LABELS.items()}
    tests |= {c: f"contains({f}.label, {text_literal(part)})" for c, part in C.CONTEXT_LABEL_PART.items()}

    def support(category: str, place: int) -> str:
        cut = let(window, "near", boost(category, "near"))
        all_around = f"chars <= {WHOLE_CHARS} and {f}.start <= {C.CONTEXT_WINDOW} and chars <= {f}.end + {C.CONTEXT_WINDOW}"
        return f"if({all_around}, get({whole}, {place}), {cut})" if whole else cut

    cases = [f"when {test} then {support(category, place)}" for place, (category, test) in enumerate(tests.items())]
    return f"case {' '.join(cases)} else 0.0D end"


def with_context(findings: str, text: str = "text", window: str | None = None) -> str:
    """Findings with their context score added to the confidence, at most 1."""
    rescored = finding("f", confidence="least(f.confidence + support, 1.0D)", context_score="support")
    parts = " or ".join(f"contains(f.label, {text_literal(part)})" for part in C.CONTEXT_LABEL_PART.values())
    categorised = f"{among('f.label', sum(C.CONTEXT_LABELS.values(), ()))} or {parts}"
    # A finding that no words can support stays as it is, if its scores are in their ranges already.
    settled = f"f.confidence > 0.0D and f.confidence <= 1.0D and f.context_score = 0.0D and not ({categorised})"
    score = context_score(text, "f", window, None if window else "supports")
    scored = f"transform({findings}, f -> if({settled}, f, {let(score, 'support', rescored)}))"
    if window:
        return scored
    boosts = ", ".join(boost(c, "lowered") for c in (*C.CONTEXT_LABELS, *C.CONTEXT_LABEL_PART))
    supports = f"if(chars <= {WHOLE_CHARS}, {let_array(f'lower({text})', 'lowered', f'array({boosts})', 'double')}, null)"
    return let_array(f"length({text})", "chars", let_array(supports, "supports", scored, FINDING), FINDING)


def merge_overlaps(findings: str) -> str:
    """Keep one finding of each overlap: the surer, then the longer, then the earlier one.

    A finding is compared with the current winner only, in order of start and arrival, so
    the winner's end decides what the next finding overlaps with.
    """
    better = (
        "(new.confidence > old.confidence or "
        "(new.confidence = old.confidence and new.end - new.start > old.end - old.start))"
    )
    step = (
        "case when size(kept) = 0 then array(new) "
        "when new.start >= old.end then array_append(kept, new) "
        f"when {better} then array_append(slice(kept, 1, size(kept) - 1), new) else kept end"
    ).replace("old.", "try_element_at(kept, -1).")
    return fold_to_array(f"sort_array({findings})", FINDING, "kept", "new", step)


def above(findings: str, threshold: str | float) -> str:
    """Findings at or above a threshold, given as a number or as SQL text."""
    limit = f"{float(threshold)}D" if isinstance(threshold, (int, float)) else threshold
    return f"filter({findings}, f -> f.confidence >= {limit})"


def mean_confidence(findings: str) -> str:
    total = f"aggregate({findings}, 0.0D, (sum, f) -> sum + f.confidence)"
    return f"if(size({findings}) = 0, 0.0D, {total} / size({findings}))"


def of_types(findings: str, types: tuple[str, ...] = C.DECLARED_ENTITY_TYPES) -> str:
    """Findings whose label is on an allow-list."""
    return f"filter({findings}, f -> {among('f.label', types)})"
