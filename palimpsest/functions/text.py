"""Scalar text functions as SQL text: character tests, check digits and rewriting strategies."""

from __future__ import annotations

from palimpsest.functions import constants as C
from palimpsest.functions.arrays import characters, keyed_draw, let, pick, quoted

DEFAULT_SALT = "palimpsest"
# Digits in the wide sense: decimal digits plus super- and subscript ones.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def matches(text: str, regex: str) -> str:
    return f"({text} rlike {quoted(regex)})"


def is_title_case(text: str) -> str:
    """At least one capital, capitals only at word starts and no small letter at one."""
    capital = matches(text, r"[\p{Lu}\p{Lt}]")
    inner_capital = matches(text, r"(?<=[\p{Lu}\p{Lt}\p{Ll}])[\p{Lu}\p{Lt}]")
    small_start = matches(text, r"(?<![\p{Lu}\p{Lt}\p{Ll}])\p{Ll}")
    return f"({capital} and not {inner_capital} and not {small_start})"


def passes_luhn(text: str) -> str:
    """Luhn check over the digits of `text`. Other digits than 0-9 leave too few for a card number."""
    bare = f"regexp_replace({text}, '[^0-9]', '')"
    digits = characters(f"reverse({bare})")
    weight = (
        "case when place % 2 = 0 then cast(digit as int) "
        "when cast(digit as int) > 4 then cast(digit as int) * 2 - 9 "
        "else cast(digit as int) * 2 end"
    )
    total = f"aggregate(transform({digits}, (digit, place) -> {weight}), 0, (sum, v) -> sum + v)"
    return f"(length({bare}) >= {C.CARD_DIGITS} and {total} % 10 = 0)"


def safe_file_name(name: str) -> str:
    """File name reduced to its last path part and to letters, digits, `_`, `.` and `-`."""
    spaced = f"regexp_replace({name}, {quoted(r'[/\s]+')}, ' ')"
    joined = f"replace(trim({spaced}), ' ', '_')"
    plain = f"regexp_replace({joined}, '[^A-Za-z0-9_.-]', '')"
    return f"regexp_replace({plain}, '^[._]+|[._]+$', '')"


def bracketed(label: str) -> str:
    return f"concat('[', {label}, ']')"


def masked(text: str) -> str:
    stars = f"repeat('*', length({text}) - 2)"
    return (
        f"if(length({text}) <= 2, repeat('*', length({text})), "
        f"concat(substring({text}, 1, 1), {stars}, substring({text}, -1, 1)))"
    )


def partly_masked(text: str) -> str:
    stars = f"repeat('*', length({text}) - 4)"
    return (
        f"if(length({text}) <= 4, repeat('*', length({text})), "
        f"concat(substring({text}, 1, 2), {stars}, substring({text}, -2, 2)))"
    )


def realistic(text: str, label: str, salt: str) -> str:
    first = pick(C.FIRST_NAMES, keyed_draw(text, "'first'", len(C.FIRST_NAMES), salt))
    family = pick(C.LAST_NAMES, keyed_draw(text, "'last'", len(C.LAST_NAMES), salt))
    company = pick(C.COMPANIES, keyed_draw(text, "'company'", len(C.COMPANIES), salt))
    return (
        f"case {label} when 'PERSON' then concat({first}, ' ', {family}) "
        f"when 'ORGANIZATION' then {company} else {bracketed(label)} end"
    )


def same_format(text: str, salt: str) -> str:
    """Digits become digits, capitals capitals, other letters small letters; the rest stays."""
    ten = keyed_draw(text, "cast(place as string)", 10, salt)
    letter = keyed_draw(text, "cast(place as string)", 26, salt)
    # The usual characters are told by plain comparison, which is the first thing asked.
    digit = f"(c between '0' and '9' or c > '~' and {matches('c', DIGIT)})"
    capital = f"(c between 'A' and 'Z' or c > '~' and {matches('c', quoted_class('Lu'))})"
    small = f"(c between 'a' and 'z' or c > '~' and {matches('c', quoted_class('L'))})"
    surrogate = (
        f"case when {digit} then cast({ten} as string) when {capital} then char(65 + {letter}) "
        f"when {small} then char(97 + {letter}) else c end"
    )
    return f"array_join(transform({characters(text)}, (c, place) -> {surrogate}), '')"


def quoted_class(name: str) -> str:
    return rf"\p{{{name}}}"


def new_domain(text: str, salt: str) -> str:
    local = f"regexp_replace(substring_index({text}, '@', 1), '[a-zA-Z]', 'x')"
    domain = pick(C.DOMAINS, keyed_draw(text, "'domain'", len(C.DOMAINS), salt))
    changed = f"concat(regexp_replace({local}, '[0-9]', '0'), '@', {domain})"
    return f"if(contains({text}, '@'), {changed}, {text})"


def private_address(text: str, salt: str) -> str:
    third = keyed_draw(text, "'third'", 255, salt)
    fourth = keyed_draw(text, "'fourth'", 255, salt)
    return f"concat('192.168.', cast({third} as string), '.', cast({fourth} as string))"


def hashed(text: str) -> str:
    return f"substring(sha2({text}, 256), 1, 16)"


def encoded(text: str) -> str:
    """`ENC_` and the code point of each character in hex. Reversible, so not a protection."""
    code = let("lower(hex(ascii(c)))", "h", "if(length(h) < 2, concat('0', h), h)")
    each = f"array_join(transform({characters(text)}, c -> {code}), '')"
    # The bytes of ASCII text are its code points.
    return f"concat('ENC_', if(octet_length({text}) = length({text}), lower(hex({text})), {each}))"


def rewritten(
    text: str, label: str, strategy: str, preserve: str, realistic_names: str, salt: str
) -> str:
    """Replacement for one finding under its strategy."""
    return (
        f"case when {strategy} = 'mask' then {masked(text)} "
        f"when {strategy} = 'replace_realistic' and {realistic_names} "
        f"then {realistic(text, label, salt)} "
        f"when {strategy} = 'replace_format' and {preserve} then {same_format(text, salt)} "
        f"when {strategy} = 'replace_partial' then {partly_masked(text)} "
        f"when {strategy} = 'replace_domain' then {new_domain(text, salt)} "
        f"when {strategy} = 'replace_network' then {private_address(text, salt)} "
        f"when {strategy} = 'hash' then {hashed(text)} "
        f"when {strategy} = 'encrypt' then {encoded(text)} "
        f"else {bracketed(label)} end"
    )
