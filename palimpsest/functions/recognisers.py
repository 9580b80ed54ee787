"""Recognisers: a pattern, the label it writes, its score rule and a cheap gate."""

from __future__ import annotations

from dataclasses import dataclass

from palimpsest.functions import constants as C

# Case-blind with Unicode classes and word boundaries.
FLAGS = "(?iU)"

# A gate is a cheap test that every match of the pattern passes. A text that fails the gate
# is not scanned with the pattern. Most texts fail all gates, so one test stands for many scans.
# Each gate looks for its rarest character first and checks what precedes it afterwards.
LETTER_THEN_DIGITS = FLAGS + r"\d{3}(?<=[A-Z][-_]?\d{3})"
NAMED_PREFIX = FLAGS + r"[-_](?<=(?:POL|POLICY|SYS|SYSTEM|SERVER|AUDIT)[-_])"
DIGITS_BEFORE_PLACE = FLAGS + r"\d{3}[A-Z]?\s*(?:room|office|door)"
LETTERS_BEFORE_DIGITS = FLAGS + r"[-_](?<=[A-Z]{2}[-_])\d{6}"
DOTTED_DIGITS = r"\.(?<=[0-9]\.)[0-9]{1,3}\.[0-9]"
HEX_PAIRS = r"[:-](?<=[0-9A-Fa-f]{2}[:-])[0-9A-Fa-f]{2}[:-]"

_GATES = {
    ("POLICY_NUMBER", 0): NAMED_PREFIX,
    ("SYSTEM_ID", 0): NAMED_PREFIX,
    ("SYSTEM_ID", 2): NAMED_PREFIX,
    ("AUDIT_REF", 1): NAMED_PREFIX,
    ("ROOM_NUMBER", 1): DIGITS_BEFORE_PLACE,
    ("IP_ADDRESS", 0): DOTTED_DIGITS,
    ("MAC_ADDRESS", 0): HEX_PAIRS,
    ("ACCESS_CARD", 2): LETTERS_BEFORE_DIGITS,
}


# What stands where a match can start. It is quicker to test than the pattern's own start, and every match passes it.
_LETTER = r"[A-Za-zſıİ\u212A]"
_STARTS = {
    ("EMPLOYEE_ID", 2): rf"(?<![A-Za-z0-9])(?={_LETTER}{{2,3}}[-_\p{{Nd}}])",
    ("ACCESS_CARD", 2): rf"(?<![A-Za-z0-9])(?={_LETTER}{{2}}[-_])",
    "EMPLOYEE_ID": "(?=[Ee])",
    ("ACCESS_CARD", 0): "(?=[Aa])",
    ("ACCESS_CARD", 1): "(?=[Cc])",
    "POLICY_NUMBER": "(?=[Pp])",
    "SYSTEM_ID": "(?=[Ssſ])",
    "BADGE_NUMBER": "(?=[Bb])",
    "AUDIT_REF": "(?=[Aa])",
    "CREDENTIAL_ID": "(?=[Cc])",
    ("ROOM_NUMBER", 0): "(?=[Rr])",
}

# A test before the gate: the marks of a text with a match (see `scan.marks`) hold one of these pieces.
_AFTER_NAME = ("0", "-0", "_0")
_PIECES = {
    ("EMPLOYEE_ID", 0): tuple(name + after for name in ("EMP", "EMPLOYEE") for after in _AFTER_NAME),
    ("EMPLOYEE_ID", 1): ("EMP0",),
    ("ACCESS_CARD", 0): tuple(name + after for name in ("AC", "ACCESS") for after in _AFTER_NAME),
    ("ACCESS_CARD", 1): ("CARD0", "CARD-0", "CARD_0"),
    ("POLICY_NUMBER", 0): ("POL-", "POL_", "POLICY-", "POLICY_"),
    ("POLICY_NUMBER", 1): ("P0-0", "P0_0"),
    ("POLICY_NUMBER", 2): ("POLICY-0", "POLICY_0"),
    ("SYSTEM_ID", 0): ("SYS-", "SYS_", "SYSTEM-", "SYSTEM_"),
    ("SYSTEM_ID", 1): ("SRV-0", "SRV_0"),
    ("SYSTEM_ID", 2): ("SERVER-", "SERVER_"),
    ("BADGE_NUMBER", 0): tuple(name + after for name in ("B", "BADGE") for after in _AFTER_NAME),
    ("BADGE_NUMBER", 1): ("BDG0",),
    ("AUDIT_REF", 0): ("AUD-0", "AUD_0", "AUDIT-0", "AUDIT_0"),
    ("AUDIT_REF", 1): ("AUDIT-REF", "AUDIT_REF"),
    ("CREDENTIAL_ID", 0): ("CRED-0", "CRED_0", "CREDENTIAL-0", "CREDENTIAL_0"),
    ("CREDENTIAL_ID", 1): ("CRED0",),
    ("ROOM_NUMBER", 0): tuple(name + after for name in ("ROOM", "RM") for after in _AFTER_NAME),
    ("IP_ADDRESS", 0): ("0.0",),
}
# Up to so many digits are one 0 among the marks, so a card number without gaps is two.
MARK_DIGITS = 12
_STANDARD_PIECES = {
    "EMAIL_ADDRESS": ("@",),
    "PHONE_NUMBER": ("0-0", "0 0", "0.0"),
    "CREDIT_CARD": ("00", "0-0", "0 0"),
    "SSN": ("0-0-0",),
    "URL": ("://",),
}


# Where a long text may be cut: behind a blank before a word, or at a line's start. No pattern of ours goes on from a blank into a letter, none holds a
# line end, and what rooms are looked for by behind blanks (room, office, door) starts with neither.
_NOT_PLACE = "RODrod"
CUT = rf"(?:[ \t\r\n](?=[A-Za-z&&[^{_NOT_PLACE}]])|\n(?=(?U:[^\s{_NOT_PLACE}])))"


@dataclass(frozen=True)
class Recogniser:
    """One pattern of one engine. `score` None means the length and separator rule."""

    label: str
    pattern: str
    engine: str = "custom_patterns"
    score: float | None = None
    gate: str | None = None
    luhn: bool = False
    pieces: tuple[str, ...] = ()
    start: str = ""
    # No match holds, or depends on, a word of letters alone that stands between blanks (see `scan.brief`).
    wordless: bool = False
    # No match holds, or depends on, what stands on the other side of a place that CUT ends at.
    parted: bool = False

    @property
    def regex(self) -> str:
        return self.start + FLAGS + self.pattern


def security_recognisers(labels: tuple[str, ...] | None = None) -> list[Recogniser]:
    """The identifier patterns, all or those of some labels."""
    return [
        Recogniser(
            label,
            pattern,
            gate=_GATES.get((label, i), LETTER_THEN_DIGITS),
            pieces=_PIECES.get((label, i), ()),
            start=_STARTS.get((label, i), _STARTS.get(label, "")),
            wordless=(label, i) != ("ROOM_NUMBER", 1),
            parted=True,
        )
        for label, patterns in C.SECURITY_PATTERNS.items()
        if labels is None or label in labels
        for i, pattern in enumerate(patterns)
    ]


def security_id_recognisers() -> list[Recogniser]:
    """The combined security identifier of the analyzer engine."""
    policy, system = FLAGS + "-(?<=POL-)", FLAGS + "-(?<=SYS-)"
    gates = (LETTER_THEN_DIGITS, LETTER_THEN_DIGITS, policy, LETTER_THEN_DIGITS, system)
    pieces = ("EMP0", "AC-0", "POL-", "B-0", "SYS-")
    starts = ("(?=[Ee])", "(?=[Aa])", "(?=[Pp])", "(?=[Bb])", "(?=[Ssſ])")
    return [
        Recogniser("SECURITY_ID", p, engine="presidio", score=C.SECURITY_ID_SCORE, gate=g, pieces=(piece,), start=start, wordless=True, parted=True)
        for p, g, piece, start in zip(C.SECURITY_ID_PATTERNS, gates, pieces, starts, strict=True)
    ]


def standard_recognisers() -> list[Recogniser]:
    """E-mail, phone, card, social security number and URL, under the analyzer engine."""
    gates = {
        "EMAIL_ADDRESS": "@",
        "PHONE_NUMBER": r"(?U)\d{3}[ .-]\d{4}",
        "CREDIT_CARD": r"(?U)\d{4}[ -]?\d{4}[ -]?\d{4}",
        "SSN": r"(?U)\d{3}-\d{2}-\d{4}",
        "URL": "://",
    }
    return [
        Recogniser(
            label,
            pattern,
            engine="presidio",
            score=score,
            gate=gates[label],
            luhn=label == "CREDIT_CARD",
            pieces=_STANDARD_PIECES[label],
            wordless=True,
            parted=True,
        )
        for label, (pattern, score) in C.STANDARD_PATTERNS.items()
    ]
