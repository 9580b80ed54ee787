"""Fixed values. They decide results, so they are listed plainly and in one place."""

# Identifier patterns per label, in scan order. Matching ignores case.
SECURITY_PATTERNS = {
    "EMPLOYEE_ID": (
        r"\b(EMP|EMPLOYEE)[-_]?\d{4,8}\b",
        r"\bEMP\d{6}\b",
        r"\b[A-Z]{2,3}[-_]?\d{4,6}\b",
    ),
    "ACCESS_CARD": (
        r"\b(AC|ACCESS)[-_]?\d{4,8}\b",
        r"\bCARD[-_]?\d{4,8}\b",
        r"\b[A-Z]{2}[-_]\d{6}\b",
    ),
    "POLICY_NUMBER": (
        r"\b(POL|POLICY)[-_][A-Z0-9-]{6,15}\b",
        r"\bP\d{4}[-_]\d{3}\b",
        r"\bPOLICY[-_]\d{4}[-_]\d{3}\b",
    ),
    "SYSTEM_ID": (
        r"\b(SYS|SYSTEM)[-_][A-Z0-9-]{6,15}\b",
        r"\bSRV[-_]\d{3,6}\b",
        r"\bSERVER[-_][A-Z0-9]{4,8}\b",
    ),
    "BADGE_NUMBER": (
        r"\b(B|BADGE)[-_]?\d{4,8}\b",
        r"\bBDG\d{6}\b",
    ),
    "AUDIT_REF": (
        r"\b(AUD|AUDIT)[-_]\d{4}[-_][A-Z0-9-]{6,10}\b",
        r"\bAUDIT[-_]REF[-_][A-Z0-9]+\b",
    ),
    "CREDENTIAL_ID": (
        r"\b(CRED|CREDENTIAL)[-_]\d{6}[-_][A-Z]\b",
        r"\bCRED\d{8}\b",
    ),
    "ROOM_NUMBER": (
        r"\b(ROOM|RM)[-_]?\d{3}[A-Z]?\b",
        r"\b\d{3}[A-Z]?(?=\s*(room|office|door))\b",
    ),
    "IP_ADDRESS": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",),
    "MAC_ADDRESS": (r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",),
}

# Patterns of the combined security identifier, all scored alike.
SECURITY_ID_PATTERNS = (
    r"EMP\d{6}",
    r"AC-\d{6}",
    r"POL-[A-Z0-9-]+",
    r"B-\d{6}",
    r"SYS-[A-Z0-9-]+",
)
SECURITY_ID_SCORE = 0.8

# Fewest digits of a card number.
CARD_DIGITS = 13

# Our own patterns for the standard types, with their scores.
STANDARD_PATTERNS = {
    "EMAIL_ADDRESS": (r"\b[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}\b", 0.95),
    "PHONE_NUMBER": (r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b", 0.75),
    "CREDIT_CARD": (r"\b(?:\d{4}[ -]?){3}\d{1,4}\b", 0.9),
    "SSN": (r"\b\d{3}-\d{2}-\d{4}\b", 0.85),
    "URL": (r"\bhttps?://[^\s<>\x22\x27]+", 0.6),
}

# Scoring of pattern findings.
PATTERN_BASE = 0.8
PATTERN_LONG_CHARS = 8
PATTERN_LONG_BONUS = 0.1
PATTERN_SEPARATOR_BONUS = 0.05

# Words that support a finding, and the labels they support.
CONTEXT_WINDOW = 100
CONTEXT_KEYWORDS = {
    "personal": ("name", "address", "phone", "email", "personal", "identity"),
    "financial": ("card", "account", "bank", "payment", "credit", "ssn"),
    "corporate": ("employee", "staff", "worker", "id", "badge", "access"),
    "technical": ("ip", "address", "server", "system", "network", "mac"),
    "security": ("password", "credential", "key", "token", "auth", "login"),
}
CONTEXT_LABELS = {
    "personal": ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER"),
    "financial": ("CREDIT_CARD", "SSN"),
    "technical": ("IP_ADDRESS", "MAC_ADDRESS"),
}
CONTEXT_LABEL_PART = {"corporate": "EMPLOYEE"}
# 0.05 added n times in double arithmetic, never above 0.2.
CONTEXT_BOOST = (0.0, 0.05, 0.1, 0.15000000000000002, 0.2, 0.2, 0.2)

# Named-entity labels taken over, their names here, and sensitivity.
NER_LABELS = {
    "PERSON": "PERSON",
    "ORG": "ORGANIZATION",
    "GPE": "LOCATION",
    "DATE": "DATE",
    "TIME": "TIME",
    "MONEY": "FINANCIAL",
    "CARDINAL": "NUMBER",
    "ORDINAL": "NUMBER",
}
NER_SENSITIVE = ("PERSON", "ORG", "GPE", "MONEY")
NER_THRESHOLD = 0.7
TRANSFORMER_LABELS = {
    "PER": "PERSON",
    "PERSON": "PERSON",
    "ORG": "ORGANIZATION",
    "LOC": "LOCATION",
    "MISC": "MISCELLANEOUS",
}
TRANSFORMER_SENSITIVE = ("PER", "PERSON", "ORG", "ORGANIZATION")
TRANSFORMER_THRESHOLD = 0.8

# Engine keys in the order they run, and the name each writes into findings.
ENGINES = ("presidio", "spacy", "transformers", "custom_patterns")
ENGINE_NAMES = {
    "presidio": "presidio",
    "spacy": "spacy",
    "transformers": "transformer",
    "custom_patterns": "custom_patterns",
}
DETECTION_THRESHOLD = 0.7
DOCUMENT_THRESHOLD = 0.8
DOCUMENT_ENGINES = ("presidio", "spacy", "custom_patterns")

# Catalogue of entity types.
STANDARD_ENTITIES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD",
    "SSN", "IP_ADDRESS", "URL", "ORGANIZATION", "LOCATION",
    "DATE", "TIME", "FINANCIAL",
)
SECURITY_ENTITIES = (
    "EMPLOYEE_ID", "ACCESS_CARD", "POLICY_NUMBER", "SYSTEM_ID",
    "BADGE_NUMBER", "AUDIT_REF", "CREDENTIAL_ID", "ROOM_NUMBER",
    "MAC_ADDRESS",
)
# The configured allow-list of entity types.
DECLARED_ENTITY_TYPES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "SSN", "IP_ADDRESS", "URL",
    "EMPLOYEE_ID", "ACCESS_CARD", "POLICY_NUMBER", "SYSTEM_ID", "BADGE_NUMBER", "AUDIT_REF",
    "CREDENTIAL_ID", "ROOM_NUMBER", "MAC_ADDRESS",
)

# Rewriting strategy per label; anything else is replaced by its label.
DEFAULT_STRATEGIES = {
    "PERSON": "replace_realistic",
    "EMAIL_ADDRESS": "replace_domain",
    "PHONE_NUMBER": "replace_format",
    "CREDIT_CARD": "replace_partial",
    "SSN": "replace_format",
    "IP_ADDRESS": "replace_network",
    "EMPLOYEE_ID": "replace_format",
    "ACCESS_CARD": "replace_format",
    "POLICY_NUMBER": "replace_format",
    "SYSTEM_ID": "replace_format",
    "BADGE_NUMBER": "replace_format",
}
# The configured variant of the strategies.
DECLARED_STRATEGIES = {
    "PERSON": "replace_realistic",
    "EMAIL_ADDRESS": "replace_domain",
    "PHONE_NUMBER": "replace_format",
    "CREDIT_CARD": "replace_partial",
    "SSN": "mask",
    "IP_ADDRESS": "replace_network",
    "EMPLOYEE_ID": "replace_format",
}
FALLBACK_STRATEGY = "replace"

# Surrogates.
FIRST_NAMES = ("John", "Jane", "Michael", "Sarah", "David", "Emily", "Robert", "Lisa")
LAST_NAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis")
DOMAINS = ("example.com", "sample.org", "test.net", "demo.co")
COMPANIES = ("ACME Corp", "Global Industries", "Tech Solutions", "Business Systems")

# OCR rules.
OCR_THRESHOLD = 0.7
OCR_FALLBACK_CONFIDENCE = 0.8
OCR_FALLBACK_CHARS = 50
OCR_LINE_PIXELS = 20

# Logo classes (id, name, category, sensitive).
LOGO_CLASSES = (
    (0, "microsoft", "tech", True),
    (1, "google", "tech", True),
    (2, "apple", "tech", True),
    (3, "amazon", "tech", True),
    (4, "facebook", "social", True),
    (5, "twitter", "social", True),
    (6, "linkedin", "social", True),
    (7, "generic_company", "business", True),
    (8, "government_seal", "government", True),
    (9, "bank_logo", "financial", True),
)
LOGO_THRESHOLD = 0.6
LOGO_IOU = 0.5
LOGO_MAX_DETECTIONS = 100
LOGO_REMOVAL_CONFIDENCE = 0.7
LOGO_METHODS = ("inpaint", "blur", "pixelate", "black_box", "replace")
LOGO_METHOD_FALLBACK = "black_box"
LOGO_PADDING = {"inpaint": 5, "replace": 20}
REGION_METHODS = ("blur", "pixelate", "black_box", "white_box")
REGION_METHOD_FALLBACK = "blur"

# Intake limits.
MAX_TEXT_CHARS = 1_000_000
MAX_FILE_BYTES = 52_428_800
MAX_BATCH = 20
ALLOWED_MIME = ("image/jpeg", "image/png", "image/tiff", "image/bmp")
ALLOWED_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "bmp")

# Request options and their defaults.
OPTION_DEFAULTS = {
    "ocr_confidence": 0.7,
    "pii_confidence": 0.8,
    "logo_confidence": 0.6,
    "pii_engines": DOCUMENT_ENGINES,
    "logo_removal_method": "inpaint",
    "preserve_format": True,
    "realistic_replacements": True,
}
