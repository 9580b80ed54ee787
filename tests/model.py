"""Plain-Python models the operators are compared with."""

import re

from palimpsest.functions import constants as C


def pattern_score(text):
    score = 0.8
    if len(text) > 8:
        score += 0.1
    if "-" in text or "_" in text:
        score += 0.05
    return min(score, 1.0)


def scan(text):
    """(rule_no, label, start, end, text, confidence) of all identifier patterns."""
    out, number = [], 0
    for label, patterns in C.SECURITY_PATTERNS.items():
        for pattern in patterns:
            for m in re.finditer(pattern, text, re.IGNORECASE):
                out.append((number, label, m.start(), m.end(), m.group(), pattern_score(m.group())))
            number += 1
    return out


def boost(text, label, start, end):
    near = text[max(0, start - 100) : min(len(text), end + 100)].lower()
    category = None
    for name, labels in C.CONTEXT_LABELS.items():
        if label in labels:
            category = name
    if "EMPLOYEE" in label:
        category = "corporate"
    total = 0.0
    for word in C.CONTEXT_KEYWORDS[category] if category else ():
        if word in near:
            total += 0.05
    return min(total, 0.2)


def merge(spans):
    """Winners among (start, end, confidence, ...) in arrival order."""
    kept = []
    for new in sorted(spans, key=lambda s: s[0]):
        if not kept or new[0] >= kept[-1][1]:
            kept.append(new)
            continue
        old = kept[-1]
        longer = new[1] - new[0] > old[1] - old[0]
        if new[2] > old[2] or (new[2] == old[2] and longer):
            kept[-1] = new
    return kept


def page_text(tokens):
    """Text of (y1, x1, y2, text) tokens in combined order."""
    lines, line, y = [], [], -1
    for t in sorted(tokens, key=lambda t: (t[0], t[1])):
        center = (t[0] + t[2]) // 2
        if y == -1 or abs(center - y) <= 20:
            line.append(t)
        else:
            lines.append(line)
            line = [t]
        y = center
    if line:
        lines.append(line)
    return "\n".join(" ".join(t[3] for t in sorted(part, key=lambda t: t[1])) for part in lines)


def iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def suppress(boxes, limit=0.5):
    """Kept (seq, confidence, box) rows of one group."""
    kept = []
    for row in sorted(boxes, key=lambda r: (-r[1], r[0])):
        if all(iou(k[2], row[2]) <= limit for k in kept):
            kept.append(row)
    return kept
