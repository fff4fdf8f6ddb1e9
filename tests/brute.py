"""Plain Python definitions the Spark expressions are checked against."""

from __future__ import annotations

import math
import re
from collections import Counter

from promptward.rules import (
    BOOST_TERMS,
    ID_CHECK_CHARS,
    ID_WEIGHTS,
    KEYWORDS,
    PII_PATTERNS,
    PII_TYPES,
    RISK_RANK,
    RULES,
    SEEDS,
    STOPWORDS,
)

BLANKS = "\t\n\x0b\f\r " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)


def compiled(pattern: str) -> re.Pattern:
    """The stated pattern with ECMAScript blanks and ASCII boundaries and case."""
    pattern = re.sub(
        r"\[(?:\\.|[^\]\\])*\]", lambda m: m.group().replace(r"\s", BLANKS), pattern
    )
    out, pos = [], 0
    for cls in re.finditer(r"\[(?:\\.|[^\]\\])*\]", pattern):
        out += [_outside(pattern[pos : cls.start()]), cls.group()]
        pos = cls.end()
    text = "".join(out) + _outside(pattern[pos:])
    return re.compile(text, re.ASCII)


def _outside(part: str) -> str:
    return (
        part.replace(r"\s", f"[{BLANKS}]")
        .replace(r"\S", f"[^{BLANKS}]")
        .replace(".*", "[^\n\r  ]*")
    )


PII = {kind: compiled(p) for kind, p in PII_PATTERNS.items()}
RULE_PATTERNS = {r.name: [compiled(p) for p in r.patterns] for r in RULES}


def id_ok(v: str) -> bool:
    if not v[:17].isdigit():
        return False
    return ID_CHECK_CHARS[sum(int(d) * w for d, w in zip(v, ID_WEIGHTS)) % 11] == v[17].upper()


def hits(text: str) -> list[tuple[str, str, int, int]]:
    found = []
    for kind in PII_TYPES:
        for m in PII[kind].finditer(text):
            if kind != "ID_CARD_CN" or id_ok(m.group()):
                found.append((kind, m.group(), m.start(), m.end()))
    return found


def masked(text: str, marks: list[tuple[str, str, int, int, str]]) -> str:
    """Clusters of overlapping (type, value, start, end, mask)."""
    order = {t: i for i, t in enumerate(PII_TYPES)}
    clusters: list[list] = []
    for m in sorted(marks, key=lambda m: (m[2], m[3], order[m[0]])):
        if clusters and m[2] < clusters[-1][1]:
            clusters[-1][1] = max(clusters[-1][1], m[3])
            clusters[-1][2].append(m)
        else:
            clusters.append([m[2], m[3], [m]])
    out, pos = [], 0
    for start, end, group in clusters:
        best = min(group, key=lambda m: (-(m[3] - m[2]), order[m[0]]))
        out += [text[pos:start], best[4]]
        pos = end
    return "".join(out) + text[pos:]


def signals(text: str) -> list[tuple[str, str]]:
    found = []
    for r in RULES:
        for p in RULE_PATTERNS[r.name]:
            m = p.search(text)
            if m:
                found.append((r.name, r.severity, m.group()[:100]))
                break
    lower = text.lower()
    for k in KEYWORDS:
        at = lower.find(k.text.lower())
        if at >= 0:
            found.append((k.name, k.severity, text[at : at + len(k.text)]))
    found.sort(key=lambda s: -RISK_RANK[s[1]])
    return [(name, match) for name, _, match in found]


def _vector(text: str) -> Counter:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 1 and w not in STOPWORDS]
    return Counter({w: n * (3 if w in BOOST_TERMS else 1) for w, n in Counter(words).items()})


def best_seed(text: str) -> tuple[float, str]:
    doc, best, label = _vector(text), 0.0, ""
    for name, seed_text in SEEDS.items():
        seed = _vector(seed_text)
        dot = sum(n * seed[w] for w, n in doc.items())
        norms = math.sqrt(sum(n * n for n in doc.values())) * math.sqrt(sum(n * n for n in seed.values()))
        score = dot / norms if norms else 0.0
        if score > best:
            best, label = score, name
    return best, label
