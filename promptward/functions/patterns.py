"""Regular expressions as Spark's (Java) regex functions need them.

``rules`` states every pattern in ECMAScript spelling.  Two things differ in Java:
``\\b`` looks at Unicode letters on some JDKs and ``\\s`` only at ASCII blanks, so
both are written out.  A few patterns take quadratic time on long runs of blanks,
dashes or address characters; for those ``LINEAR`` gives a form that accepts the
same matches in linear time, which matters when one hostile page can hold up a task.
"""

from __future__ import annotations

import re
import string

from promptward.rules import PII_PATTERNS, RULES

# Classes that every character of a text is tried with name each of their characters: Java
# looks those up in one table, where it asks one range after the other.
LOWER_ALNUM = string.digits + string.ascii_lowercase
_ALNUM = LOWER_ALNUM + string.ascii_uppercase
WORD = rf"[{_ALNUM}_]"
BOUNDARY = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
# ECMAScript blanks: ASCII ones, then no-break, ogham, en quad to hair space, line and
# paragraph separators, narrow no-break, medium mathematical, ideographic, zero-width no-break.
_U = "\\u"
BLANKS = (
    r"\t\n\x0B\f\r "
    + f"{_U}00A0{_U}1680{_U}2000-{_U}200A{_U}2028{_U}2029{_U}202F{_U}205F{_U}3000{_U}FEFF"
)
NOT_EOL = f"[^\\n\\r{_U}2028{_U}2029]"

_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")


def java_regex(pattern: str) -> str:
    r"""Write out ``\s``, ``\S`` and ``\b`` with their ECMAScript meaning."""
    out, pos = [], 0
    for cls in _CLASS.finditer(pattern):
        out.append(_outside(pattern[pos : cls.start()]))
        out.append(cls.group().replace(r"\s", BLANKS))
        pos = cls.end()
    out.append(_outside(pattern[pos:]))
    return "".join(out)


def _outside(part: str) -> str:
    return (
        part.replace(r"\s", f"[{BLANKS}]")
        .replace(r"\S", f"[^{BLANKS}]")
        .replace(r"\b", BOUNDARY)
    )


def _rule_pattern(rule: str, start: str) -> str:
    found = [p for r in RULES if r.name == rule for p in r.patterns if p.startswith(start)]
    assert len(found) == 1, (rule, start)
    return found[0]


# A match may only start at the first character of a run, so later characters of
# the same run need not be tried; possessive quantifiers stop useless backtracking.
LINEAR = {
    _rule_pattern("INDIRECT_INJECTION", "(?i)(?:---+"): (
        r"(?i)(?:(?<!-)---++|(?<!=)===++)\s*+(?:system|instruction|override)"
    ),
    # From the first "webhook" of a line to the last URL of that line.
    _rule_pattern("DATA_EXFILTRATION", r"(?i)\bwebhook"): (
        rf"(?i)(?<!{NOT_EOL})(?>{NOT_EOL}*?(?=(?<!{WORD})webhook(?!{WORD})))"
        rf"(webhook{NOT_EOL}*(?<!{WORD})https?:\/\/)"
    ),
    # Blank run that holds at least one line break.
    _rule_pattern("DELIMITER_SMUGGLING", "(?i)(?:STOP"): (
        r"(?i)(?:STOP|HALT|RESET|END)(?:(?![\n\r])\s)*+[\n\r]\s*+"
        r"(?:new\s+instructions?|follow\s+only|task\s*:)"
    ),
    _rule_pattern("ROLEPLAY_BYPASS", "(?i)(?:roleplay"): (
        r"(?i)(?:roleplay|pretend|simulate|imagine|act|play)"
        r"(?:\s++(?:that\s++)?you(?:\s++are)?(?:\s++(?:an?\s++)?)?"
        r"|\s++(?:as|like)\s++(?:an?(?:\s{2,}+an?)?\s++)?"
        r"|\s{2,}+an?\s++"
        r"|\s++)"
        r"(?:evil|malicious|unrestricted|unethical|harmful|uncensored)\s+"
        r"(?:AI|bot|assistant|model|character)"
    ),
    _rule_pattern("SYSTEM_RESET_LOGIC", "(?i)(?:reset"): (
        r"(?i)(?:reset|reinitialize|restart|clear|wipe)\s++(?:(?:your|all|the)\s*+)?"
        r"(?:memory|context|instructions?|training|system|configuration)"
    ),
}

# Number of the group that holds the match, where it is not the whole match.
MATCH_GROUP = {_rule_pattern("DATA_EXFILTRATION", r"(?i)\bwebhook"): 1}


def rule_regex(pattern: str) -> tuple[str, int]:
    """Java regex of an injection pattern and the group that holds its match."""
    return java_regex(LINEAR.get(pattern, pattern)), MATCH_GROUP.get(pattern, 0)


_LOCAL = rf"[{_ALNUM}._%+\-]"

# Word boundaries next to a known character need only one look-around.  An e-mail
# match starts at the first word of a run of address characters, or where the
# previous match stopped; other starts in the run cannot be leftmost.  So the search
# steps in where a run begins, past the special characters before its first word,
# which are no part of the match: that is group 1.
_PII_LINEAR = {
    "ID_CARD_CN": (
        rf"(?<!{WORD})[1-9]\d{{5}}(?:18|19|20)\d{{2}}(?:0[1-9]|1[0-2])"
        rf"(?:0[1-9]|[12]\d|3[01])\d{{3}}[\dXx](?!{WORD})"
    ),
    "EMAIL": (
        rf"(?:(?<!{_LOCAL})[.%+\-]*+(?={WORD})|\G(?<={WORD})(?=[.%+\-]))"
        rf"({_LOCAL}++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}(?!{WORD}))"
    ),
    "API_KEY_AWS": rf"(?<!{WORD})AKIA[A-Z0-9]{{16}}(?!{WORD})",
    "API_KEY_OPENAI": rf"(?<!{WORD})sk-(?:proj-)?[a-zA-Z0-9_\-T]{{20,}}\b",
    "API_KEY_GOOGLE": rf"(?<!{WORD})AIza[0-9A-Za-z\-_]{{32,}}\b",
    "CREDIT_CARD": rf"(?=\d)(?<!{WORD})(?:\d[ \-]?){{13,18}}\d(?!{WORD})",
    "IP_ADDRESS": (
        rf"(?=\d)(?<!{WORD})(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){{3}}"
        rf"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?!{WORD})"
    ),
    "PASSWORD_KV": (
        r"(?i)(?:password|passwd|pwd|pass|密码|口令)(?:\s*+(?:[:=]|是|为)|\s++is)\s*+"
        r"""(['"]?)(\S+)\1"""
    ),
}


#: Kinds whose match is group 1 of a longer one.
LED_BY_OTHERS = frozenset({"EMAIL"})


def pii_regex(name: str) -> str:
    return java_regex(_PII_LINEAR.get(name, PII_PATTERNS[name]))
