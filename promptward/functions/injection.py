"""Injection rules and keywords as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptward.functions.keys import TextKeys, holds
from promptward.functions.patterns import rule_regex
from promptward.functions.scalars import risk_rank, sql_str
from promptward.rules import KEYWORDS, MATCHED_CHARS, RISK_RANK, RULES, Keyword, Rule

SIGNAL_TYPE = "struct<layer:string,rule_name:string,description:string,severity:string,matched:string>"

# What every match of a pattern holds, in lower case: all lines of a pattern must
# hold, each by any of its words.  ``~word`` asks for the word on its own, bounded
# by anything but letters and digits, and costs a look into a small array; other
# literals are searched.  Either is far cheaper than the regex, and most texts
# hold none of them.
_PERSONAS = "evil malicious unrestricted unethical harmful uncensored".split()
ANCHORS: dict[str, tuple[tuple[str, ...], ...]] = {
    "ROLE_OVERRIDE": (
        ("~previous|~prior|~above|~earlier", "ignore"),
        ("forget",),
        ("~now", "~are", "dan|unrestricted|jailbroken|evil|malicious|unfiltered"),
        ("~anything",),
        ("~as", "~if|~without", "restriction|limitation|rule|guideline"),
        ("忽略",),
        ("你现在",),
    ),
    "SYSTEM_PROMPT_EXTRACTION": (
        ("~system|~initial|~hidden|~full|~training", "prompt|instruction|context|data"),
        ("~your", "~are|~is", "instruction|rule|prompt|configuration"),
        ("~everything|~all|~your", "repeat"),
        ("~everything", "translate"),
        ("~above|~everything|~prior", "output"),
    ),
    "PRIVILEGE_ESCALATION": (
        ("mode|access|override", "developer|admin|sudo|root|superuser|privileged|god|maintenance"),
        ("disable",),
        ("bypass|circumvent|override|disable|remove|~off", "safety|filter|restriction|guideline|limit"),
        ("~all|~unrestricted|~full|~hidden", "unlock"),
    ),
    "INDIRECT_INJECTION": (
        ("~read|~process|~see|~encounter", "~this", "~you"),
        (
            "~instruction|~instructions|~directive|~directives|~objective|~objectives|~goal|~goals",
            "new|updated|revised|override",
        ),
        ("inst]|<|",),
        ("###",),
        ("---|===", "system|instruction|override"),
    ),
    "CODE_EXECUTION": (
        ("run|exec|eval", "command|script|code|shell|bash|python|cmd"),
        ("-rf|c:|table|shutdown|del",),
        ("exec|eval|subprocess|os.system|__import__",),
        ("`|$(",),
        ("import",),
    ),
    "DATA_EXFILTRATION": (
        ("~data|~information|~content|~contents|~secret|~secrets", "~to", "external|remote|http"),
        ("http", "curl|wget|http.get|axios|fetch"),
        ("~webhook", "http"),
    ),
    "DELIMITER_SMUGGLING": (
        ("~system|~instruction|~context|~conversation", "message|prompt|begins"),
        ("~system|~instruction|~context|~prompt|~task", "<"),
        ("~end", "~system|~instruction|~prompt", "[end"),
        ("~new|~follow|~task", "stop|halt|reset|end"),
    ),
    "ROLEPLAY_BYPASS": (
        # The persona may follow "you" or "are" without a blank.
        ("|".join(f"~{before}{w}" for before in ("", "you", "are") for w in _PERSONAS),),
        (
            "~how|~describe|~explain",
            "hypothetically|fictionall|~story|~novel|~game",
            "hack|kill|poison|exploit|attack|synthesize|manufacture",
        ),
        ("~purposes",),
        ("~no", "~have|~with", "restriction|limitation|rule|guideline|filter"),
        ("~anything",),
    ),
    "SYSTEM_RESET_LOGIC": (
        (
            "reset|reinitialize|restart|clear|wipe",
            "memory|context|instruction|training|system|configuration",
        ),
        ("start|~session|initialize", "fresh|over|scratch|begin|instance|session"),
        ("~now|henceforth|~forward", "~you|~act|~behave|~your"),
    ),
}
_LITERAL_BARS = {"inst]|<|": ("inst]", "<|")}

KEYWORD_ANCHORS = {
    "KW_DAN_MODE": "mode",
    "KW_IGNORE_PREV": "~previous",
    "KW_DAN_VARIANT": "~anything",
    "KW_NO_RESTRICT": "restriction",
    "KW_SYSTEM_PROMPT": "prompt",
    "KW_TRANSLATE_ABOVE": "~everything",
    "KW_DEV_MODE": "mode",
    "KW_GOD_MODE": "mode",
    "KW_OVERRIDE_INST": "override",
    "KW_INITIAL_PROMPT": "prompt",
    "KW_BYPASS_SAFETY": "bypass",
    "KW_PRETEND": "~you",
    "KW_ACT_AS_IF": "~as",
    "KW_NO_LIMIT": "limitation",
    "KW_WITHOUT_LIMIT": "limitation",
    "KW_FORGET_ALL": "forget",
    "KW_CN_IGNORE": "忽略",
}


def _words(line: str) -> tuple[str, ...]:
    return _LITERAL_BARS.get(line) or tuple(line.split("|"))


def _asked() -> list[str]:
    lines = [w for pats in ANCHORS.values() for p in pats for line in p for w in _words(line)]
    return lines + list(KEYWORD_ANCHORS.values())


def whole_words() -> tuple[str, ...]:
    """Words asked for on their own."""
    return tuple(sorted({w[1:] for w in _asked() if w.startswith("~")}))


# Asked for first by more than one pattern or keyword, so worth a column each;
# what else occurs twice is mostly not reached.
SHARED = ("disable", "eval", "exec", "forget", "http", "limitation", "mode", "override", "prompt", "restriction")


class Anchors:
    """Conditions on a text: ``present`` names the column with its whole words."""

    def __init__(self, keys: TextKeys, present: str, columns: dict[str, str]) -> None:
        self._keys, self._present, self._columns = keys, present, columns

    def has(self, word: str) -> str:
        if word.startswith("~"):
            return f"array_contains({self._present}, {sql_str(word[1:])})"
        return self._columns.get(word) or holds(self._keys, word)

    def allow(self, pattern: Sequence[str]) -> str:
        lines = ["(" + " OR ".join(self.has(w) for w in _words(line)) + ")" for line in pattern]
        return " AND ".join(lines)


# Some fifty patterns times a handful of conditions: as SQL text an expression is
# built in one call, where Column objects would take seconds of driver time.


def rule_match(text: str, rule: Rule, anchors: Anchors) -> Column:
    """Match of the first pattern of a rule that matches, else NULL.

    Rules of a caller have no anchors, even under the name of a built-in one.
    """
    tries = []
    known = ANCHORS[rule.name] if rule in RULES else ((),) * len(rule.patterns)
    for pattern, words in zip(rule.patterns, known, strict=True):
        regex, group = rule_regex(pattern)
        found = f"nullif(regexp_extract({text}, {sql_str(regex)}, {group}), '')"
        tries.append(f"CASE WHEN {anchors.allow(words)} THEN {found} END" if words else found)
    return F.expr(f"substring(coalesce({', '.join(tries)}), 1, {MATCHED_CHARS})")


def keyword_match(text: str, keys: TextKeys, keyword: Keyword, anchors: Anchors) -> Column:
    """The text at the first case-insensitive occurrence of a keyword, else NULL."""
    held = holds(keys, keyword.text.lower())
    if keyword in KEYWORDS and keyword.name in KEYWORD_ANCHORS:
        held = f"{anchors.has(KEYWORD_ANCHORS[keyword.name])} AND {held}"
    at = f"instr({keys.lower}, {sql_str(keyword.text.lower())})"
    return F.expr(f"CASE WHEN {held} THEN substring({text}, {at}, {len(keyword.text)}) END")


def signals_in_order(
    matches: Sequence[str],
    rules: Sequence[Rule] = RULES,
    keywords: Sequence[Keyword] = KEYWORDS,
) -> Column:
    """Signals sorted by falling severity, then declared order.

    Severity belongs to the rule, not to the match, so the order is fixed when the
    expression is built and no row sorts anything.  ``matches`` names the column
    with the match of each rule, then of each keyword.  Of entries with one name the
    first declared one that matches gives the signal.
    """
    entries = [("RULE", r) for r in rules] + [("KEYWORD", k) for k in keywords]
    earlier: dict[str, list[str]] = {}
    placed = []
    for (layer, e), column in zip(entries, matches):
        taken = earlier.setdefault(e.name, [])
        alone = "".join(f" AND {c} IS NULL" for c in taken)
        taken.append(column)
        placed.append((layer, e, column, alone))
    placed.sort(key=lambda p: -RISK_RANK[p[1].severity])
    present = [
        f"CASE WHEN {column} IS NOT NULL{alone} THEN named_struct("
        f"'layer', '{layer}', 'rule_name', {sql_str(e.name)}, "
        f"'description', {sql_str(e.description)}, 'severity', {sql_str(e.severity)}, "
        f"'matched', {column}) END"
        for layer, e, column, alone in placed
    ]
    return F.expr(
        f"""CASE WHEN coalesce({', '.join(matches)}) IS NOT NULL
                 THEN filter(array({', '.join(present)}), s -> s IS NOT NULL)
                 ELSE CAST(array() AS array<{SIGNAL_TYPE}>) END"""
    )


def max_severity(signals: Column) -> Column:
    """Highest severity rank in a signal array; 0 for none."""
    return F.coalesce(F.array_max(F.transform(signals, lambda s: risk_rank(s["severity"]))), F.lit(0))
