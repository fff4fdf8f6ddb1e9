"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from broad patterns.  Labelers vote on each (yes, no, or
nothing): the strict pattern, a check of the format, a gazetteer of known endings,
codes and key names, words of the context before it, and a look at its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is for either truth, without any labelled data, and gives every pattern a
probability.  With these as soft labels a naive Bayes classifier over features of
the span is trained, which decides about each candidate.  The number of vote
patterns and of feature values is fixed, so what reaches the driver is bounded
whatever the corpus.  Spans of the strict patterns always stay.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import exp, log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.functions.arrays import emitting_fold
from promptward.functions.fence import fence
from promptward.llm.common import text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Characters of context before a candidate.
CONTEXT = 40
ROUNDS = 30
THRESHOLD = 0.5

# The strict patterns, written so that a failed start costs no second look at the
# same run of characters; they match the same spans as the plain ones.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates; ``secret`` has no strict pattern.
BROAD = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9])(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey)[\x22']?[\x20]{0,3}[:=][\x20]{0,3}[\x22']?[^\s\x22']{6,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
}
#: Cheap conditions that hold wherever a pattern can match.
_GUARD = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9][.][0-9]'",
    "card": "text rlike '[0-9]'",
    "phone": "contains(text, '+')",
    "broad_email": "text rlike '[\\\\[(]at[\\\\])]'",
    "broad_phone": "text rlike '[0-9]{3}[ .-][0-9]{4}'",
    "broad_secret": "contains(text, '=') or contains(text, ':') or contains(text, 'AKIA')",
}

# Gazetteers and context words (own lists).
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "86", "81", "91", "61", "55", "52")
CARD_LEADS = ("3", "4", "5", "6")
CUES = {
    "email": "mail|contact|write|e-mail|correo|courriel",
    "ip": "ip|host|server|address|addr|from",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|contact|anruf",
    "secret": "login|key|auth|credential|config|export",
}
COUNTER_CUES = "version|page|isbn|figure|chapter|section|item no|order no"

_TYPE = "struct<kind:string,start:int,end:int,value:string,left:string,strict:boolean>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _octets_ok(value: Column) -> Column:
    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(value, "[.]"), fits)


def _strict_ok(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": _octets_ok(value),
        "card": F.when(n.between(12, 19), luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


def _with_candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id and ``spans``: all candidates of each text, strict ones marked."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    patterns = {k: (k, p) for k, p in STRICT.items()} | {f"broad_{k}": (k, p) for k, p in BROAD.items()}
    none = F.array().cast("array<string>")
    for name, (_, p) in patterns.items():
        found = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        df = df.withColumn(f"m_{name}", F.when(F.expr(_GUARD[name]), found).otherwise(none))
    df = fence(df, [f"m_{n}" for n in patterns])
    for name, (_, p) in patterns.items():
        df = df.withColumn(f"p_{name}", F.when(F.size(f"m_{name}") > 0, F.split("text", p, -1)).otherwise(none))
    df = fence(df, [f"p_{n}" for n in patterns]).drop("text")

    def placed(name: str, kind: str) -> Column:
        gaps = F.col(f"p_{name}")
        items = F.transform(
            f"m_{name}",
            lambda m, i: F.struct(
                F.length(F.get(gaps, i)).alias("gap"), m.alias("value"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left")
            ),
        )

        def step(end: Column, item: Column) -> tuple[Column, Column]:
            start = end + item["gap"]
            stop = start + F.length(item["value"])
            strict = _strict_ok(kind, item["value"]) if not name.startswith("broad_") else F.lit(False)
            span = F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), stop.alias("end"), item["value"].alias("value"),
                item["left"].alias("left"), strict.alias("strict"),
            )
            return stop, F.array(span)

        folded = emitting_fold(items, F.lit(0), _TYPE, step)["out"]
        return F.when(F.size(f"m_{name}") > 0, folded).otherwise(F.array().cast(f"array<{_TYPE}>"))

    return df.select("id", F.concat(*[placed(n, k) for n, (k, _) in patterns.items()]).alias("spans"))


# --- labelers -----------------------------------------------------------------

LABELERS = ("pattern", "check", "gazetteer", "context", "shape")
YES, NO, NONE = 1, 0, -1


def _by_kind(kind: Column, votes: dict[str, Column]) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, votes[k]).otherwise(rest), votes, F.lit(NONE))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(YES))
    return out.when(no, F.lit(NO)).otherwise(NONE) if no is not None else out.otherwise(NONE)


def votes(span: Column) -> dict[str, Column]:
    """One column per labeler: 1 yes, 0 no, -1 no vote."""
    kind, value, left = span["kind"], span["value"], F.lower(span["left"])
    digits = _digits(value)
    n = F.length(digits)
    secret = F.regexp_extract(value, r"([^\s\x22'=:]+)$", 1)
    mixed = secret.rlike("[A-Za-z]") & secret.rlike("[0-9]")
    card_sum = F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    end_of_domain = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    code = F.lit(False)
    for c in CALLING_CODES:
        code = code | value.startswith(f"+{c}")
    return {
        "pattern": _vote(span["strict"] | ((kind == "secret") & (F.length(value) >= 12))),
        "check": _by_kind(
            kind,
            {
                "email": _vote(end_of_domain.rlike("^[a-z]{2,}$"), ~end_of_domain.rlike("^[a-z]{2,}$")),
                "ip": _vote(_octets_ok(value), ~_octets_ok(value)),
                "card": _vote(card_sum, ~card_sum),
                "phone": _vote(n.between(9, 15), ~n.between(9, 15)),
                "secret": _vote(mixed, ~mixed),
            },
        ),
        "gazetteer": _by_kind(
            kind,
            {
                "email": _vote(end_of_domain.isin(*DOMAIN_ENDS), ~end_of_domain.isin(*DOMAIN_ENDS)),
                "ip": _vote(~value.rlike("^0*(?:0|127)[.]"), value.rlike("^0*(?:0|127)[.]")),
                "card": _vote(F.substring(digits, 1, 1).isin(*CARD_LEADS), ~F.substring(digits, 1, 1).isin(*CARD_LEADS)),
                "phone": _vote(code),
                "secret": _vote(value.rlike("(?i)^(?:pass|pwd|token|secret|api|AKIA)")),
            },
        ),
        "context": _by_kind(
            kind, {k: _vote(left.rlike(rf"\b(?:{cue})\b"), left.rlike(COUNTER_CUES)) for k, cue in CUES.items()}
        ),
        "shape": _vote(
            F.lit(False), value.rlike(r"([0-9A-Za-z])\1{6,}") | ((kind == "card") & (n < 12)) | ((kind == "ip") & (F.length(value) > 15))
        ),
    }


def features(span: Column) -> dict[str, Column]:
    """Small numbers that describe a span; each takes a few values."""
    value, left = span["value"], span["left"]
    n, digits = F.length(value), F.length(_digits(value))
    return {
        "length": F.least(F.floor(F.log2(n + 1)), F.lit(9)).cast("int"),
        "digits": F.least(digits, F.lit(20)).cast("int"),
        "share": F.floor(4 * digits / n).cast("int"),
        "separators": F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(8)).cast("int"),
        "before": F.when(left == "", 0).when(left.rlike(r"\s$"), 1).when(left.rlike("[A-Za-z0-9]$"), 2).otherwise(3),
        "check": votes(span)["check"],
    }


def estimate(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes) to be personal data, by expectation-maximisation.

    Labelers are independent given the truth; a vote of each labeler has its own
    probability under either truth.  The start is the share of yes votes.
    """
    p = {}
    for kind, pattern, _ in counts:
        cast = [v for v in pattern if v != NONE]
        p[kind, pattern] = (0.5 + sum(cast)) / (1 + len(cast))
    for _ in range(ROUNDS):
        prior: dict[str, list[float]] = {}
        table = {(k, v, y): 1.0 for k in range(len(LABELERS)) for v in (YES, NO, NONE) for y in (0, 1)}
        for kind, pattern, n in counts:
            yes = p[kind, pattern]
            totals = prior.setdefault(kind, [1.0, 1.0])
            for y, share in ((1, yes), (0, 1 - yes)):
                totals[y] += n * share
                for k, v in enumerate(pattern):
                    table[k, v, y] += n * share
        for k, y in product(range(len(LABELERS)), (0, 1)):
            total = sum(table[k, v, y] for v in (YES, NO, NONE))
            for v in (YES, NO, NONE):
                table[k, v, y] /= total
        for kind, pattern, _ in counts:
            logit = log(prior[kind][1] / prior[kind][0])
            logit += sum(log(table[k, v, 1] / table[k, v, 0]) for k, v in enumerate(pattern))
            p[kind, pattern] = 1 / (1 + exp(-max(-30.0, min(30.0, logit))))
    return p


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,double>")


def _pattern_key(span: Column) -> Column:
    return F.concat_ws(",", span["kind"], *[v.cast("string") for v in votes(span).values()])


def _feature_keys(span: Column) -> list[Column]:
    return [F.concat_ws(":", span["kind"], F.lit(f), v.cast("string")) for f, v in features(span).items()]


def train(spans: DataFrame) -> dict[str, float]:
    """Log-odds by feature key, and by kind, of the span classifier."""
    one = spans.select(F.explode("spans").alias("span"))
    keyed = written(
        one.select(
            F.col("span.kind").alias("kind"), _pattern_key(F.col("span")).alias("pattern"),
            F.array(*_feature_keys(F.col("span"))).alias("features"),
        )
        .groupBy("kind", "pattern", "features")
        .agg(F.count("*").alias("n")),
        "votes",
    )
    rows = keyed.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()  # 5 kinds, 243 patterns at most
    counts = [(r["kind"], tuple(int(v) for v in r["pattern"].split(",")[1:]), r["n"]) for r in rows]
    chance = {f"{kind}," + ",".join(map(str, pattern)): v for (kind, pattern), v in estimate(counts).items()}
    soft = keyed.withColumn("p", F.coalesce(_literal_map(chance)[F.col("pattern")], F.lit(0.0)))
    weights = soft.select(F.explode(F.concat("features", F.array("kind"))).alias("key"), "kind", "n", "p").groupBy("key", "kind").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    found = weights.collect()  # a fixed number of kinds, features and values
    total = {r["kind"]: (r["yes"], r["no"]) for r in found if r["key"] == r["kind"]}
    model = {}
    for r in found:
        yes, no = total[r["kind"]]
        if r["key"] == r["kind"]:
            model[r["key"]] = log((yes + 1) / (no + 1))
        else:
            model[r["key"]] = log((r["yes"] + 1) / (yes + 2)) - log((r["no"] + 1) / (no + 2))
    return model


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans, both arrays of (start, ord, kind, end).

    Offsets count code points, the end is exclusive.  ``base`` holds the spans of the
    strict patterns that pass their checks; ``spans`` adds the candidates that the
    trained classifier accepts and that overlap no base span.  Both are sorted by start,
    then kind.  A null text is empty and has none.  Repeated rows each get their
    row, with equal spans; other columns are ignored; an empty table gives no rows.
    """
    found = written(_with_candidates(docs, id_col, text), "candidates")
    model = _literal_map(train(found))
    order = [*KINDS, "secret"]

    def short(span: Column) -> Column:
        ord_ = reduce(lambda rest, i: F.when(span["kind"] == order[i], i).otherwise(rest), range(len(order)), F.lit(len(order)))
        return F.struct(span["start"].alias("start"), ord_.alias("ord"), span["kind"].alias("kind"), span["end"].alias("end"))

    def accepted(span: Column) -> Column:
        odds = [F.coalesce(model[k], F.lit(0.0)) for k in (span["kind"], *_feature_keys(span))]
        return reduce(add, odds) >= log(THRESHOLD / (1 - THRESHOLD))

    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["strict"]), short))
    # What fails the check of its kind is never added, however the others vote.
    more = F.filter("spans", lambda s: ~s["strict"] & (votes(s)["check"] != NO) & accepted(s))
    df = fence(found.select("id", base.alias("base"), more.alias("more")), ["base", "more"])
    free = F.filter(
        "more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    every = F.array_sort(F.concat("base", F.transform(free, short)))
    return df.select(F.col("id").alias(id_col), "base", every.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
