"""Personal-data detection and masking as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptward.functions.arrays import bind, emitting_fold, text_blocks, text_span
from promptward.functions.keys import TextKeys
from promptward.functions.patterns import BLANKS, LED_BY_OTHERS, java_regex, pii_regex
from promptward.rules import ID_CHECK_CHARS, ID_WEIGHTS, PII_TYPES

HIT_TYPE = "struct<type:string,value:string,masked:string,start:int,end:int>"


class PiiPattern(NamedTuple):
    """One kind of personal data.

    ``guard`` is a cheap SQL condition that holds for every text with a match; the
    regex runs only where it does.  In it ``{text}`` stands for the text,
    ``{vocab}`` for its distinct lower-case words and ``_numeric`` for the outcome
    of ``may_hold_numbers``.  ``valid`` drops matches that fail a check.  ``group`` is
    the group that holds the match; it ends where the whole match ends.
    """

    type: str
    regex: str
    mask: Callable[[Column], Column]
    guard: str = "true"
    valid: Callable[[Column], Column] | None = None
    group: int = 0


def id_checksum_ok(value: Column) -> Column:
    """GB 11643 check character of an 18-character identity number."""
    total = reduce(
        add,
        [F.substring(value, i, 1).cast("int") * w for i, w in enumerate(ID_WEIGHTS, start=1)],
    )
    expected = F.substring(F.lit(ID_CHECK_CHARS), total % 11 + 1, F.lit(1))
    return (F.length(value) == 18) & (expected == F.upper(F.substring(value, 18, 1)))


def _last4(value: Column) -> Column:
    return F.substring(value, -4, 4)


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def _mask_phone(value: Column) -> Column:
    prefix = java_regex(r"^(?:\+86|0086)[\s\-]?")
    digits = F.regexp_replace(F.regexp_replace(value, prefix, ""), f"[{BLANKS}\\-]", "")
    return F.concat(
        F.regexp_extract(value, prefix, 0), F.substring(digits, 1, 3), F.lit("****"), _last4(digits)
    )


def _mask_id(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 6), F.lit("********"), F.substring(value, 15, 3), F.lit("*"))


def _mask_email(value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    size = F.length(local)
    stars = F.when(size <= 2, size).otherwise(F.least(size - 2, F.lit(4)))
    kept = F.when(size <= 2, "").otherwise(F.substring(local, 1, 2))
    return F.concat(kept, _stars(stars), F.lit("@"), F.substring_index(value, "@", -1))


def _mask_openai(value: Column) -> Column:
    prefix = F.when(value.startswith("sk-proj-"), "sk-proj-").otherwise("sk-")
    hidden = F.greatest(F.length(value) - F.length(prefix) - 4, F.lit(0))
    return F.concat(prefix, _stars(hidden), _last4(value))


def _mask_aws(value: Column) -> Column:
    return F.concat(F.lit("AKIA"), _stars(F.lit(12)), _last4(value))


def _mask_google(value: Column) -> Column:
    return F.concat(F.lit("AIza"), _stars(F.length(value) - 8), _last4(value))


def _mask_card(value: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), _last4(F.regexp_replace(value, "[ \\-]", "")))


def _mask_ip(value: Column) -> Column:
    return F.concat(F.substring_index(value, ".", 2), F.lit(".***.***"))


def _mask_password(value: Column) -> Column:
    head = java_regex(
        r"(?i)^(?:password|passwd|pwd|pass|密码|口令)(?:\s*+(?:[:=]|是|为)|\s++is)\s*+"
    )

    def redact(prefix: Column) -> Column:
        first = F.substring(value, F.length(prefix) + 1, F.lit(1))
        quote = F.when(first.isin("'", '"'), first).otherwise("")
        return F.concat(prefix, quote, F.lit("[REDACTED]"), quote)

    return bind(F.regexp_extract(value, head, 0), redact)


def may_hold_numbers(text: Column) -> Column:
    """Four digits with at most one separator between them: part of every number kind."""
    return text.rlike(f"[0-9](?:[{BLANKS}.\\-]?[0-9]){{3}}")


# A mobile number ends in two groups of four digits.
_EIGHT_DIGITS = (
    "_numeric AND rlike({text}, '"
    + f"[0-9]{{4}}[{BLANKS}\\-]?[0-9]{{4}}".replace("{", "{{").replace("}", "}}").replace("\\", "\\\\")
    + "')"
)


_PASSWORD_WORDS = (
    "(contains({vocab}, 'pass') OR contains({vocab}, 'pwd')"
    " OR contains({text}, '密码') OR contains({text}, '口令'))"
)


def builtin_patterns() -> tuple[PiiPattern, ...]:
    """The nine built-in kinds, in declared order."""
    parts = {
        "PHONE_CN": (_mask_phone, _EIGHT_DIGITS, None),
        "ID_CARD_CN": (_mask_id, "_numeric AND rlike({text}, '[0-9]{{17}}')", id_checksum_ok),
        "EMAIL": (_mask_email, "contains({text}, '@')", None),
        "API_KEY_OPENAI": (_mask_openai, "contains({text}, 'sk-')", None),
        "API_KEY_AWS": (_mask_aws, "contains({vocab}, 'akia')", None),
        "API_KEY_GOOGLE": (_mask_google, "contains({vocab}, 'aiza')", None),
        "CREDIT_CARD": (_mask_card, "_numeric AND rlike({text}, '[0-9](?:[ \\\\-]?[0-9]){{13}}')", None),
        "IP_ADDRESS": (_mask_ip, "_numeric AND rlike({text}, '[0-9][.][0-9]{{1,3}}[.][0-9]')", None),
        "PASSWORD_KV": (_mask_password, _PASSWORD_WORDS, None),
    }
    return tuple(
        PiiPattern(name, pii_regex(name), mask, guard, valid, int(name in LED_BY_OTHERS))
        for name, (mask, guard, valid) in ((n, parts[n]) for n in PII_TYPES)
    )


def matched_values(text: str, keys: TextKeys, pattern: PiiPattern) -> Column:
    """All matched strings of one kind, before validation."""
    guard = pattern.guard.format(text=f"`{text}`", vocab=keys.vocabulary)
    return F.when(
        F.expr(guard), F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group))
    ).otherwise(F.array().cast("array<string>"))


def gaps_before(text: Column, values: Column, pattern: PiiPattern) -> Column:
    """Matches of one kind with the number of characters since the previous one."""
    gaps = F.transform(F.slice(F.split(text, pattern.regex, -1), F.lit(1), F.size(values)), F.length)
    if pattern.group:
        whole = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
        lead = F.zip_with(whole, values, lambda w, v: F.length(w) - F.length(v))
        gaps = F.zip_with(gaps, lead, lambda g, more: g + more)
    paired = F.zip_with(
        values,
        gaps,
        lambda v, g: F.struct(F.lit(pattern.type).alias("type"), v.alias("value"), g.alias("gap")),
    )
    none = F.array().cast("array<struct<type:string,value:string,gap:int>>")
    return F.when(F.size(values) > 0, paired).otherwise(none)


def hits_of(paired: Column, patterns: Sequence[PiiPattern]) -> Column:
    """Hits with offsets in characters, from the ``gaps_before`` of all kinds in turn.

    Offsets are running sums that start anew at each kind.
    """

    def advance(state: Column, item: Column) -> tuple[Column, Column]:
        start = F.when(item["type"] == state["type"], state["pos"]).otherwise(0) + item["gap"]
        hit = F.struct(
            item["type"].alias("type"),
            item["value"].alias("value"),
            start.alias("start"),
            (start + F.length(item["value"])).alias("end"),
        )
        return (
            F.struct(item["type"].alias("type"), hit["end"].alias("pos")),
            F.array(hit),
        )

    zero = F.struct(F.lit("").alias("type"), F.lit(0).alias("pos"))
    located = emitting_fold(
        paired, zero, "struct<type:string,value:string,start:int,end:int>", advance
    )["out"]

    def by_type(hit: Column, parts: list[tuple[str, Column]], default: Column) -> Column:
        return reduce(lambda chain, p: chain.when(hit["type"] == p[0], p[1]), parts, F).otherwise(default)

    checked = [p for p in patterns if p.valid is not None]
    if checked:
        located = F.filter(
            located, lambda h: by_type(h, [(p.type, p.valid(h["value"])) for p in checked], F.lit(True))
        )
    return F.transform(
        located,
        lambda h: F.struct(
            h["type"].alias("type"),
            h["value"].alias("value"),
            by_type(h, [(p.type, p.mask(h["value"])) for p in patterns], h["value"]).alias("masked"),
            h["start"].alias("start"),
            h["end"].alias("end"),
        ),
    )


_CLUSTER = "struct<start:int,end:int,len:int,prio:int,masked:string>"


def mask_clusters(hits: Column, types: Sequence[str]) -> Column:
    """Merge overlapping hits; each cluster is shown as the mask of its longest hit.

    Equal lengths go to the type declared first.  The whole cluster is replaced,
    so no character of a losing hit stays visible.
    """
    order = F.array(*[F.lit(t) for t in types])
    spans = F.sort_array(
        F.transform(
            hits,
            lambda h: F.struct(
                h["start"].alias("start"),
                h["end"].alias("end"),
                (h["end"] - h["start"]).alias("len"),
                F.array_position(order, h["type"]).cast("int").alias("prio"),
                h["masked"].alias("masked"),
            ),
        )
    )
    none = F.array().cast(f"array<{_CLUSTER}>")
    zero = F.struct(
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
        F.lit(0).alias("len"),
        F.lit(0).alias("prio"),
        F.lit("").alias("masked"),
    )

    def merge(cur: Column, hit: Column) -> tuple[Column, Column]:
        better = (hit["len"] > cur["len"]) | ((hit["len"] == cur["len"]) & (hit["prio"] < cur["prio"]))
        joined = F.struct(
            cur["start"].alias("start"),
            F.greatest(cur["end"], hit["end"]).alias("end"),
            *[
                F.when(better, hit[f]).otherwise(cur[f]).alias(f)
                for f in ("len", "prio", "masked")
            ],
        )
        overlaps = hit["start"] < cur["end"]
        emitted = F.when(overlaps | (cur["start"] < 0), none).otherwise(F.array(cur))
        return F.when(overlaps, joined).otherwise(hit), emitted

    folded = emitting_fold(spans, zero, _CLUSTER, merge)
    clusters = bind(folded, lambda r: F.concat(r["out"], F.array(r["state"])))
    return F.when(F.size(hits) > 0, clusters).otherwise(none)


def masked_text(text: Column, clusters: Column) -> Column:
    """Text with every cluster replaced by its mask."""

    def rebuild(doc: Column) -> Column:
        marks, blocks = doc["clusters"], doc["blocks"]

        def part(cluster: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(marks, i - 1)["end"])
            return F.concat(text_span(blocks, before, cluster["start"]), cluster["masked"])

        tail = text_span(blocks, F.element_at(marks, -1)["end"], doc["len"])
        return F.concat(F.array_join(F.transform(marks, part), ""), tail)

    doc = F.struct(
        clusters.alias("clusters"),
        text_blocks(text).alias("blocks"),
        F.length(text).alias("len"),
    )
    return F.when(F.size(clusters) > 0, bind(doc, rebuild)).otherwise(text)
