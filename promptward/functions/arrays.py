"""Array expressions used by the detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512
TEXT_BLOCK = 1024


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may refer to it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def emitting_fold(
    items: Column,
    zero: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Left fold over an array that also emits; gives ``struct<state, out>``.

    ``step(state, item)`` gives the next state and an array of emitted elements.
    Appending to one growing array would copy it once per item, so items are
    folded in blocks: a text with a million hits stays far from quadratic.
    """
    none = F.array().cast(f"array<{out_type}>")
    no_blocks = F.array().cast(f"array<array<{out_type}>>")

    def pair(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def fold_block(block: Column, state: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            return bind(
                pair(*step(acc["state"], item)),
                lambda r: pair(r["state"], F.concat(acc["out"], r["out"])),
            )

        return F.aggregate(block, pair(state, none), one)

    def blocks_of(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)),
        )

    folded = F.aggregate(
        bind(items, blocks_of),
        pair(zero, no_blocks),
        lambda acc, block: bind(
            fold_block(block, acc["state"]),
            lambda r: pair(r["state"], F.concat(acc["out"], F.array(r["out"]))),
        ),
    )
    return bind(folded, lambda r: pair(r["state"], F.flatten(r["out"])))


def text_blocks(text: Column) -> Column:
    """Text cut into fixed-size blocks, so that ``text_span`` need not walk all of it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def text_span(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (from 0) up to ``end`` of a text given as ``text_blocks``."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.floor((end - 1) / TEXT_BLOCK).cast("int")
    window = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(
        end > start, F.substring(window, start - first * TEXT_BLOCK + 1, end - start)
    ).otherwise("")
