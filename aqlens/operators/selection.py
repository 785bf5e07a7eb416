"""Exact order statistics of many columns at once by radix selection.

A double becomes a 64-bit key that sorts as the double does.  One histogram of
a digit over the keys that still agree with what is known of an answer tells
the next digit of every column's answers; eight digits of eight bits are all
there is, and a bucket of one distinct key ends the search early.  Each pass is
one aggregation with partial sums over a written table of keys; the driver sees
at most 256 counts a column and answer.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqlens.session import written

DIGIT = 8
_SIGN_OFF = (1 << 63) - 1


def order_key(c: Column) -> Column:
    """The bits of a double as a long in the order of the doubles (-0.0 before
    0.0, NaN last); null stays null."""
    text = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(c.cast("double"), F.lit(0.0)))
    bits = text.cast("long")
    return F.when(c.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_SIGN_OFF))))


def value_of(key: int) -> float:
    bits = key if key >= 0 else key ^ _SIGN_OFF
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def select(keys: DataFrame, ranks: Callable[[int], list[int]]) -> dict[str, list[float | None]]:
    """Per column of ``keys`` (order keys), the values at the 0-based ranks that
    ``ranks(n)`` names for its number n of non-null values."""
    cols = keys.columns
    long = keys.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("key")) for i, c in enumerate(cols)])))
    long = long.filter("key IS NOT NULL")
    # per column and answer: [digits known so far, rank among those, answer]
    open_: dict[int, list[list]] = {}
    answers: dict[str, list[float | None]] = {c: [] for c in cols}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        rows = long
        if open_:
            known = F.lit(False)
            for i, wanted in open_.items():
                prefixes = sorted({w[0] for w in wanted if w[2] is None})
                if prefixes:
                    known = known | ((F.col("i") == i) & F.shiftright("key", shift + DIGIT).isin(*prefixes))
            rows = rows.filter(known)
        counts = rows.groupBy("i", F.shiftright("key", shift).alias("head")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        buckets: dict[int, list] = {}
        for r in counts.collect():
            buckets.setdefault(r["i"], []).append((r["head"], r["n"], r["low"], r["high"]))
        if shift == 64 - DIGIT:
            open_ = {i: [[None, k, None] for k in ranks(sum(b[1] for b in own))] for i, own in buckets.items()}
        for i, wanted in open_.items():
            for w in wanted:
                if w[2] is not None:
                    continue
                for head, n, low, high in sorted(buckets[i]):
                    if w[0] is not None and head >> DIGIT != w[0]:
                        continue
                    if w[1] < n:
                        w[0], w[2] = head, (low if low == high else None)
                        break
                    w[1] -= n
        if all(w[2] is not None for wanted in open_.values() for w in wanted):
            break
    for i, wanted in open_.items():
        answers[cols[i]] = [value_of(w[2]) for w in wanted]
    return answers


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (the mean of the two middle values for an even count);
    None for a column without values."""
    if not cols:
        return {}
    keys = written(df.select(*[order_key(F.col(c)).alias(c) for c in cols]), "order-keys")
    found = select(keys, lambda n: [(n - 1) // 2, n // 2])
    return {c: (sum(v) / 2 if v else None) for c, v in found.items()}
