"""Fill-in-middle transformation by in-place block rotation.

A text is cut at two places into prefix, middle and suffix.  The cuts are
scanned for in the bytes, sentinels are inserted in a bytearray from the right
to the left, and the order of the parts is changed by exchanging two adjacent
blocks: each is reversed, then both together (three reversals, in place, with a
bounded buffer).

* plain: the text itself;
* psm: <P> prefix <S> suffix <M> middle (the last two blocks exchanged);
* spm: <S> suffix <P> prefix <M> middle (suffix exchanged with all before it).

``restore`` finds the sentinels, rotates the same blocks back and deletes the
sentinels, which gives the exact text.  That needs sentinels that neither the
text holds nor that overlap; texts that hold one stay plain, and sentinels that
could overlap are refused.

Forms and cuts come from a SHA-256 of seed and id, so they are the same however
rows are partitioned.  Null texts count as empty, empty texts stay plain; a
null id counts as the empty string in the hash; rows that repeat an id are cut
by the same numbers.  Texts of any length are handled whole, a bounded number
of bytes at a time; other columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import slices

# Bytes that one step of a scan or of a reversal holds.
STEP = 1 << 16
PLAIN_SHARE = 10
SPM_SHARE = 20


class Marks(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def checked(marks: Marks) -> Marks:
    """Refuse sentinels of which one could begin within another."""
    for a in marks:
        for b in marks:
            inner = a in b and (a is not b)
            if not a or inner or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels must not be empty or overlap: {marks}")
    return marks


def offsets(text: bytes, first: int, second: int) -> tuple[int, int]:
    """Byte offsets before the code points ``first`` and ``second`` (first <= second)."""
    view = np.frombuffer(text, np.uint8)
    found, seen = [], 0
    for at in range(0, len(view), STEP):
        leads = np.flatnonzero((view[at : at + STEP] & 0xC0) != 0x80)
        while len(found) < 2 and (first, second)[len(found)] < seen + len(leads):
            found.append(at + int(leads[(first, second)[len(found)] - seen]))
        if len(found) == 2:
            break
        seen += len(leads)
    found += [len(text)] * (2 - len(found))
    return found[0], found[1]


def _reverse(buf: bytearray, start: int, end: int) -> None:
    view = np.frombuffer(buf, np.uint8)
    while end - start > 2 * STEP:
        head = view[start : start + STEP].copy()
        view[start : start + STEP] = view[end - STEP : end][::-1]
        view[end - STEP : end] = head[::-1]
        start, end = start + STEP, end - STEP
    view[start:end] = view[start:end][::-1].copy()


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks start..cut and cut..end in place."""
    _reverse(buf, start, cut)
    _reverse(buf, cut, end)
    _reverse(buf, start, end)


def arranged(text: bytes, form: str, prefix: int, middle: int, marks: Marks = Marks()) -> bytes:
    """The text with its parts in the order of ``form``; ``prefix`` and
    ``middle`` are lengths in code points."""
    if form == "plain":
        return text
    p, s, m = (x.encode() for x in marks)
    first, second = offsets(text, prefix, prefix + middle)
    buf = bytearray(text)
    buf[second:second] = s
    buf[first:first] = m
    buf[:0] = p
    # now p prefix m middle s suffix
    at_middle = len(p) + first
    at_suffix = at_middle + len(m) + second - first
    rotate(buf, at_middle if form == "psm" else 0, at_suffix, len(buf))
    return bytes(buf)


def rebuilt(output: bytes, form: str, marks: Marks = Marks()) -> bytes:
    """The text that ``arranged`` was given."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    buf = bytearray(output)
    at_middle = buf.find(m)
    if form == "psm":
        at_suffix = buf.find(s)
        rotate(buf, at_suffix, at_middle, len(buf))
        first, second = at_suffix, at_suffix + len(buf) - at_middle
    else:
        at_prefix = buf.find(p)
        rotate(buf, 0, at_prefix, len(buf))
        first, second = at_middle - at_prefix, len(buf) - at_prefix
    # first and second are now the places of the middle's and suffix's marks
    del buf[second : second + len(s)]
    del buf[first : first + len(m)]
    del buf[: len(p)]
    return bytes(buf)


def _binary_map(df: DataFrame, change, column: int, name: str, keep: list[str]) -> DataFrame:
    """Replace the binary column at place ``column`` by ``change`` of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                rows = zip(*(c.to_pylist() for c in part.columns[column:]))
                out = pa.array([change(*row) for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], out], names=[*keep, name])

    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kept}, {name} binary")


def _choices(id_col: Column, n: Column, text: Column, seed: int, plain_share: int, spm_share: int, marks: Marks):
    """(form, lesser cut, greater cut) of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    cuts = [h[0] % (n + 1), h[1] % (n + 1)]
    held = text.contains(marks.prefix) | text.contains(marks.suffix) | text.contains(marks.middle)
    form = (
        F.when((n == 0) | held | (h[2] % 100 >= 100 - plain_share), "plain")
        .when(h[3] % 100 < spm_share, "spm")
        .otherwise("psm")
    )
    return form, F.least(*cuts), F.greatest(*cuts)


def transform(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_share: int = PLAIN_SHARE,
    spm_share: int = SPM_SHARE,
    marks: Marks = Marks(),
) -> DataFrame:
    """One row per input row: ``id_col``, n (code points), form, prefix_chars
    and middle_chars (null where plain) and output (text).

    ``plain_share`` per cent of the rows stay plain, ``spm_share`` per cent of
    the others are spm.
    """
    checked(marks)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    form, first, second = _choices(F.col("id"), F.col("n"), F.col("text"), seed, plain_share, spm_share, marks)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("form", form).select(
        "id",
        "n",
        F.when(cut, first).alias("prefix_chars"),
        F.when(cut, second - first).alias("middle_chars"),
        "form",
        F.col("text").cast("binary").alias("text"),
        F.col("form").alias("form_"),
        F.when(cut, first).alias("prefix_"),
        F.when(cut, second - first).alias("middle_"),
    )
    change = lambda text, form, prefix, middle: arranged(text, form, prefix, middle, marks)
    out = _binary_map(rows, change, 5, "output", ["id", "n", "prefix_chars", "middle_chars", "form"])
    return out.select(
        F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output")
    )


def restore(
    df: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored", marks: Marks = Marks()
) -> DataFrame:
    """``df`` with ``restored_col``, the exact text rebuilt from output and form.

    A null output counts as empty, a null form as plain.  A column of the name
    ``restored_col`` is replaced.
    """
    checked(marks)
    columns = [c for c in df.columns if c != restored_col]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.coalesce(F.col(output_col).cast("string"), F.lit("")).cast("binary").alias("output"),
        F.coalesce(F.col(form_col), F.lit("plain")).alias("form"),
    )
    out = _binary_map(rows, lambda output, form: rebuilt(output, form, marks), 1, "restored", ["row"])
    return out.select("row.*", F.col("restored").cast("string").alias(restored_col))
