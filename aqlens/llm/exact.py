"""Exact duplicates by content-defined chunk recipes.

A text (runs of ASCII white space made one space) is cut where a rolling hash
of its last 16 bytes meets a mask, so equal stretches are cut alike wherever
they stand.  Each chunk gets an identifier; the distinct (identifier, chunk)
rows are gathered once and prove that every identifier names one chunk only.
If one does not, all identifiers are made anew, twice as wide.  Two texts are
equal exactly when their ordered identifier lists are, so only these short
lists are grouped and joined: a long document never moves as a whole, and a
chunk moves once per task that holds it.

Nulls count as the empty text, whose recipe is empty.  Of equal texts the row
with the smallest id stays; rows without an id come last, and of rows that
repeat an id exactly one stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import released, remove, sized, slices, written

MEAN_BITS = 10  # a chunk holds about 2^10 bytes beyond the least
LEAST, MOST = 256, 8192
ID_BYTES = 16
WIDEST = 64
# Dropped rows up to which their keys go to all tasks, so that texts stay put.
BROADCAST_ROWS = 500_000
SPACE = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")
SPACE_SQL = r"[\x20\x09-\x0D]+"

SCHEMA = "kind int, uid long, id string, text_sha256 string, recipe binary, ident binary, chunk binary"


def _gear() -> np.ndarray:
    """256 mixed 32-bit words (a multiplicative hash of the byte value)."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length (none if empty)."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        moved = h.copy()
        moved[s:] += h[:-s] << np.uint32(s)
        h = moved
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST and mark < n:
            ends.append(mark)
            start = mark
    while n - start > MOST:
        start += MOST
        ends.append(start)
    ends.append(n)
    return ends


def normalised(text: bytes | None) -> bytes:
    return SPACE.sub(b" ", text) if text else b""


def _prepare(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row (kind 0) per document with its recipe, and (kind 1) the chunks
    that each batch holds, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for part in slices(batch, 1):
                docs, chunks = [], {}
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = normalised(text)
                    recipe, start = [], 0
                    for end in cut_points(data):
                        chunk = data[start:end]
                        name = hashlib.blake2b(chunk, digest_size=width).digest()
                        recipe.append(name)
                        chunks[(name, chunk)] = None  # both: a clash is kept to be found
                        start = end
                    docs.append((uid, ident, hashlib.sha256(data).hexdigest(), b"".join(recipe)))
                    uid += 1
                n, m = len(docs), len(chunks)
                cols = list(zip(*docs)) if docs else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * n + [1] * m, pa.int32()),
                        pa.array([*cols[0], *[None] * m], pa.int64()),
                        pa.array([*cols[1], *[None] * m], pa.string()),
                        pa.array([*cols[2], *[None] * m], pa.string()),
                        pa.array([*cols[3], *[None] * m], pa.binary()),
                        pa.array([None] * n + [k[0] for k in chunks], pa.binary()),
                        pa.array([None] * n + [k[1] for k in chunks], pa.binary()),
                    ],
                    names=["kind", "uid", "id", "text_sha256", "recipe", "ident", "chunk"],
                )

    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(released(run), SCHEMA)


def verified_recipes(df: DataFrame, id_col: str, text_col: str, id_bytes: int = ID_BYTES) -> DataFrame:
    """Written table of uid, id, text_sha256 and recipe, with identifiers that
    are proven to name one chunk each."""
    width = id_bytes
    while True:
        staged = written(_prepare(df, id_col, text_col, width), "recipes", partition_by="kind")
        names = staged.filter("kind = 1").select("ident", "chunk").distinct().groupBy("ident").count()
        if names.filter("count > 1").isEmpty():
            return staged.filter("kind = 0").select("uid", "id", "text_sha256", "recipe")
        if width >= WIDEST:
            raise RuntimeError("two chunks share their widest identifier")
        remove(staged)
        width *= 2


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = ID_BYTES
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the id of the row that stays (null only if no row of the
    group has an id).  Columns of the input other than the two named are not
    read, so their names can't clash.  An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType
    docs = verified_recipes(df, id_col, text_col, id_bytes).withColumn("id", F.col("id").cast(kind))
    groups = (
        docs.groupBy("recipe")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "uid")).alias("keep"),
            F.count("*").alias("group_size"),
        )
        .filter("group_size > 1")
        .select("recipe", F.col("keep.id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), "group_size")
    )
    groups = written(groups, "exact-groups")
    single = F.col("group_size").isNull()
    return docs.join(groups, "recipe", "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    found = written(exact_dedup(df, id_col, text_col), "exact-result")
    gone = found.filter("not kept").select(F.col(id_col).alias("gone_id"), F.unhex("text_sha256").alias("gone_sha"))
    gone = sized(written(gone.distinct(), "exact-gone"), BROADCAST_ROWS)
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE_SQL, " ")
    # the row as one column, so that its names can't clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    # Rows that repeat id and text: the join removes them all, one comes back.
    kept = found.filter("kept").select(F.col(id_col).alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    again = kept.join(gone, F.col("kept_id").eqNullSafe(F.col("gone_id")) & (F.col("kept_sha") == F.col("gone_sha")), "left_semi")
    if not again.isEmpty():
        back = rows.join(again, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
        out = out.unionByName(back.groupBy("id", "sha").agg(F.min("row").alias("row")))
    return out.select("row.*")
