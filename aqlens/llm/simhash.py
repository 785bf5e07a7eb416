"""SimHash near duplicates with pigeonring filtering.

The 64 bits of a fingerprint are dealt to m = distance + 1 segments in a ring.
If two fingerprints differ in at most ``distance`` bits, some segment begins a
chain along the ring whose first l segments differ in at most
floor(l * distance / m) bits, for every l.  So:

* for each start, the first ``chain`` segments with every choice of the bits
  that the budget lets differ blanked out form a key; linked fingerprints share
  a key (64 keys a fingerprint for distance 4 and chain 2, about 24 bits each);
* only keys with two or more different fingerprints go on; within them the
  budgets of the longer chains prune what the full Hamming check then decides.

Fingerprints are first made distinct, so copies cost nothing.  A key's members
are searched in blocks of at most BLOCK, every block with every other, so a
hot key is spread over many tasks; within a pair of blocks only fingerprints
not reached yet are compared, and only the links that first reach them are
kept: links within a component may be left out, connections never are.

Null texts count as empty; texts without words have fingerprint zero and link
like any other.  Rows that repeat an id are the same document.  Columns other
than the two named are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import released, sized, slices, written
from aqlens.llm.graph import components

BITS = 64
DISTANCE = 4
SHINGLE = 4
CHAIN = 2
SEED = 42
BLOCK = 256
# Keys of two or more fingerprints, up to which their table goes to all tasks.
BROADCAST_KEYS = 1_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()]
                fp = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), fp], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def ring(distance: int) -> list[int]:
    """Masks of distance + 1 segments that cover the 64 bits in order."""
    m = distance + 1
    edges = [round(BITS * k / m) for k in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def chain_keys(distance: int, chain: int) -> list[tuple[int, int]]:
    """(start segment, mask) of every key: the bits of the first ``chain``
    segments less those that the budgets let differ."""
    segments = ring(distance)
    m = len(segments)
    chain = min(chain, m)
    budget = [(k + 1) * distance // m for k in range(chain)]
    keys = []
    for start in range(m):
        own = [segments[(start + k) % m] for k in range(chain)]
        bits = [(k, b) for k in range(chain) for b in range(BITS) if own[k] >> b & 1]
        whole = sum(own)
        for blank in combinations(bits, budget[-1]):
            if all(sum(k <= upto for k, _ in blank) <= budget[upto] for upto in range(chain)):
                keys.append((start, whole & ~sum(1 << b for _, b in blank)))
    return keys


def _reach(start: int, fps: np.ndarray, distance: int, chain: int) -> list[tuple[int, int]]:
    """Links that connect the members of one key, found by a search that
    compares each newly reached fingerprint with those not reached yet."""
    segments = ring(distance)
    m = len(segments)
    wider = [
        (np.uint64(sum(segments[(start + k) % m] for k in range(n))), n * distance // m) for n in range(chain + 1, m)
    ]
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            own = frontier.pop()
            diff = rest ^ own
            near = np.ones(len(rest), bool)
            for mask, budget in wider:
                near &= np.bitwise_count(diff & mask) <= budget
            near[near] = np.bitwise_count(diff[near]) <= distance
            if near.any():
                found = rest[near]
                links.extend((int(own), int(x)) for x in found.tolist())
                frontier.extend(found)
                rest = rest[~near]
    return links


def _search(distance: int, chain: int, starts: list[int]):
    """Task over rows (tag, masked, x, y, fp), sorted so that groups are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            # rows: columns tag, masked, x, y, fp; whole groups
            edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            bounds = np.concatenate(([0], edge, [len(rows)]))
            fps = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            sizes = np.diff(bounds)
            out: list[np.ndarray] = []
            pairs = bounds[:-1][sizes == 2]  # most groups: all at once
            if len(pairs):
                a, b = fps[pairs], fps[pairs + 1]
                near = np.bitwise_count(a ^ b) <= distance
                out.append(np.stack([a[near], b[near]], axis=1))
            for k in np.flatnonzero(sizes > 2).tolist():
                found = _reach(starts[int(rows[bounds[k], 0])], fps[bounds[k] : bounds[k + 1]], distance, chain)
                if found:
                    out.append(np.array(found, np.uint64))
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.empty((0, 2), np.uint64)
            pairs = pairs.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if held and (held[-1][-1, :4] != rows[0, :4]).any():
                yield links(np.concatenate(held))
                held = []
            if len(change):
                yield links(np.concatenate([*held, rows[: change[-1]]]))
                held = [rows[change[-1] :]]
            else:
                held.append(rows)
        if held:
            yield links(np.concatenate(held))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (column fp,
    no repeats) that differ in at most ``distance`` bits."""
    keys = chain_keys(distance, chain)
    signed = [mask - (1 << 64) if mask >> 63 else mask for _, mask in keys]
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(mask).cast("long")) for mask in signed])
    # few small files hold the fingerprints: deal them out before each makes its keys
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(tasks, "fp").select("fp", F.posexplode(masked).alias("tag", "masked"))
    shared = keyed.groupBy("tag", "masked").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(shared, "simhash-keys")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    members = (
        keyed.join(sized(shared, BROADCAST_KEYS), ["tag", "masked"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tag", "masked", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    group = ["tag", "masked", "x", "y"]
    sorted_rows = members.repartition(*group).sortWithinPartitions(*group)
    return sorted_rows.mapInArrow(released(_search(distance, chain, [s for s, _ in keys])), "a long, b long").distinct()


def near_duplicates(
    df: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    chain: int = CHAIN,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 lowercase hex digits)
    and component_id (smallest id that links reach; null only if no document of
    the component has an id)."""
    docs = written(fingerprints(df, shingle, id_col, text_col), "simhash-docs")
    groups = written(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    roots = written(components(links(groups.select("fp"), distance, chain, block), "a", "b"), "simhash-roots")
    inner = groups.join(roots, groups.fp == roots.node, "left").select("fp", "root", "least")
    by_root = inner.filter("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    by_root = written(by_root, "simhash-components")
    labels = inner.join(by_root, "root", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")
    )
    labels = written(labels, "simhash-labels")
    return docs.join(labels, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_duplicates(
    df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component
    the document with the smallest id.  Rows without an id go where their
    component has a document with one, else all of them stay."""
    found = written(near_duplicates(df, shingle, distance, id_col, text_col), "simhash-result")
    # without an id a row is known by its fingerprint alone
    gone = found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("gone_id"), "fingerprint")
    # the row as one column, so that its names can't clash
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = gone.filter("gone_id is not null").select("gone_id").distinct()
    named = sized(written(named, "simhash-gone"), BROADCAST_KEYS)
    out = rows.join(named, F.col("id") == F.col("gone_id"), "left_anti").select("row")
    # an id of rows that go and of rows that stay names them with the fingerprint
    stays = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("both_id"))
    both = written(stays.join(named, F.col("both_id") == F.col("gone_id"), "left_semi").distinct(), "simhash-both")
    if not both.isEmpty():
        few = sized(both, BROADCAST_KEYS)
        mixed = rows.join(few, F.col("id") == F.col("both_id"), "left_semi").select(F.struct("row", "id").alias("known"), "text")
        keyed = fingerprints(mixed, shingle, "known", "text").withColumn("own", F.lower(F.lpad(F.hex("fp"), 16, "0")))
        going = gone.join(few, F.col("gone_id") == F.col("both_id"), "left_semi").distinct()
        same = (F.col("id.id") == F.col("gone_id")) & (F.col("own") == F.col("fingerprint"))
        out = out.unionByName(keyed.join(going, same, "left_anti").select(F.col("id.row").alias("row")))
    nameless = gone.filter("gone_id is null").select("fingerprint").distinct()
    if not nameless.isEmpty():
        keyed = fingerprints(rows.filter("id is null"), shingle, "row", "text")
        keyed = keyed.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
        back = keyed.join(nameless, "fingerprint", "left_anti").select(F.col("id").alias("row"))
        out = out.filter(F.col(f"row.`{id_col}`").isNotNull()).unionByName(back)
    return out.select("row.*")
