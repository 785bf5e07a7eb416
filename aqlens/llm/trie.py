"""Conversation prefix trie by fixed-length block hashing.

A node stands for a distinct sequence of first turns; its members are the
conversations that start with it.  Turns get a digest each, and runs of BLOCK
turns of a conversation form a block.

1. The digest of a prefix is the sum of the hashes of (depth, turn) over its
   turns, two independent 64-bit hashes, so digests of long conversations come
   from sums of blocks and of lots of blocks: no step reads one conversation
   in one go.
2. Conversations are grouped by the digest at the end of each block.  All turns
   in between are known by that one row a block and conversation.
3. Where all that goes on from a block boundary shares the next block, its turn
   boundaries have the same members and are written down as they are.  Only
   where siblings diverge the turn boundaries inside the block are grouped, and
   there each distinct block counts once, whatever the number of its copies.

Sums over subtrees need no walk: a node is represented by its smallest member,
all nodes of a representative lie on one path, and all of the subtree's nodes
belong to members of the node.  So each conversation is given the sum over the
nodes that it represents (and whether it ends in a leaf), these are summed over
members by the same grouping, and what the representative has above the node is
taken off again.  The number of jobs doesn't depend on depth.

Null ids name no conversation: such rows are left out.  Null roles and texts
count as empty; turns come in the order of ``turn`` (null first), equal ones by
role and digest; repeated rows are turns of their own.  Texts of any length are
hashed and counted within their row, and only digests are moved.  Columns other
than those named are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqlens.llm.common import sized, written

# Turns in a block; blocks (or nodes of a path) whose running sums are made in one go.
BLOCK = 8
LOT = 512
# Bytes of joined ids that one row of an end list holds.
CHUNK = 1 << 16
# Rows up to which a written table goes to all tasks.
BROADCAST_ROWS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"
# Sums of 64-bit hashes, kept as their remainder.
SUM = "decimal(38,0)"
MODULUS = (1 << 63) - 25


def _mod(total):
    return F.pmod(total, F.lit(MODULUS).cast(SUM)).cast("long")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, digest, words): the turns of every conversation, numbered
    from 1.

    Rows are dealt by ranges of their order, so a conversation of any length is
    spread over tasks; each task numbers its own part, and what lies before it
    is added for the conversations that run over a boundary (as many rows as
    there are boundaries, at most).
    """
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    role_ = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        role_.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("digest"),
        F.regexp_count(text_, F.lit(WORDS)).cast("long").alias("words"),
    )
    # the bounds of the ranges are sampled from the digests, not from the texts
    rows = written(rows, "trie-digests")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "trie-order")
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = written(parts.withColumn("before", before).filter("before > 0").drop("n"), "trie-parts")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row")).cast("long")
    rows = rows.withColumn("own", own).join(sized(later, BROADCAST_ROWS), ["conv", "part"], "left")
    depth = F.col("own") + F.coalesce("before", F.lit(0))
    return rows.select("conv", depth.alias("depth"), "digest", "words")


def lengths(turned: DataFrame) -> DataFrame:
    """(conv, n): turns of every conversation."""
    return turned.groupBy("conv").agg(F.max("depth").alias("n"))


def _running(df: DataFrame, group: str, order: str, values: list[str], name: str) -> DataFrame:
    """``df`` with before_<value>: the sum of the value over the rows of the
    group that come earlier.  ``order`` numbers a group's rows (gaps are fine);
    sums are made within lots of it, then over lots."""
    df = df.withColumn("lot_", F.floor(F.col(order) / LOT))
    lots = df.groupBy(group, "lot_").agg(*[F.sum(v).cast(SUM).alias(f"lot_{v}") for v in values])
    earlier = Window.partitionBy(group).orderBy("lot_").rowsBetween(Window.unboundedPreceding, -1)
    carry = lots.select(group, "lot_", *[F.sum(f"lot_{v}").over(earlier).cast(SUM).alias(f"carry_{v}") for v in values])
    # the first lot of a group carries nothing
    carry = sized(written(carry.filter(f"carry_{values[0]} IS NOT NULL"), name), BROADCAST_ROWS)
    within = Window.partitionBy(group, "lot_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"own_{v}": F.sum(v).over(within).cast(SUM) for v in values})
    df = df.join(carry, [group, "lot_"], "left")
    zero = F.lit(0).cast(SUM)
    sums = {f"before_{v}": F.coalesce(f"own_{v}", zero) + F.coalesce(f"carry_{v}", zero) for v in values}
    return df.withColumns(sums).drop("lot_", *[f"{p}_{v}" for p in ("own", "carry") for v in values])


def blocks(turned: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: conv, k, start and end (depth and
    digest of the prefix before it and with it) and its turns, in order, each
    with the sums of the hashes up to it."""
    rows = turned.select(
        "conv",
        "depth",
        "words",
        F.floor((F.col("depth") - 1) / block).alias("k"),
        F.xxhash64("depth", "digest").cast(SUM).alias("a"),
        F.xxhash64("digest", "depth", F.lit(1)).cast(SUM).alias("b"),
    )
    upto = Window.partitionBy("conv", "k").orderBy("depth")
    rows = rows.withColumns({c: F.sum(c).over(upto).cast(SUM) for c in "ab"})
    found = rows.groupBy("conv", "k").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("turns"))
    last = F.element_at("turns", -1)
    found = found.select("conv", "k", "turns", last["depth"].alias("depth"), last["a"].alias("a"), last["b"].alias("b"))
    found = _running(written(found, "trie-blocks"), "conv", "k", ["a", "b"], "trie-lots")
    start = F.struct(_mod(F.col("before_a")).alias("a"), _mod(F.col("before_b")).alias("b"))
    end = F.struct(_mod(F.col("before_a") + F.col("a")).alias("a"), _mod(F.col("before_b") + F.col("b")).alias("b"))
    prefix = lambda t: F.struct(
        t["depth"].alias("depth"),
        F.struct(_mod(F.col("before_a") + t["a"]).alias("a"), _mod(F.col("before_b") + t["b"]).alias("b")).alias("at"),
        t["words"].alias("words"),
    )
    return found.select("conv", "k", "depth", start.alias("start"), end.alias("end"), F.transform("turns", prefix).alias("turns"))


def _shared(block_rows: DataFrame, sums: dict) -> DataFrame:
    """Blocks grouped by the prefix digest at their end: k, depth, start, end,
    n_convs, conv (smallest member) and the given sums over members."""
    return block_rows.groupBy("k", "depth", "start", "end").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), *[F.sum(v).alias(c) for c, v in sums.items()]
    )


def _diverging(groups: DataFrame) -> DataFrame:
    """``groups`` with ``diverges``: whether other blocks go on from the same start."""
    first = groups.filter("k = 0")
    several = first.limit(2).count() > 1
    starts = groups.filter("k > 0").groupBy(F.col("k").alias("k_"), F.col("start").alias("start_")).count()
    starts = sized(written(starts.filter("count > 1"), "trie-starts"), BROADCAST_ROWS)
    later = groups.filter("k > 0").join(starts, (F.col("k") == F.col("k_")) & (F.col("start") == F.col("start_")), "left")
    later = later.withColumn("diverges", F.col("count").isNotNull()).drop("k_", "start_", "count")
    return first.withColumn("diverges", F.lit(several)).unionByName(later)


def _nodes(block_rows: DataFrame, groups: DataFrame, sums: list[str]) -> DataFrame:
    """(depth, at, up, conv, n_convs, words, sums): every node below the root,
    ``at`` and ``up`` the digests of its prefix and of its parent's."""
    own = block_rows.select(F.col("conv").alias("conv_"), F.col("k").alias("k_"), "turns")
    rows = groups.join(own, (F.col("conv") == F.col("conv_")) & (F.col("k") == F.col("k_")))
    rows = rows.select("diverges", "start", "conv", "n_convs", "turns", *sums, F.posexplode("turns").alias("i", "t"))
    up = F.coalesce(F.get("turns", F.col("i") - 1)["at"], F.col("start"))
    rows = rows.select("diverges", "t.depth", "t.at", up.alias("up"), "conv", "n_convs", "t.words", *sums)
    alone = rows.filter("NOT diverges").drop("diverges")
    split = rows.filter("diverges").groupBy("depth", "at").agg(
        F.first("up").alias("up"),
        F.min("conv").alias("conv"),
        F.sum("n_convs").alias("n_convs"),
        F.first("words").alias("words"),
        *[F.sum(c).alias(c) for c in sums],
    )
    return alone.unionByName(split)


def _id_digests(ends: DataFrame) -> DataFrame:
    """(depth, at, sha): per node, the SHA-256 of its members' decimal ids in
    ascending order, comma-joined.

    Ranges of the order are joined to chunks of bounded size wherever they lie,
    then the chunks of a node go through one running hash: no list of ids is
    ever held as a whole.
    """
    order = ["depth", "a", "b", "conv"]
    rows = ends.select("depth", "at.a", "at.b", "conv").repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a node and run of at most CHUNK bytes of ids."""
        out: list[tuple] = []
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            for depth, a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (node != (depth, a, b) or size >= CHUNK):
                    out.append((*node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = (depth, a, b), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _chunk_batch(out)
            out = []
        if ids:
            yield _chunk_batch([(*node, first, ",".join(ids))])

    chunks = rows.mapInArrow(joined, "depth long, a long, b long, conv long, ids string")
    chunks = chunks.repartition("depth", "a", "b").sortWithinPartitions(*order)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out: list[tuple] = []
            for depth, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != (depth, a, b):
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = (depth, a, b), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield _sha_batch(out)
        if node is not None:
            yield _sha_batch([(*node, running.hexdigest())])

    found = chunks.mapInArrow(hashed, "depth long, a long, b long, sha string")
    return found.select("depth", F.struct("a", "b").alias("at"), "sha")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("conv", pa.int64()), ("ids", pa.string())]
    return pa.RecordBatch.from_pylist([dict(zip([n for n, _ in kinds], r)) for r in rows], pa.schema(kinds))


def _sha_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())]
    return pa.RecordBatch.from_pylist([dict(zip([n for n, _ in kinds], r)) for r in rows], pa.schema(kinds))


def prefix_trie(turned: DataFrame, convs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (the
    parent's conv_id, null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) x words of the last turn) and
    ends_sha256 (SHA-256 of the ids that end there, ascending, comma-joined).

    ``turned`` has the columns of ``turns``; ``convs`` (column conv, no repeats)
    names all conversations where some have no turns.
    """
    spark = turned.sparkSession
    turned = written(turned, "trie-turns")
    convs = lengths(turned).select("conv") if convs is None else convs.select("conv")
    convs = written(convs, "trie-convs")
    total, root_conv = convs.agg(F.count("*"), F.min("conv")).first()
    rows = written(blocks(turned, block), "trie-prefixes")

    # members and representatives of every node
    groups = written(_diverging(written(_shared(rows, {}), "trie-groups")), "trie-diverging")
    nodes = written(_nodes(rows, groups, []), "trie-nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    children = written(children, "trie-children")
    value = ((F.col("n_convs") - 1) * F.col("words")).cast(SUM)
    leaves = nodes.join(children, ["depth", "at"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast(SUM).alias("value"))
    worth = nodes.filter("n_convs > 1").select("conv", F.lit(0).cast("long").alias("leaf"), value.alias("value"))
    weights = leaves.unionByName(worth).groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("value").cast(SUM).alias("value"))
    weights = written(weights.withColumnRenamed("conv", "conv_"), "trie-weights")

    # the same grouping once more, with the weights of the members
    weighed = rows.select("conv", "k", "depth", "start", "end").join(sized(weights, BROADCAST_ROWS), F.col("conv") == F.col("conv_"), "left")
    sums = {"leaf": F.coalesce("leaf", F.lit(0)), "value": F.coalesce("value", F.lit(0).cast(SUM))}
    flags = groups.select("k", "depth", "end", "diverges")
    summed = _shared(weighed, sums).join(flags, ["k", "depth", "end"])
    nodes = written(_nodes(rows, written(summed, "trie-weighed"), list(sums)), "trie-sums")

    # off comes what the representative has above the node
    shared = nodes.filter("n_convs > 1").withColumn("own", ((F.col("n_convs") - 1) * F.col("words")).cast(SUM))
    shared = _running(shared, "conv", "depth", ["own"], "trie-above")
    shared = shared.withColumn("saved", F.col("value") - F.col("before_own")).drop("own", "before_own")
    alone = nodes.filter("n_convs = 1").withColumn("saved", F.lit(0).cast("decimal(38,0)"))
    nodes = written(shared.unionByName(alone), "trie-saved")

    # parents: those of another representative are looked up
    heads = nodes.groupBy("conv").agg(F.min("depth").alias("head"))
    nodes = nodes.join(heads, "conv")
    inner = nodes.filter("depth > head").withColumn("parent", F.col("conv"))
    first = nodes.filter("depth = head AND depth = 1").withColumn("parent", F.lit(root_conv).cast("long"))
    parents = nodes.filter("n_convs > 1").select((F.col("depth") + 1).alias("depth_"), F.col("at").alias("up_"), F.col("conv").alias("parent"))
    other = nodes.filter("depth = head AND depth > 1")
    other = other.join(parents, (F.col("depth") == F.col("depth_")) & (F.col("up") == F.col("up_"))).drop("depth_", "up_")
    nodes = written(inner.unionByName(first).unionByName(other).drop("head"), "trie-parents")

    # conversations that end at a node, by the last of their blocks
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "end")).alias("last"))
    ends = convs.join(last, "conv", "left").select(
        "conv", F.coalesce("last.depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("last.end", _origin()).alias("at")
    )
    shas = written(_id_digests(ends), "trie-ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    below = nodes.join(children, ["depth", "at"], "left").join(shas, ["depth", "at"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaf").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.coalesce("sha", none).alias("ends_sha256"),
    )
    if not total:
        return below
    top = nodes.filter("depth = 1").agg(F.count("*"), F.sum("leaf"), F.sum("saved")).first()
    ended = shas.filter("depth = 0").select("sha").first()
    root = spark.range(1).select(
        F.lit(root_conv).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total).cast("long").alias("n_convs"),
        F.lit(top[0]).cast("long").alias("n_children"),
        F.lit(top[1] or 1).cast("long").alias("n_leaves"),
        F.lit(int(top[2] or 0)).cast("long").alias("saved_tokens"),
        F.lit(ended["sha"] if ended else hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
    )
    return root.unionByName(below)


def _origin():
    """Digest of the empty prefix."""
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def with_shared_heads(turned: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt so that families share their beginnings:
    conversation c is the first h turns of conversation c - c % family (all if
    fewer, none if absent), then its own turns after its first h; h is the
    CRC-32 of c in decimal, modulo ``most``."""
    turned = written(turned, "trie-original")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = written(lengths(turned), "trie-lengths").select("conv", "n", head.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base"))
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = convs.join(base, "base", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv", "base", "h", "m")
    plan = written(plan, "trie-plan")
    shift = plan.select("conv", (F.col("h") - F.col("m")).alias("shift"))
    own = turned.filter(F.col("depth") > head).join(sized(shift, BROADCAST_ROWS), "conv")
    own = own.select("conv", (F.col("depth") - F.col("shift")).alias("depth"), "digest", "words")
    heads = turned.filter((F.col("depth") < most) & (F.pmod("conv", F.lit(family)) == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(plan, "base").filter("depth <= m").select("conv", "depth", "digest", "words")
    return own.unionByName(heads), plan.select("conv")
