"""Best-fit packing of tokenised documents by minimum bin slack.

Where a piece goes depends on its length only, and lengths are at most the
capacity, so the whole problem is a histogram of at most ``capacity`` rows.
For each bin a bitset subset-sum over the available lengths finds the fullest
feasible combination that holds the longest length left; it is used as often
as its lengths last and removed.  Every use ends a length's supply, so there
are few distinct patterns however many bins there are, and the plan (a bounded
table) is what tasks need to place their pieces.

A piece's rank among those of its length is its rank within the tokenising
task plus the counts of earlier tasks; no group of pieces is gathered.

Null and empty texts are documents of one end token.  Repeated rows are packed
each on its own; null ids stay null.  Columns other than the two named are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqlens.llm.common import released, slices, written

CAPACITY = 4096
END_ID = 1
# Words kept in a worker's memo.
MEMO_WORDS = 1_000_000
MEMO_WORD_BYTES = 64


class _Words:
    """Ids of words, worked out when first met.

    What is known is held in Arrow and numpy arrays, a few dozen bytes a word:
    the words, and where the ids of each begin in one array.  Beyond MEMO_WORDS
    it begins anew with the words at hand."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        # special strings are found in the text as it is, before it is lower-cased
        added = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = {s: array("I", [i]).tobytes() for s, i in added.items()}
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        tokenizer.encode_special_tokens = True  # what is lower-cased to one is none
        self.known = pa.array([], pa.binary())
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def packed(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text (binary; null is empty).

        Words are made distinct by Arrow, so each word of the batch is looked up
        once; the ids of all words are then gathered at one go."""
        texts = texts.fill_null(b"")
        odd = {}
        if self.pattern is not None:
            for k in np.flatnonzero(pc.match_substring(texts, b"<").to_numpy(zero_copy_only=False)).tolist():
                text = texts[k].as_py()
                if self.pattern.search(text):
                    odd[k] = [self.special.get(part) or part.lower().split() for part in self.pattern.split(text)]
        # the tokenizer lower-cases, so ASCII letters may be so before
        lowered = pc.ascii_lower(texts.cast(pa.string(), safe=False))
        lists = pc.ascii_split_whitespace(lowered)
        flat, ends = self.gathered(lists.flatten().cast(pa.binary()))
        words = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = ends[words]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        if odd:
            parts = [part for own in odd.values() for part in own if isinstance(part, list)]
            flat, ends = self.gathered(pa.array([w for part in parts for w in part], pa.binary()))
            bounds = ends[np.cumsum([0] + [len(part) for part in parts])].tolist()
            between = iter([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
            for k, own in odd.items():
                out[k] = b"".join(part if isinstance(part, bytes) else next(between) for part in own)
        return out

    def gathered(self, words: pa.Array) -> tuple[bytes, np.ndarray]:
        """Packed ids of all words in a row, and the byte at which each word's
        ids begin, with the end of the last."""
        coded = words.dictionary_encode()
        ids, starts, lengths = self.looked_up(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[which]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        total = int(ends[-1])
        kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        places = np.repeat((starts[which] - ends[:-1]).astype(kind), counts)
        places += np.arange(total, dtype=kind)
        return ids[places].tobytes(), 4 * ends

    def looked_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it those of each word begin and how
        many they are; words that were not known are so from here on."""
        at = pc.index_in(distinct, value_set=self.known)
        missing = pc.is_null(at)
        new = distinct.filter(missing)
        found = []
        for begin in range(0, len(new), 8192):
            part = [w.decode() for w in new.slice(begin, 8192).to_pylist()]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        more = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        ids = np.concatenate((self.ids, more))
        new_starts = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
        starts, lengths = np.concatenate((self.starts, new_starts)), np.concatenate((self.lengths, counts))
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        self.keep(new, ids, new_starts, counts, distinct, starts[place], lengths[place])
        return ids, starts[place], lengths[place]

    def keep(self, new, ids, new_starts, counts, distinct, all_starts, all_lengths) -> None:
        """Add the new words; beyond the bound begin anew with the words at hand."""
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known, self.ids = pa.array([], pa.binary()), np.empty(0, np.uint32)
            self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int32)
            new, new_starts, counts = distinct.slice(0, MEMO_WORDS), all_starts[:MEMO_WORDS], all_lengths[:MEMO_WORDS]
        short = pc.less_equal(pc.binary_length(new), MEMO_WORD_BYTES)
        new, few = new.filter(short), short.to_numpy(zero_copy_only=False)
        new_starts, counts = new_starts[few], counts[few]
        ends = np.cumsum(counts, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        own = ids[np.repeat(new_starts - (ends - counts), counts) + np.arange(total)]
        self.starts = np.concatenate((self.starts, len(self.ids) + ends - counts))
        self.lengths = np.concatenate((self.lengths, counts))
        self.ids = np.concatenate((self.ids, own))
        self.known = pa.concat_arrays([self.known, new])


_LOADED: dict[int, _Words] = {}


def _words(shared) -> _Words:
    from tokenizers import Tokenizer

    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Words(Tokenizer.from_str(shared.value))
    return _LOADED[key]


def pieces(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise whole texts and cut those longer than the capacity.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order; the tokenizer's special strings in a
    text are their own ids, as the library has it.  Rows: id, piece, start, length,
    ids_crc32, part and rank (the piece's number among those of its length in
    its task); ``with_ids`` adds the ids (binary, little-endian 32-bit).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # as large as the file
    end = array("I", [end_id]).tobytes()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared)
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                owner, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for k, packed in enumerate(words.packed(part.column(1))):
                    packed += end
                    for p, at in enumerate(range(0, len(packed), 4 * capacity)):
                        cut = packed[at : at + 4 * capacity]
                        n = len(cut) // 4
                        owner.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(cut))
                        rank.append(int(seen[n]))
                        seen[n] += 1
                        if with_ids:
                            ids.append(cut)
                cols = [
                    part.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([number] * len(owner), pa.int32()),
                    pa.array(rank, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return rows.mapInArrow(released(run), schema + ", ids binary" * with_ids)


def fullest(supply: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The fullest combination of (length, copies) within ``room``: bitset
    subset-sum with bounded copies, ended early once the room is full."""
    reach, states, used = 1, [], []
    mask = (1 << (room + 1)) - 1
    for length, count in supply:
        if length > room:
            continue
        states.append(reach)
        used.append((length, count))
        left, step = min(count, room // length), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> room:
            break
    target = reach.bit_length() - 1
    chosen = []
    for (length, count), before in zip(reversed(used), reversed(states)):
        copies = 0
        while not (before >> target) & 1:
            target -= length
            copies += 1
        if copies:
            chosen.append((length, copies))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Slots by length: (first rank, first bin, copies a bin, offset), and the
    number of bins.  Ranks of a length from ``first rank`` on fill ``copies``
    places in each bin from ``first bin`` on, until the next slot begins."""
    left = {k: n for k, n in histogram.items() if n > 0}
    slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in left}
    given = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    bins = 0
    while lengths:
        longest = lengths[0]
        supply = [(k, left[k] - (k == longest)) for k in lengths if k <= capacity - longest and left[k] > (k == longest)]
        pattern = dict(fullest(supply, capacity - longest))
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            m = pattern[k]
            slots[k].append((given[k], bins, m, offset))
            offset += m * k
            given[k] += m * times
            left[k] -= m * times
        bins += times
        lengths = [k for k in lengths if left[k]]
    return slots, bins


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place the rows of a written table of ``pieces``: adds sequence_id and
    offset.  Sequences are filled without gaps from offset 0."""
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    # at most one row for each length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan_bins(histogram, capacity)
    # a bin's pattern has under 91 different lengths (1 + ... + 91 > 4096) and each
    # pattern ends a length's supply, which bounds this table
    shared = cut.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in slots.items()})
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    first = written(first, "packing-ranks")
    columns = [c for c in cut.columns if c not in ("part", "rank")]
    ranked = cut.join(first, ["part", "length"]).select(*columns, (F.col("before") + F.col("rank")).alias("rank"))
    at = columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(columns)).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                begin, bins, copies, base = shared.value[int(length[own[0]])]
                k = np.searchsorted(begin, rank[own], side="right") - 1
                nth = rank[own] - begin[k]
                sequence[own] = bins[k] + nth // copies[k]
                offset[own] = base[k] + nth % copies[k] * length[own]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(sequence), pa.array(offset)], names=columns + ["sequence_id", "offset"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(released(run), schema + ", sequence_id long, offset long")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise, cut and place documents: one row per piece with ``id_col``,
    piece, start, length, ids_crc32, (ids,) sequence_id and offset."""
    cut = written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "packing-pieces")
    return place(cut, capacity).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, length
    and ids; a sequence holds at most the capacity, so a group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.unhex(F.concat_ws("", F.col("parts.ids"))).alias("ids")
    )
