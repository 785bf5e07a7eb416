"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters (WIDTH bytes wide, as one table a tap from byte to FILTERS
values) slide over all bytes of a text.  The text is covered by chunks of two
strides that overlap by one; each filter is max-pooled within a chunk, and the
greatest, mean and least pooled values over the chunks combine into one
probability that the quality label is 1.

The network is fitted on the driver from at most TRAIN_DOCS labelled documents
(those first by a hash of their id) with at most TRAIN_CHUNKS evenly spread
chunks each; this bounded sample is the only part that doesn't see all data.
Scoring reads every byte.  Labels are learned only from the training fold:
rows with crc32(id as text) mod FOLDS other than 0.

Null texts count as empty, which is scored like any other text; rows without
an id are scored and not held out; repeated rows each get a row.  Labels
without an id or value are ignored, repeated ones are averaged.  If the labels
don't hold both classes every score is their smoothed mean (0.5 without any).
Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import released, slices

WIDTH, FILTERS, STRIDE = 6, 16, 128
TRAIN_DOCS, TRAIN_CHUNKS = 3000, 8
EPOCHS, BATCH, RATE = 12, 64, 0.01
FOLDS = 5
THRESHOLD = 0.3
SLICE = 1 << 20
POSITIONS = 1 << 14  # positions whose filter values are held at a time


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (3 * FILTERS,)
    offset: float

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Max of each filter within every chunk of every text, and the chunks
        of each text."""
        valid = np.array([max(1, len(t) - WIDTH + 1) for t in texts], np.int64)
        blocks = -(-(valid + WIDTH - 1) // STRIDE)
        first = np.concatenate(([0], np.cumsum(blocks)))
        data = np.zeros(int(first[-1]) * STRIDE + WIDTH, np.uint8)
        live = np.zeros(int(first[-1]) * STRIDE, bool)
        for t, at, n in zip(texts, (first[:-1] * STRIDE).tolist(), valid.tolist()):
            data[at : at + len(t)] = np.frombuffer(t, np.uint8)
            live[at : at + n] = True
        top = np.empty((int(first[-1]), FILTERS), np.float32)
        values, term = (np.empty((POSITIONS, FILTERS), np.float32) for _ in range(2))
        for begin in range(0, len(live), POSITIONS):
            size = min(POSITIONS, len(live) - begin)
            np.take(self.taps[0], data[begin : begin + size], axis=0, out=values[:size])
            for k in range(1, WIDTH):
                np.take(self.taps[k], data[begin + k : begin + k + size], axis=0, out=term[:size])
                values[:size] += term[:size]
            values[:size][~live[begin : begin + size]] = -1e9
            top[begin // STRIDE : (begin + size) // STRIDE] = values[:size].reshape(-1, STRIDE, FILTERS).max(axis=1)
        # the last block may hold only the ends of the last windows
        blocks = -(-valid // STRIDE)
        used = np.arange(int(first[-1])) - np.repeat(first[:-1], np.diff(first)) < np.repeat(blocks, np.diff(first))
        top = top[used]
        first = np.concatenate(([0], np.cumsum(blocks)))
        # a chunk is two neighbouring blocks of a text; a text of one block is one chunk
        chunks = np.maximum(blocks - 1, 1)
        joined = np.concatenate([np.maximum(top[:-1], top[1:]), top[-1:]])
        joined[first[:-1][blocks == 1]] = top[first[:-1][blocks == 1]]
        keep = np.ones(len(top), bool)
        keep[first[1:][blocks > 1] - 1] = False
        return np.maximum(joined[keep] + self.bias, 0), chunks

    def features(self, texts: list[bytes]) -> np.ndarray:
        pooled, chunks = self.pooled(texts)
        first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        mean = np.add.reduceat(pooled, first, axis=0) / chunks[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, first, axis=0), mean, np.minimum.reduceat(pooled, first, axis=0)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = self.features(texts).astype(np.float64) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train_chunks(text: bytes | None, most: int = TRAIN_CHUNKS) -> list[bytes]:
    """At most ``most`` evenly spread chunks of a text."""
    text = text or b""
    blocks = -(-max(1, len(text) - WIDTH + 1) // STRIDE)
    starts = np.unique(np.linspace(0, max(blocks - 2, 0), num=min(most, max(blocks - 1, 1))).astype(int))
    return [text[s * STRIDE : (s + 2) * STRIDE + WIDTH - 1] for s in starts.tolist()]


def fit(samples: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit the network by Adam on the log loss; a max-pooled value passes its
    gradient to the one window that gave it."""
    rng = np.random.default_rng(seed)
    mean = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(3 * FILTERS),
        float(np.log(mean / (1 - mean))),
    )
    if len(set(labels.tolist())) < 2:
        return net
    size = 2 * STRIDE
    chunks = [c for s in samples for c in s]
    owner = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    data = np.zeros((len(chunks), size + WIDTH - 1), np.uint8)
    valid = np.array([max(1, len(c) - WIDTH + 1) for c in chunks])
    for i, c in enumerate(chunks):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
    net.weight = rng.normal(0, 0.1, 3 * FILTERS)
    params = [net.taps, net.bias, net.weight, np.array([net.offset])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # the rarer class counts by the root of the ratio: its rows are what the
    # threshold has to catch, the score stays a probability of either class
    ones = labels.mean()
    cost = np.where(labels == 1, 1.0, np.sqrt(ones / (1 - ones)))
    cost /= cost.mean()
    step, rows_of = 0, np.searchsorted(owner, np.arange(len(samples) + 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rows = np.concatenate([np.arange(rows_of[d], rows_of[d + 1]) for d in docs])
            counts = rows_of[docs + 1] - rows_of[docs]
            x, begin = data[rows], np.concatenate(([0], np.cumsum(counts)[:-1]))
            values = params[0][0][x[:, :size]]
            for k in range(1, WIDTH):
                values += params[0][k][x[:, k : k + size]]
            values[np.arange(size)[None, :] >= valid[rows][:, None]] = -1e9
            where = values.argmax(axis=1)  # (chunks, FILTERS)
            raw = np.take_along_axis(values, where[:, None, :], 1)[:, 0, :] + params[1]
            pooled = np.maximum(raw, 0)
            parts = [[pooled[b : b + c].argmax(axis=0), pooled[b : b + c].argmin(axis=0)] for b, c in zip(begin, counts)]
            hi = np.array([p[0] for p in parts]) + begin[:, None]
            lo = np.array([p[1] for p in parts]) + begin[:, None]
            f = np.arange(FILTERS)
            feats = np.concatenate([pooled[hi, f], np.add.reduceat(pooled, begin, axis=0) / counts[:, None], pooled[lo, f]], axis=1)
            z = feats @ params[2] + params[3][0]
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[docs]) * cost[docs] / len(docs)
            d_feats = error[:, None] * params[2]
            d_pool = np.repeat(d_feats[:, FILTERS : 2 * FILTERS] / counts[:, None], counts, axis=0)
            np.add.at(d_pool, (hi, f), d_feats[:, :FILTERS])
            np.add.at(d_pool, (lo, f), d_feats[:, 2 * FILTERS :])
            d_pool[raw <= 0] = 0
            d_taps = np.zeros_like(params[0])
            for k in range(WIDTH):
                byte = np.take_along_axis(x, where + k, 1)
                np.add.at(d_taps[k], (byte, np.broadcast_to(f, byte.shape)), d_pool)
            grads = [d_taps, d_pool.sum(axis=0), feats.T @ error, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    net.offset = float(params[3][0])
    return net


def fold(id_col: str | Column) -> Column:
    """Remainder of crc32 of the id as text; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % FOLDS


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most: int = TRAIN_DOCS,
) -> Network:
    """Fit on at most ``most`` labelled documents of the training fold."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .filter("id is not null and label is not null")
        .filter(fold("id") != 0)
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    # labels may name documents that are not in this table: only those here count
    here = known.join(texts.select("id").distinct(), "id", "left_semi")
    chosen = here.orderBy(F.xxhash64("id"), "id").limit(most)  # bounds the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                cut = [train_chunks(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut, pa.list_(pa.binary()))], names=["id", "label", "chunks"])

    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(released(run), f"id {kind}, label int, chunks array<binary>")
    # rows that repeat an id: one of them
    found = found.groupBy("id").agg(F.min(F.struct("label", "chunks")).alias("s")).select("id", "s.label", "s.chunks")
    sample = sorted(found.collect(), key=lambda r: str(r["id"]))
    return fit([[bytes(c) for c in r["chunks"]] for r in sample], np.array([r["label"] for r in sample], np.float64))


def _scores(net: Network, texts: pa.Array) -> np.ndarray:
    return net.score([t or b"" for t in texts.to_pylist()])


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(net, part.column(1)))], names=["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score THRESHOLD or more, with all their columns;
    no row is shuffled."""
    names = df.columns
    schema = df.schema
    scored = "_" * (1 + max(map(len, names), default=0))  # no column is named so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), SLICE):
                good = _scores(net, part.column(len(names))) >= THRESHOLD
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(pa.array(good))

    whole = df.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").cast("binary").alias(scored))
    return whole.mapInArrow(released(run), schema)
