"""Text quality by a factorisation machine.

Features of a text: its words hashed to ``BUCKETS`` (share of the words, square-rooted and normalised) and structure
statistics with its length. The score is ``w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)`` through the
logistic function: all pairwise interactions of rank ``RANK`` in time linear in the features.

The model is fitted by AdaGrad on at most ``SAMPLE`` labelled texts, those with the smallest hash of their id; which
rows may be learned from is the caller's filter. All rows are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.bytehash import SLICE, U64, mix, span_hashes, word_spans
from tallyweave.llm.common import released, slices, text_bytes

BUCKETS, RANK = 4096, 8
#: Most labelled texts that a model is fitted on, and their bytes that are sent to the driver as features at most.
SAMPLE = 6000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-5
_KIND = np.zeros(256, np.int8)  # 0 white space and control, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol
_KIND[33:127] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 1
STATISTICS = ("words", "lower", "upper", "digit", "punctuation", "symbol", "word length", "long words", "distinct words",
              "repeated words", "one-character words", "lines", "bar words", "loud words", "empty")
WIDTH = BUCKETS + len(STATISTICS)


def _spread(row: np.ndarray, rows: int, value: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, value, rows)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: bounds of each row, columns and values; every row has all statistics."""
    rows = len(offs) - 1
    size = np.diff(offs)
    of = np.repeat(np.arange(rows), size)
    kind = _KIND[raw]
    shares = [_spread(of[kind == k], rows) / np.maximum(size, 1) for k in range(1, 6)]
    lines = _spread(of[raw == 10], rows) + (size > 0)
    first, last, row = word_spans(raw, offs)
    length = (last - first).astype(float)
    hashes = span_hashes(raw, first, last)
    count = _spread(row, rows)
    some = np.maximum(count, 1)
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    upper = np.concatenate(([0], np.cumsum(kind == 2)))
    loud = (upper[last] - upper[first]) * 2 > length
    bars = (length == 1) & (kind[first] == 5)

    order = np.lexsort((hashes, row))
    distinct = np.ones(len(row), bool)
    distinct[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    different = _spread(row[order][distinct], rows)

    key = row * BUCKETS + (mix(hashes) % U64(BUCKETS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    owner, column = key // BUCKETS, key % BUCKETS
    share = np.sqrt(times / some[owner])

    values = np.stack([
        np.log1p(count) / 8, *shares, _spread(row, rows, length) / some / 8, _spread(row[length > 16], rows) / some,
        different / some, _spread(row[again], rows) / some, _spread(row[length == 1], rows) / some,
        np.log1p(lines) / 5, _spread(row[bars], rows) / some, _spread(row[loud], rows) / some,
        (count == 0).astype(float)], axis=1)
    n = len(STATISTICS)
    bounds = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=rows) + n, out=bounds[1:])
    columns, out = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    at = bounds[owner] + n + np.arange(len(owner)) - (bounds[owner] - owner * n)
    columns[at], out[at] = column, share
    at = bounds[:-1, None] + np.arange(n)
    columns[at], out[at] = BUCKETS + np.arange(n), values
    return bounds, columns, out


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of rows that each have a feature, by sums and sums of squares."""
        at = bounds[:-1]
        linear = np.add.reduceat(self.weight[columns] * values, at)
        terms = self.factor[columns] * values[:, None]
        sums = np.add.reduceat(terms, at, axis=0)
        squares = np.add.reduceat(terms * terms, at, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """A machine from (columns, values, label) rows; without rows of both labels a constant one."""
    labels = np.array([r[2] for r in rows], float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(0)
    weight = np.zeros(WIDTH, np.float32)
    factor = rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)
    if not 0 < labels.sum() < len(labels):
        return Machine(bias, weight, np.zeros_like(factor))
    grown = [np.full(1, 1e-6), np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            chosen = [rows[k] for k in order[start:start + BATCH]]
            y = labels[order[start:start + BATCH]]
            columns = np.concatenate([c for c, _, _ in chosen])
            values = np.concatenate([v for _, v, _ in chosen])
            counts = [len(c) for c, _, _ in chosen]
            bounds = np.concatenate(([0], np.cumsum(counts)))
            terms = factor[columns] * values[:, None]
            sums = np.add.reduceat(terms, bounds[:-1], axis=0)
            squares = np.add.reduceat(terms * terms, bounds[:-1], axis=0)
            logit = bias + np.add.reduceat(weight[columns] * values, bounds[:-1]) + \
                0.5 * (sums * sums - squares).sum(axis=1)
            slope = (logistic(logit) - y) / len(y)
            each = np.repeat(slope, counts)
            used, back = np.unique(columns, return_inverse=True)
            step_w = np.bincount(back, each * values) + DECAY * weight[used]
            pull = (each * values)[:, None] * (np.repeat(sums, counts, axis=0) - terms)
            step_v = np.stack([np.bincount(back, pull[:, f]) for f in range(RANK)], axis=1) + DECAY * factor[used]
            grown[0] += slope.sum() ** 2
            grown[1][used] += step_w**2
            grown[2][used] += step_v**2
            bias -= float(RATE * slope.sum() / np.sqrt(grown[0][0]))
            weight[used] -= RATE * step_w / np.sqrt(grown[1][used])
            factor[used] -= RATE * step_v / np.sqrt(grown[2][used])
    return Machine(bias, weight, factor)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = text_bytes(batch.column(1))
        for a, b in slices(offs, SLICE):
            bounds, columns, values = features(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
            cut = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                 pa.ListArray.from_arrays(cut, pa.array(columns)), pa.ListArray.from_arrays(cut, pa.array(values))],
                ["doc_id", "label", "columns", "values"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on up to ``sample`` of the labelled rows (doc_id, quality) that are not held out.

    Rows without id or label are passed over; of several labels of an id the smallest counts, of several texts one (by
    hash), so that no more than ``sample`` rows reach the driver.
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` ids and labels
    one = F.min_by(F.struct("text"), F.xxhash64("text"))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id").agg(one["text"].alias("text"), F.first("label").alias("label"))
            .mapInArrow(released(_featured), "doc_id long, label int, columns array<int>, values array<float>"))
    table = rows.toArrow().combine_chunks().sort_by("doc_id")
    return fitted([(c.values.to_numpy(), v.values.to_numpy(), y) for c, v, y in zip(
        table["columns"], table["values"], table["label"].to_pylist(), strict=True)])


def _scores(batch: pa.RecordBatch, at: int, machine: Machine) -> np.ndarray:
    raw, offs = text_bytes(batch.column(at))
    out = [np.zeros(0)]
    for a, b in slices(offs, SLICE):
        out.append(logistic(machine.logits(*features(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]))))
    return np.concatenate(out)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null, empty and blank texts get the score of no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch, 1, machine).astype(float))],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, at, machine) >= least))

    return docs.mapInArrow(released(run), T.StructType(docs.schema.fields))
