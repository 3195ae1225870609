"""Benchmark items inside documents: size-partitioned MinHash containment search.

A short item has a low Jaccard similarity with a long document, so minima of whole documents cannot find it. Items
are partitioned by size (powers of two of their distinct shingles). For each size class that occurs, documents are
read in windows of one and a half times the class size at steps of half of it: an item's passage lies inside one of
them whole, and then shares at least a quarter of their union even at 80 % containment and half the class size. Each
of 48 minima then agrees with probability 1/4 or more, so a passage is passed over with probability 1e-6 at worst.
Any agreeing minimum makes a candidate; candidates are confirmed by exact containment of the item's shingle set in
the document's. Items of at most eight shingles are candidates wherever one of their shingles stands.

Items are the query set: they go to the tasks in blocks of about ``BLOCK`` shingles, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.bytehash import LOWER, SLICE, U64, row_sets, shingles, span_hashes, word_spans
from tallyweave.llm.common import released, slices, text_bytes
from tallyweave.llm.neardup import minima

MINIMA = 48
#: Item shingles that are sent to the tasks at once (8 bytes each).
BLOCK = 1 << 20
TINY = 8
_FILTER = np.uint32(0xFFFF)


class ItemBlock:
    """Items by size class, looked up by their minima."""

    def __init__(self, ids: list[int], words: list[int], sets: list[np.ndarray], n: int) -> None:
        self.ids, self.words, self.sets, self.n = ids, words, sets, n
        self.classes: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}
        for k, found in enumerate(sets):
            if not len(found):
                continue
            if words[k] < n:
                self.short.setdefault(words[k], []).append(k)
            elif len(found) > TINY:
                self.classes.setdefault(1 << (len(found) - 1).bit_length(), []).append(k)
        tiny = [k for k, found in enumerate(sets) if words[k] >= n and 0 < len(found) <= TINY]
        self.tiny = np.concatenate([np.zeros(0, U64), *(sets[k] for k in tiny)])
        order = np.argsort(self.tiny)
        self.tiny, self.tiny_of = self.tiny[order], np.repeat(tiny, [len(sets[k]) for k in tiny])[order]
        self.tables: dict[int, tuple] = {}

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each minimum: a bit map of low halves, the sorted values, and the items they belong to."""
        if size not in self.tables:
            at = self.classes[size]
            lens = np.array([len(self.sets[k]) for k in at])
            got = minima(np.concatenate([self.sets[k] for k in at]), np.cumsum(lens) - lens, MINIMA).T
            order = np.argsort(got, axis=1)
            seen = np.zeros((MINIMA, 1 << 16), bool)
            for k in range(MINIMA):
                seen[k, got[k] & _FILTER] = True
            self.tables[size] = seen, np.take_along_axis(got, order, 1), np.array(at)[order]
        return self.tables[size]

    def matches(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every item that a text contains to 80 %, by row and item."""
        raw = LOWER[raw]
        first, last, row = word_spans(raw, offs)
        words = span_hashes(raw, first, last)
        grams, of = shingles(words, row, self.n)
        candidates: set[tuple[int, int]] = set()
        if self.classes and len(grams):
            self._windows(grams, of, len(offs) - 1, candidates)
        if len(self.tiny):
            low, high = (np.searchsorted(self.tiny, grams, side) for side in ("left", "right"))
            for g in np.flatnonzero(high > low):
                candidates.update((int(of[g]), int(k)) for k in self.tiny_of[low[g]:high[g]])
        out, own, at = [], None, -1
        for r, k in sorted(candidates):
            if r != at:
                own, at = np.unique(grams[np.searchsorted(of, r):np.searchsorted(of, r + 1)]), r
            item = self.sets[k]
            shared = int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())
            if 100 * shared >= 80 * len(item):
                out.append((r, k, shared))
        for size, items in self.short.items():
            found, where = shingles(words, row, size)
            for k in items:
                out += [(int(r), k, 1) for r in np.unique(where[found == self.sets[k][0]])]
        return sorted(out)

    def _windows(self, grams: np.ndarray, of: np.ndarray, rows: int, candidates: set[tuple[int, int]]) -> None:
        begin = np.searchsorted(of, np.arange(rows))
        place = np.arange(len(of)) - begin[of]
        got = starts = owner = None
        step = 0
        for size in sorted(self.classes):
            if got is None:
                step = size // 2
                starts = np.flatnonzero(place % step == 0)
                owner, got = of[starts], minima(grams, starts, MINIMA)
            while step < size // 2:  # blocks of twice the length from pairs within a row
                step *= 2
                keep = np.flatnonzero(place[starts] % step == 0)
                got = np.minimum.reduceat(got, keep, axis=0)
                starts, owner = starts[keep], owner[keep]
            window = got.copy()
            for ahead in (1, 2):
                same = owner[ahead:] == owner[:-ahead]
                window[:-ahead][same] = np.minimum(window[:-ahead][same], got[ahead:][same])
            seen, values, items = self.table(size)
            for k in range(MINIMA):
                value = window[:, k]
                hit = np.flatnonzero(seen[k, value & _FILTER])
                low, high = (np.searchsorted(values[k], value[hit], side) for side in ("left", "right"))
                for w, a, b in zip(hit[high > low].tolist(), low[high > low], high[high > low], strict=True):
                    candidates.update((int(owner[w]), int(x)) for x in items[k, a:b])


def _item_sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            sets = row_sets(raw, offs, n)
            words = np.bincount(word_spans(raw, offs)[2], minlength=len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "words", "size", "shingles"])
    return run


def _blocks(items: DataFrame, n: int) -> Iterator[ItemBlock]:
    """Item sets in blocks of a bounded expected size."""
    sets = items.select("item_id", "text").mapInArrow(
        released(_item_sets(n)), "item_id long, words long, size long, shingles binary").filter("size > 0")
    total = sets.agg(F.sum("size")).first()[0] or 0
    count = -(-total // BLOCK)
    for k in range(count):
        rows = sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(count)) == k).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.shingles))
        yield ItemBlock([r.item_id for r in rows], [r.words for r in rows],
                        [np.frombuffer(bytes(r.shingles), U64) for r in rows], n)


def _found(batch: pa.RecordBatch, at: int, block: ItemBlock) -> list[tuple[int, int, int]]:
    raw, offs = text_bytes(batch.column(at))
    out = []
    for a, b in slices(offs, SLICE):
        out += [(a + r, k, s) for r, k, s in block.matches(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])]
    return out


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item whose distinct ``n``-word shingles stand
    to 80 % or more in a document.

    Words stand between ASCII white space and A-Z are lower-cased. An item of fewer words is found where its whole word
    sequence stands. Null, empty and blank texts match nothing; repeated rows match each for itself.
    """
    def run(block: ItemBlock) -> Callable:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _found(batch, 1, block)
                size = [len(block.sets[k]) for _, k, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _, _ in got], pa.int64())),
                     pa.array([block.ids[k] for _, k, _ in got], pa.int64()), pa.array(size, pa.int64()),
                     pa.array([s for _, _, s in got], pa.int64()),
                     pa.array([s / m for (_, _, s), m in zip(got, size, strict=True)], pa.float64())],
                    ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])
        return judge

    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for block in _blocks(items, n):
        part = docs.select("doc_id", "text").mapInArrow(released(run(block)), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item (as ``contained_items`` finds them)."""
    at = docs.columns.index("text")

    def run(block: ItemBlock) -> Callable:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in _found(batch, at, block)]] = False
                yield batch.filter(pa.array(clean))
        return judge

    for block in _blocks(items, n):
        docs = docs.mapInArrow(released(run(block)), T.StructType(docs.schema.fields))
    return docs


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: For items of five words or more.
SQL = rf"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(translate(text, {LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM texts
), grams AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM worded
), sizes AS (
  SELECT id, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM shared JOIN sizes ON id = item_id WHERE 100 * n_shared >= 80 * n
"""
