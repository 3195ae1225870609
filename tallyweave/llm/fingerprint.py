"""Document fingerprints from content-defined chunks.

A rolling gear hash over 32 bytes proposes cuts; they are normalised: a strict test up to the usual chunk size, a
loose one after it, between a least and a greatest size. A cut depends on the bytes before it only, so an insertion
moves the chunks behind it but changes few of them. The fingerprint is the sorted list of chunk digests with the
number of bytes each covers; ``containment`` of one in another is the share of its bytes whose chunks the other has.

Null texts count as empty. An empty text has an empty fingerprint; it is contained in an empty one only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.bytehash import SLICE, U64, mix, span_hashes
from tallyweave.llm.common import released, stored

LEAST, USUAL, MOST = 32, 96, 320
STRICT, LOOSE = np.uint32(24), np.uint32(27)
GEAR = (mix(np.arange(1, 257, dtype=U64) << U64(17)) >> U64(32)).astype(np.uint32)
RECORD = np.dtype([("digest", ">u8"), ("bytes", ">u4")])
Fingerprint = tuple[np.ndarray, np.ndarray]


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling the window."""
    acc = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        acc[width:] += acc[:-width] << np.uint32(width)
    return acc


def chunk_ends(raw: np.ndarray, offs: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of the chunks of every row, and how many each row has."""
    acc = gear_hashes(raw)
    loose = np.flatnonzero(acc >> LOOSE == 0)
    strict = loose[acc[loose] >> STRICT == 0].tolist()
    loose = loose.tolist()
    ends, counts, i, j = [], [], 0, 0
    for pos, end in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        before = len(ends)
        while pos < end:
            last = min(pos + MOST, end) - 1
            i = bisect_left(strict, pos + LEAST - 1, i)
            if i < len(strict) and strict[i] < min(pos + USUAL - 1, last):
                last = strict[i]
            else:
                j = bisect_left(loose, pos + USUAL - 1, j)
                if j < len(loose) and loose[j] < last:
                    last = loose[j]
            pos = last + 1
            ends.append(pos)
        counts.append(len(ends) - before)
    return ends, counts


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    """Sorted distinct chunk digests of each text and the bytes that each covers."""
    raw, offs = _joined(texts)
    ends, counts = chunk_ends(raw, offs)
    ends = np.array(ends, np.int64)
    starts = np.concatenate((ends[:0], [0], ends[:-1])) if len(ends) else ends
    digest = span_hashes(raw, starts, ends)
    row = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((digest, row))
    digest, row, size = digest[order], row[order], (ends - starts)[order]
    new = np.ones(len(order), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    size = np.add.reduceat(size, at) if len(at) else size
    digest, cut = digest[at], np.searchsorted(row[at], np.arange(len(texts) + 1))
    return [(digest[a:b], size[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def packed(print_: Fingerprint) -> bytes:
    out = np.empty(len(print_[0]), RECORD)
    out["digest"], out["bytes"] = print_
    return out.tobytes()


def unpacked(data: bytes) -> Fingerprint:
    got = np.frombuffer(data, RECORD)
    return got["digest"].astype(U64), got["bytes"].astype(np.int64)


def containment(one: Fingerprint, other: Fingerprint) -> float:
    """Share of the first text's bytes in chunks that the other has as well, each as often as both have it."""
    if not len(one[0]):
        return float(not len(other[0]))
    if not len(other[0]):
        return 0.0
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    return float(np.minimum(one[1][i], other[1][j]).sum() / one[1].sum())


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many of the next text's first, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, " \
         "near_next double"
KEPT = RESULT + ", part int, edge string, text string"


def _judged(ids: list, texts: list[str]) -> dict[str, list]:
    """Result columns of all texts but the last, which only is the next of the one before it."""
    other = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    own = fingerprints([t.encode() for t in texts])
    theirs = fingerprints(other)
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in other],
        "print": [packed(p) for p in own[:-1]], "edited_print": [packed(p) for p in theirs],
        "near_edited": [containment(a, b) for a, b in zip(own, theirs, strict=False)],
        "near_next": [containment(a, b) for a, b in zip(own, own[1:], strict=False)],
    }


_TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "print": pa.binary(),
          "edited_print": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(),
          "edge": pa.string(), "text": pa.string()}


def _batch(columns: dict[str, list], names: Iterable[str]) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(k, [None] * n), _TYPES[k]) for k in names], list(names))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: all but its last have their next here; first and last go out with their texts."""
    part, ids, texts, size, first = TaskContext.get().partitionId(), [], [], 0, None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            first = first or (doc_id, text)
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > SLICE // 2 and len(ids) > 1:
                yield _batch(_judged(ids, texts), _TYPES)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
    if ids:
        if len(ids) > 1:
            yield _batch(_judged(ids, texts), _TYPES)
        yield _batch({"doc_id": [first[0], ids[-1]], "text": [first[1], texts[-1]], "part": [part] * 2,
                      "edge": ["first", "last"]}, _TYPES)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [k for k in _TYPES if k not in ("part", "edge", "text")]
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield _batch(_judged([doc_id, None], [text, following]), names)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and both likenesses.

    Rows stand in descending doc_id, equal ids by a hash of the text, null ids last; the row after the last is the first. They are
    range-partitioned and sorted; the last row of a partition meets the first of the next in a small join. A single
    row is its own next. No rows give none.
    """
    rows = docs.select("doc_id", "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(_neighbours), KEPT))
    firsts = kept.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = kept.filter("edge = 'last'").select("doc_id", "text", "part")
    parts = kept.filter("edge = 'first'").select("part").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    # one number per partition: which partition follows which, skipping empty ones
    following = parts.select(F.posexplode("parts").alias("at", "part"), "parts").select(
        "part", F.col("parts")[(F.col("at") + 1) % F.size("parts")].alias("next_part"))
    ends = lasts.join(following, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")
    inner = kept.filter("edge IS NULL").select([c.split()[0] for c in RESULT.split(", ")])
    return inner.unionByName(ends.mapInArrow(released(_pairs), RESULT)).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
