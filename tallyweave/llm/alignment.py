"""Alignment of two tokenizers over the same texts by diagonal run skipping.

Tokens of both sides end at byte offsets of the same text. Where A and B tokens both end, a group ends. Ends are
compared at the current index shift: blocks of 1, 2, 4, … ends of A and B that are equal are one-to-one groups and are
jumped over at once; a block that differs is halved down to the first difference. There the smaller end is moved on
until both sides meet again, which closes one irregular group and sets a new shift.

No token of either side reaches over a single space between two other characters, so texts are encoded word by word:
words met before are looked up, new ones are encoded and checked once. The table of words is bounded and starts anew
when it is full.

A token pair is linked where its byte ranges overlap. Counts of linked id pairs are added up per slice of text before
they meet, so a pair that stands in every document brings one row per slice. Back at its slice a count meets the
documents by their place in the slice's list of pairs; no link is ever a row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import released, slices, stored, text_bytes

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SLICE, STRETCH = 1 << 20, 1 << 20
WORDS, LETTERS = 200_000, 1 << 22  # most words and characters of the table
SPACE = "▁"
#: Fixed value: how a byte-level BPE divides a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile(r"[^\x00-\u024F]")  # where engines could know different versions of Unicode
_CUT = re.compile(r"(?<=\S) (?=\S)")

SPANS = "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, group_bytes array<long>"
SLICED = ("slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, pairs array<long>, times array<long>, cut binary, doc binary, linked binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places after the last A and the last B token of every group; both lists ascend and have the same last end."""
    out_a, out_b, i, j, n = [], [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            first_i, first_j, step = i, j, 1
            while i < n and a[i:i + step] == b[j:j + step]:
                i, j, step = min(i + step, n), min(j + step, len(b)), 2 * step
            while step > 1:
                step //= 2
                if i + step <= n and a[i:i + step] == b[j:j + step]:
                    i, j = i + step, j + step
            out_a.extend(range(first_i + 1, i + 1))
            out_b.extend(range(first_j + 1, j + 1))
            if i == n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out_a.append(i)
        out_b.append(j)
    return out_a, out_b


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of about ``size`` characters, cut between words. A text without single spaces is one part and one word."""
    start = 0
    while found := _CUT.search(text, start + size):
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


def _gathered_runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``values`` end to end."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizers:
    """Both encoders, and the bytes of every token."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up in their order
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(c): c for c in own}
        shown |= {chr(0x100 + k): c for k, c in enumerate(sorted(set(range(256)) - set(own)))}
        assert isinstance(self.a.decoder, decoders.ByteLevel)
        size = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(k) or "" for k in range(size)]
        self.a_bytes = [bytes(shown[c] for c in name) if all(c in shown for c in name) else name.encode() for name in names]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
                        for k, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.fast = self._fast_engine(a_file)
        rows = [b"%d" % k for k in range(max(size, len(pieces)))]
        self.width = len(rows)
        #: decimal ids before a comma, a bar and a semicolon
        self.written = np.array([r + mark for mark in (b",", b"|", b";") for r in rows], object)
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.words: dict[str, int] = {}
        self.letters = 0
        self.known = [array("i"), array("i")]  # ids of all words end to end, A and B
        self.from_ = [array("q", [0]), array("q", [0])]  # where each word's ids begin
        self.fits = array("b")  # whether both sides' bytes are the word after a space

    def _a_ids(self, words: list[str]) -> list[list[int]]:
        """A's ids of every word after a space; plain Latin words go through the faster engine over the same merges."""
        out: list = [self.fast(" " + w) if self.fast and not _BEYOND.search(w) else None for w in words]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, e in zip(rest, self.a.encode_batch_fast([" " + words[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def _fast_engine(self, a_file: str):
        """An engine that merges by rank, if this file's merges are in the order of their ids."""
        import tiktoken

        with open(a_file, encoding="utf-8") as source:
            model = json.load(source)["model"]
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or model.get("dropout") or model.get("ignore_merges"):
            return None
        ranks = {self.a_bytes[k]: k for k in vocab.values() if k not in self.a.get_added_tokens_decoder()}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _learn(self, new: list[str]) -> None:
        sides = self._a_ids(new), self.b.encode(new, num_threads=1)
        whole = [(" " + w).encode() for w in new]
        ends = np.cumsum([len(w) for w in whole])
        fits = np.ones(len(new), bool)
        for known, starts, names, lengths, ids in zip(self.known, self.from_, (self.a_bytes, self.b_bytes), (self.a_len, self.b_len), sides, strict=True):
            flat = list(chain.from_iterable(ids))
            upto = np.cumsum([len(k) for k in ids])
            bytes_to = np.concatenate(([0], np.cumsum(lengths[flat])))[upto]
            if (bytes_to != ends).any() or b"".join(map(names.__getitem__, flat)) != b"".join(whole):
                fits &= [b"".join(map(names.__getitem__, k)) == w for k, w in zip(ids, whole, strict=True)]
            starts.extend((upto + len(known)).tolist())
            known.extend(flat)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.letters += sum(map(len, new))
        self.fits.extend(fits.tolist())

    def _runs(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of all texts in runs of about a stretch, and the text of each word."""
        words, of, size = [], [], 0
        for k, text in enumerate(texts):
            for part in stretches(text) if text else ():
                found = _CUT.split(part)
                words += found
                of.append((k, len(found)))
                size += len(part)
                if size >= STRETCH:
                    yield words, np.repeat(*np.array(of).T)
                    words, of, size = [], [], 0
        if words:
            yield words, np.repeat(*np.array(of).T)

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of A and of B of all texts end to end, and how many of each a text has: none where the bytes of either
        side are not the text after a space."""
        ids, counts, bad = ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)]), np.zeros((2, len(texts)), np.int64), np.zeros(len(texts), bool)
        for words, of in self._runs(texts):
            if new := [w for w in dict.fromkeys(words) if w not in self.words]:
                self._learn(new)
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            bad[of[np.array(self.fits)[at] == 0]] = True
            for side in (0, 1):
                starts = np.array(self.from_[side])
                n = starts[at + 1] - starts[at]
                ids[side].append(_gathered_runs(np.array(self.known[side]), starts[at], n))
                counts[side] += np.bincount(of, n, len(texts)).astype(np.int64)
            if len(self.words) > WORDS or self.letters > LETTERS:
                self.clear()
        joined = [np.concatenate(parts) for parts in ids]
        if bad.any():
            joined = [found[~np.repeat(bad, n)] for found, n in zip(joined, counts, strict=True)]
            counts[:, bad] = 0
        return joined, counts

@lru_cache(maxsize=1)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


class Aligned:
    """The texts of one slice, encoded and aligned. Tokens of all texts stand end to end, ends are bytes of the slice."""

    def __init__(self, both: Tokenizers, texts: list[str]) -> None:
        (a, b), (self.n_a, self.n_b) = both.encoded(texts)
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.a_ends, self.b_ends = np.cumsum(both.a_len[self.a]), np.cumsum(both.b_len[self.b])
        ends = group_ends(self.a_ends.tolist(), self.b_ends.tolist())
        self.group_a, self.group_b = (np.array(e, np.int64) for e in ends)
        self.after_a = np.cumsum(self.n_a)
        self.groups_to = np.searchsorted(self.group_a, self.after_a, side="right")  # groups up to each text's end

    def written(self, both: Tokenizers) -> list[str]:
        """Per text the digest of ``a1,a2|b1;…`` over its groups; empty without tokens."""
        n, m = len(self.a), len(self.b)
        order = np.empty(n + m, np.int64)
        last = np.zeros(n, bool)
        last[self.group_a - 1] = True
        of = np.cumsum(last) - last  # group of each A token
        order[np.arange(n) + np.concatenate(([0], self.group_b[:-1]))[of]] = self.a + last * both.width
        last = np.zeros(m, bool)
        last[self.group_b - 1] = True
        of = np.cumsum(last) - last
        order[np.arange(m) + self.group_a[of]] = self.b + last * 2 * both.width
        ends = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(both.written[order[s:e]].tolist())[:-1]).hexdigest() if e > s else ""
                for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Id pair (A in the upper half) and text of every overlap: one for each byte range that no token end divides."""
        if not len(self.a):
            return self.a, self.a
        size = int(self.a_ends[-1]) + 1
        in_a, in_b = np.zeros(size, np.int32), np.zeros(size, np.int32)
        in_a[self.a_ends], in_b[self.b_ends] = 1, 1
        ends = np.flatnonzero(in_a | in_b)
        i, j = np.cumsum(in_a, dtype=np.int32)[ends - 1], np.cumsum(in_b, dtype=np.int32)[ends - 1]  # tokens that end before
        owner = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return self.a[i] << 32 | self.b[j], owner[i]


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    _, offs = text_bytes(batch.column(1))
    for s, e in slices(offs, SLICE):
        part = batch.slice(s, e - s)
        yield part, [t or "" for t in part.column(1).to_pylist()]


def _spans(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_file, b_file)
        for batch in batches:
            for part, texts in _text_slices(batch):
                got = Aligned(both, texts)
                a, b, g = (np.concatenate(([0], x)) for x in (got.after_a, np.cumsum(got.n_b), got.groups_to))
                rows = np.repeat(np.arange(len(texts)), np.diff(g))
                ends = got.a_ends[got.group_a - 1]
                base = np.concatenate(([0], got.a_ends))[a[:-1]]
                lists = [(a, got.a, pa.int32()), (b, got.b, pa.int32()), (g, got.group_a - a[rows], pa.int32()),
                         (g, got.group_b - b[rows], pa.int32()), (g, ends - base[rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind)) for cuts, values, kind in lists)],
                    ["doc_id", "a_ids", "b_ids", "group_a", "group_b", "group_bytes"])
    return run


def _sliced(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers(a_file, b_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in _text_slices(batch):
                got = Aligned(both, texts)
                pair, doc = got.links()
                order = np.argsort(pair, kind="stable")  # texts ascend within a pair
                pair, doc = pair[order], doc[order]
                new_pair = np.append(True, pair[1:] != pair[:-1])[:len(pair)]
                new = new_pair | np.append(True, doc[1:] != doc[:-1])[:len(pair)]
                at = np.flatnonzero(new)
                linked = np.diff(np.append(at, len(pair)))
                starts = np.flatnonzero(new_pair)
                n_groups = np.diff(got.groups_to, prepend=0)
                one = {"slice": number, "doc_id": part.column(0).to_pylist(), "n_a": got.n_a, "n_b": got.n_b, "n_groups": n_groups,
                       "n_links": got.n_a + got.n_b - n_groups, "groups_sha256": got.written(both), "pairs": pair[starts],
                       "times": np.diff(np.append(starts, len(pair))),
                       "cut": np.append(np.searchsorted(at, starts), len(at)).astype(np.int32).tobytes(),
                       "doc": doc[at].astype(np.int32).tobytes(), "linked": linked.astype(np.int32).tobytes()}
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([v], pa.list_(pa.string() if k == "groups_sha256" else pa.int64()) if isinstance(v, (list, np.ndarray))
                             else None) for k, v in one.items()], list(one))
    return run


def _gathered(sliced: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one slice, with the counts of the slice's pairs (pos, count, best) added up over their links."""
    columns = {name: sliced.column(name).combine_chunks().flatten()
               for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    cut, doc, linked = (np.frombuffer(sliced.column(name)[0].as_buffer(), np.int32) for name in ("cut", "doc", "linked"))
    pos = counts.column("pos").to_numpy()
    count, best = np.zeros(len(cut) - 1, np.int64), np.zeros(len(cut) - 1, np.int64)
    count[pos], best[pos] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    each = np.diff(cut)
    sums = [np.zeros(len(columns["doc_id"]), np.int64) for _ in range(2)]
    for total, values in zip(sums, (best, count), strict=True):
        np.add.at(total, doc, linked * np.repeat(values, each))
    columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table({name: columns[name] for name in (f.split()[0] for f in RESULT.split(", "))})


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ids of both sides and, per group, the places after its last A and B
    token and its last byte (of the text after one space). Null, empty and differing texts have empty lists."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_spans(a_file, b_file)), SPANS)


def pair_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(a_id, b_id, count): how many links of all ``docs`` hold the pair."""
    return _counted(_stored_slices(docs, a_file, b_file)).select(
        F.expr("shiftright(pair, 32)").alias("a_id"), F.expr("pair & 4294967295").alias("b_id"), "count")


def _stored_slices(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_sliced(a_file, b_file)), SLICED))


def _counted(sliced: DataFrame) -> DataFrame:
    return (sliced.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair"))
            .agg(F.sum("times").alias("count")))


def summed(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): tokens of both sides, groups, links, links whose pair is the most
    counted of its B id (ties included), the sum of pair counts over links, and the digest of the groups.

    A is a byte-level BPE (tokenizers' JSON), B a SentencePiece model that puts a space before a text, without other
    changes. Texts that are null or empty, or whose joined token bytes on either side are not the text after one space
    (a text's own U+2581, for one), have no tokens: zeros and an empty digest. Repeated rows, and rows without id, count
    and are returned each. Other columns are ignored. Very long texts are encoded in stretches.
    """
    sliced = _stored_slices(docs, a_file, b_file)
    counts = stored(_counted(sliced))
    b_id = F.expr("pair & 4294967295").alias("b_id")
    best = counts.groupBy(b_id).agg(F.max("count").alias("highest"))  # as many rows as B has ids
    known = (counts.withColumn("b_id", b_id).join(F.broadcast(best), "b_id")
             .select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best")))
    placed = (sliced.select(F.col("slice").alias("of"), F.posexplode("pairs").alias("pos", "pair")).join(known, "pair")
              .select("of", "pos", "count", "best"))
    return (sliced.drop("pairs", "times").groupBy("slice").cogroup(placed.groupBy("of"))
            .applyInArrow(_gathered, RESULT))
