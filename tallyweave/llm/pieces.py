"""Sampled SentencePiece segmentations without replacement, and decoding.

Every text has a lattice of pieces. Forward sums give each choice (which piece ends here) its exact conditional
probability, so a segmentation can be drawn backwards. The ``k`` best segmentations under Gumbel-perturbed
log-probabilities are a sample without replacement. They come from a best-first search whose bounds are themselves
perturbed: the space without a drawn segmentation falls apart by the first choice that differs; the best of each part
is a Gumbel variable of the part's mass, cut off at the score just drawn. The part with the highest one is entered,
the rest of its path is drawn, and it is divided in turn. All randomness comes from the row's key.

The lattice falls apart where no piece can reach across (before a space after another character, around characters
that stand in no longer piece), so equal stretches of a batch share one lattice and all are drawn in step.

A U+2581 of a text's own is spelled in bytes, because its piece stands for a space; so decoding gives back every text.

``log_inclusion`` is the logarithm of ``1 - exp(-exp(log_prob - next))`` with ``next`` the score of the first
segmentation left out: the probability that this one is among those taken, given that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.bytehash import U64, from_sums, mix, prefix_sums
from tallyweave.llm.common import released, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
LITERAL = 0xD800  # stands for a text's own U+2581 in a lattice; no text holds a surrogate
SLICE = 1 << 19
_FILTER = U64((1 << 20) - 1)
_STEP, _DRAW = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


class Vocabulary:
    """Pieces by hash, with log-probabilities.

    A unigram model's scores are log-probabilities. Those of a BPE model only rank its pieces; they are taken as
    Zipf's law over the ranks. A character without a piece becomes its bytes, each as likely as the last piece.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(reader.vocab_size())
        self.pieces = [reader.id_to_piece(i) for i in ids]
        self.bytes_at = [reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        usual = [i for i in ids if not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i)
                                        or reader.is_unused(i))]
        score = np.array([reader.get_score(i) for i in usual])
        if len(score) and (score == np.round(score)).all():  # ranks of merges
            rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
            score = -np.log(rank + 10.0)
            score -= np.log(np.exp(score).sum())
        self.byte_score = float(score.min()) if len(score) else 0.0
        points = [np.array([ord(c) for c in self.pieces[i]], np.uint32) for i in usual]
        flat = np.concatenate(points)
        ends = np.cumsum([len(p) for p in points])
        starts = ends - [len(p) for p in points]
        self.longest = int((ends - starts).max())
        sums = prefix_sums(mix(flat.astype(U64)))
        hashes = from_sums(sums, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.scores = hashes[order], np.array(usual, np.int32)[order], score[order]
        # pieces by 20 bits of their hash, and by 20 other bits those that share the first; few are left for a search
        place = np.arange(len(self.hashes), dtype=np.int32)
        self.slots = []
        for shift in (0, 20):
            slot = np.full(1 << 20, -1, np.int32)
            key = (self.hashes[place] >> U64(shift) & _FILTER).astype(np.int64)
            slot[key[::-1]] = place[::-1]
            place = place[slot[key] != place]
            self.slots.append(slot)
        self.crowded = self.hashes[place]
        self.single = np.zeros(0x110000, bool)  # characters that are a piece
        self.inner = np.zeros(0x110000, bool)  # characters that stand in a longer piece
        for p in points:
            (self.single if len(p) == 1 else self.inner)[p] = True
        self.splits = not any((p[1:] == SPACE)[(p[:-1] != SPACE)].any() for p in points)
        self.spelled = [b""] * len(self.pieces)
        for i in usual:
            self.spelled[i] = self.pieces[i].replace(chr(SPACE), " ").encode()
        for b, i in enumerate(self.bytes_at):
            self.spelled[i] = bytes((b,))
        self._flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self._width = np.array([len(x) for x in self.spelled])
        self._begin = np.cumsum(self._width) - self._width

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which pieces they are."""
        first, second = (slot[(hashes >> U64(shift) & _FILTER).astype(np.int64)] for slot, shift in zip(self.slots, (0, 20), strict=True))
        at = np.flatnonzero(first >= 0)
        k = first[at]
        real = self.hashes[k] == hashes[at]
        again = np.flatnonzero(~real & (second[at] >= 0))
        k[again] = second[at[again]]
        real[again] = self.hashes[k[again]] == hashes[at[again]]
        if len(self.crowded):
            again = np.flatnonzero(~real & np.isin(hashes[at], self.crowded))
            k[again] = np.searchsorted(self.hashes, hashes[at[again]])
            real[again] = True
        return at[real], k[real]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: pieces spelled out, without the space that encoding puts in front."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of many segmentations, laid end to end, as ``decode`` gives them."""
        width = self._width[ids]
        ends = np.concatenate(([0], np.cumsum(width)))
        data = self._flat[np.repeat(self._begin[ids] - ends[:-1], width) + np.arange(ends[-1])]
        offs = ends[bounds]
        front = offs[:-1][np.diff(offs) > 0]
        front = front[data[front] == 0x20]
        data = np.delete(data, front)
        offs = (offs - np.searchsorted(front, offs)).astype(np.int32)
        out = pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        return out


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _uniform(seed: np.ndarray, draw: np.ndarray | int, step: np.ndarray | int) -> np.ndarray:
    x = mix(seed + np.asarray(draw).astype(U64) * _DRAW + np.asarray(step).astype(U64) * _STEP)
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbels(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these locations that are at most ``most``; -inf where the location is."""
    there = location > -np.inf
    out = np.full(len(location), -np.inf)
    out[there] = location[there] - np.log(np.exp(location[there] - most[there]) - np.log(u[there]))
    return out


class Lattice:
    """The lattices of a few texts: stretches, the distinct ones' nodes, and edges sorted by the node they end in."""

    def __init__(self, vocab: Vocabulary, texts: list[str]) -> None:
        marked = [chr(SPACE) + t.replace(chr(SPACE), chr(LITERAL)).replace(" ", chr(SPACE)) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        begin = np.zeros(len(points), bool)
        begin[bounds[:-1][np.diff(bounds) > 0]] = True
        alone = ~vocab.inner[points]
        begin |= alone
        begin[1:] |= alone[:-1]
        if vocab.splits:
            begin[1:] |= (points[1:] == SPACE) & (points[:-1] != SPACE)
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(points)) if len(start) else start
        self.row = np.searchsorted(bounds, start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))

        sums = prefix_sums(mix(points.astype(U64)))
        _, at, self.kind = np.unique(from_sums(sums, start, end), return_index=True, return_inverse=True)
        self._build(vocab, points, start[at], (end - start)[at])

    def _build(self, vocab: Vocabulary, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        kinds = len(start)
        base = np.concatenate(([0], np.cumsum(size + 1)))
        self.last = base[1:] - 1  # the end node of each distinct stretch
        self.is_start = np.zeros(base[-1], bool)
        self.is_start[base[:-1]] = True
        ends = np.cumsum(size)
        points = points[np.repeat(start - (ends - size), size) + np.arange(size.sum())]
        of = np.repeat(np.arange(kinds), size)
        left = ends[of] - np.arange(len(points))  # characters to the end of the stretch
        node = (np.arange(len(points)) + of).astype(np.int32)
        values = mix(points.astype(U64))
        sums = prefix_sums(values)
        found = []
        for length in range(1, min(vocab.longest, int(size.max(initial=0))) + 1):
            at = np.flatnonzero(left >= length)
            if length == 1:
                at = at[vocab.single[points[at]]]
            there, k = vocab.lookup(from_sums(sums, at, at + length))
            at = at[there]
            found.append((node[at], node[at] + np.int32(length), vocab.ids[k], vocab.scores[k]))
        strange = np.flatnonzero(~vocab.single[points])
        code = points[strange].astype(np.int64)
        code[code == SPACE] = 0x20
        code[code == LITERAL] = SPACE
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        found.append((node[strange], node[strange] + np.int32(1), (-1 - code).astype(np.int32), width * vocab.byte_score))
        begin, end, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        depth = (np.arange(base[-1]) - np.repeat(base[:-1], size + 1)).astype(np.int32)[end]
        order = np.argsort(end, kind="stable")  # runs by length ascend, so merging them is quick
        narrow = np.uint16 if size.max(initial=0) < 1 << 16 else np.int64  # 16 bits are sorted by digits
        order = order[np.argsort(depth[order].astype(narrow), kind="stable")]
        begin, end, ids, score, depth = (x[order] for x in (begin, end, ids, score, depth))
        total = np.full(base[-1], -np.inf)
        total[base[:-1]] = 0.0
        part = np.empty(len(end))
        cut = np.searchsorted(depth, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):  # nodes by their distance from the start
            value = total[begin[a:b]] + score[a:b]
            group = np.flatnonzero(np.concatenate(([True], end[a + 1:b] != end[a:b - 1])))
            peak = np.repeat(np.maximum.reduceat(value, group), np.diff(np.append(group, b - a)))
            total[end[a:b][group]] = peak[group] + np.log(np.add.reduceat(np.exp(value - peak), group))
            part[a:b] = value
        part -= total[end]
        order = np.argsort(end - 0.999 * np.exp(part))  # by node, the likeliest edge first
        self.begin, self.end, self.ids, self.log = begin[order], end[order], ids[order], part[order]
        self.low = np.concatenate(([0], np.cumsum(np.bincount(self.end, minlength=base[-1]))))
        self.share = np.exp(self.log)  # what a draw is compared with

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node, by its probability."""
        edge, last = self.low[node], self.low[node + 1] - 1
        left = u - self.share[edge]
        go = np.flatnonzero((left >= 0) & (edge < last))
        while len(go):
            edge[go] += 1
            left[go] -= self.share[edge[go]]
            go = go[(left[go] >= 0) & (edge[go] < last[go])]
        return edge


@dataclass
class Path:
    """One segmentation per row: edges by stretch, each stretch from its end; masses of what is left beside it."""

    edges: np.ndarray
    cut: np.ndarray  # where each stretch's edges begin
    mass: np.ndarray
    log_prob: np.ndarray  # by row
    diverge: np.ndarray  # by row: the first choice of its own, counted from the row's first
    passed: list[list[int]]  # by row: edges at that choice that belong to earlier paths


class Sampler:
    def __init__(self, vocab: Vocabulary, texts: list[str], seeds: np.ndarray) -> None:
        self.grid = Lattice(vocab, texts)
        self.rows = len(texts)
        self.seeds = mix(seeds)
        self.ends = self.grid.last[self.grid.kind]
        self.serial = np.arange(len(self.ends)) - self.grid.first[self.grid.row]  # stretch number within its row

    def _walk(self, at: np.ndarray, node: np.ndarray, step: np.ndarray, draw: int) -> list[tuple]:
        """Draw from ``node`` to the start of each stretch ``at``: (stretch, step, edge) triples."""
        out = []
        while True:
            go = ~self.grid.is_start[node]
            if not go.all():
                at, node, step = at[go], node[go], step[go]
            if not len(at):
                return out
            u = _uniform(self.seeds[self.grid.row[at]] + self.serial[at].astype(U64) * U64(0x632BE59BD9B4E019), draw, step)
            edge = self.grid.pick(node, u)
            out.append((at, step, edge))
            node, step = self.grid.begin[edge], step + 1

    def _path(self, counts: np.ndarray, triples: list[tuple], diverge: np.ndarray, passed: list[list[int]]) -> Path:
        cut = np.concatenate(([0], np.cumsum(counts)))
        edges = np.empty(cut[-1], np.int64)
        for at, step, edge in triples:
            edges[cut[at] + step] = edge
        log = self.grid.log[edges]
        before = np.concatenate(([0.0], np.cumsum(log)))
        bounds = cut[self.grid.first]
        per_row = np.diff(bounds)
        with np.errstate(divide="ignore"):
            mass = before[:-1] - np.repeat(before[bounds[:-1]], per_row) + np.log(np.maximum(-np.expm1(log), 0))
        # the node that an edge ends in has no other edge
        mass[(self.grid.low[1:] - self.grid.low[:-1] == 1)[self.grid.end[edges]]] = -np.inf
        place = np.arange(len(edges)) - np.repeat(bounds[:-1], per_row)
        mass[place < np.repeat(diverge, per_row)] = -np.inf
        for r in np.flatnonzero(diverge >= 0):
            c = bounds[r] + diverge[r]
            rest = 1 - np.exp(self.grid.log[passed[r] + [edges[c]]]).sum()
            node = self.grid.end[edges[c]]
            full = len(passed[r]) + 1 == self.grid.low[node + 1] - self.grid.low[node]
            mass[c] = -np.inf if full or rest <= 1e-12 else before[c] - before[bounds[r]] + np.log(rest)
        return Path(edges, cut, mass, before[bounds[1:]] - before[bounds[:-1]], diverge, passed)

    def _log_sums(self, path: Path) -> np.ndarray:
        """The logarithm of what is left beside a path, by row."""
        starts = path.cut[self.grid.first[:-1]]
        full = np.flatnonzero(np.diff(path.cut[self.grid.first]) > 0)
        out = np.full(self.rows, -np.inf)
        if len(full):
            starts = starts[full]
            peak = np.maximum.reduceat(path.mass, starts)
            level = np.where(peak > -np.inf, peak, 0.0)
            each = np.exp(path.mass - np.repeat(level, np.diff(np.append(starts, len(path.mass)))))
            with np.errstate(divide="ignore"):
                out[full] = level + np.log(np.add.reduceat(each, starts))
        return out

    def take(self, k: int) -> tuple[list[Path], np.ndarray, np.ndarray]:
        """Up to ``k`` paths: each with its perturbed score by row (-inf where a row has none), and the next score."""
        every = np.arange(len(self.ends))
        triples = self._walk(every, self.ends, np.zeros(len(every), np.int64), 0)
        counts = np.zeros(len(every), np.int64)
        for at, step, _ in triples:
            counts[at] = step + 1
        paths = [self._path(counts, triples, np.full(self.rows, -1), [[] for _ in range(self.rows)])]
        u = _uniform(self.seeds, 1 << 20, 0)
        scores = [-np.log(-np.log(u))]
        best = np.full((k + 1, self.rows), -np.inf)  # the best perturbed score left beside each path
        best[0] = self._rest(paths[0], scores[0], 0, 0)
        for n in range(1, k):
            chosen = best[:n].argmax(axis=0)
            score = best[:n].max(axis=0)
            paths.append(self._next(paths, chosen, score > -np.inf, n))
            alive = score > -np.inf
            for old in np.unique(chosen[alive]):
                rows = alive & (chosen == old)
                best[old, rows] = self._rest(paths[old], score, n, 1)[rows]
            best[n, alive] = self._rest(paths[n], score, n, 2)[alive]
            scores.append(score)
        return paths, np.array(scores), best[:k].max(axis=0)

    def _rest(self, path: Path, most: np.ndarray, n: int, role: int) -> np.ndarray:
        u = _uniform(self.seeds, (1 << 21) + 4 * n + role, 0)
        return _gumbels(self._log_sums(path), most, u)

    def _next(self, paths: list[Path], chosen: np.ndarray, alive: np.ndarray, n: int) -> Path:
        """For each row the path that leaves the chosen one at a choice drawn by mass."""
        grid = self.grid
        diverge, passed = np.full(self.rows, -1), [[] for _ in range(self.rows)]
        triples, counts = [], np.zeros(len(self.ends), np.int64)
        walk_at, walk_node, walk_step = [], [], []
        draws = _uniform(self.seeds, (1 << 22) + n, 0), _uniform(self.seeds, (1 << 23) + n, 0)
        for r in range(self.rows):
            a, b = grid.first[r], grid.first[r + 1]
            old = paths[chosen[r]]
            x, y = old.cut[a], old.cut[b]
            leave = b
            if alive[r]:
                mass = old.mass[x:y]
                share = np.cumsum(np.exp(mass - mass.max()))
                c = int(np.searchsorted(share, draws[0][r] * share[-1], side="right"))
                old.mass[x + c] = -np.inf
                gone = [int(old.edges[x + c])] + (old.passed[r] if c == old.diverge[r] else [])
                node = int(grid.end[old.edges[x + c]])
                free = np.arange(grid.low[node], grid.low[node + 1])
                for taken in gone:
                    free = free[free != taken]
                share = np.cumsum(np.exp(grid.log[free]))
                edge = int(free[min(np.searchsorted(share, draws[1][r] * share[-1], side="right"), len(free) - 1)])
                leave = int(np.searchsorted(old.cut, x + c, side="right")) - 1
                step = x + c - old.cut[leave]
                diverge[r], passed[r] = c, gone
                kept = np.arange(old.cut[leave], x + c)
                triples.append((np.full(step + 1, leave), np.arange(step + 1), np.append(old.edges[kept], edge)))
                counts[leave] = step + 1
                walk_at.append(np.arange(leave, b))
                walk_node.append(np.append(grid.begin[edge], self.ends[leave + 1:b]))
                walk_step.append(np.append(step + 1, np.zeros(b - leave - 1, np.int64)))
            size = np.diff(old.cut[a:leave + 1])
            counts[a:leave] = size
            at = np.repeat(np.arange(a, leave), size)
            span = np.arange(x, old.cut[leave])
            triples.append((at, span - old.cut[at], old.edges[span]))
        if walk_at:
            drawn = self._walk(*(np.concatenate(w).astype(np.int64) for w in (walk_at, walk_node, walk_step)), n)
            for at, step, _ in drawn:
                counts[at] = step + 1
            triples += drawn
        return self._path(counts, triples, diverge, passed)


def _ids(vocab: Vocabulary, sampler: Sampler, path: Path) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows in reading order, characters without a piece as bytes; and the rows' bounds."""
    counts = np.diff(path.cut)
    at = np.repeat(path.cut[1:], counts) - 1 - (np.arange(len(path.edges)) - np.repeat(path.cut[:-1], counts))
    ids = sampler.grid.ids[path.edges[at]]
    bounds = path.cut[sampler.grid.first]
    strange = np.flatnonzero(ids < 0)
    if len(strange):
        width = np.ones(len(ids), np.int64)
        spelled = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[strange]]
        width[strange] = [len(s) for s in spelled]
        place = np.concatenate(([0], np.cumsum(width)))
        wide = np.repeat(ids, width)
        for p, s in zip(place[strange].tolist(), spelled, strict=True):
            wide[p:p + len(s)] = [vocab.bytes_at[b] for b in s]
        ids, bounds = wide, place[bounds]
    return ids, bounds


def log_inclusion(log_prob: np.ndarray, following: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_prob - following))), also where that underflows."""
    x = log_prob - following
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))


FIELDS = "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, " \
         "log_inclusion double"


NAMES = ("ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "text")


def _draws(vocab: Vocabulary, batch: pa.RecordBatch, k: int, seed: int, spell: bool) -> Iterator[tuple[pa.Array, Iterator]]:
    """By slice of a batch its doc_ids, and for each sample in turn the columns NAMES and the rows that have it."""
    keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in slices(text_bytes(batch.column(1))[1], SLICE):
        texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
        seeds = mix(keys[a:b].view(U64)) ^ mix(np.full(b - a, seed, np.int64).view(U64))

        def samples(texts: list[str] = texts, seeds: np.ndarray = seeds) -> Iterator[tuple[list[pa.Array], pa.Array]]:
            sampler = Sampler(vocab, texts, seeds)
            paths, scores, following = sampler.take(k)
            for n, path in enumerate(paths):
                ids, bounds = _ids(vocab, sampler, path)
                columns = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                           pa.array(np.diff(bounds)), pa.array(path.log_prob), pa.array(scores[n]),
                           pa.array(log_inclusion(path.log_prob, following))]
                yield columns + ([vocab.texts(ids, bounds)] if spell else []), pa.array(scores[n] > -np.inf)

        yield batch.column(0).slice(a, b - a), samples()


def sampled(docs: DataFrame, k: int = 2, seed: int = 0, model: str = MODEL, spell: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of each text, drawn without replacement: rows (doc_id, sample from 1, ids,
    n_pieces, log_prob, perturbed, log_inclusion) in falling order of their perturbed score.

    The draw of a row depends on its doc_id (null: as 0) and ``seed`` only, so repeated rows get equal results. A text
    with fewer segmentations gives fewer rows; a null or empty one gives its one, empty, with log_prob 0. ``spell``
    decodes each segmentation where it is drawn: a last column text, as ``decoded`` adds it.
    """
    with open(model, "rb") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(data)
        names = ["doc_id", "sample", *NAMES[:5 + spell]]
        for batch in batches:
            for keys, samples in _draws(vocab, batch, k, seed, spell):
                for n, (columns, there) in enumerate(samples):
                    number = pa.array(np.full(len(keys), n + 1, np.int32))
                    yield pa.RecordBatch.from_arrays([keys, number, *columns], names).filter(there)

    return docs.select("doc_id", "text").mapInArrow(released(run), FIELDS + ", text string" * spell)


def gathered(docs: DataFrame, k: int = 2, seed: int = 0, model: str = MODEL) -> DataFrame:
    """The rows of ``sampled`` with their decoded texts, one row per document: the first sample in columns, the further
    ones in the array ``others``, in order."""
    with open(model, "rb") as file:
        data = file.read()
    fields = ["sample int", "ids array<int>", "n_pieces long", "log_prob double", "perturbed double",
              "log_inclusion double", "text string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(data)
        names = ["sample", *NAMES]
        for batch in batches:
            for keys, samples in _draws(vocab, batch, k, seed, True):
                rows, first, parts, there = len(keys), None, [], []
                for n, (columns, some) in enumerate(samples):
                    columns = [pa.array(np.full(rows, n + 1, np.int32)), *columns]
                    if n:
                        parts.append(pa.StructArray.from_arrays(columns, names))
                        there.append(some.to_numpy(zero_copy_only=False))
                    else:
                        first = columns
                if parts:
                    at = np.stack(there, axis=1)  # by row and sample
                    row, n = np.nonzero(at)
                    items = pa.concat_arrays(parts).take(pa.array(n * rows + row))
                    offs = np.concatenate(([0], np.cumsum(at.sum(axis=1))))
                else:
                    items = pa.StructArray.from_arrays([c.slice(0, 0) for c in first], names)
                    offs = np.zeros(rows + 1)
                others = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([keys, *first, others], ["doc_id", *names, "others"])

    nested = f"others array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>>"
    return docs.select("doc_id", "text").mapInArrow(released(run), ", ".join(["doc_id long", *fields, nested]))


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with a column text spelled from their column ids; null ids give a null text."""
    with open(model, "rb") as file:
        data = file.read()
    base = rows.drop("text")
    at = base.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(data)
        for batch in batches:
            column = batch.column(at)
            bounds = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            for a, b in slices(bounds, SLICE):
                part = column.slice(a, b - a)
                texts = vocab.texts(part.flatten().to_numpy(zero_copy_only=False), bounds[a:b + 1] - bounds[a])
                if part.null_count:
                    texts = pc.if_else(part.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), texts],
                                                 [*batch.schema.names, "text"])

    return base.mapInArrow(released(run), T.StructType([*base.schema.fields, T.StructField("text", T.StringType())]))
