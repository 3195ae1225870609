"""Near-duplicate documents by b-bit MinHash.

Each text gets 96 minima over its distinct word shingles. Bands of four minima propose candidates; of each minimum
four bits are packed into six longs, and the share of equal groups of bits, corrected for chance agreement,
estimates the similarity of a candidate pair. What could still reach the threshold is confirmed on the full sets.

Groups of copies are not expanded into pairs. Equal sets become one class first. Every member meets one other: the
smallest that shares any bucket with it. A bucket whose members then lie in one component is done. In the others a
shingle that no other member of an unfinished bucket has can be in no intersection: a member with too many of those can
reach no partner of the bucket's sizes and leaves. Of the rest, a few members are picked to meet the others, where sizes
and packed bits allow the threshold. Two documents meet in the first of their common buckets only.

Buckets that are still unfinished form groups by their smallest member, and there all that has to meet has met when
picked members, eight times as many each round, have met the others. A set is described by what it differs in from the
shingles that most of its group have: two sets differ in what is in one description only. Descriptions of near copies
are short and mostly differ, so either two of them are so short that the sets are linked, then both are linked with the
set of the shortest, or they must have a number of shingles in common that follows from their lengths, and one of them
among the first, rarest ones. Only members that have are compared. No bucket is capped, all pruning is exact but for the
bits, and members that are nearly similar enough cost pairs only if they differ from the rest in the same way.

A pair at exactly 80 % shares no band with probability 3e-6 and less above; the bit count then passes over one with
a probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.bytehash import SLICE, U64, mix, row_sets
from tallyweave.llm.common import released, slices, stored, text_bytes
from tallyweave.llm.components import components

BANDS, ROWS = 24, 4
MINIMA = BANDS * ROWS
BITS, LONGS = 4, MINIMA * 4 // 64
#: Fewest equal bit groups of 96 at which a pair may have a similarity of 0.8 (mean 78, deviation 3.8).
LEAST_EQUAL = 56
#: Picked members that the others of a bucket meet at first; eight times as many in each further round.
FEW = 8
#: Levels of excess in a group: the more, the shorter are the prefixes, and the more of them there are.
LEVELS = 32
_SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=U64))
_FACTOR = (_SEEDS[:MINIMA] >> U64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (_SEEDS[MINIMA:] >> U64(32)).astype(np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U64) << U64(20))

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def minima(values: np.ndarray, starts: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """Per run of ``values`` that begins at ``starts`` its smallest value under each of ``count`` permutations."""
    low = (values >> U64(32)).astype(np.uint32)
    out = np.empty((len(starts), count), np.uint32)
    work = np.empty_like(low)
    for k in range(count):
        np.bitwise_xor(low, _FLIP[k], out=work)
        np.multiply(work, _FACTOR[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Digests (two sums over the set), band keys and packed bits of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    found = minima(values, starts)
    bands = np.zeros((len(sets), BANDS), U64)
    for k in range(ROWS):
        bands = mix(bands ^ found[:, k::ROWS].astype(U64) + _BAND)
    fours = ((found ^ (found >> np.uint32(16))) & np.uint32(15)).astype(np.uint8)
    packed = np.ascontiguousarray(fours[:, 0::2] << 4 | fours[:, 1::2])
    sums = [np.add.reduceat(mix(values ^ U64(k)), starts) for k in (0x5A5A5A5A, 0x3C3C3C3C00)]
    return sums[0].view(np.int64), sums[1].view(np.int64), bands.view(np.int64), packed.view(np.int64)


def _lists(rows: np.ndarray, full: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as lists, null where ``full`` is false."""
    width = rows.shape[1]
    offs = np.zeros(len(full) + 1, np.int32)
    np.cumsum(full * width, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32(), mask=np.append(~full, False)),
                                    pa.array(rows.ravel(), pa.int64()))


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for a, b in slices(offs, SLICE):
                sets = row_sets(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = sizes > 0
                zero = np.zeros(b - a, np.int64)
                one, two, bands, bits = zero, zero.copy(), np.zeros((0, BANDS), np.int64), np.zeros((0, LONGS), np.int64)
                if full.any():
                    one[full], two[full], bands, bits = signatures([s for s in sets if len(s)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(one), pa.array(two),
                     _lists(bands, full, n), _lists(bits, full, n)],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])
    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for a, b in slices(offs, SLICE):
                sets = row_sets(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a], n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "shingles"])
    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)],
                                             ["a", "b"])
    return run


def equal_groups(one: str, two: str) -> F.Column:
    """How many of the 96 four-bit groups of two packed signatures are equal."""
    total = F.lit(MINIMA)
    for k in range(LONGS):
        x = F.col(one)[k].bitwiseXOR(F.col(two)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def estimate(one: str, two: str) -> F.Column:
    """Similarity estimated from the packed bits, corrected for groups that agree by chance."""
    return F.greatest(F.lit(0.0), (equal_groups(one, two) / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), doc_id, np.int64))],
                                             ["shingle", "doc_id"])


def _own_shingles(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, size, own): of the sets of ``ids``, how many shingles are in none of the others."""
    chosen = sets.join(ids, "doc_id", "left_semi")
    own = (chosen.mapInArrow(released(_exploded), "shingle long, doc_id long")
           .groupBy("shingle").agg(F.count("*").alias("docs"), F.min("doc_id").alias("doc_id"))
           .filter("docs = 1").groupBy("doc_id").agg(F.count("*").alias("own")))
    sizes = chosen.select("doc_id", (F.octet_length("shingles") / 8).cast("long").alias("size"))
    return stored(sizes.join(own, "doc_id", "left").select("doc_id", "size", F.coalesce("own", F.lit(0)).alias("own")))


def _bucket_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *row, data in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
            values = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), v, np.int64)) for v in row] + [pa.array(values)], ["bucket", "rows", "shingle"])


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, found = [], []
        for data, centre in zip(batch.column("shingles"), batch.column("centre"), strict=True):
            values = np.frombuffer(data.as_buffer(), np.int64)
            usual = np.asarray(centre.values) if centre.is_valid else values[:0]
            sizes.append(len(values))
            found.append(np.setxor1d(values, usual, assume_unique=True))
        offs = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(d) for d in found], out=offs[1:])
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
        names = ["bucket", "doc_id", "component", "pivot"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(sizes, pa.int64()), lists],
                                         [*names, "size", "delta"])


def _described(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, doc_id, component, pivot, size, excess, common) of each set of the rows ``placed``.

    A set x is described by the shingles in which it differs from those that more than half of its bucket have. With
    d(x) of them and e(x) = (100 + percent) d(x) - (100 - percent) size(x), its excess, x and y are linked exactly if
    the descriptions share at least (e(x) + e(y)) / (2 (100 + percent)) shingles. ``common`` holds those that another
    set of the bucket has in its description too, the rarest first.
    """
    tally = (placed.select("bucket", "rows", "doc_id").join(sets, "doc_id").select("bucket", "rows", "shingles")
             .mapInArrow(released(_bucket_shingles), "bucket long, rows long, shingle long")
             .groupBy("bucket", "shingle").agg(F.count("*").alias("docs"), F.max("rows").alias("rows")))
    centre = stored(tally.filter("2 * docs > rows").groupBy("bucket").agg(F.collect_list("shingle").alias("centre")))
    names = ("bucket", "doc_id", "component", "pivot")
    changed = stored(placed.select(*names).join(sets, "doc_id").join(centre, "bucket", "left")
                     .select(*names, "shingles", "centre")
                     .mapInArrow(released(_deltas), "bucket long, doc_id long, component long, pivot boolean, size long, "
                                                    "delta array<long>")
                     .withColumn("row", F.monotonically_increasing_id()))  # an id may have several sets
    each = changed.select("row", "bucket", F.explode("delta").alias("shingle"))
    weights = each.groupBy("bucket", "shingle").agg(F.count("*").alias("weight")).filter("weight > 1")
    common = (each.join(weights, ["bucket", "shingle"]).groupBy("row")
              .agg(F.sort_array(F.collect_list(F.struct("weight", "shingle"))).getField("shingle").alias("common")))
    excess = (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("size")
    return stored(changed.withColumn("excess", excess).drop("delta").join(common, "row", "left").drop("row"))


def _meetings(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link a pivot's component with another one of its bucket, of the rows ``placed``."""
    described = _described(placed, sets, percent)
    double = 2 * (100 + percent)
    star = stored(described.groupBy("bucket").agg(F.min(F.struct("excess", "size", "doc_id", "component")).alias("star")))
    described = described.join(star, "bucket")
    linked = described.filter((F.col("component") != F.col("star.component")) & (F.col("excess") + F.col("star.excess") <= 0))

    # Fewer shared shingles are enough beside a smaller excess, so a row has a prefix for every level of partners.
    step = F.col("star.size") * (double / LEVELS)
    able = stored(described.filter(double * F.size("common") >= F.greatest(F.lit(double), F.col("excess") + F.col("star.excess")))
                  .withColumn("level", F.least(F.lit(LEVELS), F.floor((F.col("excess") - F.col("star.excess")) / step)))
                  .select("bucket", "doc_id", "component", "pivot", "excess", "common", F.size("common").alias("most"), "level"))
    levels = able.groupBy("bucket", F.col("level").alias("other")).agg(F.min("excess").alias("base"),
                                                                       F.max("most").alias("other_most"))
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("base")) / double)).cast("int")
    keyed = stored(able.join(stored(levels), "bucket").withColumn("need", need)
                   .filter("need <= least(most, other_most)")
                   .select("bucket", "level", "other", "doc_id", "component", "pivot", "excess", "most",
                           F.explode(F.slice("common", F.lit(1), F.col("most") - F.col("need") + 1)).alias("shingle")))
    pivots = keyed.filter("pivot").select(*(F.col(k).alias(f"p_{k}") for k in keyed.columns))
    both = F.least("most", "p_most")
    met = keyed.join(pivots, (F.col("bucket") == F.col("p_bucket")) & (F.col("shingle") == F.col("p_shingle"))
                     & (F.col("level") == F.col("p_other")) & (F.col("other") == F.col("p_level"))
                     & (F.col("component") != F.col("p_component"))
                     & (double * both >= F.col("excess") + F.col("p_excess")))
    return (met.select("doc_id", "p_doc_id").unionByName(linked.select("doc_id", F.col("star.doc_id").alias("p_doc_id")))
            .select(F.least("doc_id", "p_doc_id").alias("a"), F.greatest("doc_id", "p_doc_id").alias("b")).distinct())


def _candidates(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b) whose packed signatures allow the threshold."""
    one = bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a"))
    two = bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b"))
    return pairs.join(one, "a").join(two, "b").filter(equal_groups("bits_a", "bits_b") >= LEAST_EQUAL).select("a", "b")


def _links(pairs: DataFrame, bits: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links by their full sets; ``bits`` rules others out before, where that is not done yet."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    close = stored(_candidates(pairs, bits) if bits is not None else pairs)
    return stored(close.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
                  .mapInArrow(released(_confirmed(percent)), "a long, b long"))


def _open(placed: DataFrame) -> DataFrame:
    """Buckets whose remaining members lie in several components, and their members."""
    return (placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.count("*").alias("rows"))
            .filter("low < high").select("bucket", "rows"))


def _unfinished(untested: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (bucket, doc_id) of unfinished buckets, with their components."""
    placed = stored(untested.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    return placed.join(stored(_open(placed)).drop("rows"), "bucket")


def _picked(placed: DataFrame, width: int) -> DataFrame:
    """The rows of unfinished buckets, with their number per bucket and whether they are among about ``width`` pivots."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(width)), F.lit(1 << 30)) / float(1 << 30)
    return stored(placed.join(stored(_open(placed)), "bucket")
                  .withColumn("pivot", draw * F.col("rows") < F.lit(float(width))))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id (smallest linked id), kept.

    Texts are linked when ``100 * common >= percent * union`` over their sets of ``n``-word shingles (words between
    ASCII white space, A-Z lower-cased; a shorter text is one shingle). Null, empty and blank texts have no
    shingles and are linked with nothing. Rows with the same id are one document and share a fate; a row without id is
    linked with nothing and kept. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    signed = stored(texts.mapInArrow(released(_signed(n)), SIGNED))
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = stored(known.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first"),
                                                                      F.count("*").alias("rows"))
                    .filter("rows > 1").drop("rows"))
    classed = stored(signed.join(copies, ["set_a", "set_b", "n_shingles"], "left")
                     .withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")))
                     .select("doc_id", "n_shingles", "first", *(
                         F.when((F.col("doc_id") == F.col("first")) & (F.col("n_shingles") > 0), F.col(k)).alias(k)
                         for k in ("bands", "bits"))))

    entries = classed.filter("bands IS NOT NULL").select(F.explode("bands").alias("bucket"), "doc_id")
    shared = stored(entries.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("tail"))
                    .filter("lead < tail").drop("tail"))
    members = stored(entries.join(shared, "bucket"))
    ids = stored(members.select("doc_id").distinct())
    bits = stored(classed.filter("bits IS NOT NULL").select("doc_id", "bits").join(ids, "doc_id", "left_semi"))
    sets = stored(texts.join(ids, "doc_id", "left_semi").mapInArrow(released(_full_sets(n)), "doc_id long, shingles binary"))

    follow = members.filter("doc_id <> lead")
    links = _links(follow.groupBy(F.col("doc_id").alias("b")).agg(F.min("lead").alias("a")), bits, sets, percent)
    found = components(links)
    placed = stored(_unfinished(members.select("bucket", "doc_id"), found))
    if placed.limit(1).count():
        present = stored(placed.select("doc_id").distinct())
        lists = (members.join(present, "doc_id", "left_semi").groupBy("doc_id")
                 .agg(F.collect_set("bucket").alias("buckets")))  # one per band at most
        facts = stored(_own_shingles(sets, present).join(lists, "doc_id").join(bits, "doc_id"))
        placed = stored(placed.join(facts, "doc_id"))
        least = placed.groupBy("bucket").agg(F.min("size").alias("least"))
        most = F.col("size") - F.col("own")  # the largest intersection with any other member
        placed = stored(placed.join(least, "bucket").filter(
            100 * most >= percent * (F.col("size") + F.greatest("least", most) - most)).drop("least"))
        placed = _picked(placed, FEW)
        pivots = placed.filter("pivot").select(*(F.col(k).alias(f"p_{k}") for k in (
            "bucket", "doc_id", "component", "size", "own", "buckets", "bits")))
        both = F.least(F.col("size") - F.col("own"), F.col("p_size") - F.col("p_own"))
        pairs = (placed.join(pivots, (F.col("bucket") == F.col("p_bucket")) & (F.col("component") != F.col("p_component"))
                             & (100 * both >= percent * (F.col("size") + F.col("p_size") - both))
                             & (equal_groups("bits", "p_bits") >= LEAST_EQUAL)
                             & (F.array_min(F.array_intersect("buckets", "p_buckets")) == F.col("bucket")))
                 .select(F.least("doc_id", "p_doc_id").alias("a"), F.greatest("doc_id", "p_doc_id").alias("b")).distinct())
        links = links.unionByName(_links(pairs, None, sets, percent))
        found = components(links)
        rest = _unfinished(placed.filter("NOT pivot").select("bucket", "doc_id"), found)
        untested, width = rest.join(shared, "bucket").select(F.col("lead").alias("bucket"), "doc_id").distinct(), FEW * 8
        while True:
            placed = stored(_unfinished(untested, found))
            if not placed.limit(1).count():
                break
            placed = _picked(placed, width)
            links = links.unionByName(_links(_meetings(placed, sets, percent), bits, sets, percent))
            found = components(links)
            untested, width = placed.filter("NOT pivot").select("bucket", "doc_id"), width * 8

    groups = found.select(F.col("node").alias("first"), F.col("component"))
    return classed.join(groups, "first", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps: of each group the smallest id.

    Rows with the same id are one document: they stay or go together.
    """
    gone = stored(near_duplicates(docs, n, percent).filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
