"""Shards of near-equal bytes by a k-d tree over metadata, with built-in functions only.

Points are distinct texts: their weight is the bytes of all copies, their place the smallest metadata of the copies, so
that copies share a shard. A text whose copies weigh or number more than a hundredth of a shard is divided by row into
parts of about that size, neighbours in every order; a cut may run between them. Every node is split along its widest
dimension (its range as a share of the whole range; ties: the first) at the weighted median, or the weighted share that
its leaves need, until as many leaves as shards are left, each of the target bytes.

Medians of all nodes of a level are found together: weights are added up in bins between the smallest and the largest
value left, and the bin that holds the median is divided again until it weighs next to nothing. Values that tie are
ordered by hash of the text, then by part. What the driver sees are at most ``BINS`` sums per node.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stored
from tallyweave.operators.ordered import numbered

BINS = 2048
#: Largest part of copies, and the weight at which a median counts as found, as shares of a shard.
PART, FINE = 0.01, 0.0005
TOP = (1 << 61) - 1  # hashes lie from 0 to here
OVERHEAD = 8  # bytes of a row besides its text


@dataclass
class Node:
    """A leaf holds ``leaves`` = 1 shard, ``first``; a node with a cut sends smaller points to its left."""
    first: int
    leaves: int
    dim: str | None = None
    cut: tuple[int, int, int] | None = None
    left: Node | None = None
    right: Node | None = None

    def open(self) -> Iterator[Node]:
        if self.left:
            yield from self.left.open()
            yield from self.right.open()
        elif self.leaves > 1:
            yield self

    def place(self) -> Column:
        """The first shard of the node that a point (dimensions, hash, part) falls into."""
        if not self.left:
            return F.lit(self.first)
        value, text, part = self.cut
        here, tie = F.col(self.dim), F.col("hash")
        less = (here < value) | ((here == value) & ((tie < text) | ((tie == text) & (F.col("part") < part))))
        return F.when(less, self.left.place()).otherwise(self.right.place())


@dataclass
class Search:
    """Where the cut of a node may still lie: level 0 looks at the dimension, 1 at hashes, 2 at parts."""
    node: Node
    dim: str
    want: float
    low: int
    high: int
    level: int = 0
    below: float = 0
    value: int = 0
    text: int = 0

    def step(self, bins: list, fine: float) -> tuple[int, int, int] | None:
        """Narrow the search by the sums of its bins; the cut, if it is found."""
        under = self.below
        for found in bins:
            if under + found.weight > self.want or found is bins[-1]:
                break
            under += found.weight
        if found.weight <= fine or (self.level == 2 and found.low == found.high):
            nearer = self.want - under <= under + found.weight - self.want
            at = found.low if nearer else found.high + 1
            return ((at, 0, 0), (self.value, at, 0), (self.value, self.text, at))[self.level]
        self.below, self.low, self.high = under, found.low, found.high
        if found.low == found.high:
            if self.level == 0:
                self.value, self.low, self.high = found.low, 0, TOP
            else:
                self.text, self.low, self.high = found.low, 0, 1 << 40
            self.level += 1
        return None


def _ordered(text: Column, shared: str) -> Column:
    """The seven bytes after the prefix that all values share, as a number in their order (null: 0)."""
    tail = F.substring(F.encode(text, "UTF-8"), len(shared.encode()) + 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(tail), 14, "0"), 16, 10).cast("long"), F.lit(0))


def _listed(rows: list[dict]) -> Column:
    return F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in row.items())) for row in rows)))


def grown(points: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree over ``points`` (the dimensions as longs, hash, part, weight), ``shards`` leaves."""
    spark, root = points.sparkSession, Node(0, shards)
    whole, leaf = {}, 0.0
    while todo := list(root.open()):
        nodes = points.withColumn("node", root.place()).filter(F.col("node").isin([n.first for n in todo]))
        stats = {r.node: r for r in nodes.groupBy("node").agg(
            F.sum("weight").alias("weight"), *(f(d).alias(f"{name}_{d}") for d in dims
                                               for name, f in (("least", F.min), ("most", F.max)))).collect()}
        if not whole:
            if root.first not in stats:
                return Node(0, 1)
            leaf = stats[0].weight / shards
            whole = {d: max(1, stats[0][f"most_{d}"] - stats[0][f"least_{d}"]) for d in dims}
        searches = []
        for node in todo:
            if node.first not in stats:
                node.leaves = 1  # nothing lies here, its other shards stay empty
                continue
            got = stats[node.first]
            dim = max(dims, key=lambda d: (got[f"most_{d}"] - got[f"least_{d}"]) / whole[d])
            searches.append(Search(node, dim, got.weight * (node.leaves // 2) / node.leaves,
                                   got[f"least_{dim}"], got[f"most_{dim}"]))
        while searches:
            state = spark.range(1).select(_listed([
                {"node": s.node.first, "level": s.level, "dim": s.dim, "value": s.value, "text": s.text, "low": s.low,
                 "high": s.high, "width": (s.high - s.low) // BINS + 1} for s in searches]))
            along = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims))
            at = F.when(F.col("level") == 0, along).when(F.col("level") == 1, F.col("hash")).otherwise(F.col("part"))
            bins = (nodes.join(F.broadcast(state), "node").withColumn("at", at)
                    .filter(F.col("at").between(F.col("low"), F.col("high"))
                            & ((F.col("level") == 0) | (along == F.col("value")))
                            & ((F.col("level") < 2) | (F.col("hash") == F.col("text"))))
                    .groupBy("node", F.expr("(at - low) div width").alias("bin"))
                    .agg(F.sum("weight").alias("weight"), F.min("at").alias("low"), F.max("at").alias("high"))
                    .collect())
            by_node: dict[int, list] = {}
            for row in sorted(bins, key=lambda r: (r.node, r.bin)):
                by_node.setdefault(row.node, []).append(row)
            rest = []
            for search in searches:
                node, cut = search.node, search.step(by_node[search.node.first], FINE * leaf)
                if cut is None:
                    rest.append(search)
                    continue
                node.dim, node.cut, some = search.dim, cut, node.leaves // 2
                node.left, node.right = Node(node.first, some), Node(node.first + some, node.leaves - some)
            searches = rest
    return root


@dataclass
class Shards:
    """A tree, what every copy of heavy texts needs to know, and the shard of every point."""
    tree: Node
    heavy: DataFrame
    points: DataFrame
    dims: list[str]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (crc, text_hash, row and the dimensions) with their shard."""
        return (_parted(rows, self.heavy, self.dims).drop(*self.dims, "weight")
                .join(self.points, ["crc", "text_hash", "part"]).drop("part"))


def _parted(rows: DataFrame, heavy: DataFrame, dims: list[str]) -> DataFrame:
    """Copies of heavy texts take the dimensions of their text and a part by hash of their row; others are part 0."""
    known = heavy.select("crc", "text_hash", "parts", *(F.col(d).alias(f"all_{d}") for d in dims))
    return rows.join(F.broadcast(known), ["crc", "text_hash"], "left").withColumns({
        "part": F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)),
        **{d: F.coalesce(f"all_{d}", d) for d in dims}}).drop("parts", *(f"all_{d}" for d in dims))


def slim(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """One small row per row of ``docs``: size, hashes of the text, a row number and the dimensions source, lang,
    chars and age (the id). Written once."""
    text = F.coalesce("text", F.lit(""))
    ends = docs.agg(*(f(c).alias(f"{n}_{c}") for c in ("source", "lang") for n, f in (("a", F.min), ("z", F.max)))).first()
    shared = {c: os.path.commonprefix([ends[f"a_{c}"] or "", ends[f"z_{c}"] or ""]) for c in ("source", "lang")}
    dims = {"source_at": _ordered(F.col("source"), shared["source"]), "lang_at": _ordered(F.col("lang"), shared["lang"]),
            "chars_at": F.coalesce(F.length("text").cast("long"), F.lit(0)), "age_at": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("weight"), F.crc32(text).alias("crc"),
                       F.xxhash64(text).alias("text_hash"), *(c.alias(d) for d, c in dims.items()),
                       F.monotonically_increasing_id().alias("row"))
    return stored(rows), list(dims)


def planned(rows: DataFrame, dims: list[str], shards: int | None = None, target: int | None = None) -> Shards:
    """The shards of ``rows`` (from ``slim``): so many, or as many as parts of ``target`` bytes are needed."""
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count("*").alias("rows")).first()
    shards = shards or max(1, -(-total.weight // target))
    unit = [max(1.0, PART * x / shards) for x in total]
    places = [F.min(d).alias(d) for d in dims]
    texts = rows.groupBy("crc", "text_hash").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"), *places)
    parts = F.ceil(F.greatest(F.col("weight") / unit[0], F.col("rows") / unit[1]))
    heavy = stored(texts.filter("rows > 1").withColumn("parts", F.least(parts, F.col("rows"))).filter("parts > 1")
                   .select("crc", "text_hash", "parts", *dims))  # at most 2 * shards / PART rows
    points = stored(_parted(rows, heavy, dims).groupBy("crc", "text_hash", "part").agg(F.sum("weight").alias("weight"), *places)
                    .withColumn("hash", F.shiftrightunsigned("text_hash", 3)))
    tree = grown(points, dims, shards)
    return Shards(tree, heavy, points.select("crc", "text_hash", "part", tree.place().cast("int").alias("shard")), dims)


def sharded(docs: DataFrame, shards: int = 24, target: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The size is the UTF-8 bytes of the text (null: none) plus 8. Law ``bytes``: sizes of shards differ by little more
    than the rows at the cuts; ``grown_shard`` is null. Slots count from 0 in every shard, by id. Null metadata counts as
    the smallest value, a null text as empty. Equal texts share a shard unless a cut divides a text with very many
    copies. Repeated rows are rows of their own. With fewer texts than shards, some shards stay empty. Other columns are
    ignored. With ``target`` there are as many shards as targets fit into the whole.
    """
    rows, dims = slim(docs)
    plan = planned(rows, dims, None if target else shards, target)
    sizes = rows.select("row", "weight", "crc", "text_hash", "doc_id", *dims)
    placed = plan.placed(sizes.withColumn("size", F.col("weight")))
    slots = numbered(placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "row"), ["shard"],
                     ["doc_id", "row"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, target: int | None = None) -> None:
    """Write all columns of ``docs`` as Parquet below ``path``, one folder ``shard=N`` per shard that has rows."""
    rows, dims = slim(docs)
    plan = planned(rows, dims, None if target else shards, target)
    text = F.coalesce("text", F.lit(""))
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("text_hash"),
                        F.monotonically_increasing_id().alias("row"), *(F.lit(0).cast("long").alias(d) for d in dims))
    out = plan.placed(inner).select(F.col("shard").alias("_shard"), "doc.*")
    out = out.withColumnRenamed("_shard", "shard") if "shard" not in docs.columns else out.drop("shard").withColumnRenamed("_shard", "shard")
    out.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("shard").parquet(path)
