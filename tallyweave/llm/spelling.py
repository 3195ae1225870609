"""Spelling variants of the words of a corpus by permuterm rotations.

Every word gets a terminator and is rotated to each of its places. In the sorted list of rotations a rotation without
its last character is the prefix that all words share which differ in that character alone; the same string as a whole
rotation is the word that lacks the character. So each rotation stands in the list twice, whole and shortened, sorted by
range partitions; equal strings follow each other and are scanned once. Such a group holds at most one word for each
letter and one shorter word, whatever the size of the corpus.

The scan gives every member the number of the others, and the most frequent of them, without making pairs. Words that
arise from one another in several ways (a letter beside its like) are met at the first letter of the run only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import released, slices, stored, text_bytes

#: A letter in UTF-8, A-Z lower-cased: a to z, or U+00C0 to U+00FF, which are C3 and any second byte.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = "$"  # not a letter
SLICE = 1 << 22
DROP = 199


def with_typos(word: bytes, prefix: int, drop: int) -> bytes:
    """``word`` without one character where ``drop`` divides its hash; ``prefix`` is the crc32 of what stands before."""
    h = crc32(word, prefix)
    if h % drop:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def _counted(drop: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            raw, offs = text_bytes(column)
            for s, e in slices(offs, SLICE):
                total: Counter[bytes] = Counter()
                for k in range(s, e):
                    runs = Counter(_RUN.findall(raw[offs[k]:offs[k + 1]].tobytes().translate(_LOWER)))
                    if drop and ids[k] is not None:
                        prefix = crc32(b"%d:" % ids[k])
                        for word, n in runs.items():
                            total[with_typos(word, prefix, drop)] += n
                    else:
                        total.update(runs)
                words = pa.array(list(total), pa.binary()).cast(pa.string())
                got = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
                yield got.filter(pc.greater_equal(pc.utf8_length(words), least))
    return run


def vocabulary(docs: DataFrame, drop: int = DROP, letters: int = 6, times: int = 5) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, of at least ``letters`` code points and ``times`` uses.

    ``drop`` > 0 plants typing errors: where it divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at
    that hash modulo its length. A row without id loses none.
    """
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_counted(drop, letters)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, alone, word, n): the shortened rotations, and with ``last`` null the whole ones.

    ``alone`` marks the shortened ones whose missing character is the first of its run in the word.
    """
    marked = words.withColumn("marked", F.concat("word", F.lit(END)))
    turned = marked.select("word", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("marked")),
        lambda k: F.concat(F.substr("marked", k), F.substr("marked", F.lit(1), k - 1)))).alias("turn"))
    before = F.expr("substring(turn, length(turn) - 1, 1)")
    whole = turned.select(F.col("turn").alias("key"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("alone"), "word", "n")
    last = F.expr("right(turn, 1)")
    short = turned.filter(last != END).select(F.expr("left(turn, length(turn) - 1)").alias("key"), last.alias("last"),
                                              (last != before).alias("alone"), "word", "n")
    return whole.unionByName(short)


def _best(rows: list[tuple], but: str) -> tuple[int | None, str | None]:
    """The most frequent of ``rows`` (n, word) besides one, the smallest of ties; ``rows`` are the best two."""
    for n, word in rows:
        if word != but:
            return n, word
    return None, None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of every member of every group of equal keys: rows come sorted by key."""
    out: list[tuple] = []

    def close(group: list[tuple]) -> None:
        short = next((g for g in group if g[0] is None), None)
        full = [g for g in group if g[0] is not None]
        alone = [g for g in full if g[1]]
        ranked = sorted((-n, word) for _, _, word, n in full)[:2]
        if short and alone:
            n, word = min((-g[3], g[2]) for g in alone)
            out.append((short[2], len(alone), -n, word))
        if len(full) > 1:
            for _, _, word, _ in full:
                n, other = _best(ranked, word)
                out.append((word, len(full) - 1, -n, other))
        if short:
            out.extend((word, 1, short[3], short[2]) for _, _, word, _ in alone)

    def ready() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True) if out else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            ["word", "near", "near_n", "near_word"])
        out.clear()
        return batch

    key, group = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(group) > 1:
                    close(group)
                key, group = k, []
            group.append(tuple(row))
        if out:
            yield ready()
    if len(group) > 1:
        close(group)
    if out:
        yield ready()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near_word) of the words that have a near word: how many, and the most frequent one."""
    listed = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    seen = listed.select("key", "last", "alone", "word", "n").mapInArrow(
        released(_scan), "word string, near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near_word"))
    return seen.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.down")).alias("near_n"), F.col("best.near_word").alias("near_word"))


def grouped(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per row of ``words`` (word, n; words distinct): form, root, n, n_near, form_n.

    Two words are near if they differ by one code point inserted, deleted or replaced. The form of a word is its most
    frequent near word (ties: the smallest) if that is at least ``ratio`` times as frequent, else null; the root follows
    forms to the last. Counts grow along forms, so there are no circles.
    """
    words = stored(words.filter("word IS NOT NULL").select("word", "n"))
    found = stored(words.join(neighbours(words), "word", "left").withColumn("has", F.col("near_n") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("near_word")).alias("form"),
        F.when(F.col("has"), F.col("near_n")).alias("form_n")))
    up = stored(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # every round doubles the steps taken
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        longer = stored(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"),
                                                              F.col("above").isNotNull().alias("moved")))
        up = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            break
    return found.join(up, "word", "left").select("word", "n", "n_near", "form", F.coalesce("root", "word").alias("root"), "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with planted typing errors, as ``vocabulary`` and ``grouped`` say.

    Null and empty texts have no words; repeated rows count again; other columns are ignored.
    """
    return grouped(vocabulary(docs))
