"""Conversations without quotations, in reply order.

Lines that begin with ``>`` marks are quoted, as many levels deep as there are marks; a line that only names the
quoted person right before them goes with them. Lines of one level that follow each other are a passage: a quotation
below marks, a paragraph without. Passages are normalised, with spaces for their line breaks, hashed, and joined to the
messages of the same conversation that say them without marks, so a quotation that was wrapped anew meets its original;
single lines are joined as well, for quotations of a part. The earliest message that says it is the original. A message
answers the original of its shallowest linked level, there of a whole passage before single lines, then the one with most
of its lines, of those the latest. Messages without a linked quotation begin threads of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import released, stored
from tallyweave.operators.ordered import numbered

QUOTED = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
#: How lines end that name a quoted person.
NAMING = ("wrote:", "schrieb:", "a écrit :", "a écrit:", "escribió:")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(line: str) -> str:
    """A line with single spaces between its words and A-Z lower-cased."""
    return " ".join(re.split(r"[ \t\r\f\v]+", line.strip(" \t\r\f\v"))).translate(_LOWER)


def key_of(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "big", signed=True)


def taken_apart(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotations, and its passages: level (0: not quoted) and normalised lines."""
    kept, passages, run = [], [], None
    lines = text.split("\n")
    marks = [QUOTED.match(line) for line in lines]
    for line, mark, following in zip(lines, marks, [*marks[1:], None], strict=True):
        if not mark and following and line.rstrip(" \t\r").endswith(NAMING):
            run = None
            continue
        if not mark:
            kept.append(line)
        level, body = (mark[1].count(">"), normal(mark[2])) if mark else (0, normal(line))
        if not body:
            run = None
            continue
        if run is None or run[0] != level:
            run = (level, [])
            passages.append(run)
        run[1].append(body)
    return "\n".join(kept).strip(" \t\r\n"), passages


def keys_of(lines: list[str]) -> list[tuple[int, int, bool]]:
    """Keys of a passage, each with how many lines it stands for and whether it is the whole."""
    return [(key_of("\n" + " ".join(lines)), len(lines), True), *((key_of(line), 1, False) for line in lines)]


PARTS = "conv_id long, turn long, role string, content string, n_quoted long, own array<long>, " \
        "quoted array<struct<level:int,key:long,lines:int,whole:boolean>>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), ("lines", pa.int32()), ("whole", pa.bool_())]))
    for batch in batches:
        contents, owns, quotes, counts = [], [], [], []
        for text in batch.column(3).to_pylist():
            content, passages = taken_apart(text or "")
            contents.append(content)
            owns.append(sorted({key for level, lines in passages if not level for key, _, _ in keys_of(lines)}))
            quotes.append([{"level": level, "key": key, "lines": n, "whole": whole}
                           for level, lines in passages if level for key, n, whole in keys_of(lines)])
            counts.append(sum(len(lines) for level, lines in passages if level))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(contents, pa.string()), pa.array(counts, pa.int64()), pa.array(owns, pa.list_(pa.int64())),
             pa.array(quotes, kind)], ["conv_id", "turn", "role", "content", "n_quoted", "own", "quoted"])


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent_turn), by doubling the steps towards the root."""
    walk = stored(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = walk.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"),
                         F.col("depth").alias("more"))
        further = stored(walk.join(up, ["conv_id", "root_turn"], "left"))
        walk = further.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"),
                              (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not further.filter("above IS NOT NULL").limit(1).count():
            return walk


def linked(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, content (without quotations),
    n_quoted (lines), parent_turn, root_turn, depth and position in the reply order of its conversation.

    The order is by root_turn, depth and turn, so a message stands behind the one it answers. Rows with the same
    conversation and turn are one message and get neighbouring positions; a row without conversation or turn is linked
    with nothing. Null and empty texts have empty content. Other columns are ignored.
    """
    parts = stored(messages.select("conv_id", "turn", "role", "text").mapInArrow(released(_parts), PARTS))
    quoted = parts.select("conv_id", "turn", F.inline("quoted"))
    wanted = stored(quoted.select("conv_id", "key").distinct())
    originals = stored(parts.select("conv_id", "turn", F.explode("own").alias("key"))
                       .join(wanted, ["conv_id", "key"], "left_semi")
                       .groupBy("conv_id", "key").agg(F.min("turn").alias("origin")))
    votes = (quoted.join(originals, ["conv_id", "key"]).filter("origin < turn")
             .groupBy("conv_id", "turn", "level", "origin", "whole").agg(F.sum("lines").alias("lines")))
    best = F.max(F.struct(-F.col("level"), "whole", "lines", "origin"))
    links = stored(votes.groupBy("conv_id", "turn").agg(best["origin"].alias("parent_turn")))
    threads = stored(_threads(links).join(links, ["conv_id", "turn"]))
    rows = parts.select("conv_id", "turn", "role", "content", "n_quoted").join(
        threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "content", "n_quoted", "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    rows = rows.withColumn("tie", F.xxhash64("role", "content"))
    return numbered(rows, ["conv_id"], ["root_turn", "depth", "turn", "tie"], "position").drop("tie")


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT conv_id, turn, role, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM conversations
), marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]{0,3}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
         translate(trim(regexp_replace(regexp_replace(line, '^[ \t]{0,3}(?:>[ \t]?)+', ''), '[ \t\r\f\v]+', ' ', 'g')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM cut
), judged AS (
  SELECT *, level = 0 AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY no), 0) > 0
            AND regexp_matches(line, '(wrote:|schrieb:|a écrit ?:|escribió:)[ \t\r]*$') AS naming
  FROM marked
), solid AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY no) AS run FROM (
    SELECT *, CASE WHEN body = '' OR naming OR level <> lag(level) OVER w OR lag(body = '' OR naming) OVER w THEN 1 ELSE 0 END AS fresh
    FROM judged WINDOW w AS (PARTITION BY conv_id, turn ORDER BY no))
), said AS (
  SELECT conv_id, turn, level, body, 1 AS lines, false AS whole FROM judged WHERE NOT naming AND body <> ''
  UNION ALL
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY no), count(*), true FROM solid WHERE NOT naming AND body <> ''
  GROUP BY conv_id, turn, level, run
), originals AS (
  SELECT conv_id, body, whole, min(turn) AS origin FROM said WHERE level = 0 GROUP BY ALL
), votes AS (
  SELECT q.conv_id, q.turn, q.level, origin, q.whole, sum(q.lines) AS lines
  FROM said q JOIN originals o ON q.conv_id = o.conv_id AND q.body = o.body AND q.whole = o.whole AND o.origin < q.turn
  WHERE q.level > 0 GROUP BY ALL
), links AS (
  SELECT conv_id, turn, arg_max(origin, [-level, whole::INT, lines, origin]) AS parent_turn FROM votes GROUP BY ALL
), tree AS (
  SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM (SELECT DISTINCT conv_id, turn FROM conversations)
  WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM links)
  UNION ALL
  SELECT l.conv_id, l.turn, t.root_turn, t.depth + 1
  FROM tree t JOIN links l ON l.conv_id = t.conv_id AND l.parent_turn = t.turn
), contents AS (
  SELECT conv_id, turn, role,
         trim(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (level = 0 AND NOT naming), ''),
              ' ' || chr(9) || chr(10) || chr(13)) AS content,
         count(*) FILTER (level > 0 AND body <> '') AS n_quoted
  FROM judged GROUP BY ALL
)
SELECT conv_id, turn, role, content, n_quoted, parent_turn, root_turn, depth::BIGINT AS depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, depth, turn, role, content) AS position
FROM contents JOIN tree USING (conv_id, turn) LEFT JOIN links USING (conv_id, turn)
"""
