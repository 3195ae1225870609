"""Spelling variants, k-d shards and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import alignment, kdshards, spelling
from tests.llm.helpers import DOCS, awkward, docs, lower

LETTERS = "abcdefgàÿ"


# --- op11 ---

def near(one, two):
    if len(one) == len(two):
        return sum(x != y for x, y in zip(one, two, strict=True)) == 1
    short, long = sorted((one, two), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def grouped(counts):
    """The definition, every word against every other."""
    out, form = set(), {}
    others = {w: [u for u in counts if near(w, u)] for w in counts}
    for w in counts:
        best = min(others[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(others[w]), form[w], root, counts.get(form[w])))
    return out


def typed(rows, drop=199, letters=6, times=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times and len(w) >= letters}


def found(rows):
    return {(r.word, r.n, r.n_near, r.form, r.root, r.form_n) for r in rows.collect()}


def edited(rng, word):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice(LETTERS) if kind else "") + word[at + (kind != 1):]


def test_words_in_chains_runs_and_ties_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {"aaaaaa": 5, "aaaaaaa": 60, "aaaaaaaa": 900, "aabaaa": 30, "zzzzzz": 7}
    for _ in range(60):
        word = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 10)))
        family = [word]
        for _ in range(9):
            counts[family[-1]] = rng.choice((5, 5, 25, 125, 700))
            family.append(edited(rng, rng.choice(family)))
    counts = {w: n for w, n in counts.items() if len(w) > 4}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = grouped(counts)
    assert found(spelling.grouped(table)) == want
    assert any(r != f and f for _, _, _, f, r, _ in want) and max(n for _, _, n, _, _, _ in want) > 5


def test_one_word_with_a_neighbour_for_every_letter(spark):
    letters = [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
    counts = {"stammwort": 100000} | {f"sta{c}mwort": 5 + k for k, c in enumerate(letters) if c != "m"}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r.word: r for r in spelling.grouped(table).collect()}
    assert got["stammwort"].n_near == len(letters) - 1 == got["staÿmwort"].n_near and got["staÿmwort"].root == "stammwort"


def test_words_of_texts_equal_brute_force(spark):
    rng = random.Random(6)
    pool = ["Strasse", "strase", "Straße", "commité", "committee", "ÀBCDEFG", "dot×dot", "short", "xçxçxçx", "kommittee"]
    rows = awkward() + [(k, " ".join(rng.choices(pool, k=40)) + "!") for k in range(300)] + [(7, None), (None, "Strasse strase, " * 3)]
    counts = typed(rows)
    assert found(spelling.variants(docs(spark, rows))) == grouped(counts)
    assert len(counts) > len({lower(w) for w in pool if len(w) > 5})  # planted errors are frequent enough to be words


def test_no_words(spark):
    for rows in ([], [(1, None), (None, ""), (2, "a few short words")]):
        assert spelling.variants(docs(spark, rows)).collect() == []


# --- op12 ---

def fixture(spark, rows):
    table = spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCS)
    return table.selectExpr("*", "'x' AS shard", "1 AS weight", "'y' AS row", "2 AS hash", "3 AS part", "4 AS slot", "5 AS node")


def checked(rows, got, shards):
    size = Counter(len((t or "").encode()) + 8 for _, t, _, _ in rows)
    assert Counter(r.size for r in got) == size
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by.get(k, [])) for k in range(shards)]


def brute(points, dims, shards, first=0):
    """The tree by its definition over points (dimensions, hash, part, weight): {point: shard}."""
    def divide(part, leaves, first):
        if leaves == 1 or not part:
            return {p: first for p in part}
        dim = max(dims, key=lambda d: (max(p[d] for p in part) - min(p[d] for p in part)) / whole[d])
        part = sorted(part, key=lambda p: (p[dim], *p[len(dims):len(dims) + 2]))
        want, total, at = sum(p[-1] for p in part) * (leaves // 2) / leaves, 0, 0
        while at < len(part) - 1 and total + part[at][-1] <= want:
            total += part[at][-1]
            at += 1
        at += not want - total <= total + part[at][-1] - want
        some = leaves // 2
        return divide(part[:at], some, first) | divide(part[at:], leaves - some, first + some)
    whole = {d: max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in dims}
    return divide(points, shards, first)


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_tree_equals_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(kdshards, "FINE", 0)
    rng = random.Random(shards)
    points = [(rng.randrange(5), rng.randrange(1000), rng.randrange(3), rng.randrange(kdshards.TOP), 0, rng.randrange(1, 900))
              for _ in range(300)]
    points += [(2, 500, 1, 12345, k, 40) for k in range(50)]  # parts of one text
    table = spark.createDataFrame(points, "x long, y long, z long, hash long, part long, weight long")
    tree = kdshards.grown(table, ["x", "y", "z"], shards)
    got = {tuple(r)[:6]: r.shard for r in table.withColumn("shard", tree.place()).collect()}
    weights = Counter()
    for point, shard in got.items():
        weights[shard] += point[-1]
    assert got == brute(points, (0, 1, 2), shards)
    assert max(weights.values()) - min(weights[k] for k in range(shards)) <= 2 * 900


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(9)
    rows = [(k, "w" * rng.randrange(20, 2000), rng.choice(("de", "en", None)), rng.choice(("src0", "src0", f"src{k % 20}", None)))
            for k in range(4000)]
    copies = [(5000 + k, f"copy {k % 40} " * 30, "en", f"src{k % 7}") for k in range(400)]
    hot = [(9000 + k, "hot text " * 100, "en", f"src{k % 11}") for k in range(2000)]
    same = [(None, None, None, None)] * 700 + [(1, "", "de", "src1")] * 500
    rows += copies + hot + same
    got = kdshards.sharded(fixture(spark, rows)).collect()
    sizes = checked(rows, got, 24)
    mean = sum(sizes) / 24
    assert all(abs(s - mean) < 0.04 * mean for s in sizes), sizes
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    crc = [zlib.crc32(t.encode()) for t in {c[1] for c in copies}]
    assert all(len(where[c]) == 1 for c in crc) and len(where[zlib.crc32(hot[0][1].encode())]) > 1


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "same", "en", "s")] * 30, [(i, t, None, None) for i, t in awkward()]])
def test_small_and_awkward_tables_are_sharded(spark, rows):
    checked(rows, kdshards.sharded(fixture(spark, rows)).collect(), 24)


def test_shards_by_target_are_written(spark, tmp_path):
    rows = [(k, f"text {k} " * 50, "en", "s") for k in range(200)] + [(500, "again " * 10, "en", "s")] * 100
    table = fixture(spark, rows)
    kdshards.write_shards(table, str(tmp_path / "out"), target=10_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = [r.s for r in back.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "s").collect()]
    total = sum(len(t) + 8 for _, t, _, _ in rows)
    assert back.count() == 300 and len(sizes) == -(-total // 10_000)
    assert Counter(r.doc_id for r in back.collect()) == Counter(i for i, *_ in rows)


# --- op13 ---

@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers(alignment.A_FILE, alignment.B_FILE)


def by_hand(both, rows):
    """Every row's tokens, groups and links by comparing all spans; counts over all rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(alignment.A_FILE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    out, counts = [], Counter()
    for i, text in rows:
        whole, sides = (" " + text).encode() if text else b"", []
        for ids, names in ((a_side.encode(" " + text, add_special_tokens=False).ids if text else [], both.a_bytes),
                           (b_side.encode(text) if text else [], both.b_bytes)):
            ends = np.cumsum([len(names[k]) for k in ids]).tolist()
            sides.append([(k, s, e) for k, s, e in zip(ids, [0, *ends], ends, strict=False)])
            if b"".join(names[k] for k in ids) != whole:
                sides = [[], []]
                break
        a, b = (sides + [[]])[:2]
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        common, groups, start = sorted({x[2] for x in a} & {y[2] for y in b}), [], 0
        for end in common:
            groups.append("|".join(",".join(str(k) for k, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        counts.update(links)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return Counter((i, na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)
                   for i, na, nb, ng, links, digest in out)


def test_group_ends_of_runs_and_irregular_stretches():
    rng = random.Random(8)
    for _ in range(300):
        same = rng.random()
        a, b = set(), set()
        for end in range(1, rng.randrange(2, 200)):
            if rng.random() < same:
                a.add(end), b.add(end)
            else:
                (a if rng.random() < 0.5 else b).add(end)
        a, b = sorted(a | {200}), sorted(b | {200})
        common = sorted(set(a) & set(b))
        want = [a.index(e) + 1 for e in common], [b.index(e) + 1 for e in common]
        assert alignment.group_ends(a, b) == want
    assert alignment.group_ends([], []) == ([], [])


TEXTS = ["Plain words, and more words.", " leading", "trailing  ", "two  spaces\n\nlines\ttabs", "日本語 mixed ü é 😀 text", "<|endoftext|> <s> </s> <unk> <0x41>",
         "a ▁ of its own", "x", " ", "\n", "it's 1234567890 don't", "  odd spaces　", "\x00\x01 control", "ÀÉÎ" * 30, "é combining"]


def test_tables_equal_brute_force(spark, both):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(i, t) for i, t in awkward(900)] + [(3, TEXTS[3])] * 2 + [(99, None), (100, "")]
    got = Counter(tuple(r) for r in alignment.summed(docs(spark, rows).repartition(3)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == by_hand(both, rows)
    zeros = {r[0] for r in got if r[1] == 0}
    assert TEXTS.index("a ▁ of its own") in zeros and {99, 100} <= zeros
    assert alignment.summed(docs(spark, [])).collect() == []


def test_both_engines_of_a_agree(both):
    rng = random.Random(12)
    assert both.fast
    signs = [chr(c) for c in range(0x250)]
    for _ in range(4000):
        word = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 9)))
        assert both.fast(" " + word) == both.a.encode(" " + word, add_special_tokens=False).ids, repr(word)


def test_stretches_and_slices_change_nothing(spark, both, monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choice(["word", "über", "a", "two  gaps", "x\ny", "it's", "12", "‘q’", "日本"]) for _ in range(3000))
    rows = [(1, long), (2, long[:500]), (3, "under_score" * 2000)]
    whole = by_hand(both, [(1, long[:3000])])
    plain, counts = both.encoded([long, "", long[:500], None])
    monkeypatch.setattr(alignment, "WORDS", 5)
    monkeypatch.setattr(alignment, "STRETCH", 50)
    assert len(list(alignment.stretches(long, 50))) > 100
    again, same = both.encoded([long, "", long[:500], None])
    assert (counts == same).all() and all((x == y).all() for x, y in zip(plain, again, strict=True)) and counts[0, 1] == 0 < counts[1, 2]
    assert Counter(tuple(r) for r in alignment.summed(docs(spark, [(1, long[:3000])])).collect()) == whole
    assert all(r.n_a and r.n_b for r in alignment.summed(docs(spark, rows)).collect())
    copies = alignment.summed(docs(spark, [(k, long[:9000]) for k in range(400)]).coalesce(1)).collect()  # several slices
    one = alignment.summed(docs(spark, [(0, long[:9000])])).collect()[0]
    assert len(copies) == 400 and {tuple(r)[1:] for r in copies} == {(*tuple(one)[1:6], 400 * one.count_sum, one.groups_sha256)}


def test_spans_and_pair_counts(spark, both):
    rows = [(1, "Plain words here"), (2, None), (3, "words here")]
    spans = {r.doc_id: r for r in alignment.alignments(docs(spark, rows)).collect()}
    one = spans[1]
    assert one.group_bytes[-1] == len(" Plain words here") and one.group_a[-1] == len(one.a_ids) and one.group_b[-1] == len(one.b_ids)
    assert spans[2].a_ids == [] and spans[3].group_bytes[-1] == len(" words here")
    counts = {(r.a_id, r.b_id): r["count"] for r in alignment.pair_counts(docs(spark, rows)).collect()}
    sums = {r.doc_id: r for r in alignment.summed(docs(spark, rows)).collect()}
    assert sum(counts.values()) == sum(r.n_links for r in sums.values())
    assert counts[both.a.token_to_id("Ġhere"), both.b.piece_to_id("▁here")] == 2
