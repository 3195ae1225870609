"""Fingerprints, near-duplicates and decontamination against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tallyweave.llm import decontaminate, fingerprint, neardup
from tallyweave.llm.bytehash import row_sets
from tallyweave.llm.common import text_bytes
from tallyweave.llm.components import components
from tests.llm.helpers import awkward, docs, shingle_set, words


def chunks(data):
    """Cuts by the definition: the gear hash of the last 32 bytes, a strict test up to the usual size, then a loose."""
    gear, out, start = [int(g) for g in fingerprint.GEAR], [], 0
    while start < len(data):
        end = min(start + fingerprint.MOST, len(data))
        for k in range(start + fingerprint.LEAST, end):
            acc = 0
            for byte in data[k - 32:k]:
                acc = ((acc << 1) + gear[byte]) & 0xFFFFFFFF
            if acc >> (24 if k < start + fingerprint.USUAL else 27) == 0:
                end = k
                break
        out.append(data[start:end])
        start = end
    return out


def share(one, other):
    one, other = chunks(one), chunks(other)
    if not one:
        return float(not other)
    shared = sum(min(sum(len(c) for c in one if c == x), sum(len(c) for c in other if c == x)) for x in set(one))
    return shared / sum(map(len, one))


def test_chunks_are_as_defined():
    rng = random.Random(1)
    for size in (0, 1, 31, 32, 33, 319, 320, 321, 5000):
        data = bytes(rng.choice(b"abcde \n") for _ in range(size))
        ends, counts = fingerprint.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, size]))
        assert ends == list(itertools.accumulate(map(len, chunks(data)))) and counts == [len(ends)]


def test_an_insertion_moves_few_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(2000)).encode()
    one, two = fingerprint.fingerprints([text, text[:5000] + b"inserted" + text[5000:]])
    assert fingerprint.containment(one, two) > 0.95
    assert fingerprint.unpacked(fingerprint.packed(one))[0].tolist() == one[0].tolist()


@pytest.mark.parametrize("rows", [[], [(3, "lonely text " * 20)], awkward()])
def test_fingerprints_with_edited_texts(spark, rows):
    got = fingerprint.with_fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    known = {i for i, _ in rows if i is not None and sum(i == j for j, _ in rows) == 1}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for r in got:
        assert (r.n_chars == 0) == (r.fingerprint == "")
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in known:
            at = next(k for k, (i, _) in enumerate(order) if i == r.doc_id)
            text, (following_id, following) = order[at][1] or "", order[(at + 1) % len(order)]
            if len(rows) == 1 or following_id in known:
                other = text[:len(text) - len(text) // 2] + (following or "")[:len(text) // 2]
                assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
                assert r.near_edited == pytest.approx(share(text.encode(), other.encode()))
                assert r.near_next == pytest.approx(share(text.encode(), (following or "").encode()))
            prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_over_many_partitions(spark):
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(60)]
    got = {r.doc_id: r for r in fingerprint.with_fingerprints(docs(spark, rows).repartition(9)).collect()}
    text = dict(rows)
    for k, r in got.items():
        following = text[(k - 1) % 60]
        half = len(text[k]) // 2
        assert r.edited_sha256 == hashlib.sha256((text[k][:len(text[k]) - half] + following[:half]).encode()).hexdigest()


def brute_groups(rows, n, percent=80):
    sets = {i: shingle_set(t, n) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


def edited_family(rng, n):
    """A text and copies with more and more words changed, some of them linked only through others."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(60)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
        if k % 3 == 0:
            base = copy
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    texts = [t for _ in range(6) for t in edited_family(rng, 25)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(40)]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), n).collect()}
    assert got == brute_groups(rows, n)
    assert len({c for _, c in got.values()}) < len(rows)


def near_copies(rng, count, changes, words=150):
    """Copies of one text with some words changed, each in other places."""
    base = [f"b{k}" for k in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for at in rng.sample(range(words), rng.choice(changes)):
            copy[at] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_of_groups_that_hang_together_in_parts(spark, monkeypatch):
    """With a single member picked at first, groups take several rounds: chains, families in families, repeated ids."""
    monkeypatch.setattr(neardup, "FEW", 1)
    rng = random.Random(80)
    rows = list(enumerate(near_copies(rng, 60, (0, 1, 2, 4, 6, 9), 60)))
    rows += [(100 + k, f"{t} {' '.join(f't{j}' for j in range(24))}") for k, t in enumerate(near_copies(rng, 30, (0, 2, 3), 60))]
    rows += [(200 + k, t) for k, t in enumerate(edited_family(rng, 40))]
    rows += [(300 + k, f"{t} {k} tail {k}") for k, t in enumerate(near_copies(rng, 20, (5, 6, 7, 8), 60))]
    rows += [(k, t) for k, t in rows[:5]] + [(400, "b1 b2"), (401, "b1 b2 b3"), (402, None)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           neardup.near_duplicates(docs(spark, rows).repartition(3), 4).collect()}
    assert got == brute_groups(rows, 4)


def test_few_pairs_of_a_large_group_of_near_copies_are_compared(spark, monkeypatch):
    rng, compared, links = random.Random(8), [], neardup._links

    def counted(pairs, *args):
        compared.append(pairs.count())
        return links(pairs, *args)

    monkeypatch.setattr(neardup, "_links", counted)
    texts = near_copies(rng, 300, (0, 1, 2, 3)) + near_copies(rng, 300, (4, 5, 6, 7))
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute_groups(rows, 4)
    assert max(compared) < 12 * len(rows) and sum(compared[2:]) < 4 * len(rows)  # after the first pivots


def test_near_duplicates_of_awkward_rows(spark):
    rows = awkward()
    got = neardup.near_duplicates(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert want[2][1] == -3 and want[8][1] == want[10][1] == 8
    kept = neardup.without_near_duplicates(docs(spark, rows), 4)
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {None, -3, 5, 6, 7, 8, 9, 20, 21}


def test_no_documents(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    assert decontaminate.contained_items(docs(spark, []), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_estimate_follows_similarity(spark):
    a = [f"s{k}" for k in range(400)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:320])), (2, " ".join(f"t{k}" for k in range(400)))]
    raw, offs = text_bytes(__import__("pyarrow").array([t for _, t in rows]))
    bits = neardup.signatures(row_sets(raw, offs, 1))[3]
    table = spark.createDataFrame([(bits[i].tolist(), bits[j].tolist()) for i, j in ((0, 0), (0, 1), (0, 2))],
                                  "x array<long>, y array<long>").select(neardup.estimate("x", "y").alias("e"))
    same, near, far = [r.e for r in table.collect()]
    assert same == 1 and abs(near - 0.8) < 0.15 and far < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice((1, 3, 4, 5, 8, 13, 20, 60, 200)))))
             for k in range(40)] + [(40, None), (41, "  "), (None, "same words here to be found in some text"),
                 (42, "words here to be found in some text")]
    rows = list(awkward())
    for k in range(40):
        filler = [f"f{rng.randrange(10**6)}" for _ in range(rng.choice((10, 400, 3000)))]
        for _ in range(3):
            passage = words(rng.choice(items[:40])[1])
            if rng.random() < 0.5 and len(passage) > 6:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(filler))
            filler[at:at] = passage
        rows.append((100 + k, " ".join(filler)))
    rows.append((200, "The SAME words here\nto be found in some text, then more"))
    want = set()
    for i, t in rows:
        for item, text in items:
            n = min(5, len(words(text)))
            q = shingle_set(text, n) if n else set()
            both = len(q & shingle_set(t, n)) if q and len(words(t)) >= n else 0
            if q and 100 * both >= 80 * len(q):
                want.add((i, item, len(q), both))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in
           decontaminate.contained_items(docs(spark, rows), table).collect()}
    assert got == want and len(got) > 30
    assert (200, None, 5, 4) in got and (200, 42) not in {g[:2] for g in got}  # 4 of 5 shingles are 80 %, 3 of 4 are less
    clean = decontaminate.without_items(docs(spark, rows), table)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, _ in rows if i not in {w[0] for w in want})


def test_items_in_several_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(12)],
                                  "item_id long, text string")
    rows = [(k, "before " + " ".join(f"i{k}w{j}" for j in range(30)) + " after") for k in range(12)]
    monkeypatch.setattr(decontaminate, "BLOCK", 60)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs(spark, rows), items).collect()}
    assert got == {(k, k) for k in range(12)}
