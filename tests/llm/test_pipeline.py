"""The pipeline against its stages done plainly, and the registered queries."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from tallyweave.llm import pieces, pseudonym, quality
from tests.llm.helpers import shingle_set
from tests.llm.test_pairs import brute_groups

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in names] == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_equals_plain_steps(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    machine = quality.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(table, machine).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect() if r.doc_id in good]
    groups = brute_groups(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sets = {i: shingle_set(t, 5) for i, t in rows}
    rows = [(i, t) for i, t in rows if not any(100 * len(q & sets[i]) >= 80 * len(q) for q in items)]
    feistel = pseudonym.Feistel(pseudonym.DEMO_KEY)
    want = {i: pseudonym.replaced(feistel, t)[0] for i, t in rows}
    assert any(want[i] != t for i, t in rows) and len(want) < 200
    got = pieces.decoded(corpus_pipeline.run(spark, SF)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)


def test_stages_keep_columns_and_take_awkward_tables(spark):
    from tests.llm.helpers import awkward, docs
    for rows in (awkward(), []):
        table = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == table.columns
            stage(spark, table, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


def test_last_stage_draws_without_replacement_and_decodes(spark):
    from tests.llm.helpers import awkward, docs
    rows = awkward(300) + [(60, "x"), (70, "\u2581 own \u2581")]
    table = docs(spark, rows)
    got = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert len(got) == len(rows)
    flat = {(r.doc_id, r.sample): r for r in pieces.sampled(table, 2).collect() if r.doc_id is not None}
    want = dict(rows)
    for r in got:
        if r.doc_id is None:
            continue
        assert r.text == (want[r.doc_id] or "") and all(x.text == r.text for x in r.others)
        drawn = [r, *r.others]
        assert [x.sample for x in drawn] == sorted(n for i, n in flat if i == r.doc_id)
        assert all(x.ids == flat[r.doc_id, x.sample].ids and x.perturbed == flat[r.doc_id, x.sample].perturbed for x in drawn)
        assert len({tuple(x.ids) for x in drawn}) == len(drawn)
    assert max(len(r.others) for r in got) == 1 and any(not r.others for r in got)
    assert [r.others for r in pieces.gathered(table, 1).collect()] == [[]] * len(rows)
    assert all(len(r.others) == 2 for r in pieces.gathered(table.filter("doc_id = 1"), 3).collect())
