from __future__ import annotations

import pytest
from axismap.llm import queries as corpus
from helpers import DATA, same_rows


@pytest.mark.parametrize("name", sorted(corpus.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    same_rows(corpus.queries()[name](spark, DATA), duck.sql(corpus.ORACLE_SQL[name]))


def test_stages(spark, docs, tmp_path):
    """Planted rejects, copies, passages and leaks go; clean documents stay."""
    import corpus_pipeline as cp

    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en' and n_chars > 600").orderBy("doc_id").limit(30).collect()]
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    passage = " ".join(base[0][1].split()[:60])
    from axismap.llm import decontaminate, simhash

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [*base, (5000, "12 34"), (5001, base[3][1]), (5002, "Fresh words stand before what was said. " + passage + " And others after it."), (5003, base[5][1][:200] + " " + leak)]
    stages = dict(cp.STAGES)
    df = docs(rows)
    kept = stages["language_id"](spark, df, DATA)
    assert kept.columns == df.columns and 5000 not in {r.doc_id for r in kept.collect()} and kept.count() == len(rows) - 1
    near = stages["simhash_near_dedup"](spark, kept, DATA)
    groups = {r.doc_id: r.component_id for r in simhash.components(kept).collect()}
    assert {r.doc_id for r in near.collect()} == {k for k, c in groups.items() if k == c} and 5001 not in {r.doc_id for r in near.collect()}
    cut = stages["suffix_array_dedup"](spark, near, DATA)
    texts = {r.doc_id: r for r in cut.collect()}
    assert passage not in texts[5002].text and texts[5002].text.startswith("Fresh words") and all(r.n_chars == len(r.text) for r in texts.values())
    clean = stages["benchmark_decontamination"](spark, cut, DATA)
    dirty = {r.doc_id for r in decontaminate.report(cut, bench).collect() if r.contaminated}
    assert 5003 in dirty and {r.doc_id for r in clean.collect()} == texts.keys() - dirty
    packed = stages["best_fit_packing"](spark, clean, DATA)
    assert {r.doc_id for r in packed.collect()} == texts.keys() - dirty


def test_run(spark):
    import corpus_pipeline as cp

    got = cp.run(spark, DATA)
    assert got.count() > 50 and "sequence_id" in got.columns


@pytest.mark.parametrize("empty", [True, False])
def test_stages_of_empty_and_odd_tables(spark, docs, odd_rows, empty):
    import corpus_pipeline as cp
    from axismap.llm.tables import stash

    long = "A text that is long enough to be told apart from all others, with words of its own. " * 3
    df = docs([] if empty else [*odd_rows, (None, long), (None, long), (40, long + "And an end."), (41, None)])
    for name, stage in cp.STAGES[:-1]:
        out = stash(stage(spark, df, DATA), f"test-{name}")
        assert out.columns == df.columns and out.count() <= df.count()
        df = out
    packed = cp.STAGES[-1][1](spark, df, DATA)
    assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    assert empty == (packed.count() == 0)
