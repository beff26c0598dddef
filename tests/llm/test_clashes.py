"""Clashing column names, ids with several texts, and the shared folder."""

from __future__ import annotations

import pytest
from axismap.llm import decontaminate, langid, nearcopies, packing, quality, shard, simhash, suffix, tables

NAMES = ["key", "th", "__key", "__th", "__spans", "__same", "__kept", "__text", "none__", "id__", "same__", "gone__", "spans__", "h", "size", "place", "task", "pos", "row", "words", "media", "none", "id", "same"]


@pytest.fixture
def crowded(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, "other words that stand alone here and there for good"), (2, "other words that stand alone here and there for good"), (3, None)]
    return spark.createDataFrame([(k, t, "en", *["clash"] * len(NAMES)) for k, t in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_every_name_passes_through(spark, crowded):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    kept = decontaminate.decontaminate(crowded, bench)
    assert kept.columns == crowded.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3"]
    cut = decontaminate.decontaminate(crowded, bench, action="spans")
    assert cut.columns == crowded.columns and {r.text for r in cut.collect() if r.doc_id == 1} == {"one "}
    for made in (simhash.near_dedup(crowded), nearcopies.near_copies_dedup(crowded)):
        assert made.columns == crowded.columns and sorted(str(r.doc_id) for r in made.collect()) == ["1", "2", "3"]
        assert {r["__same"] for r in made.collect()} == {"clash"}
    assert suffix.remove_repeats(crowded).columns == crowded.columns and suffix.remove_repeats(crowded).count() == 4
    model = langid.fit(crowded)
    assert langid.score(crowded, model, keep=["doc_id", "text", "__text"]).columns == ["doc_id", "text", "__text", "lang_pred", "score"]
    assert langid.score(crowded, model, keep=["doc_id", "text", "__text"]).count() == 4 and langid.keep_identified(crowded).columns == crowded.columns
    assert packing.best_fit_packing(crowded).count() == 4 and shard.shard(crowded, 2).count() == 4
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.predict(crowded, labels).count() == 4


def test_one_id_with_near_equal_texts(spark):
    long = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(1, long), (1, long + " end"), (2, "quite another text")], "doc_id long, text string")
    for made in (simhash.near_dedup(df, radius=8), nearcopies.near_copies_dedup(df)):
        assert sorted(r.doc_id for r in made.collect()) == [1, 2]


def test_fates_beyond_the_broadcast_bound(docs, monkeypatch):
    rows = [(k, "the same words again" if k % 2 else f"text {k} with its own words") for k in range(20)] + [(0, "text 0 with its own words")]
    want = sorted(r.doc_id for r in nearcopies.near_copies_dedup(docs(rows)).collect())
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    assert sorted(r.doc_id for r in nearcopies.near_copies_dedup(docs(rows)).collect()) == want == [0, 1, *range(2, 20, 2)]


def test_tables_are_released(spark):
    since = tables.mark(spark)
    first, second = (tables.stash(spark.range(k), "released") for k in (3, 4))
    tables.release(spark, since, [second])
    assert tables.mark(spark) == since + 1 and second.count() == 4
    with pytest.raises(Exception, match="released"):
        first.collect()


def test_unused_names():
    assert tables.unused(["A", "a_"], "a") == "a__" and tables.unused(["b"], "a") == "a"
