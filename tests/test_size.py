"""What only showed on larger tables."""

from __future__ import annotations

import os
import random
import time

import pytest
from axismap.operators import chain, query
from axismap.plans import queries as maps
from helpers import DATA, same_rows

OUTGROWN: list[str] = [
    "builder_groups",
    "chain_roundtrip",
    "container_order_a",
    "container_order_b",
    "container_window_a",
    "container_window_b",
    "paf_roundtrip",
    "builder_presorted",
    "container_verify",
]


@pytest.fixture(scope="module")
def outgrown(tmp_path_factory):
    """Tables whose runs lie beyond the lengths declared for their members, and below 0 on axis b."""
    import duckdb

    path = str(tmp_path_factory.mktemp("outgrown"))
    con = duckdb.connect()
    for table, key, more in (("orders", "o_orderkey", 700_000), ("lineitem", "l_orderkey", 3_000_000), ("events", "event_id", 100_000)):
        old = f"{DATA}/{table}.parquet"
        old += "/*.parquet" if os.path.isdir(old) else ""
        con.sql(f"COPY (SELECT * FROM '{old}' UNION ALL SELECT * REPLACE ({key} + {more} AS {key}) FROM '{old}') TO '{path}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return path, con


@pytest.mark.parametrize("name", OUTGROWN)
def test_runs_beyond_declared_lengths(spark, outgrown, name):
    path, con = outgrown
    same_rows(maps.QUERIES[name](spark, path), con.sql(maps.ORACLE_SQL[name]))


def test_sweep_spreads_no_windows(spark):
    """Steps are taken where runs are, so that a window costs its runs and not its positions; windows are not broadcast."""
    runs = spark.createDataFrame([(0, 5, 0, 95, 10, 0), (0, 40, 0, 1_000_003, 20, 1), (1, 0, 1, 95, 10, 0)], "a_member long, a long, b_member long, b long, len long, strand int")
    windows = spark.createDataFrame([(7, 0, 0, 4_000_000), (8, 0, 98, 101), (9, 0, 120, 120), (9, 1, 97, 98)], "query_id long, member long, lo long, hi long")
    found = query.sweep(runs, windows, 10, "b")
    assert sorted((r.query_id, r.pos, r.a) for r in found.collect()) == [(7, 100, 5), (7, 1_000_010, 40), (7, 1_000_020, 40), (8, 98, 5), (9, 97, 0)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def _picked(chains, frac):
    """Best-first by sets of bases."""
    kept, cover = set(), set()
    for number, _, parts in sorted(chains, key=lambda c: (-c[1], c[0])):
        own = {x for s, e in parts for x in range(s, e)}
        if len(own & cover) <= frac * len(own):
            kept.add(number)
            cover |= own
    return kept


def test_many_chains_of_one_query(spark):
    """Choosing costs about the same for each chain, however many were kept before."""
    rng = random.Random(5)
    for frac in (0.0, 0.3, 1.0):
        for _ in range(40):
            chains = [(k, rng.randint(1, 5), [(s, s + rng.randint(1, 9)) for s in rng.sample(range(90), rng.randint(1, 3))]) for k in range(25)]
            assert chain.pick(chains, frac) == _picked(chains, frac)
    began = time.time()
    assert len(chain.pick([(k, k % 7, [(20 * k, 20 * k + 10)]) for k in range(60_000)], 0.0)) == 60_000
    assert time.time() - began < 20


def test_chains_chosen_by_stretch(spark):
    """Chains that meet only by way of others, and over bins, are chosen together."""
    rng = random.Random(6)
    chains = [(k, rng.randint(1, 9), [(s, s + rng.choice((5, 40, 700_000 if k % 20 == 0 else 9))) for s in (rng.randint(0, 4_000_000 if k % 3 else 900),)]) for k in range(200)]
    spans = spark.createDataFrame([(0, k, score, s, e) for k, score, parts in chains for s, e in parts], "q_member long, chain_id long, chain_score long, q_start long, q_end long")
    got = chain.select_chains(spans, 0.0)
    assert got.count() == 200
    assert {r.chain_id for r in got.collect() if r.keep} == chain.pick(chains, 0.0)
