"""Maps and windows derived from the driver's tables, by integer arithmetic only.

``runs_f`` is a function on axis a (no overlap) with collinear stretches, small gaps
and reverse blocks; ``runs_m`` has many overlaps and duplicates. Member ids are the
ranks of the names gA.chr1..4 and gB.scaf1..5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

A_LENGTH = 10_000_000
B_LENGTH = {"f": 40_000_000, "m": 100_000_000}

RUNS_SQL = {
    "f": """
SELECT CAST((o_orderkey {div} 200) % 4 AS BIGINT) AS a_member, o_orderkey * 64 AS a, CAST((o_orderkey {div} 100) % 5 AS BIGINT) AS b_member,
  CASE WHEN rev = 1 THEN 40000000 - o_orderkey * 64 - sh - l ELSE o_orderkey * 64 + sh END AS b, l AS len, rev AS strand
FROM (SELECT o_orderkey, CAST(16 + o_custkey % 49 AS BIGINT) AS l, (o_orderkey {div} 10) % 3 * 7 AS sh,
        CASE WHEN (o_orderkey {div} 50) % 3 = 2 THEN 1 ELSE 0 END AS rev FROM {orders}) x""",
    "m": """
SELECT l_orderkey % 4 AS a_member, a, l_suppkey % 5 AS b_member,
  CASE WHEN l_returnflag = 'R' THEN 100000000 - a - l ELSE a + 1000 * (l_partkey % 3) END AS b, l AS len, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS strand
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS l, (l_orderkey {div} 4) * 16 + l_linenumber * 8 AS a FROM {lineitem}) x""",
}
WINDOWS_SQL = {
    "f": "SELECT event_id AS query_id, event_id % 4 AS member, event_id * 96 AS lo, event_id * 96 + (event_id % 7) * (event_id % 7) * 60 AS hi FROM {events}",
    "m": "SELECT event_id AS query_id, user_id % 4 AS member, event_id * 6 AS lo, event_id * 6 + (event_id % 7) * (event_id % 7) * 10 AS hi FROM {events}",
    "b": "SELECT event_id AS query_id, event_id % 5 AS member, event_id * 96 AS lo, event_id * 96 + (event_id % 7) * (event_id % 7) * 60 AS hi FROM {events}",
}


def _spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events") if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("{div}", "DIV"), **tables)


def runs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _spark(spark, sf_dir, RUNS_SQL[kind])


def windows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _spark(spark, sf_dir, WINDOWS_SQL[kind])


def members(spark: SparkSession, kind: str) -> DataFrame:
    """Four members of axis a and five of axis b, named and grouped."""
    return spark.sql(
        f"""SELECT 'a' AS axis, id AS member_id, concat('gA.chr', id + 1) AS name, CAST({A_LENGTH} AS BIGINT) AS length, CAST(0 AS BIGINT) AS group_id FROM range(4)
        UNION ALL SELECT 'b', id, concat('gB.scaf', id + 1), CAST({B_LENGTH[kind]} AS BIGINT), CAST(0 AS BIGINT) FROM range(5)"""
    )


def groups(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'a' AS axis, CAST(0 AS BIGINT) AS group_id, 'gA' AS name UNION ALL SELECT 'b', CAST(0 AS BIGINT), 'gB'")


def duck(sql: str) -> str:
    """The SQL over the pre-registered views."""
    return sql.replace("{div}", "//").replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("{events}", "events")
