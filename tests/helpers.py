"""What tests share: the small tables, and comparison of a result with SQL."""

from __future__ import annotations

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, relation) -> None:
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = sorted(tuple(map(str, r)) for r in relation.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
