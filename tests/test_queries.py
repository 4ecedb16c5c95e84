"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from rallyframe import oracles

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(oracles.oracle_sql())

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no generated tables here")


def test_every_query_is_known_and_every_oracle_has_one():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(NAMES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["match_id", "rally_idx", "start_frame", "end_frame", "last_track", "last_player"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    got = df.collect()
    found = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, row, strict=True)) for row in found.fetchall()]
    key = lambda r: tuple(str(plain(r[c])) if not isinstance(r[c], (int, float)) or isinstance(r[c], bool) else str(float(plain(r[c]))) if plain(r[c]) is not None else "None" for c in columns)
    assert sorted(map(key, got)) == sorted(map(key, want))
