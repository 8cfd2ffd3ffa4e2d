"""Every query of the broadcast operators against its SQL. Keys of line items repeat in the smallest tables, so the next ones are taken."""

from __future__ import annotations

import math

import duckdb
import pytest

from crestline import plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v != v:
        return None
    if isinstance(v, float) and math.isfinite(v):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = plans.queries()[name](spark, SF)
    want = db.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_order_of_input_does_not_matter(spark):
    from crestline.operators import greedy
    from crestline.plans.tables import candidates
    from pyspark.sql import functions as F

    found = candidates(spark, SF)
    order = [F.desc("score"), F.asc("peak_ms"), F.asc("id")]
    a = greedy.suppress(found, ["broadcast_id"], order).select("id", "pick").collect()
    b = greedy.suppress(found.orderBy(F.xxhash64("id")).repartition(7), ["broadcast_id"], order).select("id", "pick").collect()
    assert sorted(a) == sorted(b)
