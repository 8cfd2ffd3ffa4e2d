"""Queries on tables whose keys, counts or times leave the range of the given small ones, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from crestline import plans
from test_queries import rows

#: Chapters of two minutes of which one source needs more milliseconds than an int holds.
CHAPTERS = 18_000


def same_as_sql(spark, name, path, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got, want = plans.queries()[name](spark, str(path)), con.sql(plans.oracle_sql()[name])
    found = [tuple(r) for r in got.collect()]
    assert found and rows(got.columns, found) == rows(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def long_source(tmp_path_factory):
    path = tmp_path_factory.mktemp("long-source")
    duckdb.connect().execute(f"COPY (SELECT range AS doc_id, 'text ' || range AS text, 'en' AS lang, 'src' AS source, 9::BIGINT AS n_chars FROM range({CHAPTERS})) TO '{path}/documents.parquet'")
    return path


@pytest.mark.parametrize("name", ["all_chapters", "chapter_refs", "chapter_upserts", "compact_chapters", "cost_envelopes", "speech_coverage", "visual_chapters"])
def test_chapters_of_a_long_source(spark, long_source, name):
    same_as_sql(spark, name, long_source, ["documents"])


def test_cells_of_a_long_source(spark):
    from crestline.operators import intervals as iv

    last = iv.cells(spark.createDataFrame([(1, 3_000_000_000)], "broadcast_id long, duration_ms long"), 600_000).orderBy("cell").collect()[-1]
    assert (last["start_ms"], last["end_ms"]) == (2_999_400_000, 3_000_000_000)


def test_titles_alike_without_pairs(spark):
    """Lengths at both ends of the range, repeated videos, missing titles and lengths: as by all pairs, and no pair is made."""
    import random

    from crestline.operators import catalog

    rng = random.Random(4)
    titles, length = ["a", "a", "a", "b", None], lambda: rng.choice([None, -2000, 0, 1, 2000, 2001, 32_016, 34_016, rng.randrange(80_000)])
    some = lambda n, k: [(k + x, rng.choice(titles), length(), None, None) for x in range(n)]
    kinds = "title string, duration_ms long, fingerprint long, {} long"
    videos, queries = some(60, 0), some(400, 0)
    videos += videos[:3]
    found = catalog.titled_alike(spark.createDataFrame(queries, "query_id long, " + kinds.format("video_id")), spark.createDataFrame(videos, "video_id long, " + kinds.format("x")), 2000)
    want = set()
    for q, title, d, *_ in queries:
        met = [v for v, t, e, *_ in videos if t is not None and t == title and None not in (d, e) and abs(d - e) <= 2000]
        if met:
            want.add((q, len(met), met[0] if len(met) == 1 else None))
    assert {(r["query_id"], r["n"], r["found"] if r["n"] == 1 else None) for r in found.collect()} == want
    assert any(n == 1 for _, n, _ in want) and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_catalog_of_one_title(spark):
    """A title that 100,000 videos have is 10 ** 10 pairs, of which none is needed."""
    from crestline.operators import catalog
    from pyspark.sql import functions as F

    v = spark.range(100_000).select(F.col("id").alias("video_id"), F.lit("t").alias("title"), (F.col("id") % 5000).alias("duration_ms"), F.lit(None).cast("long").alias("fingerprint"))
    q = v.withColumn("query_id", F.col("video_id")).withColumn("video_id", F.lit(None).cast("long"))
    assert {(r["status"], r["match"]) for r in catalog.match_catalog(q, v).collect()} == {("ambiguous", None)}


def test_whole_texts_do_not_fill_arrow_batches(spark):
    """Ten thousand whole texts are not held by one Python worker at once."""
    from test_queries import SF

    for name in ("text_functions", "field_bytes"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
        udfs = [line for line in plan.toString().splitlines() if "ArrowEvalPython" in line]
        assert "BatchEvalPython" in plan.toString() and not any("nfkc" in line or "cut" in line for line in udfs)


def test_many_small_groups_share_arrow_batches(spark):
    """A broadcast's few dozen rows are not a batch of their own for Python."""
    from test_queries import SF

    for name in ("refinement_leads", "diverse_selection"):
        df = plans.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "GroupsIn" not in plan and "CoGroups" not in plan and df.count()


def test_event_windows_are_dealt_before_they_are_tripled(spark):
    """three rows of each candidate were sorted and sent by the tasks that read; equal ids still give a window once."""
    from crestline.operators import gates

    rows = [(1, 1, 20_000, 60_000), (1, 1, 30_000, 60_000), (2, 2, 0, 5_000)]
    found = gates.event_windows(spark.createDataFrame(rows, "broadcast_id long, id long, peak_ms long, duration_ms long"))
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("AdaptiveSparkPlan") :] if "AdaptiveSparkPlan" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    got = sorted((r["id"], r["phase"], r["start_ms"], r["end_ms"]) for r in found.collect())
    assert got == [(1, "after", 35_000, 45_000), (1, "before", 5_000, 15_000), (1, "near", 15_000, 25_000), (1, "near", 25_000, 35_000), (2, "near", 0, 5_000)]
