from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stagelight.plans import catalogue
from tests.oracle import compare

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, sf, name):
    assert compare(spark, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_plan_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).columns == ["showing_id", "shows_at", "title", "year", "name", "chain", "price"]


def test_every_stale_venue_is_listed(spark):
    from types import SimpleNamespace

    from stagelight.plans import health

    venues = spark.range(300).withColumnRenamed("id", "venue_id")
    runs = venues.where("venue_id < 20").selectExpr("venue_id", "'purchase' as event_type", "timestamp_ntz '1990-01-01 00:00:00' as started_at")
    assert health.stale_venues(SimpleNamespace(venues=venues, runs=runs)).count() == 300


@pytest.mark.parametrize("name", ["page_entries", "page_errors"])
def test_references_without_an_end(spark, tmp_path, name):
    page = '<html lang="en"><head><meta charset="utf-8"></head><body><nav><ul><li><a href="/a">A &amp;amp B&amp</a></li></ul></nav><article><h1>%s</h1></article></body></html>'
    titles = ["Ly.&amp;&amp; and&amp", "A title of more than forty characters &amp;&amp", "&am", "&amp;lt; &lt;b&gt; &#39;&quot; & x;"]
    spark.createDataFrame([(i, "http://a/", page % t) for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert compare(spark, QUERIES[name], SQL[name], str(tmp_path)) == ""


def parts(spark, tmp_path, rows) -> str:
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def most_rows(df) -> int:
    """Rows out of the step of a query's plan that has the most, once it is run."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_scores_of_odd_works(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"{draw.choice('abcdef')} {draw.choice(['ring', 'bolt'])}", "B", draw.choice(["X", "Y"]), draw.choice([1, 2, 3, 4, 5, 9, 12]), 900 + draw.randrange(30) / 10) for i in range(250)]
    rows += [(1000, "lone ring", "B", "Z", 1, 900.0), (1001, "odd", "B", "Z", 1, 900.0), (1002, "even", "B", "Z", 9, 900.0), (1003, "a pin", "B", "Y", 4, 950.0), (1004, "a pin", "B", "Y", 4, 950.0)]
    where = parts(spark, tmp_path, rows)
    assert compare(spark, QUERIES["external_scores"], SQL["external_scores"], where) == ""


def test_scores_meet_few_candidates(spark, tmp_path):
    """A work meets a fixed number of candidates, however many share its genre and head."""
    where = parts(spark, tmp_path, [(i, f"t{i % 700} ring", "B", "X", i % 5, 900 + i / 10) for i in range(2000)])
    assert most_rows(QUERIES["external_scores"](spark, where)) <= 40 * 2000


def test_title_pairs_are_spread(spark, tmp_path, monkeypatch):
    """The pairs of one title and year are many tasks' work."""
    monkeypatch.setattr("stagelight.plans.dedupe.BLOCK", 20, raising=False)
    monkeypatch.setattr("stagelight.plans.dedupe.PAIRS_A_TASK", 2000, raising=False)
    where = parts(spark, tmp_path, [(i, "Hot-ring" if i % 2 else "hot ring", "B", "X", 1, 900.0) for i in range(501)] + [(900 + i, f"t {i % 7}", "B", "X", i % 3, 900.0) for i in range(40)] + [(999, None, "B", "X", 1, 900.0)])
    name = "normalised_title_pairs"
    assert compare(spark, QUERIES[name], SQL[name], where) == ""
    shares = [r["count"] for r in QUERIES[name](spark, where).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) > 501 * 500 / 2 and max(shares) < sum(shares) / 8


def test_matches_of_odd_works(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, f"{draw.choice(['hot', 'hat', 'cold', 'bold'])} {draw.choice(['ring', 'bolt', 'ringer'])}", draw.choice(["A", "B", None]), "X", draw.choice([1, 2, 3, 5, 8, 9, 20]), 900 + draw.randrange(9) / 10) for i in range(90)]
    rows += [(200, "lone", "C", "X", 30, 900.0), (201, "x pin", "C", "X", 31, 900.0), (202, "y pin", "C", "X", 31, 900.0), (203, None, "C", "X", 31, 900.0), (204, "x pin", "C", "X", None, 900.0)]
    assert compare(spark, QUERIES["cascading_matches"], SQL["cascading_matches"], parts(spark, tmp_path, rows)) == ""


def test_matches_once_for_works_alike(spark, tmp_path):
    """Works of one title, year and maker meet the tiers' works once."""
    where = parts(spark, tmp_path, [(i, f"t{i % 7} ring", "B", "X", i % 5, 900 + i / 10) for i in range(4000)])
    df = QUERIES["cascading_matches"](spark, where)
    assert most_rows(df) <= 4000 and df.count() == 4000
