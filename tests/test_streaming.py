from __future__ import annotations

import datetime as dt

from stagelight.operators.ingest import latest_wins
from stagelight.sources.upserts import KeyedTable, part_of
from stagelight.streaming import replay as R


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.mode("append").parquet(folder)


def test_a_query_goes_on_where_it_stopped(spark, tmp_path):
    """New files are read once; state and sink carry over."""
    day = dt.datetime(2024, 1, 1)
    source, folder = f"{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    events(spark, source, [(1, 7, "a", day, 1.0), (2, 7, "a", day + dt.timedelta(hours=1), 1.0)])
    run = lambda: R.run_to_end(R.limited(R.arriving(spark, source), "user_id", "ts", 86_400, 2), "append", R.append, folder)
    out = run()
    events(spark, source, [(3, 7, "a", day + dt.timedelta(hours=2), 1.0), (4, 7, "a", day + dt.timedelta(hours=25), 1.0)])
    assert run() == out
    got = sorted((r.n, r.allowed) for r in spark.read.parquet(out).collect())
    assert got == [(1, True), (1, True), (2, True), (3, False)]
    run()
    assert spark.read.parquet(out).count() == 4


def test_latest_items_across_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    source, folder = f"{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    keep = R.keep_latest(None, ["user_id"], "ts", "event_id")
    items = lambda: R.arriving(spark, source).select("user_id", "ts", "event_id", "value")
    events(spark, source, [(1, 7, "a", day, 1.0), (2, 8, "a", day, 2.0)])
    R.run_to_end(items(), "append", keep, folder)
    events(spark, source, [(3, 7, "a", day - dt.timedelta(days=1), 9.0), (4, 8, "a", day, 3.0)])
    out = R.run_to_end(items(), "append", keep, folder)
    got = {r.user_id: r.value for r in KeyedTable(spark, out, ["user_id"]).rows(items()).collect()}
    assert got == {7: 1.0, 8: 3.0}


def test_a_key_s_state_ends_with_its_window(spark, tmp_path):
    """A thousand keys in a day, then one request two days later: only that one's window is left."""
    day = dt.datetime(2024, 1, 1)
    source, folder = f"{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    stream = lambda: R.limited(R.arriving(spark, source), "user_id", "ts", 86_400, 2)

    def run():
        query = R.started(stream(), "append", R.append, folder)
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    events(spark, source, [(i, i, "a", day + dt.timedelta(seconds=i), 1.0) for i in range(1000)])
    assert max(run()) >= 1000
    events(spark, source, [(5000, 7, "a", day + dt.timedelta(days=2), 1.0)])
    held = run()
    assert held[-1] < 10
    rows = spark.read.parquet(f"{folder}/out")
    assert rows.count() == 1001 and rows.where("n > 1").count() == 0


def test_upserts_touch_their_own_parts(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/table", ["k"], parts=16)
    rows = lambda values: spark.createDataFrame(values, "k long, at long, v string")
    merge = lambda old, new: latest_wins(old.unionByName(new), ["k"], "at", "v")
    files = lambda: {f for f in (str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet"))}
    table.upsert(rows([(i, 1, f"a{i}") for i in range(200)]), 0, merge)
    before = files()
    change = rows([(5, 2, "b"), (1000, 1, "new"), (6, 0, "old")])
    parts = {r[0] for r in change.select(part_of(["k"], 16)).collect()}
    table.upsert(change, 1, merge)
    assert {f for f in before if int(f.split("_part=")[1].split("/")[0]) not in parts} <= files()
    got = {r.k: r.v for r in table.rows(change).collect()}
    assert got == {**{i: f"a{i}" for i in range(200)}, 5: "b", 1000: "new"}
    # The same batch again, or one that is older, changes nothing.
    after = files()
    table.upsert(change, 1, lambda old, new: old.unionByName(new))
    assert sorted(table.rows(change).collect()) == sorted((k, 2 if k == 5 else 1, v) for k, v in got.items()) and {f.split("_part=")[1].split("/")[0] for f in after} == {f.split("_part=")[1].split("/")[0] for f in files()}


def test_update_mode_gives_the_newest_counts(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    source, folder = f"{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    run = lambda: R.run_to_end(R.daily_counts(R.arriving(spark, source)), "update", R.append, folder)
    events(spark, source, [(1, 7, "a", day, 1.0), (2, 7, "b", day, 2.0)])
    run()
    events(spark, source, [(3, 7, "a", day + dt.timedelta(minutes=5), 4.0)])
    assert sorted((r.event_type, r.n, r.total) for r in R.newest(spark, run(), "w", "event_type").collect()) == [("a", 2, 5.0), ("b", 1, 2.0)]


def test_heartbeat(spark, tmp_path):
    beat = R.Heartbeat()
    spark.streams.addListener(beat)
    source = f"{tmp_path}/events.parquet"
    events(spark, source, [(1, 7, "a", dt.datetime(2024, 1, 1), 1.0)])
    R.run_to_end(R.first_seen(R.arriving(spark, source), ["user_id"]), "append", R.append, f"file://{tmp_path}/run")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(beat)
    assert beat.last
