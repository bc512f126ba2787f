import time

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import stateful


@pytest.fixture()
def events(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.range(600).select(F.col("id"), (F.col("id") % 7).alias("k"), (F.col("id") * 0.5).alias("x"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)").alias("ts"))
    df.repartitionByRange(3, "id").write.parquet(path)
    return df, stateful.read_folder(spark, path, df.schema), str(tmp_path)


def test_counts_equal_batch(events):
    df, s, tmp = events
    got = stateful.drain(stateful.running_counts(s, "k"), "t_counts", "complete", f"{tmp}/c")
    assert {r.k: r.n for r in got.collect()} == {r.k: r["count"] for r in df.groupBy("k").count().collect()}


def test_windows_and_sessions_run(events):
    df, s, tmp = events
    w = stateful.drain(stateful.windowed_counts(s, "ts", "k", "1 hour", "1 day"), "t_win", "complete", f"{tmp}/w")
    assert w.agg(F.sum("n")).head()[0] == 600 and w.select("window").distinct().count() == 10
    x = stateful.drain(stateful.windowed_counts(s, "ts", "k", "1 hour", "1 day", "30 minutes"), "t_slide", "complete", f"{tmp}/w2")
    assert x.agg(F.sum("n")).head()[0] == 1200
    y = stateful.drain(stateful.sessions(s, "ts", "k", "10 minutes", "1 day"), "t_ses", "complete", f"{tmp}/s")
    assert y.agg(F.sum("n")).head()[0] == 600


def test_averages_equal_batch(spark, tmp_path):
    from spanloom.operators.stats import exponential_average

    path = str(tmp_path / "one")
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("k"), F.sin("id").alias("x"))
    df.coalesce(1).write.parquet(path)
    got = stateful.drain(stateful.exponential_averages(stateful.read_folder(spark, path, df.schema), "k", "x", "id", 0.9), "t_ema", "update", f"{tmp_path}/e")
    want = {r.k: (r.n, round(r.ema, 9)) for r in exponential_average(df, ["k"], "x", ["id"], 0.9).collect()}
    assert {r.k: (r.n, round(r.ema, 9)) for r in got.collect()} == want


def test_top_counts(events):
    df, s, tmp = events
    got = stateful.drain(stateful.top_counts(s, "k", 5, shards=2), "t_top", "update", f"{tmp}/t")
    best = {r["item"]: r.n for r in got.groupBy("item").agg(F.max("n").alias("n")).collect()}
    assert best == {str(r.k): r["count"] for r in df.groupBy("k").count().collect()}


def test_many_users_rank_exactly(spark, tmp_path):
    # more users than any bounded list holds, in several files, so in several batches
    from spanloom.plans import approximate

    df = spark.range(12_000).select((F.col("id") % F.when(F.col("id") % 3 == 0, 3_000).otherwise(50 + F.col("id") % 2_000)).alias("user_id"), F.col("id"))
    df.repartition(3, "id").write.parquet(f"{tmp_path}/events.parquet")
    rows = [(r.item, r.n) for r in approximate.stream_topk(spark, str(tmp_path)).collect()]
    want = sorted(((str(r.user_id), r["count"]) for r in df.groupBy("user_id").count().collect()), key=lambda x: (-x[1], x[0]))
    assert rows == want[:20]


def test_top_counts_give_their_error(spark, tmp_path):
    path = f"{tmp_path}/in"
    df = spark.range(3_000).select((F.col("id") % (1 + F.col("id") % 200)).alias("k"), "id")
    df.repartition(3, "id").write.parquet(path)
    s = stateful.read_folder(spark, path, df.schema)
    got = stateful.last_lists(stateful.drain(stateful.top_counts(s, "k", 2, shards=2), "t_err", "update", f"{tmp_path}/t")).collect()
    true = {str(r.k): r["count"] for r in df.groupBy("k").count().collect()}
    assert len(got) == 4 and sum(r.seen for r in {r.shard: r for r in got}.values()) == 3_000
    assert all(r.n - r.error <= true[r["item"]] <= r.n for r in got) and any(r.error for r in got)


def test_snapshots(spark, events):
    _, s, tmp = events
    q = stateful.snapshots(stateful.running_counts(s, "k"), f"{tmp}/snap", f"{tmp}/snapc", seconds=1)
    try:
        for _ in range(60):
            q.processAllAvailable()
            time.sleep(0.1)
            break
    finally:
        q.stop()
    assert spark.read.parquet(f"{tmp}/snap").groupBy("batch").agg(F.sum("n").alias("n")).agg(F.max("n")).head()[0] == 600


def test_shared_folder_and_release(spark):
    import os

    from spanloom import session

    session.release(spark)
    a = session.cut(spark.range(10), "a")
    where = session._written[-1]
    assert a.count() == 10 and os.path.isdir(where.removeprefix("file://"))
    assert session.release(spark) == 1 and not os.path.exists(where.removeprefix("file://"))

    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Cluster, type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_small_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from spanloom.session import small

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id", "id").alias("a"))
    assert small(df) and not small(df, rows=99) and not small(df, size=90_000) and small(df.select("id"), size=1000)
    assert small(df.limit(0), rows=0, size=0)
