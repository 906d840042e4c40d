import datetime as dt

from pyspark.sql import functions as F

from searchmill.operators import state as T
from searchmill.streaming import events as S

T0 = dt.datetime(2024, 1, 1)


def event(i, minutes, user, kind, k):
    return (i, T0 + dt.timedelta(minutes=minutes), user, kind, float(i), f'{{"k": {k}}}')


def write(spark, folder, rows):
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_clicks_join_their_search(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [event(1, 0, 1, "view", 3), event(2, 1, 1, "view", 3), event(3, 5, 1, "click", 3), event(4, 2, 2, "view", 4), event(5, 3, 9, "click", 9)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    S.drain(S.with_clicks(S.read_events(spark, folder)), out, check)
    # later events move the watermark past the unclicked search; the two batches after them let it out
    for n, minutes in enumerate((1000, 2000, 3000)):
        write(spark, folder, [event(50 + n, minutes, 50, "view", 1), event(60 + n, minutes, 50, "click", 2)])
        S.drain(S.with_clicks(S.read_events(spark, folder)), out, check)
    got = {r.search_id: r.clicked_at for r in spark.read.parquet(out).where("search_id in ('1:3', '2:4')").collect()}
    assert got["1:3"] == T0 + dt.timedelta(minutes=5) and got["2:4"] is None
    assert spark.read.parquet(out).where("search_id = '1:3'").count() == 1


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [event(1, 0, 1, "view", 1), event(2, 10, 1, "view", 2)])
    S.drain(S.daily_counts(S.read_events(spark, folder), length="1 day", step="1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    write(spark, folder, [event(3, 60 * 24 * 5, 1, "view", 1)])
    S.drain(S.daily_counts(S.read_events(spark, folder), length="1 day", step="1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.events, r.mean_value) for r in got] == [(2, 1.5)]


def test_queue_versions(spark, tmp_path):
    kind = "url string, normalized_url string, domain string, depth int, source_url string, source_slug string, priority int, arrival long"
    folder, base = str(tmp_path / "in"), str(tmp_path / "queue")
    queue = "id long, url string, normalized_url string, domain string, depth int, source_url string, source_slug string, status string, priority int, retry_count int, scheduled_at timestamp_ntz, processed_at timestamp_ntz"

    def merge(old, batch):
        return T.enqueue_merge(old if old is not None else batch.sparkSession.createDataFrame([], queue), batch, "2024-02-05 00:00:00")

    for depth in (2, 1):
        spark.createDataFrame([("U", "u", "d", depth, None, None, 5, depth)], kind).write.mode("append").parquet(folder)
        S.merge_batches(spark.readStream.schema(kind).parquet(folder), merge, base, str(tmp_path / "check"))
    assert spark.read.parquet(f"{base}/version=1").select(F.min("depth"), F.count("*")).first() == (1, 1)
