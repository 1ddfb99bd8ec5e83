"""The job log as a stream gives the states of the batch fold."""

import datetime
import time

from pyspark.sql import functions as F

from docloom.streaming import jobs

ROWS = [(1, "a", "submit"), (2, "a", "claim"), (3, "b", "claim"), (4, "a", "heartbeat"), (5, "b", "submit"), (6, "a", "complete"), (7, "a", "claim"), (8, "b", "claim"), (9, "b", "fail"), (10, "b", "resume"), (11, "b", "claim"), (12, "c", "submit")]
WANTED = {"a": ("complete", 1), "b": ("running", 2), "c": ("queued", 0)}


def events(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + datetime.timedelta(minutes=i), j, e) for i, j, e in rows], "event_id long, ts timestamp, job_id string, event string")


def folded(rows):
    out = {}
    for _, job, event in rows:
        state, n = out.get(job, ("", 0))
        out[job] = (jobs.step(state, event), n + (event == "claim" and state == "queued"))
    return out


def test_batch_fold(spark):
    assert {r["job_id"]: (r["state"], r["attempts"]) for r in jobs.final_states(events(spark, ROWS)).collect()} == WANTED
    assert folded(ROWS) == WANTED


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(events(spark, ROWS).schema).parquet(str(tmp_path / "in"))
    got = {}

    def keep(df, _):
        got.update({r["job_id"]: (r["state"], r["attempts"]) for r in df.collect()})

    run = jobs.job_stream(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).start()
    try:
        for k in range(3):
            events(spark, ROWS[k * 4 : k * 4 + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            wanted = folded(ROWS[: k * 4 + 4])
            # Batches without rows go on for the timers' sake, so there is no end of input to wait for.
            end = time.time() + 60
            while got != wanted and time.time() < end:
                time.sleep(0.2)
            assert got == wanted
    finally:
        run.stop()


def test_claims_and_keys(spark):
    queue = spark.createDataFrame([("x", 2, "queued"), ("y", 1, "running"), ("z", 1, "queued"), ("w", 1, "queued")], "job_id string, created int, status string")
    assert [r["job_id"] for r in jobs.claim_order(queue).collect()] == ["w", "z", "x"]
    given = spark.createDataFrame([(1, "k", "f"), (2, "k", "f"), (3, "k", "g"), (4, "m", "g")], "event_id int, key_hash string, fingerprint string")
    assert [r["outcome"] for r in jobs.idempotency(given).orderBy("event_id").collect()] == ["new", "same", "conflict", "new"]
    done = spark.createDataFrame([("x", "complete", 0), ("y", "running", 0), ("z", "failed", 90)], "job_id string, status string, s long").withColumn("updated", F.timestamp_seconds("s"))
    assert [r["job_id"] for r in jobs.expired(done, datetime.datetime(1970, 1, 1, 0, 1, 40), 60).collect()] == ["x"]
