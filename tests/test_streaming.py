import datetime as dt

from pyspark.sql import functions as F

from ledgerwood.streaming import jobs


def put(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_incremental_embeds_stale_rows_once(spark, tmp_path):
    schema = "chunk_id int, embedding array<float>, model string"
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn("model", F.lit("m2"))
    put(spark, source, [(1, None, None), (2, [1.0], "m1"), (3, [1.0], "m2")], schema, "a")
    df = jobs.stream(spark, source, spark.read.parquet(source).schema)
    jobs.incremental(df, embed, "m2", out, at).awaitTermination()
    put(spark, source, [(4, None, None)], schema, "b")
    jobs.incremental(df, embed, "m2", out, at).awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()) == [1, 2, 4]


def test_notifications_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "k", at), (1, "k", at + dt.timedelta(minutes=5)), (2, "k", at)]
    put(spark, str(tmp_path / "n"), rows, "recipient int, dedupe_key string, ts timestamp", "a")
    df = jobs.stream(spark, str(tmp_path / "n"), spark.read.parquet(str(tmp_path / "n")).schema)
    assert len(drained(jobs.once_each(df, "ts", ["recipient", "dedupe_key"]), "notices_once")) == 2


def test_windows_by_effective_time(spark, tmp_path):
    d = lambda n: dt.datetime(2024, 1, n)
    rows = [("a", d(1), d(3)), ("a", d(3), None), ("a", d(20), None)]
    put(spark, str(tmp_path / "e"), rows, "kind string, sent timestamp, received timestamp", "a")
    put(spark, str(tmp_path / "e"), [("a", d(21), None)], "kind string, sent timestamp, received timestamp", "b")
    df = jobs.stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    got = {r["start"]: r["n"] for r in drained(jobs.by_window(df, "received", "sent", ["kind"]), "effective_windows")}
    assert got[d(3)] == 2


def test_stalled_jobs(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema, path = "job_id bigint, status string, ts timestamp", str(tmp_path / "j")
    put(spark, path, [(1, "running", t(0)), (2, "running", t(0)), (2, "done", t(1))], schema, "a")
    df = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.stalled(df).writeStream.format("memory").queryName("stalled_jobs").outputMode("append").start()
    q.processAllAvailable()
    put(spark, path, [(3, "running", t(9))], schema, "b")
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert {r["job_id"] for r in spark.table("stalled_jobs").collect()} == {1}


def test_keyed_upserts(spark, tmp_path):
    path, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "job int, status string, ts int"
    put(spark, path, [(1, "queued", 1), (1, "running", 2), (2, "queued", 1)], schema, "a")
    df = jobs.stream(spark, path, spark.read.parquet(path).schema)
    jobs.keyed_upserts(df, ["job"], "ts", out, at).awaitTermination()
    put(spark, path, [(1, "done", 3)], schema, "b")
    jobs.keyed_upserts(df, ["job"], "ts", out, at).awaitTermination()
    assert {(r["job"], r["status"]) for r in spark.read.parquet(f"{out}/v=1").collect()} == {(1, "done"), (2, "queued")}


def test_upserts_keep_the_newest_row_however_late(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("u", "table", "cp"))
    schema = "k int, at int, v string"
    run = lambda: jobs.keyed_upserts(jobs.stream(spark, source, spark.read.parquet(source).schema), ["k"], "at", out, at).awaitTermination()
    for rows in ([(1, 10, "new"), (2, 1, "a")], [(1, 5, "late"), (3, 7, "c")], [(2, 1, "again")]):
        put(spark, source, rows, schema, "x")
        run()
    assert sorted(map(tuple, jobs.current(spark, out).select("k", "v").collect())) == [(1, "new"), (2, "again"), (3, "c")]
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v=")]) <= 2
