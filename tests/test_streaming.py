from pyspark.sql import functions as F

from inkfold.streaming import messages as ms

SCHEMA = "request_id long, session long, ts timestamp, type string, page long, scale double, broken boolean"


def test_validation_and_supersession_on_a_stream(spark, tmp_path):
    rows = [(1, 1, "RENDER_PAGE", 3, 1.0, False), (2, 1, "RENDER_PAGE", 99, 1.0, False), (3, 2, "RENDER_PAGE", 1, 99.0, False), (4, 2, "FIND_PAGE", 1, 1.0, False), (5, 1, "OPEN_SOURCE", None, None, True)]
    df = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in rows], "request_id long, session long, type string, page long, scale double, broken boolean")
    df.withColumn("ts", F.current_timestamp()).select([x.split()[0] for x in SCHEMA.split(", ")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = ms.validated(stream).writeStream.format("memory").queryName("validated").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.request_id: r.is_valid for r in spark.table("validated").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    q = ms.superseding(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.session: r.request_id for r in spark.table("newest").collect()} == {1: 2, 2: 3}


def test_render_sessions(spark, tmp_path):
    rows = [(1, 1, "RENDER_PAGE"), (2, 1, "OPEN_RENDERER"), (3, 1, "RENDER_PAGE"), (4, 1, "OPEN_RENDERER"), (5, 1, "CLOSE_RENDERER"), (6, 1, "RENDER_PAGE")]
    df = spark.createDataFrame(rows, "request_id long, session long, type string").select("request_id", "session", F.current_timestamp().alias("ts"), "type", F.lit(2).cast("long").alias("page"), F.lit(1.0).alias("scale"), F.lit(False).alias("broken"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = ms.render_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.request_id: r.verdict for r in spark.table("sessions").collect()}
    assert got == {1: "not_open", 2: "opened", 3: "accepted", 4: "invalid_request", 5: "closed", 6: "closed"}
