from pyspark.sql import functions as F

from inkledger.streaming import reads


def test_latest_reads_whatever_the_order(spark):
    rows = [(1, "date", 0, 1, "a", 0.5), (1, "date", 0, 2, "b", 0.4), (1, "date", 1, 1, "c", 0.1), (2, "memo", 0, 2, "x", 0.9), (2, "memo", 0, 1, "y", 0.9)]
    schema = "check_id long, field_name string, generation int, pass_rank int, text string, confidence double"
    for part in (rows, rows[::-1]):
        got = {(r.check_id, r.field_name): r.text for r in reads.latest_reads(spark.createDataFrame(part, schema)).collect()}
        assert got == {(1, "date"): "c", (2, "memo"): "x"}


def test_review_stream(spark, tmp_path):
    schema = "check_id bigint, field_name string, seq bigint, kind string, text string, state string"
    spark.createDataFrame([(1, "payer", 1, "gate", "Jo", "unsure"), (1, "payer", 2, "edit", "Joe", None), (1, "payer", 3, "gate", "J", "confident")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = reads.review_records(stream).writeStream.format("memory").queryName("records").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("records").first()
    assert (row.text, row.state, row.touched) == ("Joe", "confirmed", True)


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'click' AS event_type, 1L AS user_id, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'click', 1L, 3.0D")
    assert reads.tumbling(df).select("n", "total").first() == (2, 5.0)
    assert reads.sliding(df).count() == 2 and reads.sessions(df).agg(F.sum("n")).first()[0] == 2
