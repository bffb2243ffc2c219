"""The stock-health report on a file stream equals the batch report."""

import os
import tempfile

from conftest import sf_dir
from shelfwise.operators.metrics import enrich
from shelfwise.operators.overview import stock_health
from shelfwise.schema import INVENTORY_SCHEMA
from shelfwise.sources.star import star_schema_inventory
from shelfwise.streaming.inventory_stream import enriched_stream, start_stock_health


def test_streamed_health_equals_batch(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="shelfwise-stream-"), "in")
    inv = star_schema_inventory(spark, sf_dir("0.001"))
    inv = inv.withColumn("row_seq", inv["row_seq"].cast("bigint"))  # fits at this scale
    inv.select(*[f.name for f in INVENTORY_SCHEMA.fields]).repartition(3).write.parquet(src)
    q = start_stock_health(spark, src, "health_test", max_files_per_trigger=1)
    try:
        q.processAllAvailable()
        streamed = spark.sql("SELECT * FROM health_test").first()
    finally:
        q.stop()
    batch = stock_health(enrich(spark.read.parquet(src))).first()
    assert streamed.asDict() == batch.asDict()
    assert q.lastProgress is not None


def test_enriched_stream_is_streaming(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="shelfwise-stream-"), "in")
    inv = star_schema_inventory(spark, sf_dir("0.001")).limit(10)
    inv.withColumn("row_seq", inv["row_seq"].cast("bigint")).write.parquet(src)
    s = enriched_stream(spark, src)
    assert s.isStreaming and "days_to_stockout" in s.columns


def test_csv_stream_health_equals_batch(spark):
    from pyspark.sql import functions as F
    src = os.path.join(tempfile.mkdtemp(prefix="shelfwise-stream-"), "csv")
    inv = star_schema_inventory(spark, sf_dir("0.001"))
    inv = inv.withColumn("row_seq", inv["row_seq"].cast("bigint"))
    cols = [f.name for f in INVENTORY_SCHEMA.fields]
    inv.select(*[F.col(c).cast("string") for c in cols]).repartition(2) \
       .write.option("header", True).csv(src)
    health = stock_health(enriched_stream(spark, src, fmt="csv"))
    q = (health.writeStream.outputMode("complete").format("memory").queryName("health_csv")
         .option("checkpointLocation", os.path.join(os.path.dirname(src), "ckpt")).start())
    try:
        q.processAllAvailable()
        streamed = spark.sql("SELECT * FROM health_csv").first()
    finally:
        q.stop()
    assert streamed.asDict() == stock_health(enrich(inv)).first().asDict()


def test_restart_goes_on_where_it_stopped(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="shelfwise-stream-"), "in")
    inv = star_schema_inventory(spark, sf_dir("0.001"))
    inv = inv.withColumn("row_seq", inv["row_seq"].cast("bigint")).select(*[f.name for f in INVENTORY_SCHEMA.fields])
    first, second = inv.where("row_seq % 3 <> 0"), inv.where("row_seq % 3 = 0")
    read = []
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        q = start_stock_health(spark, src, "health_restart")
        try:
            q.processAllAvailable()
            read.append(sum(p.numInputRows for p in q.recentProgress))
            total = spark.sql("SELECT total_rows FROM health_restart").first()[0]
        finally:
            q.stop()
    assert read == [first.count(), second.count()] and total == inv.count()
