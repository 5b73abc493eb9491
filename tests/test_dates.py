"""Queries that take their day, cut or year from the tables."""

from pyspark.sql import functions as F

from foretrace.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_days_come_from_the_tables(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAY")).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda name, folder: sorted(map(tuple, catalogue.QUERIES[name](spark, folder).collect()), key=repr)
    for name in ("probable_lineup", "season_leaders"):
        assert rows(name, str(tmp_path)) == rows(name, FOLDER) != [], name
    for name in ("candidate_frame", "lineup_panels", "top_reasons"):
        assert len(rows(name, str(tmp_path))) == len(rows(name, FOLDER)) > 0, name
