"""Sharding by a two-pass external shuffle, with DataFrame functions only.

The first pass scatters records uniformly over buckets of a memory size by a seeded hash; that is the exchange of the
plan. In the second each bucket is put in the order of a Fisher-Yates shuffle of its places and written. The buckets one
after the other are then a uniform order of all records, which is cut into shards of equal numbers of records.

Only the places of a bucket are shuffled in memory (``shuffle`` draws them by Fisher-Yates from a given seed); records,
however long, go through sorts that spill. A shuffle of the largest bucket's places, without those that a smaller
bucket has not, is one of the smaller bucket's places, so the draws depend on the seed and the bucket number alone: the
same table gives the same shards again, also where an executor was lost and its tasks run anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query
from foretrace.operators.scan import prior_sums
from foretrace.sources.writers import scratch_path

SHARDS, SEED = 40, 20240117
#: Bytes of a bucket, and by how much a record is longer than its text.
BUCKET_BYTES, RECORD_BYTES = 16 << 20, 16
#: Buckets whose places one task draws.
DRAWN = 1024
#: Buckets are numbered in runs of this many, so that no task orders all of them.
RUN = 1000


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint")


def _drawn_places(spark: SparkSession, buckets: int, largest: int, seed: int) -> DataFrame:
    """(bucket, places): for every bucket a Fisher-Yates shuffle of 0 to ``largest`` - 1."""
    numbers = spark.range(0, buckets, 1, -(-buckets // DRAWN) or 1)
    return numbers.select(F.col("id").alias("bucket"), F.shuffle(F.sequence(F.lit(0), F.lit(max(largest, 1) - 1)), seed).alias("places"))


def write_shards(
    docs: DataFrame,
    path: str,
    *,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write every row of ``docs`` below ``path`` and return what was written: shard, slot, and ``record``, the whole row.

    Shards hold numbers of rows at most one apart; slots count from 0 without gaps, in the order of the files. Rows keep
    all their columns within ``record``, so no name can clash. Null ids and texts are scattered like others; rows that are equal
    in id and text share a bucket, so one such row must not repeat more often than a bucket may hold. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    ident, content = F.col(f"record.`{id_col}`"), F.col(f"record.`{text}`")
    key = F.xxhash64(F.lit(seed), ident, F.xxhash64(content))
    narrow = cut_lineage(whole.select(key.alias("key"), record_size(content).alias("size")))
    rows, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    bucket = F.pmod("key", F.lit(buckets)).alias("bucket")
    sizes = cut_lineage(narrow.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.expr(f"bucket div {RUN}")))
    starts = prior_sums(sizes, keys=[], blocks=["run"], order=["bucket"], sums={"start": "n"})
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    drawn = _drawn_places(spark, buckets, largest, seed).join(starts, "bucket")
    places = drawn.select("bucket", "start", F.filter("places", lambda p: p < F.col("n")).alias("places"))
    scattered = whole.select("record", key.alias("key")).withColumn("bucket", bucket)
    inside = Window.partitionBy("bucket").orderBy("key", ident, F.xxhash64(content))
    numbered = scattered.withColumn("number", F.row_number().over(inside)).drop("key")
    position = F.col("start") + F.element_at("places", F.col("number"))
    placed = numbered.join(places, "bucket").select("record", position.alias("position"))
    count = max(rows, 1)
    placed = placed.withColumn("shard", F.expr(f"CAST(position * {shards} div {count} AS int)"))
    first = F.expr(f"(shard * {count}L + {shards - 1}) div {shards}")
    cut = placed.select("record", "shard", (F.col("position") - first).alias("slot"))
    cut.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    kinds = [T.StructField("record", cut.schema["record"].dataType), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


@query("op12_external_shuffle_shards")
def op12_external_shuffle_shards(spark, sf_dir):
    made = write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return made.select(
        F.col("record.doc_id").alias("doc_id"),
        record_size(F.col("record.text")).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


__all__ = ["record_size", "write_shards"]
