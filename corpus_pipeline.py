"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of ``docs`` as they came. A document is a row; rows with a null or repeated id are handled by content, so that no row is lost
or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.decontaminate import decontaminate
from foretrace.llm.near_dup import near_duplicates
from foretrace.llm.pieces import encode_documents
from foretrace.llm.pii import find_personal_data, redact
from foretrace.llm.quality import judge
from foretrace.session import ship_package

#: Names that the stages use beside the columns of documents.
MARK = "__stage"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike the trusted ones go."""
    ship_package(spark)
    judged = judge(docs, table(spark, sf_dir, "labels"), into=MARK)
    return judged.where(F.col(f"{MARK}.kept")).select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; of equal ids, that with the least text hash,
    and of equal rows one. In a group without any id, the row with the least text hash stays.

    Rows get a number that orders them by (id, text hash) within their group on narrow rows; the texts are read only to be
    joined with the numbers of those that stay.
    """
    ship_package(spark)
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    rows = near_duplicates(keyed, id_col="key").groupBy("key", "component_id").agg(F.count(F.lit(1)).alias("n"))
    # null ids come first in structs, so they are told apart
    order = F.struct(F.col("key.doc_id").isNull().alias("empty"), F.col("key").alias("key"), F.col("n").alias("n"))
    best = cut_lineage(rows.groupBy("component_id").agg(F.min(order).alias("best")).select("best.key.doc_id", "best.key.hash", "best.n"))
    stay = best.select(*[F.col(c).alias(f"{MARK}_{c}") for c in best.columns])
    marked = docs.withColumn(MARK, F.xxhash64("text"))
    same = marked.doc_id.eqNullSafe(stay[f"{MARK}_doc_id"]) & (marked[MARK] == stay[f"{MARK}_hash"])
    met = marked.join(stay, same)
    alone = met.where(F.col(f"{MARK}_n") == 1).select(*docs.columns)
    if best.where("n > 1").isEmpty():
        return alone
    return alone.unionByName(_one_of_each(met.where(F.col(f"{MARK}_n") > 1), docs.columns))


def _one_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One of several rows with the same id and text hash; rows that differ only in other columns are the same document."""
    others = [c for c in columns if c != "doc_id"]
    picked = rows.groupBy("doc_id", MARK).agg(F.min(F.struct(*others)).alias(MARK + "_row"))
    return picked.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"{MARK}_row.{c}").alias(c) for c in columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    ship_package(spark)
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"), into=MARK)
    return marked.where(~F.col(f"{MARK}.contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    ship_package(spark)
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = find_personal_data(renamed, id_col=place["doc_id"], text=place["text"], keep=tuple(c for c in place.values() if c != place["doc_id"]))
    # Spark cannot hand the expression itself to a Python function; one that depends on the row's place stays a column.
    text = F.when(F.monotonically_increasing_id() >= 0, redact(F.col(place["text"]), F.col("spans")))
    made = {"text": text}
    if "n_chars" in place:
        made["n_chars"] = F.when(F.size("spans") > 0, F.char_length(text).cast("bigint")).otherwise(F.col(place["n_chars"]))
    return found.select(*[made.get(c, F.col(place[c])).alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept texts by the SentencePiece model, and the texts decoded from them, as digests."""
    ship_package(spark)
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Fingerprint links and piece tables are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
