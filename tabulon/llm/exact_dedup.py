"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a bucketed table of (digest, doc_id, batch). New documents are digested (SHA-256 of the text's UTF-8
bytes, 32 bytes a document), reduced to one per digest, anti-joined with the index on the digest, and appended.
Both sides are bucketed or hashed alike, so the index itself is never shuffled again; only digests and ids are
shuffled for the index, and whole rows once where whole rows are asked for.

Defined results: a NULL text has no content, so it is no copy of anything and always stays; an empty text is a text
like any other; of equal texts the smallest doc_id stays (NULL last), of repeated rows one; an empty table gives an
empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, fresh, ready, scratch

SCHEMA = "digest BINARY, doc_id BIGINT, batch INT"


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.encode(F.col(text), "UTF-8"), 256))


class DigestIndex:
    """A folder that outlives the session; opening it again, with as many buckets, finds all that was appended. Give an index that is to grow the buckets for its final size; a new one has spark.sql.shuffle.partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = ready(spark), path
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"tabulon_digests_{zlib.crc32(path.encode()):08x}_{len(path)}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.buckets = buckets

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def next_batch(self) -> int:
        return (self.read().agg(F.max("batch")).first()[0] or 0) + 1

    def append(self, new: DataFrame, batch: int) -> None:
        """new: distinct (digest, doc_id) of which the index has none."""
        rows = new.select("digest", "doc_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def ingest(self, docs: DataFrame) -> int:
        """Appends what is new of docs; gives the number of the batch."""
        batch = self.next_batch()
        seen = self.read().filter(F.col("batch") < batch).select("digest")
        one = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest")).filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        self.append(one.hint("merge").join(seen.hint("merge"), "digest", "left_anti"), batch)
        return batch


def survivors(docs: DataFrame, index: DigestIndex, batch: int) -> DataFrame:
    """Whole rows of docs whose text no earlier batch has: one for each text. Sorting within a digest goes by doc_id; rows that tie are equal in all that counts."""
    key, rank = fresh(docs, "digest"), fresh(docs, "rank")
    by = Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_last())
    keyed = docs.withColumn(key, digest())
    told = keyed.filter(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)
    seen = index.read().filter(F.col("batch") < batch).select(F.col("digest").alias(key))
    return told.hint("merge").join(seen.hint("merge"), key, "left_anti").drop(key).unionByName(keyed.filter(F.col(key).isNull()).drop(key))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, after their digests went into the index (a new one if none is given)."""
    index = index or DigestIndex(docs.sparkSession, scratch(docs.sparkSession, "digests"))
    return survivors(docs, index, index.ingest(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each document that stays. The table arrives in two batches, lower ids first, so that the second meets a filled index."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    index = DigestIndex(spark, scratch(spark, "digests"))
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    index.ingest(docs.filter(early))
    index.ingest(docs.filter(~early))
    return index.read().select("doc_id").unionByName(docs.filter("text IS NULL").select("doc_id"))


OP8_SQL = "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL"
