"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_text, one_of_each, settle, shared_path, whole_rows, with_group


class DigestIndex:
    """A table (digest, keep_id, group_size) in n_buckets files, bucketed and sorted by digest, that outlives the job.

    add() joins the groups of a batch with it by sort-merge anti-join (the index side is neither shuffled nor sorted) and
    appends what is new. The folder can be opened again by another session under the same path and number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int, name: str | None = None):
        self.spark, self.path, self.n = spark, path, n_buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> DataFrame:
        """Append the digests (doc_id, digest) that the index lacks; returns the index."""
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = settle(self.spark, groups, "groups")  # else the anti-join moves below the sums, and a hot digest's rows are not summed before the shuffle
        new = groups.join(self.table().hint("merge").select("digest"), "digest", "left_anti")
        new.repartition(self.n, "digest").write.format("parquet").mode("append").bucketBy(self.n, "digest").sortBy("digest").saveAsTable(self.name, path=self.path)
        self.spark.catalog.refreshTable(self.name)
        return self.table()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return key_text(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("digest"))


def buckets_for(spark: SparkSession) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def find_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays. A null doc_id loses to
    any other; rows that repeat both doc_id and text are one document and flagged alike. With an index that already holds
    a text, the document in the index stays and group_size is the index's. Empty input gives no rows.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_path(spark, "digests"), buckets_for(spark))
    rows = digests(docs, id_col, text_col)
    out = with_group(rows, index.add(rows), "digest", "group_size", "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are; one row of those that repeat doc_id and text.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays, a null one only if all are
    null. Columns of any name pass through. Empty input gives no rows.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, shared_path(spark, "digests"), buckets_for(spark))
    keep = index.add(digests(docs, id_col, text_col)).select(F.col("digest").alias("kept"), "keep_id")
    out = whole_rows(docs, id_col, text_col).join(keep, (F.col("digest") == F.col("kept")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    # where no id repeats, no row can repeat both id and text
    return one_of_each(out, docs.groupBy(docs[id_col].cast("long").alias("i")).count().where("count > 1").isEmpty())


SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) d
JOIN (SELECT sha256(coalesce(text, '')) AS text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.h = g.text_sha256
"""
