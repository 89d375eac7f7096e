"""Exact deduplication by skew-safe combining.

Copies are merged three times, always with the digest *and* the whole text as the key, so two
different texts with one digest never fall together:

1. locally: Spark's partial aggregation merges copies inside an input partition,
2. salted: (digest, salt, text) groups; the salt comes from the id, so a group that holds a
   third of all rows is spread over ``salts`` tasks,
3. globally: at most ``salts`` salt winners for each text are merged.

Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.llm.common import parts, table, text_or_empty, written


def sha256(text: Column) -> Column:
    """32 bytes of SHA-256 over the UTF-8 text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _salted(df: DataFrame, id_col: str, salts: int | None) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts or max(16, parts(df.sparkSession)))).cast("int")


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  digest: Callable[[Column], Column] = sha256, salts: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, digest.

    Null text counts as empty; equal texts (byte for byte) form a group and its largest id
    stays.  Repeated rows of one id count one by one and are all marked alike.  A null id is
    smaller than any other.  An empty input gives no rows.  Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text"))).withColumn("_salt", _salted(rows, "_id", salts))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    digests = written(groups.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")))
    # a digest that stands for one text names its group; the rows of any other are matched by text
    found = rows.select("_id", "_digest").join(digests.where("_texts = 1"), "_digest").select("_id", "_digest", "_keep", "_n")
    if not digests.where("_texts > 1").isEmpty():
        shared = digests.where("_texts > 1").select("_digest")
        texts = groups.join(shared, "_digest", "left_semi")
        found = found.unionByName(rows.select("_id", "_digest", "_text").join(texts, ["_digest", "_text"])
                                  .select("_id", "_digest", "_keep", "_n"))
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
                        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, salts: int | None = None) -> DataFrame:
    """The rows that stay, with all columns of ``df``: one for each text, the one with the
    largest id (ties: the largest other columns in order).  Null text and empty text are
    copies of each other."""
    cols = df.columns
    first = [id_col, *[c for c in cols if c not in (id_col, text_col)], text_col]
    # the text is the key; in the payload only its being null is kept
    payload = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(first[:-1])],
                       F.col(f"`{text_col}`").isNotNull().alias("has_text"))
    rows = df.select(payload.alias("_row"), text_or_empty(text_col).alias("_text"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_digest", digest(F.col("_text"))).withColumn("_salt", _salted(rows, "_id", salts))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_row").alias("_row"))
    kept = salted.groupBy("_digest", "_text").agg(F.max("_row").alias("_row"))
    back = {c: F.col(f"_row.c{i}") for i, c in enumerate(first[:-1])}
    back[text_col] = F.when(F.col("_row.has_text"), F.col("_text"))
    return kept.select(*[back[c].alias(c) for c in cols])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    c = exact_classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
