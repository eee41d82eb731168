"""Token counts through a digest cache.

Content digests are joined to a stored table of (digest, tokenizer version, count); only distinct digests
without a stored count are encoded, and their counts are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, new_path, small, stage, unstage
from .tokenizers import encode, version

#: Rows (of id and digest, some 100 bytes) of repeated contents that are broadcast to skip them; beyond it the texts shuffle.
REPEATS = 250_000
CACHE = "digest binary, tokenizer string, n_tokens bigint"


def read_cache(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The stored counts; an empty table where nothing is stored yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    cache_path: the stored counts, shared by runs; a new one for this call if None.  Null texts count as empty.
    Texts of any length are counted whole.  Repeated rows and null ids keep rows of their own, also where the cache has
    a digest twice; extra columns are ignored; an empty table gives an empty result and leaves the cache as it is.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    cache_path = cache_path or new_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    slim = stage(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version(tokenizer))

    one = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = stage(one.join(stored, "digest", "left_anti").select("digest", F.coalesce("doc_id", F.lit(-1)).alias("key")), "token-misses")
    rows = keyed.withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    settled = slim.select("digest", F.coalesce("doc_id", F.lit(-1)).alias("key")).join(misses, ["digest", "key"], "left_anti")
    settled = stage(settled, "token-settled")
    if small(settled, REPEATS):
        todo = rows.join(F.broadcast(settled), ["digest", "key"], "left_anti")
    else:
        todo = rows.join(misses, ["digest", "key"], "left_semi")

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.drop_duplicates("digest")
            yield pd.DataFrame({"digest": p["digest"], "n_tokens": [len(encode(tokenizer, t)) for t in p["text"]]})

    fresh = todo.select("digest", "text").mapInPandas(counts, "digest binary, n_tokens bigint")
    fresh = fresh.dropDuplicates(["digest"]).select("digest", F.lit(version(tokenizer)).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    # Runs that share a cache, or one that is tried again, may have appended a digest twice.
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version(tokenizer)).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    unstage(misses, settled)
    counted = slim.join(known, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
