"""Operator 1, token counts: a digest cache of counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Scratch, by_place, table, text_of
from .tokens import counter, version_digest


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache table (digest, version, n_tokens); empty where none was written yet."""
    schema = "digest binary, version string, n_tokens long"
    try:
        return spark.read.schema(schema).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def count_tokens(docs: DataFrame, cache_path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Token counts of whole texts, one row for each row of ``docs``: id, n_bytes, n_tokens, over_limit, digest.

    Texts are named by the SHA-256 of their normalised content, where normalising reads null as empty and changes
    nothing else, since the tokenizer itself sees each byte. Digests are joined to the counts stored under this
    tokenizer's version digest; only texts of distinct digests that miss are encoded, and their counts are appended
    to the table at ``cache_path`` (a folder that the cluster shares) before the counts are joined. Two jobs that
    append at once may both store a digest: readers take one row for each digest.

    Null and empty texts have 0 bytes and 0 tokens; a null or repeated id gives a row each; extra columns are not
    read, and an empty table gives no rows.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    version = version_digest(vocabulary)
    d, (i, t) = by_place(docs, id_col, text_col)
    text = text_of(t)
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = d.select(F.col(i).alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    texts = d.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    stored = read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = texts.join(stored.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = counter(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                n = [len(ids) // 4 for ids in tok.ids(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    missing.mapInArrow(encode, "digest binary, version string, n_tokens long").write.mode("append").option("compression", "zstd").parquet(cache_path)
    stored = read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written once, so that the join deals both sides itself and a digest that many rows bear is split.
    found = rows.join(Scratch(spark, "token-counts").save(stored, "stored"), "digest")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for all documents, from a cache that this call starts empty."""
    cache = f"{Scratch(spark, 'token-cache').path}/counts"
    return count_tokens(table(spark, sf_dir, "documents"), cache)
