"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import Scratch, by_place, table
from veraframe.llm.line_dedup import dedup_lines
from veraframe.llm.minhash import near_duplicates
from veraframe.llm.mixing import mix_documents
from veraframe.llm.packing import pack
from veraframe.llm.quality_classifier import fit_quality, keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the input folder.

    Null and empty texts get the score of the bias alone. Repeated rows are judged each, all alike; null ids have no
    part in it. An empty table stays empty, without labels nothing is rejected; extra columns pass through.
    """
    return keep_quality(docs, fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs that hold a word go, and with them documents that held nothing else.

    Null and empty texts stay as they are. Rows alike in id and text are one document, first where a null id comes
    first, and lose the same lines. An empty table stays empty; extra columns pass through.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text, doc_id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    left = dedup_lines(docs.toDF(*names), min_words=1, id_col=doc_id, text_col=text).where("not emptied")
    return left.select(*names).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by five-word shingles: that of the smallest id, null ids last.

    Groups are of rows, not of ids, so of repeated rows one stays, and rows of one id whose texts are not alike all
    do. Null and empty texts and texts without words are alike with nothing and stay. An empty table stays empty;
    extra columns pass through.
    """
    scratch = Scratch(spark, "near")
    named, (doc_id, text) = by_place(docs, "doc_id", "text")
    rows = scratch.save(named.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, id_col=doc_id, text_col=text, row_col="_row")
    kept = scratch.save(found.where("row = first_row").select(F.col("row").alias("_row")), "kept")
    # By merge at every size, so that small runs tell what large ones do.
    return rows.join(kept.hint("merge"), "_row", "left_semi").drop("_row").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed by source to weights 5, 2, 1 in turn.

    Null and empty texts have no words and go. A null source is one of its own. Each of repeated rows is mixed by
    itself. An empty table stays empty; extra columns pass through.
    """
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids.

    Null and empty texts hold the end id alone; null and repeated ids are packed like others. An empty table gives no
    pieces; extra columns are not read.
    """
    return pack(docs, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", packed)]

#: None: hashing, tokenizing and learning have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:  # what this stage read is not read again
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
