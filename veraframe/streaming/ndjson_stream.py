"""Datasets that arrive as files: decode rows as they come, check each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..meta import Meta
from ..operators.check import Checks, check_spec
from ..rules import Finding, findings_frame
from ..sources.ndjson import row_lines, rows_schema
from ..spec import Spec


def stream_ndjson(spark: SparkSession, folder: str, meta: Meta, files_each: int | None = None, tagged: list[str] | None = None) -> DataFrame:
    """Rows of NDJSON files as they arrive in a folder, decoded by known metadata; metadata lines, objects with ``columns``, are skipped.

    ``tagged`` names the columns whose tags stand in the rows, in the order of the metadata.
    """
    r = spark.readStream
    lines = row_lines((r.option("maxFilesPerTrigger", files_each) if files_each else r).text(folder))
    heads = F.coalesce(F.get_json_object("value", "$.columns").isNotNull(), F.lit(False))
    return rows_schema(lines.where(~heads), meta, folder, tagged)


def check_stream(rows: DataFrame, spec: Spec, dataset: str, findings_path: str, checkpoint: str, checks: Checks | None = None, then: Callable[[DataFrame, list[Finding]], None] | None = None) -> StreamingQuery:
    """Check each batch against the specification and append its findings, with the batch's number, to a table.

    Findings are those of a batch by itself: a key is unique within a batch. Started for what is there, it ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        found = check_spec(df, spec, dataset, checks=checks)
        out = findings_frame(df.sparkSession, found).selectExpr(f"{number}L batch", "*")
        out.write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
        if then is not None:
            then(df, found)
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
