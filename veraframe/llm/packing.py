"""Operator 7, packing: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_place, table, text_of, whole_ids
from .token_counts import default_vocabulary
from .tokens import counter

#: Ends each document.
END_ID = 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut the concatenated token ids of all documents into sequences of ``length``; a row for each piece.

    First pass: each task writes its documents' ids with their place in the task's own run of tokens. The totals of
    the tasks, a row for each, are summed up into global offsets. Second pass: each written document gets its task's
    offset and is cut where a sequence ends, so a document that crosses a boundary leaves a piece on either side.
    Only the last sequence may be shorter. No id is moved between tasks, however long one document is.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` also ids
    (little-endian unsigned 32-bit). Ids must be whole numbers. Null and empty texts hold the end id alone; null and repeated ids are packed
    like others; extra columns are not read, and an empty table gives no pieces.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at, part = counter(vocabulary), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part_of = b.slice(lo, 256)
                ids = [x + end for x in tok.ids(part_of.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                # two bytes an id where they suffice, which the first byte says
                narrow = [b"\x02" + v.astype("<u2").tobytes() if (v := np.frombuffer(x, "<u4")).max() < 65536 else b"\x04" + x for x in ids]
                yield pa.RecordBatch.from_arrays([part_of.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(starts), pa.array(n), pa.array(narrow, pa.binary())], ["doc_id", "part", "at", "n", "ids"])

    whole_ids(docs, id_col)
    scratch = Scratch(spark, "packing")
    d, (i, t) = by_place(docs, id_col, text_col)
    source = d.select(F.col(i).cast("long").alias("doc_id"), text_of(t).alias("text"))
    encoded = scratch.save(source.mapInArrow(encode, "doc_id long, part long, at long, n long, ids binary"), "ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row for each task of the first pass: its size is that of the job's own task list.
    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("at")).alias("begin"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_PIECES.replace(" long", "").split(", "), *["ids"] * with_ids]
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, begin, n, packed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, length)
                    size = min(length - offset, n - start)
                    piece = ids[4 * start : 4 * (start + size)]
                    for column, v in zip(out, (doc, start, size, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        column.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), *[pa.array(out[7], pa.binary())] * with_ids], names)

    return placed.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"))
