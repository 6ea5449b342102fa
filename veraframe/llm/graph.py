"""Connected components of links between ids, by joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a long, b long): the smallest node it is connected with.

    Alternates the large-star and small-star steps: each node hangs its larger, then its smaller neighbours on the
    smallest node among them, until nothing changes, which takes about the logarithm of the longest chain in rounds.
    Minima are pre-aggregated and joined back, so a node with very many neighbours is no single task's work.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    told = None
    for i in range(1, most_rounds + 1):
        both = edges.union(edges.select("b", "a"))
        low = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), f"{name}-low{i}")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = scratch.save(large, f"{name}-large{i}")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-small{i}")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = scratch.save(small.union(low.select("a", F.col("low").alias("b"))).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-low{i}", f"{name}-large{i}", f"{name}-small{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def blocked(rows: DataFrame, key: str, member: str, size: int, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` dealt to groups that hold every pair of members of a key, of at most about 2 * ``size`` rows each.

    Keys with one member go. A key of n members has g = ceil(n / size) blocks by hash, and a group (key, lo, hi) for
    each two blocks; a member of block ``part`` goes to the g groups of its block. Pairs in a group with lo < hi are
    those across the two blocks.
    """
    counts = scratch.save(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), f"{name}-counts")
    g = F.ceil(F.col("_n") / size)
    dealt = rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64(F.col(member), F.lit(5)), g).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), (g - 1).cast("int"))))
    return dealt.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_other", "_n")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows that are ordered by ``keys`` as tables of whole groups, with the bounds of these.

    What a batch cuts off waits for the next: a group, which must be of bounded size. For very many small groups this
    costs much less than a call for each.
    """
    held: pa.Table | None = None
    for b in batches:
        new = pa.Table.from_batches([b])
        t = new if held is None else pa.concat_tables([held, new])
        if t.num_rows:
            starts = _starts(t, keys)
            held = t.slice(starts[-1])
            if starts[-1]:
                yield t.slice(0, starts[-1]), starts
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        changed |= np.diff(t.column(k).to_numpy()) != 0
    return np.flatnonzero(np.r_[True, changed])
