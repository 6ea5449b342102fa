"""Operator 9, line dedup. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, by_place, doc_key, table, text_of, whole_ids

_DOC = ["k_id", "k_text"]
_POS = [*_DOC, "i"]
_NAME = ["n1", "n2"]


def _intervals(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows that share ``by`` with another row, with the first place among them as ``head``.

    The classes are written first, so that the join deals both sides itself and a class that many rows are in is split.
    """
    classes = rows.groupBy(*by).agg(F.count("*").alias("_c"), F.min(F.struct(*_POS)).alias("head")).where("_c > 1").drop("_c")
    return rows.join(scratch.save(classes, f"{name}-classes"), by)


def _double(a: str, b: str) -> list[Column]:
    return [F.xxhash64(f"{a}.n1", f"{b}.n1").alias("n1"), F.xxhash64(f"{a}.n2", f"{b}.n2", F.lit(1)).alias("n2")]


def _doubled(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each k the suffixes that share their first 2**k lines with another one: place, name of these lines, head.

    Prefix doubling: a name at k + 1 is the pair of the names at k of both halves. A class of a name is an interval
    of the suffix array whose common prefix is 2**k lines or more; ``head`` is its first member in the corpus.
    """
    levels = [scratch.save(_intervals(lines, _NAME, scratch, "level0").select(*_POS, *_NAME, "head"), "level0")]
    while levels[-1].count():
        k = len(levels)
        names = levels[-1].select(*_POS, F.struct(*_NAME).alias("n"))
        second = names.withColumn("i", F.col("i") - 2 ** (k - 1)).withColumnRenamed("n", "b")
        pairs = names.withColumnRenamed("n", "a").join(second, _POS).select(*_POS, *_double("a", "b"))
        levels.append(scratch.save(_intervals(pairs, _NAME, scratch, f"level{k}").select(*_POS, *_NAME, "head"), f"level{k}"))
    return levels[:-1]


def earlier_copies(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, m) for each suffix of ``lines`` (place, name) that has an earlier one with its first line: the most lines, m, that it shares with an earlier one.

    These are the longest common prefixes among the suffix array's intervals, each to a suffix that comes first in
    the corpus; the run of m lines at such a place is a later copy of a maximal repeated run. A suffix leaves the
    doubling at the k where it isn't its class's first any more only up to 2**k lines, so m is between 2**k and
    2**(k+1). The rest is a descent by halves in the interval: a class is split by the names of the next 2**j lines;
    members of a part leave with it, but for the part's first, which stays to be compared for what it shares with the
    other parts. A suffix is settled in one class only and stands in others at most as their first.
    """
    levels = _doubled(lines, scratch)
    state = []
    for k, level in enumerate(levels):
        here = level.select(*_POS, "head")
        if k + 1 < len(levels):
            longer = levels[k + 1].where(F.col("head") < F.struct(*_POS)).select(*_POS)
            here = here.join(longer, _POS, "left_anti")  # a class's first never goes
        state.append(here.select(*_POS, "head", F.lit(2**k).alias("m"), (F.col("head") < F.struct(*_POS)).alias("open")))
    if not state:
        return lines.sparkSession.createDataFrame([], "k_id long, k_text long, i int, m int")
    settled = [state[0].where("open").select(*_POS, "m")]
    rows = reduce(DataFrame.unionByName, state[1:]) if len(state) > 1 else None
    for j in range(len(levels) - 2, -1, -1):
        # Classes in which nothing is open have nothing left to tell. Those of 2**j lines come in at the next j.
        active = rows.groupBy("head", "m").agg(F.max("open").alias("_o")).where("_o").drop("_o")
        rows = scratch.save(rows.join(active, ["head", "m"]), f"state{j}")
        split = rows.where(F.col("m") >= 2 ** (j + 1))
        rest = rows.where(F.col("m") < 2 ** (j + 1))
        names = levels[j].select(*_DOC, F.col("i").alias("_at"), *_NAME)
        placed = split.withColumnRenamed("head", "parent").withColumn("_at", F.col("i") + F.col("m"))
        found = _intervals(placed.join(names, [*_DOC, "_at"]), ["parent", "m", *_NAME], scratch, f"split{j}")
        found = scratch.save(found.select(*_POS, "parent", "m", "open", "head"), f"parts{j}")
        first = F.col("head") == F.struct(*_POS)
        inside = found.select(*_POS, "head", (F.col("m") + 2**j).alias("m"), (F.col("open") & ~first).alias("open"))
        gone = found.where(~first).select(*_POS, F.col("parent").alias("head"), "m")
        stay = split.join(gone, [*_POS, "head", "m"], "left_anti")
        rows = reduce(DataFrame.unionByName, [inside, stay, rest])
    if rows is not None:
        settled.append(rows.where("open").select(*_POS, "m"))
    return scratch.save(reduce(DataFrame.unionByName, settled), "copies")


def repeated_lines(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(k_id, k_text, spans): the lines that are later copies, for each document that has any, as disjoint spans (at, to) in order, ``to`` excluded.

    Lines are named by 128-bit hashes; a suffix is the rest of a document from a line on. ``earlier_copies`` finds,
    for each suffix, the longest run at its start that stands earlier in the corpus, by document id, text hash and
    line; copies may overlap. Runs that hold ``min_words`` words go; their spans are united by running maxima. The
    first copy of any line stays: a line in a later copy stands earlier too. A floor of more than one word protects
    short lines: later copies of runs below it stay, in however many documents.
    """
    whole_ids(docs, id_col)
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    d, (i, t) = by_place(docs, id_col, text_col)
    lines = d.select(*doc_key(i, t), F.posexplode(F.split(text_of(t), "\n")).alias("i", "line"))
    # One word is told from none without counting.
    words = F.regexp_count("line", F.lit(WORD)) if min_words > 1 else F.regexp_like("line", F.lit(WORD)).cast("int")
    lines = lines.select(*_POS, F.xxhash64("line").alias("n1"), F.xxhash64(F.lit(1), "line").alias("n2"), words.alias("w")).distinct()
    lines = scratch.save(lines, "lines")
    copies = earlier_copies(lines.drop("w"), scratch)
    by_line = Window.partitionBy(*_DOC).orderBy("i")
    # All lines of a run stand in ``held``, so words are summed up over it alone.
    held = copies.select(*_POS, (F.col("i") + F.col("m") - 1).alias("last"))
    sums = lines.join(held.select(*_DOC).distinct(), _DOC).withColumn("upto", F.sum("w").over(by_line))
    sums = scratch.save(sums.select(*_POS, "w", "upto"), "sums")
    runs = held.join(sums, _POS).select(*_DOC, "i", "last", (F.col("upto") - F.col("w")).alias("before"))
    runs = runs.join(sums.select(*_DOC, F.col("i").alias("last"), "upto"), [*_DOC, "last"])
    runs = runs.where(F.col("upto") - F.col("before") >= min_words).select(*_POS, (F.col("last") + 1).alias("to"))
    reached = F.coalesce(F.max("to").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = runs.withColumn("reached", reached).where("to > reached").select(*_DOC, F.greatest("i", "reached").alias("at"), "to")
    spans = spans.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    keep = {"spans"}
    scratch.drop(*(n for n in scratch.names if n not in keep))
    return spans


def dedup_lines(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` finds, plus n_lines, n_removed and emptied.

    ``emptied`` is true if no line with a word is left of a text that had one. Ids must be whole numbers. Texts that
    lose nothing come back unchanged, null ones as null (a null text counts one empty line). Rows alike in id and
    text are one document and get the same result; a null id sorts before all others. Ties cannot occur: places are
    ordered by id, text hash and line. Extra columns pass through, but for those of these three names, which are
    replaced.
    """
    spans = repeated_lines(docs, min_words, id_col, text_col)
    named, (i, text) = by_place(docs, id_col, text_col)
    kept = [(n, c) for n, c in zip(named.columns, docs.columns, strict=True) if c not in ("n_lines", "n_removed", "emptied")]
    # Always by merge: a broadcast of few deletions would make small runs unlike large ones.
    rows = named.select(*doc_key(i, text), *named.columns).join(spans.hint("merge"), _DOC, "left")
    rows = rows.withColumn("lines", F.split(text_of(text), "\n"))
    # What stands between two spans, before the first and after the last.
    n = F.size("spans")
    since = lambda k: F.coalesce(F.get("spans", k - 1)["to"], F.lit(0))
    until = lambda k: F.coalesce(F.get("spans", k)["at"], F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("lines", since(k) + 1, until(k) - since(k))))
    rows = rows.withColumn("left", F.when(F.col("spans").isNotNull(), F.array_join(left, "\n")))
    new = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.col("left"))
    emptied = F.col("spans").isNotNull() & F.regexp_like(text_of(text), F.lit(WORD)) & ~F.regexp_like("left", F.lit(WORD))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda x, s: x + s["to"] - s["at"]), F.lit(0))
    out = rows.select(*[new if k == text else F.col(k) for k, _ in kept], F.size("lines").cast("long"), removed.cast("long"), F.coalesce(emptied, F.lit(False)))
    return out.toDF(*(c for _, c in kept), "n_lines", "n_removed", "emptied")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated runs that hold a word."""
    return dedup_lines(table(spark, sf_dir, "documents"), min_words=1).select("doc_id", "text", "n_lines", "n_removed", "emptied")
