"""Operator 2, mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, Scratch, by_place, table, text_of, whole_ids
from .prefix import running_offsets

#: Steps after which an index is back in range (see ``permuted``).
WALK = 20
#: Cells by which a draw finds its source.
CELLS = 4096
#: Rows that one row unfolds into at a time.
_CHUNK = 8192


def _whole(x: Column, by: Column) -> Column:
    """x div by, exactly, for longs."""
    return ((x - F.pmod(x, by)) / by).cast("long")


def permuted(df: DataFrame, out: str, x: Column, n: Column, *seed: Column) -> DataFrame:
    """``df`` plus ``out``: a pseudorandom permutation of 0..n-1 applied to x, another one for each seed.

    A Feistel network of four rounds whose halves are digits to the bases a and b, with a the root of n rounded up
    and a * b just above n. What leaves 0..n-1 is put through it again until it is back. Fewer than a indices lie
    outside, so a walk is of at most a steps, and for a large n of WALK steps or more with a chance under 1e-20 an
    index; should that happen the query fails. Each step is a column of its own, which keeps expressions small.
    """
    a, b, n_, s, low, high, once = (F.col(f"_p{k}") for k in "abnslho")

    def turn(i: int, low: Column, high: Column) -> Column:
        own, other, base = (low, high, a) if i % 2 == 0 else (high, low, b)
        return F.pmod(own + F.pmod(F.xxhash64(other, F.lit(i), s), base), base)

    def network(y: Column) -> Column:
        low, high = F.pmod(y, a), _whole(y, a)
        for i in (0, 2):
            low = turn(i, low, high)
            high = turn(i + 1, low, high)
        return high * a + low

    df = df.withColumns({"_px": x.cast("long"), "_pn": n.cast("long"), "_ps": F.xxhash64(*seed)}).withColumn("_pa", F.ceil(F.sqrt(n_)).cast("long"))
    df = df.withColumn("_pb", _whole(n_ + a - 1, a)).withColumns({"_pl": F.pmod("_px", a), "_ph": _whole(F.col("_px"), a)})
    for i in range(4):
        df = df.withColumn("_pl" if i % 2 == 0 else "_ph", turn(i, low, high))
    back = lambda y: F.when(y < n_, y).otherwise(F.raise_error(F.lit("an index did not return into range")).cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda y, _: F.when(y < n_, y).otherwise(network(y)), back)
    return df.withColumn("_po", high * a + low).withColumn(out, F.when(once < n_, once).otherwise(walked)).drop(*(f"_p{k}" for k in "xabnslho"))


def _targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """From (source, source_size) to those, weight and target: shares by weight, filled up to ``most`` times a source.

    A source is full if what it may hold, for its weight, is no more than the level of the sources left; taken in
    the order of that ratio this is one pass of running sums. A row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    s = sizes.withColumn("source_no", k).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(k, F.lit(len(weights))).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "source_no")
    total = F.sum("source_size").over(every)
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (total - used) / left).withColumn("full", F.col("ratio") <= F.col("level"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # the first of them; the level falls after it
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))).select("source_no", "source", "source_size", "docs", "weight", "target")


class Mix:
    """A mix: ``sources`` (targets), ``docs`` (their place in their source), ``slots`` (blocks dealt to shards)."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_slots: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None):
        """Pack the words of each source into blocks and draw blocks for output shards.

        The words of a source's documents, one after the other in an order by hash, are cut into blocks of
        ``block_words``. A source needs as many slots as its target has blocks. For each shard of ``shard_slots``
        slots the counts by source are drawn: a multinomial draw with the sources' shares as chances. Sums of draws
        stray from the targets (several percent for a source of few blocks), so the slots that a source drew beyond
        its need, which ones by permutation, go to sources that drew too few. Slot k of a source of n blocks is block
        perm(k mod n) of pass k div n, each pass with a permutation of its own; there are at most ``most`` passes, so
        no document is taken more than ``most`` times its size.

        Ids must be whole numbers. Null text: no words. Null source: a source of its own, last. Null and repeated ids
        are documents like others, and so are repeated rows, each on its own. Documents without words take nothing.
        Extra columns are not read. An empty table gives none. ``row_col`` names a column of unique whole numbers;
        without it rows are numbered here.
        """
        whole_ids(docs, id_col)
        spark = docs.sparkSession
        self.scratch, self.block_words, self.shard_slots, self.seed, self.most = Scratch(spark, "mixing"), block_words, shard_slots, seed, most
        d, (i, t, s) = by_place(docs, id_col, text_col, source_col)
        row = F.monotonically_increasing_id() if row_col is None else F.col(by_place(docs, row_col)[1][0])
        text = text_of(t)
        key = [F.coalesce(F.col(i).cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64(text).alias("k_text")]
        sized = d.select(row.alias("row"), *key, F.col(i).alias("doc_id"), F.col(s).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
        sized = self.scratch.save(sized, "sized")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        self.sources = self.scratch.save(self._needs(_targets(sizes, weights, most)), "sources")
        told = self.sources.agg(F.count("*"), F.sum("docs"), F.max("all")).first()
        self.n_sources, n_docs, self.n_slots = (x or 0 for x in told)
        names = self._small(self.sources.select("source_no", F.col("source").alias("_s")))
        numbered = sized.join(names, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        # By content, so that the order doesn't hang on how the input is cut into tasks; but rows without an id, which
        # may be alike in great number, are spread by their row.
        spread = ["k_id", "k_text", F.when(F.col("k_id") == NULL_ID, F.col("row"))]
        placed = running_offsets(numbered, ["source_no"], ["k_id", "k_text", "row"], "size", n_docs, spread=spread)
        self.docs = self.scratch.save(placed, "docs")
        self.scratch.drop("sized")
        self.slots = self._slots()

    def _small(self, few: DataFrame, most: int = 100_000) -> DataFrame:
        """A table with a row for each source, or a bounded number more: broadcast if the sources are counted to be few, else left to the planner."""
        return F.broadcast(few) if self.n_sources <= most else few

    def _needs(self, targets: DataFrame) -> DataFrame:
        """``targets`` with n blocks and ``slots`` to fill by source, the ``first`` of them and those of ``all`` sources."""
        s = targets.withColumn("n", F.ceil(F.col("source_size") / self.block_words))
        most = F.col("n") * self.most
        s = s.withColumn("slots", F.when(F.col("n") > 0, F.least(F.round(F.col("target") * F.col("n") / F.greatest("source_size", F.lit(1))).cast("long"), most)).otherwise(F.lit(0).cast("long")))
        before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
        return s.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all", F.sum("slots").over(Window.partitionBy()))

    def draws(self) -> DataFrame:
        """(shard, source_no, blocks): the multinomial draw of each output shard."""
        total, each = self.n_slots, self.shard_slots
        width = max(1, -(-total // CELLS))
        cell = F.explode(F.sequence(_whole(F.col("first"), F.lit(width)), _whole(F.col("first") + F.col("slots") - 1, F.lit(width)))).alias("cell")
        cells = self.sources.where("slots > 0").select("first", "source_no", cell).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("first", "source_no"))).alias("starts"))
        shards = self.docs.sparkSession.range(0, -(-total // each), 1, max(1, total // (each * 64))).withColumnRenamed("id", "shard")
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(each), F.lit(total) - F.col("shard") * each) - 1))
        drawn = shards.select("shard", at.alias("at")).select("shard", F.pmod(F.xxhash64("shard", "at", F.lit(self.seed)), F.lit(max(1, total))).alias("u"))
        drawn = drawn.withColumn("cell", _whole(F.col("u"), F.lit(width))).join(self._small(cells), "cell")
        source = F.element_at(F.filter("starts", lambda s: s["first"] <= F.col("u")), -1)["source_no"]
        return drawn.groupBy("shard", source.alias("source_no")).agg(F.count("*").alias("blocks"))

    def _slots(self) -> DataFrame:
        """(source_no, slot, shard, at, block): every slot of the mix, with its place ``at`` in its shard."""
        counts = self.scratch.save(self.draws(), "draws")
        most = min(self.n_slots, (self.n_slots // self.shard_slots + 1) * self.n_sources)  # rows that counts has at most
        counts = running_offsets(counts, ["source_no"], ["shard"], "blocks", most, "base")
        within = Window.partitionBy("shard")  # a row for each source in the shard, of which there are at most its slots
        counts = counts.withColumn("lead", F.coalesce(F.sum("blocks").over(within.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("blocks").over(within))
        counts = self.scratch.save(counts, "counts")
        s = self.sources.where("slots > 0").join(counts.groupBy("source_no").agg(F.sum("blocks").alias("drawn")), "source_no", "left")
        s = s.select("source_no", "n", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
        before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
        spare, lack = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
        s = s.withColumn("lack", lack).withColumn("spare_from", F.coalesce(F.sum(spare).over(before), F.lit(0))).withColumn("lack_from", F.coalesce(F.sum(lack).over(before), F.lit(0)))
        j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        rows = counts.join(self._small(s), "source_no").withColumn("j", j)
        rows = permuted(rows, "rank", F.col("base") + F.col("j"), F.col("drawn"), F.lit(self.seed), F.lit(1), F.col("source_no"))
        rows = permuted(rows, "at", F.col("lead") + F.col("j"), F.col("size"), F.lit(self.seed), F.lit(2), F.col("shard"))
        rows = rows.select("source_no", "shard", "slots", "n", "spare_from", "at", "rank")
        rows = self.scratch.save(rows, "ranked")  # or the planner would put one permutation into the next
        kept = rows.where("rank < slots").select("source_no", "n", F.col("rank").alias("slot"), "shard", "at")
        spares = rows.where("rank >= slots").select((F.col("spare_from") + F.col("rank") - F.col("slots")).alias("e"), "shard", "at")
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), _whole(F.col("lack") - 1, F.lit(_CHUNK))))
        lacks = s.where("lack > 0").withColumn("chunk", chunk).repartition("source_no", "chunk")
        i = F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least((F.col("chunk") + 1) * _CHUNK, F.col("lack")) - 1))
        lacks = lacks.withColumn("i", i).select("source_no", "n", (F.col("drawn") + F.col("i")).alias("slot"), (F.col("lack_from") + F.col("i")).alias("e"))
        moved = lacks.join(spares.hint("merge"), "e").select("source_no", "n", "slot", "shard", "at")
        # Places in a source's passes: the permutation that maps slots to blocks.
        every = kept.unionByName(moved)
        every = permuted(every, "block", F.pmod("slot", "n"), F.col("n"), F.lit(self.seed), F.lit(3), F.col("source_no"), _whole(F.col("slot"), F.col("n")))
        slots = self.scratch.save(every.select("source_no", "slot", "shard", "at", "block"), "slots")
        self.scratch.drop("draws", "counts", "ranked")
        return slots

    def shard_counts(self) -> DataFrame:
        """Blocks by shard and source, as drawn and set right."""
        return self.slots.groupBy("shard", "source_no").agg(F.count("*").alias("blocks"))

    def pieces(self) -> DataFrame:
        """(source_no, row, start, block, words): the part of each block that a document with words holds."""
        size = self.block_words
        last = F.col("start") + F.col("size")
        d = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(_whole(F.col("start"), F.lit(size)), _whole(last - 1, F.lit(size)))))
        return d.select("source_no", "row", "start", "block", (F.least(last, (F.col("block") + 1) * size) - F.greatest("start", F.col("block") * size)).alias("words"))

    def uses(self) -> DataFrame:
        """``pieces`` joined by index to the slots: how often the mix takes the block, and the first shard that does."""
        drawn = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("shard"))
        # The planner takes unfolded slots to be as few as the sources they come from, and would broadcast them.
        return self.pieces().join(drawn.hint("merge"), ["source_no", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))

    def taken(self) -> DataFrame:
        """A row for each input row: doc_id, size, source, source_size, target, taken, first_shard (null: none)."""
        words = self.uses().groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.min("shard").alias("first_shard"))
        docs = self.docs.join(words.hint("merge"), "row", "left").select("doc_id", "size", "source_no", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")
        s = self.sources.select("source_no", "source", "source_size", "target")
        return docs.join(self._small(s), "source_no").select("doc_id", "size", "source", "source_size", "target", "taken", "first_shard")


#: A word with the white space before it.
_SPACED = r"[\x20\x09-\x0D]*" + WORD


def _numbered(docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[DataFrame, list[str], str]:
    """``docs`` written with columns by place and a unique ``_row``, the names of its columns and that of the text."""
    d, (text,) = by_place(docs, text_col)
    return scratch.save(d.withColumn("_row", F.monotonically_increasing_id()), "numbered"), d.columns, text


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: copy c of a document holds the words of its blocks taken c times or more.

    White space before a word goes with it. A document of which no block is taken has no row, nor has one without
    words; the text column is the only one that changes. Rows are told apart by number, so each of several identical
    rows has its own words. Nulls, repeats, empty tables and extra columns are as in ``Mix``; extra columns pass through.
    """
    rows, names, text = _numbered(docs, text_col, Scratch(docs.sparkSession, "mixed"))
    _, (i, s) = by_place(docs, id_col, source_col)
    mix = Mix(rows, id_col=i, text_col=text, source_col=s, row_col="_row", **settings)
    uses = F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("uses").cast("int").alias("uses")))), lambda b: b["uses"])
    per_doc = mix.uses().groupBy(F.col("row").alias("_row")).agg(uses.alias("_uses"), F.first("start").alias("_start")).where(F.array_max("_uses") > 0)
    found = rows.join(per_doc.hint("merge"), "_row").withColumn("_round", F.explode(F.sequence(F.lit(1), F.array_max("_uses"))))
    first = F.floor(F.col("_start") / mix.block_words)
    words = F.regexp_extract_all(F.col(text), F.lit(_SPACED), F.lit(0))
    kept = F.filter(F.transform(words, lambda w, k: F.when(F.get(F.col("_uses"), (F.floor((F.col("_start") + k) / mix.block_words) - first).cast("int")) >= F.col("_round"), w)), lambda w: w.isNotNull())
    return found.select(*[F.array_join(kept, "") if n == text else F.col(n) for n in names]).toDF(*docs.columns)


def mixed_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus slot by slot: shard, at, source, row, doc_id, text; a row for each document's part of a slot's block.

    The text of a slot is that of its rows in the order of ``row``'s place in the source, which ``start`` gives.
    Nulls, repeats and empty tables are as in ``Mix``.
    """
    rows, _, text = _numbered(docs, text_col, Scratch(docs.sparkSession, "shards"))
    _, (i, s) = by_place(docs, id_col, source_col)
    mix = Mix(rows, id_col=i, text_col=text, source_col=s, row_col="_row", **settings)
    size = mix.block_words
    d = mix.pieces().join(rows.select(F.col("_row").alias("row"), F.col(i).alias("doc_id"), F.col(s).alias("source"), F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0)).alias("words_")), "row")
    at = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
    d = d.select("source_no", "block", "source", "row", "doc_id", (F.col("start") + at).alias("start"), F.array_join(F.slice("words_", (at + 1).cast("int"), F.col("words").cast("int")), "").alias("text"))
    return d.join(mix.slots.hint("merge"), ["source_no", "block"]).select("shard", "at", "start", "source", "row", "doc_id", "text")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 in turn, at most three times each."""
    return Mix(table(spark, sf_dir, "documents")).taken()
