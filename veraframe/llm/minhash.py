"""Operator 5, near-duplicates: an inverted join of MinHash signature coordinates, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_place, table, text_of, whole_ids
from .graph import blocked, components, whole_groups

#: Coordinates of a signature, and how many of them must agree: at a similarity of 0.8 fewer do in 5 of a million pairs.
COORDINATES, LEAST_MATCHES = 40, 20
#: Coordinates posted of each signature. Two signatures that agree in LEAST_MATCHES share one of these at least, if
#: each posts its first ones in one order of all coordinate-value pairs.
PREFIX = COORDINATES - LEAST_MATCHES + 1
#: Bits of the table by which pairs are counted: the order is by these counts, so that frequent ones are not posted.
TALLY_BITS = 17
#: Members of a posting list that one group compares.
BLOCK = 1024

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**31, COORDINATES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_WIDTH = 4 * COORDINATES


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit names of the distinct ``words``-word shingles of a text, A-Z in lower case.

    A text of fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    w = text.lower().split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    k = min(words, n)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set."""
    x = (s ^ (s >> np.uint64(29))).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return low.astype("<u4")


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def coordinate_values(sig: np.ndarray) -> np.ndarray:
    """Names of the coordinate-value pairs of signatures, by row and coordinate."""
    x = sig.astype(np.uint64) | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _tally(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - TALLY_BITS)).astype(np.int64)


def prefix(sig: np.ndarray, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each signature the PREFIX coordinates that come first in the order of pairs, and the names of these pairs."""
    pairs = coordinate_values(sig)
    e = np.sort(np.lexsort((pairs, tally[_tally(pairs)]), axis=1)[:, :PREFIX], axis=1)
    return e, np.take_along_axis(pairs, e, axis=1)


def _set_of(z: bytes, words: int) -> np.ndarray:
    return shingle_set(zstandard.decompress(z), words)


def _similar(x: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each of some sets: whether it is similar enough to the set x."""
    size = np.array([len(y) for y in others])
    every = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return den * shared >= num * (len(x) + size - shared)


def _candidates(lo: int, hi: int, v: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) among the rows lo to hi, one group ordered by component: pairs of different components of which enough coordinates agree, in the first list that they share.

    Collisions are counted against the whole signature: the lists of frequent pairs, which are not posted, are looked
    up there instead of merged.
    """
    comp = v["component"]
    if hi - lo < 2 or comp[lo] == comp[hi - 1]:
        return
    e, across, n, part, sig, posted = v["e"][lo], v["lo"][lo] != v["hi"][lo], v["n"], v["part"], v["sig"], v["posted"]
    last = np.searchsorted(comp[lo:hi], comp[lo:hi], side="right") + lo  # where each row's component ends
    for i in range(lo, hi):
        start = last[i - lo]
        if start == hi:
            return
        size = n[start:hi]
        j = start + np.flatnonzero(den * np.minimum(size, n[i]) >= num * np.maximum(size, n[i]))
        if across and len(j):
            j = j[part[j] != part[i]]
        if len(j):
            same = sig[j] == sig[i]
            found = same.sum(axis=1) >= LEAST_MATCHES
            j, same = j[found], same[found]
        if len(j):
            j = j[(same & posted[j] & posted[i]).argmax(axis=1) == e]
        if len(j):
            yield i, j


_GROUP = ["post", "lo", "hi", "e", "c", "component", "n", "part"]


def _read(t: pa.Table) -> dict[str, np.ndarray]:
    """Columns of rows, their signatures, and which coordinates are posted."""
    v = {k: t.column(k).to_numpy() for k in [*_GROUP, "mask"]}
    v["posted"] = (v.pop("mask")[:, None] >> np.arange(COORDINATES) & 1).astype(bool)
    return v | {"sig": _signatures(t.column("sig"))}


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Groups of documents linked by den * |A and B| >= num * |A or B| over shingle sets.

    A row for each row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links), kept (whether
    that is the row's own id), row and first_row (the row of the smallest id of the group; of several the smallest).
    Equal sets are one class, of which the first row stands for all. A class is posted under PREFIX pairs of a
    signature's coordinate and its value, those that come first when pairs are ordered by how often they occur; two
    classes whose signatures agree in LEAST_MATCHES coordinates share a list, and the chance that a pair of
    similarity 0.8 agrees in fewer is 5e-6. Lists of one are skipped. First each class is checked against the one
    first member that heads most of its lists; these links give components. Lists within one component are skipped.
    The others are merged, block by block: collisions of each pair of different components are counted, those above
    the threshold are checked on full sets in the first list that the pair shares, and a spanning forest of the links
    leaves the task. So a large group of near copies costs about a check for each member.

    Ids must be whole numbers. Null and empty texts and texts without words have empty sets and are linked with
    nothing. A null id is never the smallest; if a whole group has null ids its component_id is null, and kept is a
    comparison that takes nulls as equal. Rows of a repeated id are linked by their own texts. Extra columns are not
    read. ``row_col`` names a column of unique whole numbers; without it rows are numbered here. The signature is for
    0.8 or more, so ``num / den`` below that is refused.
    """
    if num * 5 < den * 4:
        raise ValueError("signatures are dimensioned for a similarity of 0.8 or more")
    whole_ids(docs, id_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for b in batches:
            n, names, signs, texts = [], [], [], []
            for t in b.column(2):
                raw = t.as_buffer().to_pybytes() if t.as_buffer() else b""
                s = shingle_set(raw, words)
                some = len(s) > 0
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if some else None)
                signs.append(signature(s).tobytes() if some else None)
                texts.append(small.compress(raw) if some else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (names, signs, texts))], ["id", "row", "n", "name", "sig", "z"])

    d, (i, t) = by_place(docs, id_col, text_col)
    row = F.monotonically_increasing_id() if row_col is None else F.col(by_place(docs, row_col)[1][0])
    source = d.select(F.col(i).cast("long").alias("id"), row.alias("row"), text_of(t).cast("binary").alias("text"))
    signed = scratch.save(source.mapInArrow(sign, "id long, row long, n long, name binary, sig binary, z binary"), "signed")
    first = F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("rank"), "row"))
    classes = signed.where("name is not null").groupBy("name").agg(first.alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # A class is named by the number of its first row, so no two share a name.
    classes = scratch.save(classes.select("name", F.col("first.row").alias("c"), F.col("first.rank").alias("rank"), "n", "sig"), "classes")
    zs = signed.where("name is not null").select(F.col("row").alias("c"), "z")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TALLY_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_tally(coordinate_values(_signatures(b.column(0)))).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "n"])

    counted = classes.select("sig").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    tally = np.zeros(1 << TALLY_BITS, np.int64)
    for r in counted.toLocalIterator():  # of fixed size, whatever the table's
        tally[r["at"]] = r["n"]
    sent = spark.sparkContext.broadcast(tally)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e, pairs = prefix(_signatures(b.column(2)), sent.value)
                mask = (1 << e).sum(axis=1)
                every = pa.array(pairs.astype(np.int64).ravel(), pa.int64()), pa.array(e.astype(np.int32).ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), PREFIX)), *every, pa.array(np.repeat(mask, PREFIX))], ["c", "post", "e", "mask"])

    posts = scratch.save(classes.select("c", "n", "sig").mapInArrow(post, "c long, post long, e int, mask long"), "posts")
    heads = scratch.save(posts.groupBy("post").agg(F.count("*").alias("size"), F.min("c").alias("head")).where("size > 1").select("post", "head"), "heads")
    members = scratch.save(posts.join(heads, "post").select("post", "e", "c", "mask", "head"), "members")
    scratch.drop("posts", "heads")

    led = members.where("c <> head").groupBy("c", "head").agg(F.count("*").alias("lists"))
    led = led.groupBy("c").agg(F.max(F.struct("lists", "head")).alias("m")).select(F.col("c").alias("a"), F.col("m.head").alias("b"))
    signs = classes.select("c", "n", "sig")
    led = led.join(signs.toDF("a", "na", "sa").hint("merge"), "a").join(signs.toDF("b", "nb", "sb").hint("merge"), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sizes and signatures allow a link; only their texts are fetched."""
        for b in batches:
            x, y = _signatures(b.column(2)), _signatures(b.column(3))
            n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
            keep = ((x == y).sum(axis=1) >= LEAST_MATCHES) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b) whose full sets are similar enough."""
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, za, zb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(known) > 2000:
                    known.clear()
                for c, z in ((a, za), (b, zb)):
                    if c not in known:
                        known[c] = _set_of(z, words)
                keep.append(bool(_similar(known[a], [known[b]], num, den)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    led = scratch.save(led.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(alike, "a long, b long"), "led")
    wanted = scratch.save(led.select(F.col("a").alias("c")).union(led.select("b")).distinct(), "wanted")
    texts = scratch.save(zs.join(wanted.hint("merge"), "c"), "texts")
    pairs = led.join(texts.toDF("a", "za").hint("merge"), "a").join(texts.toDF("b", "zb").hint("merge"), "b")
    links = scratch.save(pairs.select("a", "b", "za", "zb").mapInArrow(similar, "a long, b long"), "links")
    scratch.drop("led", "wanted", "texts")
    near = scratch.save(components(links, scratch, "near"), "near")
    placed = scratch.save(members.join(near.withColumnRenamed("node", "c"), "c", "left").select("post", "e", "c", "mask", F.coalesce("component", "c").alias("component")), "placed")
    scratch.drop("members")
    mixed = placed.groupBy("post").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("post")
    rows = placed.join(scratch.save(mixed, "mixed"), "post")
    rows = scratch.save(blocked(rows, "post", "c", BLOCK, scratch, "merge"), "merge")
    scratch.drop("placed", "mixed")
    rows = rows.join(signs.hint("merge"), "c").select(*_GROUP, "mask", "sig")
    by, order = ["post", "lo", "hi"], ["post", "lo", "hi", "component", "c"]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group that have a candidate in it; only their texts are fetched."""
        for t, bounds in whole_groups(batches, by):
            v = _read(t)
            hit = np.zeros(t.num_rows, bool)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                for i, j in _candidates(lo, hi, v, num, den):
                    hit[i] = hit[j] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links within each group, found in the first list that a pair shares and checked on full sets there."""
        for t, bounds in whole_groups(batches, by):
            v = _read(t)
            z, sets, a, b = t.column("z"), {}, [], []

            def full(i: int, z: pa.ChunkedArray = z, sets: dict = sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = _set_of(z[int(i)].as_py(), words)
                return sets[i]

            for lo, hi in zip(bounds, bounds[1:], strict=False):
                joined = v["component"][lo:hi].copy()
                for i, j in _candidates(lo, hi, v, num, den):
                    while len(j := j[joined[j - lo] != joined[i - lo]]):
                        some = j[:64]
                        found = some[_similar(full(i), [full(x) for x in some], num, den)]
                        for x in found:
                            if joined[x - lo] != joined[i - lo]:
                                joined[joined == joined[x - lo]] = joined[i - lo]
                                a.append(v["c"][i])
                                b.append(v["c"][x])
                        j = j[64:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    schema = "post long, lo int, hi int, e int, c long, component long, n long, part int, mask long, sig binary"
    flagged = scratch.save(rows.repartition(*by).sortWithinPartitions(*order).mapInArrow(flag, schema), "flagged")
    dealt = flagged.join(zs.hint("merge"), "c").select(*_GROUP, "mask", "sig", "z").repartition(*by).sortWithinPartitions(*order)
    more = scratch.save(dealt.mapInArrow(merge, "a long, b long"), "merged")
    scratch.drop("merge", "flagged")
    every = scratch.save(components(links.union(more), scratch, "all"), "all")
    ranks = classes.select(F.col("c").alias("node"), "rank", "name").join(every, "node", "left")
    ranks = scratch.save(ranks.select("name", F.struct("rank", F.col("node").alias("row")).alias("first"), F.coalesce("component", "node").alias("component")), "ranks")
    least = ranks.groupBy("component").agg(F.min("first").alias("first"))
    least = ranks.drop("first").join(scratch.save(least, "least"), "component")
    least = scratch.save(least.select("name", F.when(F.col("first.rank") < 2**63 - 1, F.col("first.rank")).alias("component_id"), F.col("first.row").alias("first_row")), "named")
    scratch.drop("near", "links", "merged", "all", "ranks", "least", "classes")
    own = signed.select("id", "row", "n", "name")
    alone = own.where("name is null").select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("first_row"))
    out = own.where("name is not null").join(least, "name").select("id", "row", "n", "component_id", "first_row").union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "first_row")


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("row", "first_row")
