"""Operator 3, near-duplicate vectors: spherical-cap filters by structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_place, table, whole_ids
from .graph import blocked, components, whole_groups

#: Parts of a code, directions to a part at least (CODES ** PARTS filters to a code), and filters of one code that a
#: vector exceeds on average. A single code leaves some vectors almost without filters, as their weight is spread
#: evenly over its parts; independent rotations even that out.
PARTS, CODES, FILTERS = 2, 1024, 3
#: Share of the pairs at the very threshold that must meet in a filter, and codes at most that this may take.
RECALL, MOST_TABLES = 0.985, 200
#: Members of a filter that one group compares.
BLOCK = 512


class ProductCode:
    """Filter directions: all concatenations of one random direction for each part of a randomly rotated space."""

    def __init__(self, dim: int, parts: int = PARTS, codes: int = CODES, filters: float = FILTERS, seed: int = 0, height: float | None = None):
        rng = np.random.default_rng([seed, dim])
        self.codes, self.parts = codes, min(parts, dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), self.parts)
        self.tables = []
        for cut in self.cuts:
            t = rng.standard_normal((codes, len(cut)))
            self.tables.append(t / np.linalg.norm(t, axis=1, keepdims=True) / np.sqrt(self.parts))
        self.height = self._calibrated(rng.standard_normal((256, dim)), filters) if height is None else height

    def _calibrated(self, sample: np.ndarray, filters: float) -> float:
        """The height that random vectors exceed ``filters`` times on average."""
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        low, high = 0.0, 1.0
        for _ in range(30):
            self.height = (low + high) / 2
            n = 0
            for lo in range(0, len(sample), 32):  # as soon as there are too many, the height is too low
                n += len(self.decode(sample[lo : lo + 32], most=40 * filters * 32)[0])
                if n > filters * len(sample):
                    break
            low, high = (self.height, high) if n > filters * len(sample) else (low, self.height)
        return self.height

    def _halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: sums of inner products over the first and over the second half of the parts, for all their codes."""
        r, sums = v @ self.rotation.T, []
        for half in (range(self.parts // 2), range(self.parts // 2, self.parts)):
            s = np.zeros((len(v), 1))
            for i in half:
                s = (s[:, :, None] + (r[:, self.cuts[i]] @ self.tables[i].T)[:, None, :]).reshape(len(v), -1)
            sums.append(s)
        return sums[0], sums[1]

    def decode(self, vectors: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) in order: for each unit vector all filters whose direction has an inner product with it of at least the height.

        A pair of half codes can reach the height only if each half does with the other's best, which leaves few to
        be paired. With ``most`` the first rows may be left out of a result that is larger.
        """
        a, b = self._halves(vectors)
        i, x = np.nonzero(a >= self.height - b.max(axis=1, keepdims=True))
        j, y = np.nonzero(b >= self.height - a.max(axis=1, keepdims=True))
        each = np.bincount(j, minlength=len(vectors))
        if len(i) and each[i].sum() > 1000 * most:
            return np.zeros(int(most) + 1, np.int64), np.zeros(int(most) + 1, np.int64)
        begin = np.cumsum(each) - each
        n = each[i]  # partners of each first half
        first = np.repeat(np.arange(len(i)), n)
        second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i], n)
        fits = a[i[first], x[first]] + b[j[second], y[second]] >= self.height
        first, second = first[fits], second[fits]
        return i[first], x[first].astype(np.int64) * b.shape[1] + y[second]


def _fitting(dim: int, codes: int) -> int:
    """Directions to a part, fewer where a few dimensions hold fewer that are far apart."""
    return max(2, min(codes, 3 ** min(dim // PARTS, 30)))


_codes: dict[tuple, list[ProductCode]] = {}


def _family(dim: int, tables: int, codes: int, filters: float) -> list[ProductCode]:
    key = (dim, tables, codes, filters)
    if key not in _codes:
        fitting = _fitting(dim, codes)
        first = ProductCode(dim, PARTS, fitting, filters)
        _codes[key] = [first, *(ProductCode(dim, PARTS, fitting, filters, t, first.height) for t in range(1, tables))]
    return _codes[key]


def tables_for(dim: int, codes: int, filters: float, least: float, recall: float = RECALL, pairs: int = 1024) -> int:
    """How many codes let a share ``recall`` of the pairs of cosine ``least`` meet in a filter; measured on random pairs in one code.

    Codes are rotated independently, so a pair fails to meet in any of t codes with the t-th power of its chance to
    fail in one. Settings for which MOST_TABLES don't do are refused.
    """
    rng = np.random.default_rng([7, dim])
    code, met = ProductCode(dim, PARTS, _fitting(dim, codes), filters), 0
    for _ in range(0, pairs, 32):
        x, z = rng.standard_normal((2, 32, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-300
        a, b = (set(zip(*code.decode(v), strict=True)) for v in (x, least * x + np.sqrt(max(0.0, 1 - least * least)) * z))
        met += len({row for row, _ in a & b})
    p = met / pairs
    t = 1 if p >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - p))) if p > 0 else MOST_TABLES + 1
    if t > MOST_TABLES:
        raise ValueError(f"cosine {least} in {dim} dimensions: pairs meet in a filter with a chance of {p:.4f}, too seldom for a recall of {recall}")
    return t


def _count_links(near: np.ndarray, rows: slice, v: dict[str, np.ndarray], lists: pa.ChunkedArray, out: list[tuple]) -> None:
    """Add the links of one group of which this is the first filter that both vectors are in, as counts and a spanning forest."""
    this, c, copies = v["filter"][rows.start], v["c"][rows], v["copies"][rows]
    if v["lo"][rows.start] != v["hi"][rows.start]:
        near &= v["part"][rows][:, None] != v["part"][rows][None, :]
    at = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
    earlier = [[f for f in lists[rows.start + int(i)].as_py() if f < this] for i in at]
    known = {f: k for k, f in enumerate(sorted({f for e in earlier for f in e}))}
    if known:
        has = np.zeros((len(at), len(known)), np.float32)
        for i, e in enumerate(earlier):
            has[i, [known[f] for f in e]] = 1
        near[np.ix_(at, at)] &= (has @ has.T) == 0
    links = near @ copies + near.T @ copies
    out.append((c[links > 0], links[links > 0], c[links > 0]))
    root = np.arange(len(c))
    for i in np.flatnonzero(near.any(axis=1)):
        j = np.flatnonzero(near[i] & (root != root[i]))
        if len(j):
            met, one = np.unique(root[j], return_index=True)
            out.append((np.full(len(met), c[i]), np.zeros(len(met), links.dtype), c[j[one]]))
            root[np.isin(root, met)] = root[i]


def near_vectors(vectors: DataFrame, least: float = 0.95, codes: int | None = None, filters: float = FILTERS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine ``least`` or more: id, n_links, component_id, kept; a row for each row of ``vectors``.

    Each vector is put into every filter whose cap it lies in; pairs that share a filter are compared in double
    precision, so no link is false, and a link is missed only if its two vectors share none of their filters (recall
    is measured in the tests). Equal vectors are one class, compared once. Members of a filter meet in groups of two
    blocks; a pair counts in the first filter it shares. A group returns each vector's number of links and a
    spanning forest of the links, never all pairs. ``codes``, directions to a part, grow with the square root of the
    number of different vectors unless given, so that filters stay about as full; the number of independent codes is
    then what a recall of RECALL at the threshold takes (``tables_for``), and settings that can't reach it are refused.

    Ids must be whole numbers.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component;
    vectors of other lengths are never compared. A null id gives a null component unless a smaller id is linked.
    Repeated ids count as vectors of their own. Extra columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cap-filters")
    whole_ids(vectors, id_col)
    d, (i, e) = by_place(vectors, id_col, vector_col)
    # Single precision is sent as such, and only widened to be compared.
    single = d.schema[e].dataType.elementType.typeName() == "float"
    kind = "float" if single else "double"
    v = F.col(e).cast(f"array<{kind}>")
    sound = F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = d.select(F.col(i).cast("long").alias("id"), F.when(sound, v).alias("v"))
    rows = scratch.save(rows.withColumn("n1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("n2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))), "rows")
    classes = rows.where("v is not null").groupBy("n1", "n2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = scratch.save(classes.select(F.xxhash64("n1", "n2").alias("c"), "n1", "n2", "first_id", "copies", "v"), "classes")

    told = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    codes = codes or max(CODES, 1 << int(np.ceil(np.log2(max(2, 2 * filters * sum(r["n"] for r in told))) / 2)))
    tables = {r["dim"]: tables_for(r["dim"], codes, filters, least) for r in told}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                size = part.column(1).value_lengths().to_numpy()
                for dim in np.unique(size):
                    some = part.filter(pa.array(size == dim))
                    x = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    family = _family(int(dim), tables.get(int(dim)) or tables_for(int(dim), codes, filters, least), codes, filters)
                    found = [code.decode(x) for code in family]
                    row = np.concatenate([r for r, _ in found])
                    name = np.concatenate([f + t * codes**PARTS for t, (_, f) in enumerate(found)])
                    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype(np.int32)
                    filters_ = pa.ListArray.from_arrays(offsets, pa.array(name[np.argsort(row, kind="stable")], pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column(0), filters_], ["c", "filters"])

    decoded = classes.select("c", "v").mapInArrow(decode, "c long, filters array<long>").select("c", F.explode("filters").alias("filter"))
    inside = scratch.save(blocked(scratch.save(decoded, "decoded"), "filter", "c", BLOCK, scratch, "caps"), "caps")
    # Of a vector's filters those that another vector is in too: the others are no pair's first.
    shared = scratch.save(inside.groupBy("c").agg(F.array_sort(F.collect_set("filter")).alias("filters")), "shared")
    inside = inside.join(shared, "c").join(classes.select("c", "copies", "v"), "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(c, links, other): links found here for c, and the other end of one link of a spanning forest."""
        for t, bounds in whole_groups(batches, ["filter", "lo", "hi", "dim"]):
            v = {k: t.column(k).to_numpy() for k in ("filter", "lo", "hi", "dim", "c", "part", "copies")}
            lists, rows = t.column("filters"), t.column("v")
            unit: dict[int, np.ndarray] = {}  # by dimension, of all rows of it in their order
            place = np.zeros(t.num_rows, np.int64)
            for dim in np.unique(v["dim"]):
                at = np.flatnonzero(v["dim"] == dim)
                x = rows.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x.astype(float)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
                place[at] = np.arange(len(at))
            out: list[tuple] = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    x = unit[v["dim"][lo]][place[lo] : place[lo] + hi - lo]
                    near = np.triu(np.clip(x @ x.T, -1, 1) >= least, 1)
                    if near.any():
                        _count_links(near, slice(lo, hi), v, lists, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], ["c", "links", "other"])

    inside = inside.select("filter", "lo", "hi", F.size("v").cast("int").alias("dim"), "c", "part", "copies", "filters", "v")
    dealt = inside.repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi", "dim", "c")
    found = scratch.save(dealt.mapInArrow(compare, "c long, links long, other long"), "found")
    joined = components(found.select(F.col("c").alias("a"), F.col("other").alias("b")), scratch, "linked")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "n1", "n2", "first_id", "copies").join(links, "c", "left").join(joined.withColumnRenamed("node", "c"), "c", "left")
    known = scratch.save(known.select("n1", "n2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "c").alias("component")), "known")
    least_id = scratch.save(known.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    known = scratch.save(known.join(least_id, "component").select("n1", "n2", "n_links", "component_id"), "named")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("v is not null").select("id", "n1", "n2").join(known, ["n1", "n2"]).select("id", "n_links", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
