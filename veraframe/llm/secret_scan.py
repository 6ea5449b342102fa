"""Operator 4, secrets: base patterns, and formats learnt as probabilistic automata."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_place, table, text_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What may be a credential by its letters alone.
LEAST = 8
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Values that are learnt from, at most, for each kind, and the greatest length of what is learnt from.
MOST, LONGEST = 600, 128
#: Confidence of the Hoeffding test for two states to differ, and bits by character for a format to be likely.
ALPHA, LEAST_BITS = 0.05, 0.75


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by start, then kind."""
    low = text.lower()  # any text that the pattern finds holds one of the words here
    found = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in _WORDS) else []
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def free_parts(text: str, base: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates: what base spans leave of runs of credential signs, of LEAST signs or more."""
    taken = sorted((s, e) for _, s, e, _ in base)
    k = 0
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < end:
            if taken[i][0] - at >= LEAST:
                yield at, taken[i][0]
            at = max(at, taken[i][1])
            i += 1
        if end - at >= LEAST:
            yield at, end


#: The symbols of candidates: digit 0, a to f as h, other lower case l, upper case U, any other sign itself.
SIGNS = "0hlU+/_.=-"
_CLASSES = str.maketrans({c: "0" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def symbols(value: str) -> str:
    return value.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton inferred from a sample of strings by merging compatible prefix-tree states.

    States of one depth are merged first: of many strings of one length hardly two share a long prefix, so only
    pooled do deep states tell how strings end. Then states of different depths are, which makes loops. Each state
    knows how often strings end in it and how often they leave it by each symbol; a merge adds these counts up and
    redirects transitions with the counts they have, so that they always make a distribution.
    """

    #: Share of a string that each outcome at a state has beside those that the sample has.
    SPARE = 0.001

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.end: list[int] = [0]
        self.taken: list[dict[str, int]] = [{}]
        self._next: list[dict[str, int]] = [{}]
        self._into = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        layers: list[list[int]] = [[0]]
        for s in sorted(sample):
            q = 0
            for depth, c in enumerate(s, 1):
                if c not in self._next[q]:
                    self._next[q][c] = len(self.end)
                    self.end.append(0)
                    self.taken.append({})
                    self._next.append({})
                    self._into.append(len(self._into))
                    if depth == len(layers):
                        layers.append([])
                    layers[depth].append(self._next[q][c])
                self.taken[q][c] = self.taken[q].get(c, 0) + 1
                q = self._next[q][c]
            self.end[q] += 1
        for layer in layers:
            self._merge_all(layer)
        self._merge_all([q for layer in layers for q in layer])

    def find(self, q: int) -> int:
        while self._into[q] != q:
            self._into[q] = q = self._into[self._into[q]]
        return q

    def states(self) -> list[int]:
        return [q for q in range(len(self.end)) if self._into[q] == q]

    def count(self, q: int) -> int:
        return self.end[q] + sum(self.taken[q].values())

    def step(self, q: int, c: str) -> int | None:
        t = self._next[q].get(c)
        return None if t is None else self.find(t)

    def _merge_all(self, states: list[int]) -> None:
        kept: list[int] = []
        for q in states:
            if self._into[q] != q:
                continue
            for r in kept:
                if self._into[r] == r and self._alike(r, q):
                    self._fold(r, q)
                    break
            else:
                kept.append(q)

    def _alike(self, a: int, b: int) -> bool:
        """Whether ends and transitions of both states, and of those that they lead to, are as frequent."""
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            x, y = todo.pop()
            n, m = self.count(x), self.count(y)
            wide = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if x == y or wide >= 1:  # what follows is rarer still
                continue
            if abs(self.end[x] / n - self.end[y] / m) >= wide:
                return False
            for c in self.taken[x].keys() | self.taken[y].keys():
                if abs(self.taken[x].get(c, 0) / n - self.taken[y].get(c, 0) / m) >= wide:
                    return False
                p, q = self.step(x, c), self.step(y, c)
                if p is not None and q is not None and (p, q) not in seen:
                    seen.add((p, q))
                    todo.append((p, q))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = (self.find(q) for q in todo.pop())
            if x == y:
                continue
            self._into[y] = x
            self.end[x] += self.end[y]
            for c, n in self.taken[y].items():
                self.taken[x][c] = self.taken[x].get(c, 0) + n
                if c in self._next[x]:
                    todo.append((self._next[x][c], self._next[y][c]))
                else:
                    self._next[x][c] = self._next[y][c]

    def accepts(self, s: str) -> bool:
        q: int | None = 0
        for c in s:
            q = self.step(q, c)
            if q is None:
                return False
        return self.end[q] > 0

    def bits(self, s: str, plain: dict[str, float] | None = None) -> float:
        """Log-likelihood to base 2. Where the sample never went, signs are as ``plain`` says or all as likely."""
        q: int | None = 0
        outcomes, total = len(SIGNS) + 1, 0.0
        for c in [*s, None]:
            if q is None:
                total += plain[c or "end"] if plain else -math.log2(outcomes)
                continue
            seen = self.end[q] if c is None else self.taken[q].get(c, 0)
            total += math.log2((seen + self.SPARE) / (self.count(q) + self.SPARE * outcomes))
            q = None if c is None else self.step(q, c)
        return total


class Formats:
    """An automaton for each kind of credential, against one of other candidates and the frequencies of their signs."""

    def __init__(self, credentials: dict[str, list[str]], others: list[str], signs: dict[str, int]):
        self.automata = [Automaton([symbols(v) for v in vs]) for _, vs in sorted(credentials.items()) if vs]
        self.other = Automaton([symbols(v) for v in others]) if others else None
        total = sum(signs.values()) + len(SIGNS) + 1
        self.plain = {c: math.log2((signs.get(c, 0) + 1) / total) for c in [*SIGNS, "end"]}

    def score(self, value: str) -> float:
        """Bits by character by which the likeliest format that has the value in its language beats other candidates."""
        s = symbols(value)
        fit = [a for a in self.automata if a.accepts(s)]
        if not fit:  # nearly all words
            return -math.inf
        other = sum(self.plain[c] for c in [*s, "end"])
        if self.other is not None:
            other = max(other, self.other.bits(s, self.plain))
        return max((a.bits(s, self.plain) - other) / (len(s) + 1) for a in fit)


def scan_secrets(docs: DataFrame, least_bits: float = LEAST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, for each whole text.

    The credentials that the base patterns find are labelled by their kind, all other candidates as such; candidates
    are runs of LEAST credential signs or more, or what base spans leave of them. At most MOST distinct values of
    each label, which ones by hash, of at most LONGEST characters, are what automata are inferred from; signs are
    counted over all other candidates of at most that length, as longer ones would outweigh the rest. Then every
    candidate of all texts is scored, whatever its length, and gives a ``format`` span if an automaton
    accepts it and makes it likelier than other text does, by ``least_bits`` a character. The first pass writes nothing but the learnt values.

    Null and empty texts have no spans. Null and repeated ids get a row each; extra columns are not read. In a table
    without credentials no format is learnt and nothing added.
    """
    spark = docs.sparkSession
    d, (i, t) = by_place(docs, id_col, text_col)
    rows = d.select(F.col(i).alias("id"), text_of(t).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each label the values of the least hashes, and how often each sign stands in other candidates."""
        least: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, "other")}
        bar = dict.fromkeys(least, 1 << 64)
        signs = dict.fromkeys([*SIGNS, "end"], 0)

        def trim(label: str) -> None:
            best = sorted((h, v) for v, h in least[label].items())[:MOST]
            least[label] = {v: h for h, v in best}
            bar[label] = best[-1][0] if len(best) == MOST else 1 << 64

        for b in batches:
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                parts = [text[s:e] for s, e in free_parts(text, base) if e - s <= LONGEST]
                every = symbols("".join(parts))
                for c in SIGNS:
                    signs[c] += every.count(c)
                signs["end"] += len(parts)
                for label, v in [*((k, v) for k, _, _, v in base if len(v) <= LONGEST), *(("other", p) for p in parts)]:
                    h = xxhash.xxh3_64_intdigest(v)
                    if h < bar[label]:
                        least[label][v] = h
                        if len(least[label]) > 4 * MOST:
                            trim(label)
        for label in least:
            trim(label)
        found = [(k, v, h - (1 << 63)) for k, vs in least.items() for v, h in vs.items()] + [("sign", c, n) for c, n in signs.items() if n]
        columns = list(zip(*found, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["kind", "value", "n"])

    told = Scratch(spark, "secrets").save(rows.select("text").mapInArrow(sample, "kind string, value string, n long"), "told")
    # Small heads first: each bucket gives its value of the least hash, so that one task sees 4,096 of a kind.
    bucket = F.pmod(F.xxhash64("value"), F.lit(4096)).alias("bucket")
    heads = told.where("kind <> 'sign'").groupBy("kind", bucket).agg(F.min(F.struct("n", "value")).alias("m"))
    pick = Window.partitionBy("kind").orderBy("m.n", "m.value")
    by: dict[str, list[str]] = {}
    for r in heads.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= MOST).select("kind", "m.value").collect():
        by.setdefault(r["kind"], []).append(r["value"])
    signs = {r["value"]: r["n"] for r in told.where("kind = 'sign'").groupBy("value").agg(F.sum("n").alias("n")).collect()}
    formats = spark.sparkContext.broadcast(Formats(by, by.pop("other", []), signs))  # of bounded size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                if len(known) > 200_000:
                    known.clear()
                base, more = base_spans(text), []
                for s, e in free_parts(text, base):
                    v = text[s:e]
                    if (x := known.get(v)) is None:
                        x = formats.value.score(v)
                        if e - s <= LONGEST:
                            known[v] = x
                    if x >= least_bits:
                        more.append(("format", s, e, ""))
                every = sorted([*base, *more], key=lambda s: (s[1], [*KINDS, "format"].index(s[0])))
                told = [",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans) for spans in (base, every)]
                for column, v in zip(out, [*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(told[0].encode()).hexdigest(), told[1]], strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    done = rows.mapInArrow(judge, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return done.withColumnRenamed("id", id_col)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))
