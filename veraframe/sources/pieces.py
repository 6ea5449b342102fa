"""A file as pieces that tasks read apart, and the rows of a JSON document found in them."""

from __future__ import annotations

import codecs
import gzip
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import CodecError
from ..functions.text import charset, python_codec
from .files import gzip_members

#: Bytes that a task holds at once; a row that is longer is held whole.
PIECE = 8 << 20
_MARKED, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_MARKED[list(b'"[]{},')] = True
_SPACE[list(b" \t\r\n,")] = True
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*\Z', re.S)


@dataclass(frozen=True)
class Pieces:
    """Offset and size of each piece of a file in a folder that all share, a range of bytes or gzip members that tell their sizes.

    A file that can't be split is a single stream, read block by block.
    """

    path: str
    places: tuple[tuple[int, int], ...]
    stream: bool = False
    codec: str = "utf-8"
    packed: bool = False

    def blocks(self, i: int) -> Iterator[bytes]:
        """What piece i holds, in UTF-8."""
        if not self.stream:
            raw = self._read(*self.places[i])
            yield gzip.decompress(raw) if self.packed else raw
            return
        with open(self.path, "rb") as f:
            packed = f.read(2) == b"\x1f\x8b"
        decode = codecs.getincrementaldecoder(self.codec)().decode if self.codec != "utf-8" else None
        with gzip.open(self.path) if packed else open(self.path, "rb") as f:
            while block := f.read(PIECE):
                yield decode(block).encode() if decode else block
        if decode:
            yield decode(b"", True).encode()

    def after(self, i: int) -> Iterator[bytes]:
        """What follows piece i, little at first."""
        if self.stream:
            return
        if self.packed:
            for k in range(i + 1, len(self.places)):
                yield from self.blocks(k)
            return
        at, size = sum(self.places[i]), 1 << 16
        while block := self._read(at, size):
            yield block
            at, size = at + len(block), min(2 * size, PIECE)

    def _read(self, at: int, size: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            return f.read(size)

    def each(self, spark: SparkSession, f: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``f`` makes of each piece, in their order, a task for each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield from f(i)

        n = len(self.places)
        return spark.range(0, n, 1, n).mapInArrow(run, schema)


def pieces(path: str, encoding: str | None = None) -> Pieces | None:
    """The pieces of a single file that tasks can open by its path; None for folders and other stores."""
    path = re.sub(r"\Afile:/+", "/", path)
    if not os.path.isfile(path):
        return None
    size, name = os.path.getsize(path), charset(encoding or "UTF-8")
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    utf8 = name in ("UTF-8", "US-ASCII")
    if packed and utf8 and (members := gzip_members(path)):
        groups: list[list[int]] = []
        for at, length, text in members:
            if groups and groups[-1][2] + text <= PIECE:
                groups[-1][1] += length
                groups[-1][2] += text
            else:
                groups.append([at, length, text])
        return Pieces(path, tuple((at, length) for at, length, _ in groups), packed=True)
    if packed or not utf8:
        return Pieces(path, ((0, size),), True, "utf-8" if utf8 else python_codec(name))
    return Pieces(path, tuple((at, min(PIECE, size - at)) for at in range(0, max(size, 1), PIECE)))


class State(NamedTuple):
    """What stands before a byte: whether a text is open, how many brackets are, whether a backslash escapes the byte."""

    quoted: int = 0
    depth: int = 0
    escaped: int = 0


_STARTS = [State(q, 0, e) for q in (0, 1) for e in (0, 1)]


class Marks(NamedTuple):
    """Brackets and commas outside texts: place, byte, 1 or -1 where they open or close, and the level they are of."""

    at: np.ndarray
    byte: np.ndarray
    step: np.ndarray
    level: np.ndarray
    end: State


def marks(data: bytes, state: State) -> Marks:
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARKED[b])
    byte, escaped = b[at], 0
    quote = byte == 34
    if state.escaped or b"\\" in data:
        slashes = np.flatnonzero(b == 92)
        slashes = slashes[1:] if state.escaped and len(slashes) and slashes[0] == 0 else slashes
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(first, append=len(slashes))
        by_slash = np.zeros(len(b) + 1, bool)
        by_slash[(slashes[first] + length)[length % 2 == 1]] = True
        by_slash[0] = state.escaped
        quote &= ~by_slash[at]
        escaped = int(by_slash[len(b)])
    quoted = (np.cumsum(quote) + state.quoted) & 1
    outside = ~(byte == 34) & (quoted == 0)
    end_quoted = int(quoted[-1]) if len(quoted) else state.quoted
    at, byte = at[outside], byte[outside]
    step = ((byte == 91) | (byte == 123)).astype(np.int64) - ((byte == 93) | (byte == 125))
    depth = state.depth + np.cumsum(step)
    return Marks(at, byte, step, depth + (step == -1), State(end_quoted, int(depth[-1]) if len(depth) else state.depth, escaped))


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


@dataclass(frozen=True)
class Document:
    """A Dataset-JSON document: its head without rows, where the rows stand, and the state before each piece."""

    pieces: Pieces
    head: dict
    rows: tuple[int, int] | None
    states: tuple[State, ...]
    places: tuple[int, ...]

    def lines(self, spark: SparkSession, n_max: int | None = None, numbered: bool = False) -> DataFrame:
        """The text of each row and ``_row``, by which they are in order; it counts from 1 if ``numbered``. Of each piece, ``n_max`` rows at most."""
        if self.rows is None:
            return spark.createDataFrame([], "_row long, value string")
        p, states, places, (a, b) = self.pieces, self.states, self.places, self.rows
        before = [i << 33 for i in range(len(states))]

        def found(i: int) -> Iterator[pa.Array]:
            return rows_of(itertools.chain(p.blocks(i), p.after(i)), states[i], places[i], places[i + 1], a, b, p.path)

        if numbered:
            counted = p.each(spark, lambda i: (_batch(i=pa.array([i]), n=pa.array([len(x)])) for x in found(i)), "i long, n long")
            counts = [0] * len(states)
            for r in counted.collect():
                counts[r["i"]] += r["n"]
            before = [0, *itertools.accumulate(counts)]

        def rows(i: int) -> Iterator[pa.RecordBatch]:
            n = 0
            for x in found(i):
                yield _batch(_row=pa.array(np.arange(n + 1, n + 1 + len(x)) + before[i]), value=x)
                n += len(x)
                if n_max is not None and n >= n_max:
                    return

        return p.each(spark, rows, "_row long, value string")


def document(spark: SparkSession, p: Pieces) -> Document:
    """Find the rows of a document: the state before each piece, then its outline, then what stands outside the rows.

    Each is a pass of tasks over the pieces; a piece tells where it leads from each state that might stand before it.
    """
    wrong = CodecError(f"{p.path} is no Dataset-JSON document", path=p.path)

    def leads(i: int) -> Iterator[pa.RecordBatch]:
        n, nul, to = 0, False, list(_STARTS)
        for block in p.blocks(i):
            known = {(s.quoted, s.escaped): marks(block, s).end for s in _STARTS if not s.escaped or block[:1] in (b'"', b"\\")}
            to = [t if not block else State((e := known.get((t.quoted, t.escaped)) or known[t.quoted, 0]).quoted, t.depth + e.depth, e.escaped) for t in to]
            n, nul = n + len(block), nul or b"\x00" in block
        yield _batch(i=pa.array([i]), n=pa.array([n]), nul=pa.array([nul]), to=pa.array([[x for t in to for x in t]]))

    states, places = [State()], [0]
    for r in sorted(p.each(spark, leads, "i long, n long, nul boolean, to array<long>").collect()):
        s = states[-1]
        k = 3 * _STARTS.index(State(s.quoted, 0, s.escaped))
        quoted, depth, escaped = r["to"][k : k + 3]
        states.append(State(quoted, s.depth + depth, escaped))
        places.append(places[-1] + r["n"])
        if r["nul"]:
            raise wrong
    if states.pop() != State():
        raise wrong

    def outline(i: int) -> Iterator[pa.RecordBatch]:
        state, at = states[i], places[i]
        for block in p.blocks(i):
            m = marks(block, state)
            over = m.at[(m.step == -1) & (m.level == 1)]
            stop = 0 if state.depth == 0 and at else int(over[0]) + 1 if len(over) else len(block)
            left, outside = 0, state.depth < 2
            for x, step in zip(*(v[(m.step != 0) & (m.level == 2) & (m.at < stop)].tolist() for v in (m.at, m.step)), strict=True):
                if step == 1:
                    yield _segment(at + left, block[left : x + 1], True)
                left, outside = x, step == -1
            if outside:
                yield _segment(at + left, block[left:stop] + block[stop:].strip()[:40], False)
            state, at = m.end, at + len(block)

    text, gap, rows, opened = b"", b"", None, None
    for r in sorted(p.each(spark, outline, "at long, text binary, opens boolean").collect()):
        segment = bytes(r["text"])
        if opened is not None:
            rows, opened = (opened, r["at"]) if opened >= 0 and rows is None else rows, None
        text, gap = text + segment, gap + segment
        if r["opens"]:
            key = _KEY.search(gap[:-1])
            opened = r["at"] + len(segment) - 1 if key and json.loads(key[1]) == "rows" and segment.endswith(b"[") else -1
            gap = b""
    try:
        keys = json.loads(text.decode("utf-8-sig"))
    except ValueError as e:
        raise wrong from e
    if not isinstance(keys, dict) or "columns" not in keys:
        raise wrong
    if not isinstance(keys.get("rows"), list | None):
        raise CodecError(f"{p.path}: rows can't be read", path=p.path)
    a, b = rows or (places[-1], places[-1])

    def aside(i: int) -> Iterator[pa.RecordBatch]:
        if a < places[i] and places[i + 1] <= b:
            return
        at = places[i]
        for block in p.blocks(i):
            for left, right in ((0, a + 1 - at), (max(b - at, 0), len(block))):
                if right > 0 and block[left:right]:
                    yield _segment(at + left, block[left:right], False)
            at += len(block)

    head = b"".join(bytes(r["text"]) for r in sorted(p.each(spark, aside, "at long, text binary, opens boolean").collect()))
    try:
        return Document(p, json.loads(head.decode("utf-8-sig")), rows, tuple(states), tuple(places))
    except ValueError as e:
        raise CodecError(f"{p.path}: bad metadata: {e}", path=p.path) from e


def _segment(at: int, text: bytes, opens: bool) -> pa.RecordBatch:
    return _batch(at=pa.array([at]), text=pa.array([text], pa.binary()), opens=pa.array([opens]))


def rows_of(blocks: Iterator[bytes], state: State, at: int, end: int, a: int, b: int, where: str) -> Iterator[pa.Array]:
    """The texts of the rows that begin from ``at`` on, before ``end``; all rows stand between the brackets at ``a`` and ``b``.

    A row is given when what follows it is known, a comma and another row or the last bracket; anything else is an error.
    """
    kept = b""
    for block in blocks:
        if at > b or not kept and at >= end:
            return
        data = kept + block
        m = marks(data, state)
        within = (m.at > a - at) & (m.at < b - at)
        starts, stops = (m.at[within & (m.step == s) & (m.level == 3)] for s in (1, -1))
        commas = m.at[within & (m.step == 0) & (m.level == 2)]
        first = a - at if 0 <= a - at < len(data) else None  # the opening bracket counts as a row that isn't given
        starts = starts if first is None else np.concatenate(([first], starts))
        if not len(starts):
            kept, state, at = b"", m.end, at + len(data)
            continue
        stops = stops[stops > starts[0]] if first is None else np.concatenate(([first], stops[stops > first]))
        last = b - at < len(data)
        bounds = np.concatenate((starts[1:], [b - at])) if last else starts[1:]
        n = len(bounds)
        if n:
            s, e = starts[:n], stops[:n]
            if len(e) < n or (e >= bounds).any() or (e < s).any():
                raise CodecError(f"{where}: rows can't be read", path=where)
            between = np.searchsorted(commas, bounds) - np.searchsorted(commas, e)
            wanted = np.ones(n, np.int64)
            wanted[-1:] = 0 if last else 1
            wanted[:1] = wanted[:1] if first is None else 0
            region = np.frombuffer(data, np.uint8)[s[0] : bounds[-1]]
            edges = np.zeros(len(region) + 1, np.int8)
            edges[s - s[0]] += 1
            edges[e + 1 - s[0]] -= 1
            inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
            if (between != wanted).any() or not _SPACE[region[~inside]].all():
                raise CodecError(f"{where}: rows can't be read", path=where)
            skip = int(first is not None)
            own = int(np.searchsorted(s, end - at))
            lengths = (e - s + 1)[skip:own]
            if len(lengths):
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.ascontiguousarray(region[inside][skip : skip + offsets[-1]])
                yield pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        if last or starts[n] + at >= end:
            return
        kept, state = data[starts[n] :], State(0, 1 if n == 0 and first is not None else 2, 0)
        at += int(starts[n])


def lines_of(p: Pieces, i: int) -> Iterator[pa.Array]:
    """The lines of piece i, with what its last one goes on with behind it; a line that began before is that piece's.

    As a piece can't know whether the one before it ends with a line, it leaves out its first and takes one more behind its end.
    """
    data = b"".join(p.blocks(i))
    if i:
        cut = data.find(b"\n")
        if cut < 0:
            return
        data = data[cut + 1 :]
    rest = []
    for block in p.after(i):
        cut = block.find(b"\n")
        rest.append(block[: cut + 1] if cut >= 0 else block)
        if cut >= 0:
            break
    data += b"".join(rest)
    if not data:
        return
    data += b"" if data.endswith(b"\n") else b"\n"
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b == 10)
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int32)
    yield pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[b != 10]))])


def text_pieces(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame | None:
    """The lines of a gzip file whose members tell their sizes, in order, a task for each; None for any other file."""
    p = pieces(path, encoding)
    return p.each(spark, lambda i: (_batch(value=x) for x in lines_of(p, i)), "value string") if p and p.packed else None
