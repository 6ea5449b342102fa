"""SAS transport files, versions 5 and 8: fixed-width records behind 80-byte headers."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CodecError, CodecWarning, EncodingWarning, InputError, warn
from ..functions.numbers import IBM_MAX, IBM_MIN, finite, from_ibm, to_ibm
from ..functions.temporal import deflated, realized
from ..functions.text import charset, cut_bytes, encodable, python_codec, to_charset
from ..meta import SPECIAL, Dataset, Meta, as_dataset, stamp
from ..types import DEFAULT_FORMATS, TEMPORAL, family, parse_format
from .files import check_path, local, write_one_file

RECORD, NAMESTR = 80, 140
#: The marks of header records, by version.
_MARKS = {5: ("LIBRARY", "MEMBER", "DSCRPTR", "NAMESTR", "OBS"), 8: ("LIBV8", "MEMBV8", "DSCPTV8", "NAMSTV8", "OBSV8")}
_START = b"HEADER RECORD*******"
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


@dataclass(frozen=True)
class Variable:
    """A column as its 140-byte description says."""

    name: str
    numeric: bool
    length: int
    label: str = ""
    format: str = ""
    informat: str = ""
    at: int = 0


@dataclass(frozen=True)
class Member:
    """One dataset of a file and where its observations are."""

    name: str
    label: str
    version: int
    variables: tuple[Variable, ...]
    start: int
    rows: int
    created: str = ""
    width: int = field(default=0)


def _padded(text: str | bytes, size: int, codec: str = "latin-1") -> bytes:
    raw = text if isinstance(text, bytes) else text.encode(codec)
    return raw[:size].ljust(size)


def sas_stamp(when: datetime) -> str:
    """ddMMMyy:hh:mm:ss with English months."""
    return f"{when.day:02d}{_MONTHS[when.month - 1]}{when.year % 100:02d}:{when:%H:%M:%S}"


def _format_field(text: str) -> tuple[bytes, int, int]:
    name, width, decimals = parse_format(text) or ("", None, None)
    return _padded(name, 8), width or 0, decimals or 0


def header(meta_name: str, label: str, variables: list[Variable], version: int, created: datetime, codec: str, rows: int) -> bytes:
    """All bytes before the first observation."""
    library, member, descriptor, names, obs = _MARKS[version]
    line = lambda mark, rest: (_START + f"{mark:<8}".encode() + b"HEADER RECORD!!!!!!!" + rest).ljust(RECORD)
    zeros, when = b"0" * 30, sas_stamp(created).encode()
    out = [line(library, zeros), _padded(b"SAS     SAS     SASLIB  " + b"9.4     " + b"X64_10PR" + b" " * 24 + when, RECORD), _padded(when, RECORD)]
    out += [line(member, b"000000000000000001600000000140"), line(descriptor, zeros)]
    if version == 5:
        out.append(_padded(b"SAS     " + _padded(meta_name, 8) + b"SASDATA 9.4     X64_10PR" + b" " * 24 + when, RECORD))
    else:
        out.append(_padded(b"SAS     " + _padded(meta_name, 32) + b"SASDATA 9.4     X64_10PR" + when, RECORD))
    out += [_padded(when + b" " * 16 + _padded(cut_bytes(label, 40, codec).encode(codec), 40), RECORD), line(names, f"000000{len(variables):04d}00000000000000000000".encode())]
    block = b""
    for i, v in enumerate(variables, 1):
        form, width, decimals = _format_field(v.format)
        inform, inwidth, indecimals = _format_field(v.informat)
        block += struct.pack(">hhhh", 1 if v.numeric else 2, 0, v.length, i) + _padded(v.name, 8) + _padded(cut_bytes(v.label, 40, codec).encode(codec), 40)
        block += form + struct.pack(">hhh2x", width, decimals, 0) + inform + struct.pack(">hhl", inwidth, indecimals, v.at)
        block += (_padded(v.name, 32) + struct.pack(">h", len(v.label.encode(codec))) if version == 8 else b"").ljust(52, b"\0")
    out.append(block + b" " * (-len(block) % RECORD))
    long = [(i, v) for i, v in enumerate(variables, 1) if version == 8 and (len(v.name) > 8 or len(v.label.encode(codec)) > 40)]
    if long:
        body = b"".join(struct.pack(">hhh", i, len(v.name.encode(codec)), len(v.label.encode(codec))) + v.name.encode(codec) + v.label.encode(codec) for i, v in long)
        out += [line("LABELV8", f"{len(long):<30d}".encode()), body + b" " * (-len(body) % RECORD)]
    out.append(line(obs, zeros if version == 5 else f"{rows:>15d}".encode() + b"0" * 15))
    return b"".join(out)


# -- writing --------------------------------------------------------------------


def _guards(x: Dataset, names: list[str], codec: str, policy: str) -> dict[str, int]:
    """Widths of text columns, after all that a file can't hold has been counted; one pass."""
    df, exprs = x.df, []
    for n in names:
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, T.StringType):
            exprs.append((n, "width", F.coalesce(F.max(F.octet_length(c)), F.lit(0))))
            exprs.append((n, "texts that are not UTF-8", F.count_if(~F.is_valid_utf8(c))))
            if policy == "error" and codec not in ("utf-8",):
                exprs.append((n, f"texts that {codec} lacks characters of", F.count_if(~encodable(codec)(c))))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            d = F.abs(c)
            exprs.append((n, "numbers that are not finite", F.count_if(c.isNotNull() & ~F.isnan(c) & ~finite(c))))
            exprs.append((n, "numbers too large", F.count_if(finite(c) & (d >= IBM_MAX))))
            exprs.append((n, "numbers too small", F.count_if(finite(c) & (d > 0) & (d < IBM_MIN))))
    row = df.agg(*[e.alias(f"_{i}") for i, (*_, e) in enumerate(exprs)]).first() if exprs else []
    bad = [f"{n}: {row[i]} {what}" for i, (n, what, _) in enumerate(exprs) if what != "width" and row[i]]
    if bad:
        raise CodecError("; ".join(bad), problems=bad)
    return {n: int(row[i]) for i, (n, what, _) in enumerate(exprs) if what == "width"}


def _names(x: Dataset, version: int) -> None:
    problems = []
    for n in x.names:
        if version == 5 and not re.fullmatch(r"[A-Z_][A-Z0-9_]{0,7}", n):
            problems.append(n)
        if version == 8 and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,31}", n):
            problems.append(n)
        if isinstance(x.df.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise CodecError(f"{n}: columns of type {x.df.schema[n].dataType.simpleString()} have no place in a transport file", column=n)
    if problems:
        raise CodecError(f"names that version {version} can't hold: {', '.join(problems)}", columns=problems)
    folded = [n.upper() for n in x.names]
    twice = sorted({n for n in folded if folded.count(n) > 1})
    if twice:
        raise CodecError(f"names that differ in case alone: {', '.join(twice)}", columns=twice)


def write_xpt(x: Dataset | DataFrame, path: str, version: int = 5, encoding: str | None = None, on_invalid: str = "error", created: datetime | None = None) -> Dataset:
    """Write one member: one pass for widths and guards, one for the records, which tasks encode in columns."""
    x = as_dataset(x)
    if version not in (5, 8):
        raise InputError("version is 5 or 8", version=version)
    _names(x, version)
    target = charset(encoding or x.meta.dataset.get("encoding") or "UTF-8")
    codec = python_codec(target)
    codec = "utf-8" if target == "UTF-8" else codec
    found = _guards(x, x.names, codec, on_invalid)
    df, columns, variables, at = x.df, [], [], 0
    for n in x.names:
        c, kind, meta = F.col(f"`{n}`"), df.schema[n].dataType, x.meta.columns[n]
        label, form, inform = meta.get("label", ""), meta.get("displayFormat", ""), meta.get("informat", "")
        if isinstance(kind, T.StringType):
            width = max(1, found[n], meta.get("length", 0))
            if "length" in meta and found[n] > meta["length"]:
                warn(CodecWarning, f"{n}: widened from {meta['length']} to {found[n]} bytes")
            if version == 5 and width > 200:
                raise CodecError(f"{n}: {width} bytes, version 5 holds 200", column=n)
            columns.append((to_charset(c, target, on_invalid) if on_invalid != "error" else c).alias(n))
        else:
            want = meta["dataType"]
            width = 8
            if want in TEMPORAL and not isinstance(kind, (T.DoubleType, T.IntegerType)):
                c = deflated(c.cast("timestamp_ntz") if want == "datetime" else c, want)
                form = form or DEFAULT_FORMATS[want]
            columns.append((c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double").alias(n))
        if len(label.encode(codec, "replace")) > 40 and version == 5:
            warn(CodecWarning, f"{n}: label cut to 40 bytes")
        variables.append(Variable(n, not isinstance(kind, T.StringType), width, label, form, inform, at))
        at += width
    for n in x.names:
        if f"{SPECIAL}{n}" in df.columns:
            columns.append(F.col(f"`{SPECIAL}{n}`"))
    if target not in ("UTF-8", "US-ASCII"):
        _fda(df, x.names, codec)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            parts = []
            for v in variables:
                s = pdf[v.name]
                if v.numeric:
                    tags = pdf[f"{SPECIAL}{v.name}"].tolist() if f"{SPECIAL}{v.name}" in pdf else None
                    parts.append(to_ibm(s.to_numpy(float, na_value=np.nan), tags))
                else:
                    raw = [("" if t is None or t is pd.NA or t != t else t).encode(codec, "replace").ljust(v.length)[: v.length] for t in s]
                    parts.append(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, v.length))
            yield pd.DataFrame({"record": [np.hstack(parts).tobytes()]})

    records = df.select(*columns).mapInPandas(encode, "record binary")
    when = created or datetime.now(timezone.utc)
    rows = df.count() if version == 8 else 0
    name = x.meta.dataset["name"]
    head = header(name.upper() if version == 5 else name, x.meta.dataset.get("label", ""), variables, version, when, codec, rows)
    write_one_file(records, path, head=head, pad_to=RECORD)
    return x


def _fda(df: DataFrame, names: list[str], codec: str) -> None:
    """Warn of bytes 160 to 191 in a single-byte set, which regulators' tools misread."""
    signs = "".join(bytes([b]).decode(codec, "ignore") for b in range(160, 192))
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if texts and signs:
        row = df.agg(*[F.count_if(F.translate(F.col(f"`{n}`"), signs, "") != F.col(f"`{n}`")) for n in texts]).first()
        hit = [n for n, k in zip(texts, row, strict=True) if k]
        if hit:
            warn(EncodingWarning, f"bytes 160 to 191 in {', '.join(hit)}")


# -- reading --------------------------------------------------------------------


class _File:
    """Headers of a file, read by seeking; observations are never read here, save the tail of a version 5 member."""

    def __init__(self, path: str):
        self.path = local(check_path(path))
        if not os.path.isfile(self.path):
            raise CodecError(f"{self.path} does not exist", path=path)
        self.size = os.path.getsize(self.path)

    def at(self, offset: int, size: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(size)

    def members(self) -> list[Member]:
        first = self.at(0, RECORD)
        version = next((v for v, m in _MARKS.items() if first.startswith(_START + f"{m[0]:<8}".encode())), None)
        if version is None:
            raise CodecError(f"{self.path} is no transport file", path=self.path)
        found, where = [], 3 * RECORD
        while where + RECORD <= self.size:
            try:
                m, end = self._member(where, version)
            except (struct.error, ValueError, IndexError, UnicodeDecodeError) as e:
                raise CodecError(f"{self.path}: damaged header: {e}", path=self.path) from e
            found.append(m)
            where = end
        if not found:
            raise CodecError(f"{self.path} has no member", path=self.path)
        return found

    def _expect(self, where: int, mark: str) -> bytes:
        line = self.at(where, RECORD)
        if not line.startswith(_START + f"{mark:<8}".encode()):
            raise CodecError(f"{self.path}: no {mark} header at byte {where}", path=self.path)
        return line

    def _member(self, where: int, version: int) -> tuple[Member, int]:
        _, member, descriptor, names, obs = _MARKS[version]
        size = int(self._expect(where, member)[-6:].strip() or NAMESTR)
        size = size if 136 <= size <= NAMESTR else NAMESTR
        self._expect(where + RECORD, descriptor)
        one, two = self.at(where + 2 * RECORD, RECORD), self.at(where + 3 * RECORD, RECORD)
        name = one[8 : 16 if version == 5 else 40].decode("latin-1").strip()
        count = int(self._expect(where + 4 * RECORD, names)[54:58])
        where += 5 * RECORD
        block = self.at(where, count * size)
        if len(block) < count * size:
            raise CodecError(f"{self.path}: cut short in the variables", path=self.path)
        variables = [self._variable(block[i * size : (i + 1) * size], version) for i in range(count)]
        where += -(-count * size // RECORD) * RECORD
        line = self.at(where, RECORD)
        if version == 8 and line.startswith((_START + b"LABELV8 ", _START + b"LABELV9 ")):
            variables, where = self._long(where, line, variables)
        last = self._expect(where, obs)
        start, width = where + RECORD, sum(v.length for v in variables)
        end = self._next(start, member)
        rows = int(last[48:63]) if version == 8 and last[48:63].strip().isdigit() else self._rows(start, end, width)
        if start + rows * width > self.size:
            raise CodecError(f"{self.path}: cut short, {rows} rows of {width} bytes are declared", path=self.path)
        end = end if version == 5 else max(end, start)
        created = one[64:80]
        return Member(name, two[32:72].decode("latin-1").strip(), version, tuple(variables), start, rows, created.decode("latin-1").strip(), width), end

    @staticmethod
    def _variable(raw: bytes, version: int) -> Variable:
        kind, _, length, _ = struct.unpack(">hhhh", raw[:8])
        width, decimals = struct.unpack(">hh", raw[64:68])
        inwidth, indecimals, at = struct.unpack(">hhl", raw[80:88])
        text = lambda b: b.replace(b"\0", b" ").decode("latin-1").rstrip()
        spelt = lambda n, w, d: f"{n}{w or ''}.{d or ''}" if n or w else ""
        name = text(raw[88:120]) if version == 8 and text(raw[88:120]) else text(raw[8:16])
        if kind not in (1, 2) or length < 1:
            raise ValueError(f"variable {name!r} of type {kind} and length {length}")
        return Variable(name, kind == 1, length, text(raw[16:56]), spelt(text(raw[56:64]), width, decimals), spelt(text(raw[72:80]), inwidth, indecimals), at)

    def _long(self, where: int, line: bytes, variables: list[Variable]) -> tuple[list[Variable], int]:
        """Names and labels that don't fit their fields."""
        nine, count = line[20:27] == b"LABELV9", int(line[48:78].split()[0])
        out, at, step = list(variables), where + RECORD, 10 if line[20:27] == b"LABELV9" else 6
        for _ in range(count):
            sizes = struct.unpack(">hhhhh" if nine else ">hhh", self.at(at, step))
            body = self.at(at + step, sum(sizes[1:]))
            v = out[sizes[0] - 1]
            out[sizes[0] - 1] = Variable(body[: sizes[1]].decode("latin-1").rstrip(), v.numeric, v.length, body[sizes[1] : sizes[1] + sizes[2]].decode("latin-1").rstrip(), v.format, v.informat, v.at)
            at += step + sum(sizes[1:])
        used = at - where - RECORD
        return out, where + RECORD + -(-used // RECORD) * RECORD

    def _next(self, start: int, mark: str) -> int:
        """Where the next member's header is, or the end; headers stand at multiples of 80 bytes."""
        wanted, chunk, at = _START + f"{mark:<8}".encode(), 8000 * RECORD, start
        while at < self.size:
            block = self.at(at, chunk + len(wanted))
            i = block.find(wanted)
            while i >= 0:
                if (at + i) % RECORD == 0:
                    return at + i
                i = block.find(wanted, i + 1)
            at += chunk
        return self.size

    def _rows(self, start: int, end: int, width: int) -> int:
        """Rows of a version 5 member: blank records at the end that may be padding aren't rows."""
        if not width:
            return 0
        total = end - start
        rows = total // width
        while rows and total - (rows - 1) * width < RECORD and not self.at(start + (rows - 1) * width, width).strip(b" "):
            rows -= 1
        return rows


def members_of(path: str) -> list[Member]:
    return _File(path).members()


def chosen(path: str, member: str | int | None = None) -> Member:
    """A member by number or by name in any case; without either the file must have just one."""
    found = members_of(path)
    if member is None:
        if len(found) > 1:
            raise CodecError(f"{path} has {len(found)} members, name one: {', '.join(m.name for m in found)}", path=path, members=[m.name for m in found])
        return found[0]
    if isinstance(member, int):
        if not 1 <= member <= len(found):
            raise InputError(f"{path} has {len(found)} members", member=member)
        return found[member - 1]
    hit = [m for m in found if m.name.upper() == member.upper()]
    if not hit:
        raise InputError(f"{path} has no member {member!r}: {', '.join(m.name for m in found)}", member=member)
    return hit[0]


class _Piece(InputPartition):
    def __init__(self, first: int, rows: int):
        super().__init__(first)
        self.first, self.rows = first, rows


def decoded(raw: bytes, member: Member, names: list[str], codec: str) -> dict[str, np.ndarray]:
    """Columns of whole records: doubles with their tags, and text without padding."""
    table = np.frombuffer(raw, np.uint8).reshape(-1, member.width)
    out: dict[str, np.ndarray] = {}
    for v in member.variables:
        if v.name in names:
            cell = np.ascontiguousarray(table[:, v.at : v.at + v.length])
            if v.numeric:
                wide = np.zeros((len(cell), 8), np.uint8)
                wide[:, : min(8, v.length)] = cell[:, :8]
                out[v.name], out[SPECIAL + v.name] = from_ibm(wide)
            else:
                texts = [b.replace(b"\0", b" ").rstrip(b" ").decode(codec, "replace") for b in map(bytes, cell)]
                out[v.name] = np.array([t or None for t in texts], object)
    return out


class XptSource(DataSource):
    """``spark.read.format("xpt")``: options path, member, columns (comma-separated), encoding, nmax, rows (to a task)."""

    @classmethod
    def name(cls) -> str:
        return "xpt"

    def _member(self) -> Member:
        m = self.options.get("member")
        return chosen(self.options["path"], int(m) if m and m.isdigit() else m)

    def _wanted(self, m: Member) -> list[str]:
        asked = [c for c in self.options.get("columns", "").split(",") if c]
        return [v.name for v in m.variables if not asked or v.name in asked]

    def schema(self) -> T.StructType:
        m = self._member()
        fields = []
        for v in m.variables:
            if v.name in self._wanted(m):
                fields.append(T.StructField(v.name, T.DoubleType() if v.numeric else T.StringType()))
                fields += [T.StructField(SPECIAL + v.name, T.StringType())] if v.numeric else []
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(local(self.options["path"]), self._member(), self._wanted(self._member()), self.options.get("encoding", "utf-8"), int(self.options.get("nmax", -1)), int(self.options.get("rows", 100_000)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, member: Member, names: list[str], codec: str, most: int, step: int):
        self.path, self.member, self.names, self.codec, self.step = path, member, names, codec, step
        self.rows = member.rows if most < 0 else min(most, member.rows)

    def partitions(self) -> list[InputPartition]:
        return [_Piece(i, min(self.step, self.rows - i)) for i in range(0, self.rows, self.step)] or [_Piece(0, 0)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        width = self.member.width
        with open(self.path, "rb") as f:
            f.seek(self.member.start + partition.first * width)
            left = partition.rows
            while left > 0:
                n = min(left, 10_000)
                cols = decoded(f.read(n * width), self.member, self.names, self.codec)
                left -= n
                arrays, names = [], []
                for k, v in cols.items():
                    arrays.append(pa.array(v, pa.float64(), mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v.tolist(), pa.string()))
                    names.append(k)
                yield pa.RecordBatch.from_arrays(arrays, names)


def detect_encoding(spark: SparkSession, path: str, member: str | int | None = None) -> str:
    """UTF-8 if all text of a member is, else WINDOWS-1252; tasks look at their own records."""
    m = chosen(path, member)
    texts = [v for v in m.variables if not v.numeric]
    labels = "".join([m.label, *(v.label for v in m.variables)]).encode("latin-1")
    try:
        labels.decode("utf-8")
    except UnicodeDecodeError:
        return "WINDOWS-1252"
    where, width, start, step = local(path), m.width, m.start, 100_000

    def sound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in pdf["id"]:
                with open(where, "rb") as f:
                    f.seek(start + int(first) * width)
                    table = np.frombuffer(f.read(min(step, m.rows - int(first)) * width), np.uint8).reshape(-1, width)
                ok = True
                for v in texts:
                    cell = np.ascontiguousarray(table[:, v.at : v.at + v.length])
                    if (cell > 127).any():
                        try:
                            b"\n".join(map(bytes, cell)).decode("utf-8")
                        except UnicodeDecodeError:
                            ok = False
                yield pd.DataFrame({"ok": [ok]})

    if not texts or not m.rows:
        return "UTF-8"
    bad = spark.range(0, m.rows, step).mapInPandas(sound, "ok boolean").where("not ok").limit(1).count()
    return "WINDOWS-1252" if bad else "UTF-8"


def meta_of(m: Member, codec: str) -> Meta:
    columns = {}
    text = lambda s: s.encode("latin-1").decode(codec, "replace")
    for v in m.variables:
        kind = family(v.format) if v.numeric else None
        c = {"itemOID": f"IT.{m.name}.{v.name}", "name": v.name}
        if v.label:
            c["label"] = text(v.label)
        c["dataType"] = (kind or "float") if v.numeric else "string"
        if kind:
            c["targetDataType"] = "integer"
        c["length"] = v.length
        if v.format:
            c["displayFormat"] = v.format
        if v.informat:
            c["informat"] = v.informat
        columns[v.name] = c
    return Meta({"name": m.name or "DATA"}, columns).with_dataset(itemGroupOID=f"IG.{m.name}", label=text(m.label) or None, records=m.rows)


def read_xpt(spark: SparkSession, path: str, encoding: str | None = None, col_select: list[str] | None = None, n_max: int | None = None, member: str | int | None = None) -> Dataset:
    """Read one member. Records are split over tasks; only the columns asked for are decoded."""
    spark.dataSource.register(XptSource)
    m = chosen(path, member)
    target = charset(encoding) if encoding else detect_encoding(spark, path, member)
    codec = "utf-8" if target == "UTF-8" else python_codec(target)
    names = [v.name for v in m.variables if not col_select or v.name in col_select]
    unknown = sorted(set(col_select or []) - set(names))
    if unknown:
        raise InputError(f"no column {', '.join(unknown)}", columns=unknown)
    r = spark.read.format("xpt").option("encoding", codec).option("columns", ",".join(names)).option("nmax", -1 if n_max is None else n_max)
    df = (r.option("member", str(member)) if member is not None else r).load(path)
    meta = meta_of(m, codec).only(names).with_dataset(encoding=target, records=m.rows)
    out = []
    for n in names:
        c = meta.columns[n]
        col = F.col(f"`{n}`")
        out.append((realized(col, c["dataType"], text=False) if c["dataType"] in TEMPORAL else col).alias(n))
    tagged = [n for n in names if SPECIAL + n in df.columns]
    return Dataset(stamp(df.select(*out, *[F.col(f"`{SPECIAL}{n}`") for n in tagged]), meta), meta)
