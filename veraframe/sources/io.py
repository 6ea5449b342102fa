"""Reading and writing by format name or file extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CodecError, Condition, InputError
from ..meta import SPECIAL, Dataset, stamp
from . import datasetjson, ndjson, parquet, xpt
from .files import check_path


@dataclass(frozen=True)
class Codec:
    name: str
    read: Callable[..., Dataset] | None
    write: Callable[..., Dataset] | None
    extensions: tuple[str, ...]


_codecs: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    """Add a format; its extensions must be free."""
    taken = [e for c in _codecs.values() if c.name != codec.name for e in codec.extensions if e in c.extensions]
    if taken:
        raise InputError(f"extensions in use: {', '.join(taken)}", extensions=taken)
    _codecs[codec.name] = codec


register(Codec("xpt", xpt.read_xpt, xpt.write_xpt, ("xpt", "xport")))
register(Codec("json", datasetjson.read_json, datasetjson.write_json, ("json",)))
register(Codec("ndjson", ndjson.read_ndjson, ndjson.write_ndjson, ("ndjson", "jsonl")))
register(Codec("parquet", parquet.read_parquet, parquet.write_parquet, ("parquet", "pq")))


def by_name(name: str) -> Codec:
    if name == "rds":
        raise CodecError("rds is a serialised object of R; write a checkpoint instead", format=name)
    if name not in _codecs:
        raise InputError(f"no format {name!r}; known are {', '.join(sorted(_codecs))}", format=name)
    return _codecs[name]


def by_extension(path: str) -> Codec:
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    gz = parts[-1] == "gz"
    ext = parts[-2] if gz and len(parts) > 2 else parts[-1]
    found = next((c for c in _codecs.values() if ext in c.extensions), None)
    if ext == "rds":
        return by_name("rds")
    if found is None or gz and found.name not in ("json", "ndjson"):
        raise InputError(f"{path}: no format has this extension; name one", path=path)
    return found


def resolve(path: str, format: str | None = None) -> Codec:
    """A format that is named wins over the extension."""
    return by_name(format) if format else by_extension(check_path(path))


def formats(spark: SparkSession) -> DataFrame:
    """format, read, write, extensions."""
    rows = [(c.name, c.read is not None, c.write is not None, ", ".join(c.extensions)) for c in sorted(_codecs.values(), key=lambda c: c.name)]
    return spark.createDataFrame(rows, "format string, read boolean, write boolean, extensions string")


def check_partial(col_select: Any, n_max: Any) -> None:
    """Arguments are checked before any byte is read."""
    if col_select is not None and (isinstance(col_select, str) or not col_select or not all(isinstance(c, str) for c in col_select) or len(set(col_select)) != len(col_select)):
        raise InputError("col_select is a list of distinct names", col_select=col_select)
    if n_max is not None and (isinstance(n_max, bool) or not isinstance(n_max, int) or n_max < 0):
        raise InputError("n_max is a whole number, not negative", n_max=n_max)


def narrow(x: Dataset, col_select: list[str] | None) -> Dataset:
    """Selected columns, in the file's order, and their companions; an unknown name is an error."""
    if col_select is None:
        return x
    unknown = [c for c in col_select if c not in x.names]
    if unknown:
        raise InputError(f"no column {', '.join(unknown)}", columns=unknown)
    meta = x.meta.only([c for c in x.names if c in col_select])
    keep = [c for c in x.df.columns if c.removeprefix(SPECIAL) in col_select]
    return Dataset(stamp(x.df.select(*[F.col(f"`{c}`") for c in keep]), meta), meta)


def read_dataset(spark: SparkSession, path: str, format: str | None = None, col_select: list[str] | None = None, n_max: int | None = None, **options: Any) -> Dataset:
    """Read a dataset of any format; what goes wrong inside is an error of the codec."""
    check_partial(col_select, n_max)
    codec = resolve(path, format)
    if codec.read is None:
        raise CodecError(f"{codec.name} is for writing only", format=codec.name)
    try:
        return narrow(codec.read(spark, path, col_select=col_select, n_max=n_max, **options), col_select)
    except Condition:
        raise
    except TypeError as e:
        if "keyword argument" in str(e):
            raise InputError(f"{codec.name}: {e}", format=codec.name) from e
        raise CodecError(f"{path}: {e}", path=path) from e
    except Exception as e:
        raise CodecError(f"{path}: {e}", path=path) from e


def write_dataset(x: Dataset | DataFrame, path: str, format: str | None = None, **options: Any) -> Dataset:
    """Write a dataset and give it back."""
    codec = resolve(path, format)
    if codec.write is None:
        raise CodecError(f"{codec.name} is for reading only", format=codec.name)
    return codec.write(x, path, **options)
