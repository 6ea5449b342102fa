"""The ten data types, their aliases, and what holds them in Spark and in files."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import TypeVocabularyError

#: The type vocabulary and the two target types.
DATA_TYPES = ("string", "integer", "decimal", "float", "double", "boolean", "date", "datetime", "time", "URI")
TARGET_TYPES = ("integer", "decimal")
TEMPORAL = ("date", "datetime", "time")
TEXT = ("string", "URI", "decimal")

#: Other spellings of the types.
ALIASES = {
    "text": "string", "char": "string", "character": "string", "string": "string", "$": "string", "int": "integer",
    "integer": "integer", "decimal": "decimal", "float": "float", "num": "float", "numeric": "float", "real": "float",
    "double": "double", "bool": "boolean", "logical": "boolean", "boolean": "boolean", "date": "date",
    "datetime": "datetime", "time": "time", "partialdate": "date", "partialtime": "time", "partialdatetime": "datetime",
    "incompletedate": "date", "incompletetime": "time", "incompletedatetime": "datetime", "durationdatetime": "string",
    "intervaldatetime": "string", "uri": "URI", "url": "URI",
}

#: The type names of a workbook or of Define-XML.
DEFINE_TYPES = {"string": "text", "boolean": "text", "URI": "text", "decimal": "float", "double": "float", "integer": "integer", "float": "float", "date": "date", "datetime": "datetime", "time": "time"}

#: Names of the formats of each temporal family.
DATE_FORMATS = frozenset(
    """DATE DAY DDMMYY DDMMYYB DDMMYYC DDMMYYD DDMMYYN DDMMYYP DDMMYYS MMDDYY MMDDYYB MMDDYYC MMDDYYD MMDDYYN MMDDYYP
    MMDDYYS YYMMDD YYMMDDB YYMMDDC YYMMDDD YYMMDDN YYMMDDP YYMMDDS YYMM YYMMC YYMMD YYMMN YYMMP YYMMS YYQ YYQC YYQD YYQN
    YYQP YYQS YYQR YYQRC YYQRD YYQRN YYQRP YYQRS MMYY MMYYC MMYYD MMYYN MMYYP MMYYS MONYY MONNAME MONTH QTR QTRR YEAR
    WEEKDAY WEEKDATE WEEKDATX WORDDATE WORDDATX JULIAN JULDAY NENGO MINGUO HDATE HEBDATE EURDFDD EURDFDE EURDFDN EURDFDT
    EURDFDWN EURDFMN EURDFMY EURDFWDX EURDFWKX NLDATE NLDATEL NLDATEM NLDATEMD NLDATEMN NLDATES NLDATEW NLDATEWN NLDATEYM
    NLDATEYMW PDJULG PDJULI B8601DA E8601DA DTDATE DTYEAR DTMONYY DTWKDATX DTYYQC""".split()
)
DATETIME_FORMATS = frozenset(
    """DATETIME DATEAMPM MDYAMPM B8601DN B8601DT B8601DZ B8601LZ E8601DN E8601DT E8601DZ E8601LZ NLDATM NLDATMAP NLDATMDT
    NLDATMMD NLDATMMN NLDATMS NLDATMTM NLDATMW NLDATMWN NLDATMWZ NLDATMYM NLDATMYW NLDATMZ DTTIME""".split()
)
TIME_FORMATS = frozenset("TIME TIMEAMPM HHMM HOUR MMSS TOD B8601TM B8601TZ E8601TM E8601TZ NLTIME NLTIMMAP NLTIMAP".split())
FAMILIES = {"date": DATE_FORMATS, "datetime": DATETIME_FORMATS, "time": TIME_FORMATS}
#: What a temporal variable without a format is written with.
DEFAULT_FORMATS = {"date": "DATE9.", "datetime": "DATETIME20.", "time": "TIME8."}

INTERVAL = T.DayTimeIntervalType(T.DayTimeIntervalType.DAY, T.DayTimeIntervalType.SECOND)
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "URI": T.StringType(), "decimal": T.StringType(), "integer": T.IntegerType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "time": INTERVAL,
}


def canonical_type(name: str | None) -> str:
    """The vocabulary's name for a type, whatever its case and declared length: ``Text(20)`` is string."""
    key = re.sub(r"\s*\(.*\)\s*$", "", (name or "").strip()).lower()
    if key not in ALIASES:
        raise TypeVocabularyError(f"{name!r} is no data type; known are {', '.join(DATA_TYPES)}", data_type=name)
    return ALIASES[key]


def parse_format(text: str | None) -> tuple[str, int | None, int | None] | None:
    """(name, width, decimals) of a SAS format such as ``F8.2`` or ``$CHAR20.``; None if there is none."""
    m = re.fullmatch(r"\s*(\$?[A-Za-z_]?(?:[A-Za-z0-9_]*[A-Za-z_])?)(\d*)(?:\.(\d*))?\s*", text or "")
    if not m or not (m[1] or m[2]):
        return None
    return m[1].upper(), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


def family(text: str | None) -> str | None:
    """The temporal family of a format's name, if it has one. Names may end in digits that are part of them."""
    name = re.sub(r"\.\d*$", "", (text or "").strip()).upper()
    for kind, names in FAMILIES.items():
        if name in names or re.sub(r"\d+$", "", name) in names:
            return kind
    return None


def storage(kind: T.DataType) -> str:
    """How a Spark type is stored as the checks see it: character, integer, double, logical or other."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "character"
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "integer"
    if isinstance(kind, (T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "double"
    return "other"


#: Storage that each data type asks for.
WANTED = {"string": "character", "URI": "character", "decimal": "character", "integer": "integer", "float": "double", "double": "double", "boolean": "logical", "date": "double", "datetime": "double", "time": "double"}


def inferred_type(kind: T.DataType) -> str:
    """The data type that a column of a Spark type has if nothing declares one."""
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.DayTimeIntervalType):
        return "time"
    known = {"character": "string", "logical": "boolean", "integer": "integer", "double": "float"}
    if storage(kind) not in known:
        raise TypeVocabularyError(f"columns of type {kind.simpleString()} have no place in a dataset", data_type=kind.simpleString())
    return known[storage(kind)]


def numeric_text(name: str) -> bool:
    """Whether values of a data type are numbers."""
    return name in ("integer", "float", "double")
