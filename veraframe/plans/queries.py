"""Queries of this engine over the benchmark's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import inspect as pane
from ..functions.numbers import from_ibm, shortest_text, to_ibm
from ..functions.temporal import deflated, iso_ok, iso_text, realized
from ..functions.text import PUNCTUATION, ascii_folds, fold_ascii, fold_punctuation, nfc, to_charset
from ..meta import SPECIAL, Dataset, get_meta, meta_from_frame, payload, set_meta
from ..operators.check import check_spec, check_study, study_matrix
from ..operators.conform import apply_spec, coercion_tally, order_columns, sort_keys
from ..operators.decode import decode_column
from ..operators.validate import scope, validate_spec
from ..rules import catalog, findings_frame
from ..sources import io
from ..sources.ndjson import write_ndjson
from ..sources.parquet import read_parquet, write_parquet
from ..sources.spec_files import read_spec, write_spec
from ..sources.xpt import read_xpt
from ..spec import Spec, make_spec, repair_spec, set_type
from ..streaming.ndjson_stream import stream_ndjson
from . import specs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _where(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='veraframe-')}"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def _finding(check: str, dataset: str | None, variable: str | None, message: str, source: str = "") -> str:
    """SQL of one finding; ``message`` is an expression, ``source`` what follows FROM."""
    r = catalog()[check]
    text = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    return f"SELECT '{check}' AS \"check\", '{r.dimension}' AS dimension, '{r.severity}' AS severity, {text(dataset)} AS dataset, {text(variable)} AS variable, {message} AS message{f' FROM {source}' if source else ''}"


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def _named(dataset: str, *columns: str) -> list[str]:
    return [_finding("variable_name", dataset, c, "'name is longer than 8 characters'") for c in columns]


_ORDERS = _union(
    _finding("missing_permissible", "ORDERS", "o_comment", "'permissible variable is not in the data'"),
    _finding("extra_variable", "ORDERS", "o_custkey", "'column is not in the specification'"),
    *_named("ORDERS", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    _finding("codelist_membership", "ORDERS", "o_orderstatus", "count(DISTINCT o_orderstatus) || ' distinct values are outside codelist CL.STATUS: ' || string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus)", "orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0"),
    _finding("length_overflow", "ORDERS", "o_orderpriority", "'longest value has ' || max(strlen(o_orderpriority)) || ' bytes, length is 8'", "orders HAVING max(strlen(o_orderpriority)) > 8"),
)
_LINES = _union(
    *[_finding("extra_variable", "LINES", c, "'column is not in the specification'") for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_linestatus")],
    *_named("LINES", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"),
    *[_finding("type_mismatch", "LINES", c, "'column is stored as double, integer asks for integer'") for c in ("l_quantity", "l_discount")],
    *[_finding("integer_fraction", "LINES", c, "count(*) || ' values have a fraction'", f"lineitem WHERE {c} <> trunc({c}) HAVING count(*) > 0") for c in ("l_quantity", "l_discount")],
    _finding("codelist_membership_extensible", "LINES", "l_returnflag", "count(DISTINCT l_returnflag) || ' distinct values are outside codelist CL.FLAG: ' || string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag)", "lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0"),
    _finding("display_format", "LINES", "l_shipdate", "'DATE9. is no datetime format'"),
    _finding("key_uniqueness", "LINES", None, "sum(n)::BIGINT || ' rows share their key (l_orderkey, l_linenumber) with another'", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0"),
)


@query(_ORDERS)
def check_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules does ORDERS break?"""
    return findings_frame(spark, check_spec(_t(spark, sf, "orders"), specs.orders(), "ORDERS"))


@query(_LINES)
def check_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return findings_frame(spark, check_spec(_t(spark, sf, "lineitem"), specs.lineitem(), "LINES"))


_BOTH = specs.make_spec(datasets=[*specs.orders().datasets, *specs.lineitem().datasets], variables=[*specs.orders().variables, *specs.lineitem().variables], codelists=[*specs.orders().codelists, *specs.lineitem().codelists])


@query(_union(_ORDERS, _LINES))
def check_study_findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings_frame(spark, check_study({"LINES": _t(spark, sf, "lineitem"), "ORDERS": _t(spark, sf, "orders")}, _BOTH))


@query(f"SELECT dataset, count(*) FILTER (\"check\" = 'extra_variable') AS extra_variable, count(*) FILTER (\"check\" = 'variable_name') AS variable_name, count(*) FILTER (\"check\" = 'key_uniqueness') AS key_uniqueness FROM ({_union(_ORDERS, _LINES)}) GROUP BY dataset")
def study_check_matrix(spark: SparkSession, sf: str) -> DataFrame:
    found = findings_frame(spark, check_study({"LINES": _t(spark, sf, "lineitem"), "ORDERS": _t(spark, sf, "orders")}, _BOTH))
    return study_matrix(found, ["extra_variable", "variable_name", "key_uniqueness"])


@query(f"SELECT severity, count(*) AS n FROM ({_LINES}) GROUP BY severity")
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return findings_frame(spark, check_spec(_t(spark, sf, "lineitem"), specs.lineitem(), "LINES")).groupBy("severity").agg(F.count("*").alias("n"))


@query(_union(
    _finding("missing_variable", "CUST", "GONE", "'mandatory variable is not in the data'"),
    _finding("missing_permissible", "CUST", "MAYBE", "'permissible variable is not in the data'"),
    *[_finding("extra_variable", "CUST", c, "'column is not in the specification'") for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "bad-name")],
    *_named("CUST", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"),
    _finding("variable_name", "CUST", "bad-name", "'name has characters other than letters, digits and underscores'"),
))
def check_missing_and_extra(spark: SparkSession, sf: str) -> DataFrame:
    spec = make_spec([{"dataset": "CUST"}], [{"dataset": "CUST", "variable": "c_custkey", "data_type": "float"}, {"dataset": "CUST", "variable": "GONE", "data_type": "string"}, {"dataset": "CUST", "variable": "MAYBE", "data_type": "string", "mandatory": "No"}])
    return findings_frame(spark, check_spec(_t(spark, sf, "customer").withColumn("bad-name", F.lit(1)), spec, "CUST"))


@query(_union(
    _finding("dataset_name", "DOCUMENTS_", None, "'name is longer than 8 characters'"),
    _finding("label_length", "DOCUMENTS_", "lang", "'label has 41 bytes, a transport file holds 40'"),
    _finding("label_match", "DOCUMENTS_", "lang", f"'label is ''{'x' * 41}'', the specification says ''Language'''"),
    _finding("type_mismatch", "DOCUMENTS_", "n_chars", "'column is stored as double, string asks for character'"),
    _finding("length_overflow", "DOCUMENTS_", "source", "'longest value has ' || max(strlen(source)) || ' bytes, length is 2'", "documents HAVING max(strlen(source)) > 2"),
    _finding("char_length_limit", "DOCUMENTS_", "text", "'longest value has ' || max(strlen(text)) || ' bytes, a transport file holds 200'", "documents HAVING max(strlen(text)) > 200"),
))
def check_lengths_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = [{"dataset": "DOCUMENTS_", "variable": n, "data_type": t, **m} for n, t, m in (("doc_id", "float", {}), ("text", "string", {}), ("lang", "string", {"label": "Language"}), ("source", "string", {"length": 2}), ("n_chars", "string", {}))]
    d = _t(spark, sf, "documents").withMetadata("lang", {"label": "x" * 41})
    return findings_frame(spark, check_spec(d, make_spec([{"dataset": "DOCUMENTS_"}], v), "DOCUMENTS_"))


@query(_finding("integer_overflow", "O", "big", "count(*) || ' values are beyond 32 bits'", "orders WHERE abs(trunc(o_totalprice * 100000)) > 2147483647 HAVING count(*) > 0"))
def check_integer_overflow(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "orders").select(F.expr("cast(o_totalprice * 100000 as bigint)").cast("double").alias("big"))
    found = check_spec(d, make_spec([{"dataset": "O"}], [{"dataset": "O", "variable": "big", "data_type": "integer"}]), "O")
    return findings_frame(spark, [f for f in found if f.check == "integer_overflow"])


@query(_finding("invalid_encoding", "D", "raw", "count(*) || ' values are not valid UTF-8'", "documents WHERE doc_id % 7 = 0 HAVING count(*) > 0"))
def check_invalid_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """A column of broken bytes has this one finding, whatever else is wrong with it."""
    d = _t(spark, sf, "documents").select(F.expr("if(doc_id % 7 = 0, cast(concat(cast(text as binary), x'ff') as string), text)").alias("raw"))
    return findings_frame(spark, check_spec(d, make_spec([{"dataset": "D"}], [{"dataset": "D", "variable": "raw", "data_type": "string", "length": 1}]), "D"))


_DTC = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:75') WHEN 4 THEN strftime(ts, '%Y/%m/%d') ELSE '2014-02-30' END"


@query(f"WITH e AS (SELECT {_DTC} AS dtc FROM events), bad AS (SELECT dtc FROM e WHERE NOT (regexp_full_match(dtc, '[0-9]{{4}}(-(0[1-9]|1[0-2]))?') OR (regexp_full_match(dtc, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9])?)?)?') AND try_cast(left(dtc, 10) AS DATE) IS NOT NULL))) " + _finding("iso8601_format", "EV", "dtc", "(SELECT count(*) FROM bad) || ' values are not ISO 8601 text of a datetime: ' || (SELECT string_agg(dtc, ', ' ORDER BY dtc) FROM (SELECT DISTINCT dtc FROM bad ORDER BY dtc LIMIT 5))"))
def check_iso8601(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda p: F.date_format("ts", p)
    m = F.pmod("event_id", F.lit(6))
    dtc = F.when(m == 0, f("yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, f("yyyy-MM")).when(m == 2, f("yyyy-MM-dd")).when(m == 3, f("yyyy-MM-dd'T'HH:'75'")).when(m == 4, f("yyyy/MM/dd")).otherwise("2014-02-30")
    d = _t(spark, sf, "events").select(dtc.alias("dtc"))
    return findings_frame(spark, check_spec(d, make_spec([{"dataset": "EV"}], [{"dataset": "EV", "variable": "dtc", "data_type": "datetime"}]), "EV"))


#: Forms of a time stamp: kind, pattern, whether it is ISO 8601; {H} and {M} are an hour and a minute beyond the clock.
_FORMS = (
    ("date", "{y}", True), ("date", "{y}-{m}", True), ("date", "{y}-{m}-{d}", True), ("date", "{y}---{d}", True), ("date", "--{m}-{d}", True),
    ("date", "{y}/{m}/{d}", False), ("date", "{y}-{H}-{d}", False), ("date", "{y}-02-30", False), ("date", "{y}-{m}T{h}", False),
    ("datetime", "{y}-{m}-{d}T{h}", True), ("datetime", "{y}-{m}-{d}T{h}:{n}:{s}.{d}", True), ("datetime", "{y}-{m}-{d}T{h}:{n}+05:30", True), ("datetime", "{y}---{d}T{h}:{n}", True),
    ("datetime", "{y}-{m}-{d}T-:{n}", True), ("datetime", "{y}-{m}-{d}T{H}:{n}", False), ("datetime", "{y}-{m}-{d}T{h}:{M}", False),
    ("time", "{h}:{n}:{s}", True), ("time", "T{h}:{n}", True), ("time", "-:{s}", True), ("time", "{H}:{n}", False), ("time", "{h}:{M}", False), ("time", "-", False),
)


def _form_sql(form: str) -> str:
    parts = {"y": "strftime(ts, '%Y')", "m": "strftime(ts, '%m')", "d": "strftime(ts, '%d')", "h": "strftime(ts, '%H')", "n": "strftime(ts, '%M')", "s": "strftime(ts, '%S')", "H": "(hour(ts) + 25)", "M": "(minute(ts) + 60)"}
    return "'" + reduce(lambda t, p: t.replace("{" + p + "}", f"' || {parts[p]} || '"), parts, form) + "'"


@query("SELECT event_id, kind, value, ok FROM (" + " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, {_form_sql(f)} AS value, {ok} AS ok FROM events WHERE event_id % {len(_FORMS)} = {i}" for i, (k, f, ok) in enumerate(_FORMS)) + ")")
def iso8601_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's time in one of the forms, judged by the grammar."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hour, minute = F.hour("ts"), F.minute("ts")
    parts = {"y": F.year("ts").cast("string"), "m": two(F.month("ts")), "d": two(F.dayofmonth("ts")), "h": two(hour), "n": two(minute), "s": two(F.second("ts")), "H": (hour + 25).cast("string"), "M": (minute + 60).cast("string")}

    def written(form: str) -> Column:
        return reduce(lambda t, p: F.replace(t, F.lit("{" + p + "}"), parts[p]), parts, F.lit(form))

    n = F.pmod("event_id", F.lit(len(_FORMS)))
    choose = lambda values: F.coalesce(*[F.when(n == i, v) for i, v in enumerate(values)])
    d = _t(spark, sf, "events").select("event_id", choose([F.lit(k) for k, *_ in _FORMS]).alias("kind"), choose([written(f) for _, f, _ in _FORMS]).alias("value"))
    c = F.col("value")
    return d.withColumn("ok", F.when(F.col("kind") == "date", iso_ok(c, "date")).when(F.col("kind") == "time", iso_ok(c, "time")).otherwise(iso_ok(c, "datetime")))


def _text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and flags as text, some of them broken."""
    d = _t(spark, sf, "lineitem")
    return d.select(
        F.col("l_orderkey").cast("string").alias("KEY"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).alias("NUM"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "N").otherwise("maybe").alias("FLAG"),
        F.col("l_quantity").alias("QTY"),
        F.col("l_extendedprice").alias("PRICE"),
        F.col("l_tax").alias("TAX"),
    )


def _text_spec(**types: str):
    kinds = {"KEY": "float", "NUM": "integer", "FLAG": "boolean", "QTY": "integer", "PRICE": "decimal", "TAX": "string"} | types
    return make_spec([{"dataset": "L"}], [{"dataset": "L", "variable": n, "data_type": t} for n, t in kinds.items()])


_LINES_AS_TEXT = "(SELECT l_orderkey::VARCHAR AS k, CASE WHEN l_linenumber = 7 THEN 'x' ELSE ' ' || l_linenumber END AS num, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'N' ELSE 'maybe' END AS flag, l_quantity AS qty, l_extendedprice AS price, l_tax AS tax FROM lineitem)"
_G = "CASE WHEN printf('%.15g', {0})::DOUBLE = {0} THEN printf('%.15g', {0}) ELSE printf('%.17g', {0}) END"


@query(f"SELECT try_cast(k AS DOUBLE) AS KEY, try_cast(trim(num) AS INTEGER) AS NUM, CASE WHEN upper(flag) IN ('YES', 'Y', 'TRUE', 'T', '1') THEN true WHEN upper(flag) IN ('NO', 'N', 'FALSE', 'F', '0') THEN false END AS FLAG, trunc(qty)::INTEGER AS QTY, {_G.format('price')} AS PRICE, {_G.format('tax')} AS TAX FROM {_LINES_AS_TEXT}")
def conform_types(spark: SparkSession, sf: str) -> DataFrame:
    """Text and numbers cast to the declared types; what isn't of the type is missing."""
    return apply_spec(_text_lines(spark, sf), _text_spec(), "L", conformance="off").df


@query(f"SELECT * FROM (SELECT 'NUM' AS variable, 'integer' AS data_type, count(*) FILTER (num = 'x') AS n, 'na_introduced' AS reason FROM {_LINES_AS_TEXT} UNION ALL SELECT 'FLAG', 'boolean', count(*) FILTER (flag = 'maybe'), 'na_introduced' FROM {_LINES_AS_TEXT} UNION ALL SELECT 'TAX', 'integer', count(*) FILTER (tax <> trunc(tax)), 'truncated' FROM {_LINES_AS_TEXT}) WHERE n > 0")
def conform_losses(spark: SparkSession, sf: str) -> DataFrame:
    """What casting would lose, counted in one pass before anything is cast."""
    t = coercion_tally(_text_lines(spark, sf), _text_spec(TAX="integer"), "L")
    return spark.createDataFrame([(r["variable"], r["data_type"], r["n"], r["reason"]) for r in t], "variable string, data_type string, n long, reason string")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with their place in the frame's order."""
    return df.rdd.zipWithIndex().map(lambda p: (*p[0], p[1])).toDF(", ".join(f"{n} {t}" for n, t in df.dtypes) + ", place long")


def _sorted(spark: SparkSession, sf: str, na: str) -> DataFrame:
    d = _t(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"), "o_orderkey")
    s = sort_keys(d, ["status", "price", "o_orderkey"], na)
    return _numbered(s.select("o_orderkey"))


def _sorted_sql(na: str) -> str:
    return f"SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'O') NULLS {na}, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END NULLS {na}, o_orderkey NULLS {na}) - 1 AS place FROM orders"


@query(_sorted_sql("FIRST"))
def conform_sort_na_first(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf, "first")


@query(_sorted_sql("LAST"))
def conform_sort_na_last(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf, "last")


@query("SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_orderstatus'), (2, 'o_orderdate'), (3, 'o_totalprice'), (4, 'o_orderpriority'), (5, 'o_custkey')) t(place, name)")
def conform_order(spark: SparkSession, sf: str) -> DataFrame:
    cols = order_columns(_t(spark, sf, "orders"), specs.orders(), "ORDERS").columns
    return spark.createDataFrame(list(enumerate(cols)), "place int, name string")


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def conform_drop_extra(spark: SparkSession, sf: str) -> DataFrame:
    return apply_spec(_t(spark, sf, "orders"), specs.orders(), "ORDERS", conformance="off", extra="drop").df


@query("SELECT o_orderkey, (DATE '1960-01-01' + (o_orderkey % 40000)::INTEGER) AS d, TIMESTAMP '1960-01-01' + to_microseconds((o_orderkey * 86399500000)::BIGINT) AS dt, (o_orderdate::DATE - DATE '1960-01-01')::DOUBLE AS days, epoch_us(o_orderdate) / 1000000.0 + 315619200 AS seconds FROM orders")
def temporal_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers to dates and instants, and back."""
    n = F.col("o_orderkey").cast("double")
    return _t(spark, sf, "orders").select("o_orderkey", realized(n % 40000, "date", text=False).alias("d"), realized(n * 86399.5, "datetime", text=False).alias("dt"), deflated(F.col("o_orderdate").cast("date"), "date").alias("days"), deflated(F.col("o_orderdate"), "datetime").alias("seconds"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END || lpad((event_id * 977 // 3600)::VARCHAR, greatest(2, length((event_id * 977 // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((event_id * 977 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id * 977 % 60)::VARCHAR, 2, '0') || '.25' AS clock, date_trunc('second', ts) - INTERVAL 330 MINUTE AS zoned FROM events")
def temporal_text(spark: SparkSession, sf: str) -> DataFrame:
    """ISO text of instants, of times beyond a day and of either sign; zones are taken off."""
    s = (F.col("event_id") * 977).cast("double") + 0.25
    t = realized(F.when(F.col("event_id") % 2 == 0, -s).otherwise(s), "time", text=False)
    zoned = realized(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), "datetime", text=True)
    return _t(spark, sf, "events").select("event_id", iso_text(F.col("ts"), "datetime").alias("iso"), iso_text(t, "time").alias("clock"), zoned.alias("zoned"))


_DECODED = "CASE n_regionkey WHEN 0 THEN 'Africa' WHEN 1 THEN 'America' WHEN 2 THEN 'Asia'{} END"


@query(f"SELECT n_nationkey, {_DECODED.format(' ELSE n_regionkey::VARCHAR')} AS region FROM nation")
def decode_keep(spark: SparkSession, sf: str) -> DataFrame:
    return decode_column(_t(spark, sf, "nation"), specs.nations(), "NATION", "n_regionkey", "region", no_match="keep").select("n_nationkey", "region")


@query(f"SELECT n_nationkey, {_DECODED.format('')} AS region FROM nation")
def decode_na(spark: SparkSession, sf: str) -> DataFrame:
    return decode_column(_t(spark, sf, "nation"), specs.nations(), "NATION", "n_regionkey", "region", no_match="na").select("n_nationkey", "region")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS code FROM nation")
def decode_to_code_soft(spark: SparkSession, sf: str) -> DataFrame:
    """Back to codes, though the decodes are padded and in capitals."""
    d = _t(spark, sf, "nation").select("n_nationkey", F.expr("concat(' ', upper(get(array('Africa', 'America', 'Asia', 'other', 'other'), n_regionkey)))").alias("region"))
    return decode_column(d, specs.nations(), "NATION", "region", "code", direction="to_code", no_match="na", ignore_case=True).select("n_nationkey", "code")


_FLAWS = (
    ("study_name_present", None, None), ("dataset_keys_resolve", "AA", None), ("dataset_comment_resolves", "AA", None), ("key_sequence_contiguous", "AA", None),
    ("key_sequence_matches_keys", "AA", None), ("dataset_label_present", "BB", None), ("key_sequence_matches_keys", "BB", None),
    ("variable_length_positive", "AA", "K1"), ("variable_label_present", "AA", "K2"), ("variable_sigdigits_nonneg", "AA", "K2"), ("variable_length_for_text", "AA", "K2"),
    ("variable_comment_resolves", "AA", "DERIVED"), ("variable_derived_has_method", "AA", "DERIVED"), ("variable_order_positive", "AA", "DERIVED"),
    ("variable_method_resolves", "AA", "LONGNAMED"), ("variable_name_length", "AA", "LONGNAMED"), ("variable_label_length", "AA", "LONGNAMED"),
    ("variable_order_unique", "AA", None), ("itemoid_unique", None, None), ("value_whereclause_present", "BB", "K1"), ("value_method_resolves", "BB", "K1"),
    ("value_comment_resolves", "BB", "K1"), ("value_codelist_resolves", "BB", "K1"), ("value_variable_resolves", "BB", "NOWHERE"),
    ("codelist_comment_resolves", None, None), ("codelist_terms_present", None, None), ("method_id_unique", None, None), ("method_document_resolves", None, None),
    ("method_description_present", None, None), ("comment_id_unique", None, None), ("comment_description_present", None, None), ("comment_document_resolves", None, None),
    ("document_id_unique", None, None), ("method_unused", None, None), ("comment_unused", None, None), ("document_unused", None, None),
    ("cross_dataset_label", None, "K1"), ("cross_dataset_type", None, "K1"),
)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else f"'{x}'" for x in (c, catalog()[c].dimension, catalog()[c].severity, d, v)) + ")" for c, d, v in _FLAWS) + ') t("check", dimension, severity, dataset, variable)')
def spec_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule about a specification itself, each of which this one breaks."""
    return findings_frame(spark, list(validate_spec(specs.flawed()).findings)).drop("message")


@query(_union(
    _finding("ct_value_in_codelist", "ORDERS", "o_orderstatus", "count(DISTINCT o_orderstatus) || ' distinct values are outside codelist CL.STATUS: ' || string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus)", "orders WHERE o_orderstatus NOT IN ('F', 'O', 'Z') HAVING count(*) > 0"),
    _finding("ct_term_unused", "ORDERS", "o_orderstatus", "'1 terms of codelist CL.STATUS are not in the data: Z'"),
    _finding("variable_present_in_data", "ORDERS", "o_comment", "'variable has no column in the data'"),
))
def spec_rules_with_data(spark: SparkSession, sf: str) -> DataFrame:
    s = specs.orders()
    s = make_spec(s.datasets, s.variables, [*s.codelists, {"codelist_id": "CL.STATUS", "term": "Z"}], study=s.study)
    found = validate_spec(s, _t(spark, sf, "orders"), "ORDERS").findings
    return findings_frame(spark, [f for f in found if catalog()[f.check].needs_data])


@query("SELECT * FROM (VALUES ('LINES', 'l_orderkey', 1), ('LINES', 'l_linenumber', 2)) t(dataset, variable, key_sequence)")
def spec_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(v["dataset"], v["variable"], v["key_sequence"]) for v in specs.lineitem().variables if v["key_sequence"]]
    return spark.createDataFrame(rows, "dataset string, variable string, key_sequence int")


@query("SELECT * FROM (VALUES ('method', 'M.TWICE', 2), ('comment', 'C.BLANK', 1), ('comment', 'C.TWICE', 2), ('document', 'D.TWICE', 2), ('codelist', 'CL.NOTHING', 1)) t(kind, id, n)")
def spec_scope(spark: SparkSession, sf: str) -> DataFrame:
    """What one dataset refers to, directly or not."""
    part = scope(specs.flawed(), "BB")
    rows = [(k, r[f"{k}_id"]) for k in ("method", "comment", "document", "codelist") for r in getattr(part, f"{k}s")]
    return spark.createDataFrame(rows, "kind string, id string").groupBy("kind", "id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'l_discount' AS variable, 'float' AS data_type UNION ALL SELECT 'l_linenumber', 'integer' UNION ALL SELECT 'l_quantity', CASE WHEN max(CASE WHEN l_quantity <> trunc(l_quantity) THEN 1 ELSE 0 END) = 1 THEN 'float' ELSE 'integer' END FROM lineitem UNION ALL SELECT 'l_returnflag', 'URI'")
def spec_repair(spark: SparkSession, sf: str) -> DataFrame:
    s = set_type(specs.lineitem(), "LINES", l_returnflag="url")
    s = repair_spec(s, check_spec(_t(spark, sf, "lineitem"), specs.lineitem(), "LINES"))
    return spark.createDataFrame([(v["variable"], v["data_type"]) for v in s.variables if v["variable"] in ("l_quantity", "l_discount", "l_linenumber", "l_returnflag")], "variable string, data_type string")


def _chain(c: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        c = f"replace({c}, chr({ord(k)}), '{v.replace(chr(39), chr(39) * 2)}')"
    return c


_TYPED = "(text || chr(8217) || chr(8230) || chr(8212) || chr(339) || chr(189))"


def _typed() -> F.Column:
    return F.concat("text", F.lit("’…—œ½"))


@query(f"SELECT doc_id, {_chain(_TYPED, PUNCTUATION)} AS folded FROM documents")
def fold_punctuation_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", fold_punctuation(_typed()).alias("folded"))


@query(f"SELECT doc_id, {_chain(_TYPED, PUNCTUATION | ascii_folds())} AS folded FROM documents")
def fold_ascii_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", fold_ascii(_typed()).alias("folded"))


@query("SELECT doc_id, nfc_normalize(replace(text, chr(233), 'e' || chr(769))) AS composed FROM documents")
def nfc_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", nfc(F.replace("text", F.lit("é"), F.lit("é"))).alias("composed"))


@query(f"SELECT l_orderkey, l_linenumber, {_G.format('l_extendedprice')} AS price, {_G.format('(l_extendedprice / 3)')} AS third FROM lineitem")
def decimal_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", shortest_text("l_extendedprice").alias("price"), shortest_text(F.col("l_extendedprice") / 3).alias("third"))


@query("SELECT p_partkey, p_retailprice, -p_retailprice / 1024 AS small FROM part")
def ibm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    def trip(frames):
        for pdf in frames:
            for c in ("p_retailprice", "small"):
                pdf[c] = from_ibm(to_ibm(pdf[c].to_numpy()))[0]
            yield pdf

    d = _t(spark, sf, "part").select("p_partkey", "p_retailprice", (-F.col("p_retailprice") / 1024).alias("small"))
    return d.mapInPandas(trip, d.schema)


@query("SELECT * FROM (SELECT 1 AS n, 'p_partkey' AS variable, 'Num' AS type, 8 AS len UNION ALL SELECT 2, 'p_name', 'Char', max(strlen(p_name))::INTEGER FROM part UNION ALL SELECT 3, 'p_brand', 'Char', max(strlen(p_brand))::INTEGER FROM part UNION ALL SELECT 4, 'p_type', 'Char', max(strlen(p_type))::INTEGER FROM part UNION ALL SELECT 5, 'p_size', 'Num', 8 UNION ALL SELECT 6, 'p_retailprice', 'Num', 8)")
def columns_pane(spark: SparkSession, sf: str) -> DataFrame:
    return pane.columns(_t(spark, sf, "part")).frame(spark).select("n", "variable", "type", "len")


@query("SELECT * FROM (VALUES (1, 'o_orderkey', 'float', NULL), (2, 'o_custkey', 'float', NULL), (3, 'o_orderstatus', 'string', NULL), (4, 'o_totalprice', 'float', NULL), (5, 'o_orderdate', 'datetime', 'integer'), (6, 'o_orderpriority', 'string', NULL)) t(n, name, data_type, target)")
def inferred_metadata(spark: SparkSession, sf: str) -> DataFrame:
    columns = payload(meta_from_frame(_t(spark, sf, "orders")))["columns"]
    return spark.createDataFrame([(i, c["name"], c["dataType"], c.get("targetDataType")) for i, c in enumerate(columns, 1)], "n int, name string, data_type string, target string")


_FLAT = "SELECT o_orderkey::DOUBLE AS ORDKEY, nullif(o_orderstatus, 'P') AS STATUS, o_totalprice AS PRICE, o_orderdate AS ORDDT, (o_orderkey % 3)::INTEGER AS SEQ FROM orders"


def _flat(spark: SparkSession, sf: str) -> Dataset:
    d = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("ORDKEY"), F.nullif("o_orderstatus", F.lit("P")).alias("STATUS"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderdate").alias("ORDDT"), (F.col("o_orderkey") % 3).cast("int").alias("SEQ"))
    return set_meta(d, meta_from_frame(d, "ORD"))


def _trip(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    path = f"{_where(spark)}.{name}"
    io.write_dataset(_flat(spark, sf), path, **options)
    return io.read_dataset(spark, path).df


@query(_FLAT)
def round_trip_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "ndjson")


@query(_FLAT)
def round_trip_ndjson_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "ndjson", layout="parts")


@query(_FLAT)
def round_trip_json(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "json")


@query(_FLAT)
def round_trip_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "parquet", compression="zstd")


@query(_FLAT.replace("(o_orderkey % 3)::INTEGER", "(o_orderkey % 3)::DOUBLE"))
def round_trip_xpt(spark: SparkSession, sf: str) -> DataFrame:
    d = _trip(spark, sf, "xpt")
    return d.drop(*[c for c in d.columns if c.startswith(SPECIAL)])


@query(_FLAT.replace("(o_orderkey % 3)::INTEGER", "(o_orderkey % 3)::DOUBLE"))
def round_trip_xpt8(spark: SparkSession, sf: str) -> DataFrame:
    d = _trip(spark, sf, "xpt", version=8)
    return d.drop(*[c for c in d.columns if c.startswith(SPECIAL)])


@query("SELECT c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25")
def partial_read(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in the file's order, and the first rows of a sorted file."""
    path = f"{_where(spark)}.ndjson"
    write_ndjson(_t(spark, sf, "customer").orderBy("c_custkey"), path)
    return io.read_dataset(spark, path, col_select=["c_mktsegment", "c_name"], n_max=25).df


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, CASE event_id % 8 WHEN 0 THEN '.A' WHEN 4 THEN '._' END AS tag FROM events")
def special_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of missing values through a folder of parts that holds them in their rows."""
    m = F.col("event_id") % 8
    d = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), F.when(m == 0, ".A").when(m == 4, "._").alias(f"{SPECIAL}value"))
    path = f"{_where(spark)}.ndjson"
    write_ndjson(set_meta(d, meta_from_frame(d, "EV")), path, layout="parts")
    back = io.read_dataset(spark, path).df
    return back.select(F.col("event_id").cast("long").alias("event_id"), "value", F.col(f"{SPECIAL}value").alias("tag"))


@query("SELECT 'ORD' AS member, count(*) AS records, 5 AS variables, 'xpt' AS format FROM orders UNION ALL SELECT 'ORD', count(*), 5, 'ndjson' FROM orders")
def members_inventory(spark: SparkSession, sf: str) -> DataFrame:
    folder = _where(spark)
    import os

    os.makedirs(folder.removeprefix("file://"))
    x = _flat(spark, sf)
    io.write_dataset(x, f"{folder}/a.xpt")
    io.write_dataset(x, f"{folder}/b.ndjson")
    open(f"{folder.removeprefix('file://')}/notes.txt", "w").close()
    return pane.members(spark, folder).select("member", "records", "variables", "format")


@query("SELECT * FROM (VALUES ('json', true, true, 'json'), ('ndjson', true, true, 'ndjson, jsonl'), ('parquet', true, true, 'parquet, pq'), ('xpt', true, true, 'xpt, xport')) t(format, read, write, extensions)")
def formats(spark: SparkSession, sf: str) -> DataFrame:
    return io.formats(spark)


@query("SELECT * FROM (VALUES ('UTF-8', 'utf_8'), ('windows-1252', 'cp1252'), ('ISO-8859-15', 'iso8859_15'), ('CP936', 'gbk')) t(r, python)")
def encodings(spark: SparkSession, sf: str) -> DataFrame:
    return pane.encodings(spark).where(F.col("r").isin("UTF-8", "windows-1252", "ISO-8859-15", "CP936")).select("r", "python")


@query("SELECT STATUS, count(*) AS n, sum(SEQ)::BIGINT AS total FROM (" + _FLAT + ") GROUP BY STATUS")
def stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """NDJSON files read as a stream, written as they come and summed up."""
    folder = _where(spark)
    x = write_ndjson(_flat(spark, sf), f"{folder}/in", layout="parts")
    rows = stream_ndjson(spark, f"{folder}/in/rows", x.meta)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("STATUS").agg(F.count("*").alias("n"), F.sum("SEQ").cast("long").alias("total"))


@query(_FLAT)
def checkpoint_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _where(spark)
    write_parquet(_flat(spark, sf), path, compression="zstd")
    return read_parquet(spark, path).df


# -- specification files ----------------------------------------------------------


def _world(spark: SparkSession, sf: str) -> Spec:
    """A specification with codelists from two small tables of fixed size: 25 nations and 5 regions."""
    nations = _t(spark, sf, "nation").orderBy("n_nationkey").collect()
    regions = _t(spark, sf, "region").orderBy("r_regionkey").collect()
    lists = [{"codelist_id": "CL.NATION", "term": str(r["n_nationkey"]), "decode": r["n_name"], "order": i} for i, r in enumerate(nations, 1)]
    lists += [{"codelist_id": "CL.REGION", "term": str(r["r_regionkey"]), "decode": r["r_name"], "order": i} for i, r in enumerate(regions, 1)]
    return make_spec(
        datasets=[{"dataset": "CUST", "label": "Customers", "keys": "CUSTKEY", "structure": "one row a customer"}],
        variables=[
            {"dataset": "CUST", "variable": "CUSTKEY", "data_type": "integer", "label": "Key", "order": 1, "mandatory": True, "key_sequence": 1},
            {"dataset": "CUST", "variable": "NATION", "data_type": "integer", "label": "Nation & code", "order": 2, "codelist_id": "CL.NATION", "mandatory": False},
            {"dataset": "CUST", "variable": "REGION", "data_type": "text", "label": "Region <1>", "order": 3, "codelist_id": "CL.REGION", "length": 12, "method_id": "MT.R", "mandatory": False},
        ],
        codelists=lists,
        methods=[{"method_id": "MT.R", "name": "Region", "type": "Computation", "description": "looked up"}],
        study={"study_name": "WORLD"},
        standard="TEST 1.0",
    )


def _told(spark: SparkSession, spec: Spec) -> DataFrame:
    rows = [("codelist", c["codelist_id"], c["term"], c["decode"], c["order"]) for c in spec.codelists]
    rows += [("variable", v["dataset"], v["variable"], f"{v['data_type']}|{v['label']}|{v['codelist_id'] or ''}|{v['length'] or ''}|{v['mandatory']}", v["order"]) for v in spec.variables]
    rows += [("dataset", d["dataset"], d["label"], d["keys"], 0) for d in spec.datasets]
    rows += [("method", m["method_id"], m["type"], m["description"], 0) for m in spec.methods]
    return spark.createDataFrame(rows, "slot string, name string, term string, told string, n int")


_WORLD_SQL = (
    "SELECT 'codelist' AS slot, 'CL.NATION' AS name, n_nationkey::VARCHAR AS term, n_name AS told, (row_number() OVER (ORDER BY n_nationkey))::INTEGER AS n FROM nation "
    "UNION ALL SELECT 'codelist', 'CL.REGION', r_regionkey::VARCHAR, r_name, (row_number() OVER (ORDER BY r_regionkey))::INTEGER FROM region "
    "UNION ALL SELECT * FROM (VALUES ('variable', 'CUST', 'CUSTKEY', 'integer|Key|||True', 1), ('variable', 'CUST', 'NATION', 'integer|Nation & code|CL.NATION||False', 2), ('variable', 'CUST', 'REGION', 'string|Region <1>|CL.REGION|12|False', 3), ('dataset', 'CUST', 'Customers', 'CUSTKEY', 0), ('method', 'MT.R', 'Computation', 'looked up', 0))"
)


def _spec_trip(spark: SparkSession, sf: str, ext: str) -> Spec:
    path = f"{_where(spark).removeprefix('file://')}.{ext}"
    write_spec(_world(spark, sf), path)
    return read_spec(path)


@query(_WORLD_SQL)
def spec_json_file(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, _spec_trip(spark, sf, "json"))


@query(_WORLD_SQL)
def spec_workbook(spark: SparkSession, sf: str) -> DataFrame:
    return _told(spark, _spec_trip(spark, sf, "xlsx"))


def _define(spec: Spec) -> str:
    """A specification as Define-XML 2.1."""
    from xml.sax.saxutils import escape, quoteattr as q

    text = lambda t: f"<Description><TranslatedText>{escape(t)}</TranslatedText></Description>"
    out = ['<ODM xmlns="http://www.cdisc.org/ns/odm/v1.3" xmlns:def="http://www.cdisc.org/ns/def/v2.1"><Study OID="S"><GlobalVariables><StudyName>WORLD</StudyName></GlobalVariables><MetaDataVersion OID="M" def:DefineVersion="2.1.0">']
    for d in spec.datasets:
        refs = "".join(f'<ItemRef ItemOID="IT.{v["variable"]}" OrderNumber="{v["order"]}" Mandatory="{"Yes" if v["mandatory"] else "No"}"' + (f' KeySequence="{v["key_sequence"]}"' if v["key_sequence"] else "") + (f" MethodOID={q(v['method_id'])}" if v["method_id"] else "") + "/>" for v in spec.variables)
        out.append(f"<ItemGroupDef OID=\"IG\" Name={q(d['dataset'])}>{text(d['label'])}{refs}</ItemGroupDef>")
    for v in spec.variables:
        length = f' Length="{v["length"]}"' if v["length"] else ""
        ref = f"<CodeListRef CodeListOID={q(v['codelist_id'])}/>" if v["codelist_id"] else ""
        out.append(f'<ItemDef OID="IT.{v["variable"]}" Name="{v["variable"]}" DataType="{v["data_type"].replace("string", "text")}"{length}>{text(v["label"])}{ref}</ItemDef>')
    for name in dict.fromkeys(c["codelist_id"] for c in spec.codelists):
        items = "".join(f'<CodeListItem CodedValue={q(c["term"])} OrderNumber="{c["order"]}"><Decode><TranslatedText>{escape(c["decode"])}</TranslatedText></Decode></CodeListItem>' for c in spec.codelists if c["codelist_id"] == name)
        out.append(f'<CodeList OID={q(name)} Name={q(name)} DataType="text">{items}</CodeList>')
    out += [f"<MethodDef OID={q(m['method_id'])} Name={q(m['name'])} Type={q(m['type'])}>{text(m['description'])}</MethodDef>" for m in spec.methods]
    return "".join([*out, "</MetaDataVersion></Study></ODM>"])


@query(_WORLD_SQL)
def spec_define_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_where(spark).removeprefix('file://')}.xml"
    with open(path, "w", encoding="utf-8") as f:
        f.write(_define(_world(spark, sf)))
    return _told(spark, read_spec(path))


@query("SELECT 'keys' AS what, 'CUSTKEY' AS told UNION ALL SELECT 'nations', count(*)::VARCHAR FROM nation UNION ALL SELECT 'regions', string_agg(r_name, ',' ORDER BY r_regionkey) FROM region UNION ALL SELECT * FROM (VALUES ('study', 'WORLD'), ('standard', 'TEST 1.0'), ('variables', 'CUSTKEY NATION REGION'))")
def spec_accessors(spark: SparkSession, sf: str) -> DataFrame:
    s = _spec_trip(spark, sf, "json")
    rows = [("keys", " ".join(s.keys("CUST"))), ("nations", str(len(s.codelist("CL.NATION")))), ("regions", ",".join(c["decode"] for c in s.codelist("CL.REGION")))]
    rows += [("study", s.study_field("study_name")), ("standard", s.standard), ("variables", " ".join(v["variable"] for v in s.ordered("CUST")))]
    return spark.createDataFrame(rows, "what string, told string")


# -- character sets, metadata, formats ------------------------------------------------

_SET = "US-ASCII"
_CURLY, _ACUTE, _OMEGA = chr(0x2019), chr(0xE9), chr(0x3A9)


def _lacking(policy: str) -> str:
    """SQL of a text after a policy: a curly quote, an accented letter and one that no table has."""
    quote = PUNCTUATION[_CURLY].replace("'", "''")
    signs = {"fold": (quote, "?", "?"), "translit": (quote, "e", "?"), "replace": ("?", "?", "?"), "ignore": ("", "", "")}[policy]
    return f"c_name || CASE c_custkey % 4 WHEN 0 THEN '{signs[0]}' WHEN 1 THEN 'caf{signs[1]}' WHEN 2 THEN '{signs[2]}x' ELSE '' END"


_POLICIES = ("fold", "translit", "replace", "ignore")


@query("SELECT c_custkey, " + ", ".join(f'{_lacking(p)} AS "{p}"' for p in _POLICIES) + " FROM customer")
def charset_policies(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of characters that a character set lacks."""
    m = F.pmod("c_custkey", F.lit(4))
    text = F.concat("c_name", F.when(m == 0, _CURLY).when(m == 1, f"caf{_ACUTE}").when(m == 2, f"{_OMEGA}x").otherwise(""))
    d = _t(spark, sf, "customer").select("c_custkey", text.alias("t"))
    return d.select("c_custkey", *[to_charset(F.col("t"), _SET, p).alias(p) for p in _POLICIES])


@query("SELECT STATUS, count(*) AS n, 'Status of the order' AS label, 3 AS place, 2 AS columns_left FROM (" + _FLAT + ") GROUP BY STATUS")
def metadata_follows(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata through a change of the frame: columns that go lose theirs, new ones get theirs inferred, others keep them."""
    x = _flat(spark, sf)
    m = get_meta(x)
    x = set_meta(x.df, replace(m, columns=m.columns | {"STATUS": m.columns["STATUS"] | {"label": "Status of the order"}}))
    y = x.transform(lambda d: d.select("SEQ", F.lit(1).alias("NEW"), "STATUS"))
    left = [n for n in y.meta.columns if n in m.columns]
    told = F.lit(y.meta.columns["STATUS"]["label"]).alias("label"), F.lit(list(y.meta.columns).index("STATUS") + 1).alias("place"), F.lit(len(left)).alias("columns_left")
    return y.df.groupBy("STATUS").agg(F.count("*").alias("n")).select("*", *told)


@query(_FLAT)
def round_trip_ndjson_gz(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "ndjson.gz")


@query(_FLAT)
def round_trip_json_gz(spark: SparkSession, sf: str) -> DataFrame:
    return _trip(spark, sf, "json.gz")


@query("SELECT c_custkey::DOUBLE AS KEY, c_name AS NAME FROM customer ORDER BY c_custkey LIMIT 25")
def partial_read_xpt(spark: SparkSession, sf: str) -> DataFrame:
    """Some columns of the first records of a transport file."""
    path = f"{_where(spark)}.xpt"
    d = _t(spark, sf, "customer").orderBy("c_custkey").select(F.col("c_custkey").cast("double").alias("KEY"), F.col("c_name").alias("NAME"), F.col("c_mktsegment").alias("SEGMENT"))
    io.write_dataset(set_meta(d, meta_from_frame(d, "CUST")), path)
    return io.read_dataset(spark, path, col_select=["NAME", "KEY"], n_max=25).df.select("KEY", "NAME")


@query("SELECT r_regionkey::DOUBLE AS KEY, r_name AS NAME FROM region")
def second_member(spark: SparkSession, sf: str) -> DataFrame:
    """One of two members of a transport file, by name."""
    frames = {"NAT": _t(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("KEY"), F.col("n_name").alias("NAME")), "REG": _t(spark, sf, "region").select(F.col("r_regionkey").cast("double").alias("KEY"), F.col("r_name").alias("NAME"))}
    base, raw = _where(spark).removeprefix("file://"), b""
    for name, d in frames.items():
        io.write_dataset(set_meta(d, meta_from_frame(d, name)), f"{base}{name}.xpt")
        with open(f"{base}{name}.xpt", "rb") as f:
            raw += f.read()[240 if raw else 0 :]  # the library's three header records stand once
    with open(f"{base}.xpt", "wb") as f:
        f.write(raw)
    return read_xpt(spark, f"{base}.xpt", member="reg").df.select("KEY", "NAME")


@query("SELECT 'PRICE: ' || count(*) FILTER (o_orderkey % 5 = 0) || ' numbers that are not finite' AS told, true AS nothing_written FROM orders")
def writer_refuses(spark: SparkSession, sf: str) -> DataFrame:
    """A number that JSON has no form for stops the writer before anything is written."""
    import os

    d = _t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("PRICE"))
    path = f"{_where(spark).removeprefix('file://')}.ndjson"
    try:
        io.write_dataset(d, path)
        told = "written"
    except Exception as e:
        told = str(e)
    return spark.createDataFrame([(told, not os.path.exists(path))], "told string, nothing_written boolean")


@query("SELECT count(*) AS n, max(length(c_name)) > 10 AS too_long, 0 AS dropped FROM customer")
def conform_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Conforming reports what it can't mend and keeps all rows."""
    spec = make_spec([{"dataset": "CUST", "keys": "c_custkey"}], [{"dataset": "CUST", "variable": "c_custkey", "data_type": "integer", "order": 1}, {"dataset": "CUST", "variable": "c_name", "data_type": "string", "order": 2, "length": 10}])
    d = _t(spark, sf, "customer").select("c_name", F.col("c_custkey").cast("int").alias("c_custkey"))
    x = apply_spec(d, spec, "CUST", conformance="warn")
    told = [f for f in x.findings if f.check == "length_overflow"]
    return x.df.agg(F.count("*").alias("n")).select("n", F.lit(bool(told)).alias("too_long"), F.lit(len(d.columns) - len(x.names)).alias("dropped"))
