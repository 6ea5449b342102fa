import datetime as dt
import gzip
import json
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from veraframe import inspect as pane
from veraframe.errors import CodecError, Condition, InputError
from veraframe.functions.numbers import from_ibm, to_ibm
from veraframe.meta import SPECIAL, Dataset, Meta, meta_from_frame, set_meta
from veraframe.sources import io, xpt
from veraframe.sources.ndjson import write_ndjson
from veraframe.sources.xpt import members_of, read_xpt, sas_stamp, write_xpt

TYPES = {
    "USUBJID": ("string", None), "AESEQ": ("integer", None), "DECVAL": ("decimal", None), "AVAL": ("float", None), "DVAL": ("double", None),
    "ABLFL": ("boolean", None), "ADT": ("date", "integer"), "ADTM": ("datetime", "integer"), "ATM": ("time", "integer"), "REFURI": ("URI", None),
}


def torture(spark, rows=None):
    """Every data type, missing values in each, and tags of special missing values."""
    data = [
        ("01-001", 1, "0.100", 1.5, None, 0.1 + 0.2, True, dt.date(2024, 3, 1), None, dt.datetime(2024, 3, 1, 12, 34, 56), dt.timedelta(hours=1), "https://x.test/a"),
        ("01-ÅÉ2", 2, "1234.5678901234567", None, ".A", -1e75, False, None, ".Z", None, None, None),
        (None, None, None, 3.25, None, None, None, dt.date(2024, 3, 15), None, dt.datetime(2024, 3, 15, 23, 59, 59), dt.timedelta(hours=30, seconds=1), "https://x.test/b"),
    ]
    schema = f"USUBJID string, AESEQ int, DECVAL string, AVAL double, {SPECIAL}AVAL string, DVAL double, ABLFL boolean, ADT date, {SPECIAL}ADT string, ADTM timestamp_ntz, ATM interval day to second, REFURI string"
    df = spark.createDataFrame(data if rows is None else rows, schema).coalesce(1)
    columns = {}
    for n, (t, target) in TYPES.items():
        columns[n] = {"itemOID": f"IT.TT.{n}", "name": n, **({"label": "Subject ÅÉ"} if n == "USUBJID" else {}), "dataType": t, **({"targetDataType": target} if target else {}), **({"displayFormat": {"date": "DATE9.", "datetime": "DATETIME20.", "time": "TIME8."}[t]} if target else {}), **({"informat": "YYMMDD10."} if n == "ADT" else {})}
    return set_meta(df, Meta({"name": "TT"}, columns).with_dataset(itemGroupOID="IG.TT", label="Torture"))


def rows_of(x):
    tags = [F.col(SPECIAL + n) if SPECIAL + n in x.df.columns else F.lit(None).alias(SPECIAL + n) for n in ("ADT", "AVAL")]
    return sorted((tuple(r) for r in x.df.select(*TYPES, *tags).collect()), key=str)


@pytest.mark.parametrize("first", ["x.json", "x.ndjson", "x.ndjson.gz", "x.parquet"])
@pytest.mark.parametrize("second", ["y.json", "y.ndjson", "y.parquet"])
def test_any_format_to_any_other(spark, tmp_path, first, second):
    x = torture(spark)
    io.write_dataset(x, f"{tmp_path}/{first}")
    y = io.read_dataset(spark, f"{tmp_path}/{first}")
    io.write_dataset(Dataset(y.df.coalesce(1), y.meta), f"{tmp_path}/{second}")
    z = io.read_dataset(spark, f"{tmp_path}/{second}")
    assert rows_of(z) == rows_of(x) and z.meta.columns == x.meta.columns


def test_parts_hold_tags_in_their_rows(spark, tmp_path):
    x, path = torture(spark), f"{tmp_path}/p.ndjson"
    write_ndjson(Dataset(x.df.repartition(3), x.meta), path, layout="parts")
    assert rows_of(io.read_dataset(spark, path)) == rows_of(x)
    wide = spark.range(4000).select(F.col("id").cast("int").alias("AESEQ"), F.lit(None).cast("double").alias("AVAL"), F.when(F.col("id") % 2 == 0, ".A").otherwise(".B").alias(f"{SPECIAL}AVAL"))
    write_ndjson(Dataset(wide, x.meta.only(["AESEQ", "AVAL"])), path, layout="parts")
    head = spark.read.text(f"{path}/head").first()[0]
    assert '".A"' not in head and len(head) < 2000
    back = io.read_dataset(spark, path).df
    assert back.count() == 4000 and back.where((F.col(f"{SPECIAL}AVAL") == ".A") != (F.col("AESEQ") % 2 == 0)).count() == 0


@pytest.mark.parametrize("name", ["e.json", "e.ndjson", "e.parquet"])
def test_empty_and_all_missing(spark, tmp_path, name):
    for rows in ([], [(None,) * 12]):
        x = torture(spark, rows)
        io.write_dataset(x, f"{tmp_path}/{name}")
        assert rows_of(io.read_dataset(spark, f"{tmp_path}/{name}")) == rows_of(x)


def slice_of(spark):
    x = torture(spark)
    keep = ["USUBJID", "AVAL", f"{SPECIAL}AVAL", "DVAL", "ADT", f"{SPECIAL}ADT", "ADTM", "ATM", "REFURI"]
    return Dataset(x.df.select(*keep).withColumn("DVAL", F.when(F.col("DVAL") > 0, F.col("DVAL"))), x.meta.only([k for k in keep if not k.startswith(SPECIAL)]))


@pytest.mark.parametrize("version", [5, 8])
def test_transport_files(spark, tmp_path, version):
    x, path = slice_of(spark), f"{tmp_path}/t.xpt"
    write_xpt(x, path, version=version, created=dt.datetime(2020, 1, 1))
    assert (tmp_path / "t.xpt").stat().st_size % 80 == 0
    y = read_xpt(spark, path)
    cols = [c for c in x.df.columns]
    assert sorted(map(str, y.df.select(*cols).collect())) == sorted(map(str, x.df.select(*cols).collect()))
    assert y.meta.columns["USUBJID"]["label"] == "Subject ÅÉ" and y.meta.columns["ADT"]["informat"] == "YYMMDD10." and y.meta.dataset["label"] == "Torture"
    some = io.read_dataset(spark, path, col_select=["ADT", "USUBJID"], n_max=2)
    assert some.names == ["USUBJID", "ADT"] and some.df.count() == 2
    (m,) = members_of(path)
    assert (m.rows, m.version, len(m.variables), m.created) == (3, version, 7, "01JAN20:00:00:00")


def test_long_names_and_labels_in_version_8(spark, tmp_path):
    d = spark.createDataFrame([("x", 1.0)], "a_rather_long_name string, b double")
    m = Meta({"name": "LONGDATASETNAME"}, {n: {"itemOID": n, "name": n, "label": n * 9, "dataType": t} for n, t in (("a_rather_long_name", "string"), ("b", "float"))})
    write_xpt(set_meta(d, m), f"{tmp_path}/l.xpt", version=8)
    back = read_xpt(spark, f"{tmp_path}/l.xpt")
    assert back.meta.dataset["name"] == "LONGDATASETNAME" and back.meta.columns["a_rather_long_name"]["label"] == "a_rather_long_name" * 9


def test_many_rows_over_many_tasks(spark, tmp_path):
    d = spark.range(0, 5000, 1, 7).select(F.format_string("%06d", "id").alias("ID"), F.col("id").cast("double").alias("N"))
    for name in ("m.xpt", "m.ndjson", "m.json"):
        io.write_dataset(d, f"{tmp_path}/{name}")
        back = io.read_dataset(spark, f"{tmp_path}/{name}").df.select("ID", "N")
        assert [tuple(r) for r in back.collect()] == [(f"{i:06d}", float(i)) for i in range(5000)]
    r = spark.read.format("xpt").option("rows", 700).load(f"{tmp_path}/m.xpt")
    assert r.rdd.getNumPartitions() == 8 and r.count() == 5000


def test_several_members(spark, tmp_path):
    d = spark.createDataFrame([("x" * 30,)] * 9, "A string")
    for n in ("ONE", "TWO"):
        write_xpt(set_meta(d, Meta({"name": n}, {"A": {"itemOID": "A", "name": "A", "dataType": "string"}})), f"{tmp_path}/{n}.xpt")
    both = (tmp_path / "ONE.xpt").read_bytes() + (tmp_path / "TWO.xpt").read_bytes()[240:]
    (tmp_path / "both.xpt").write_bytes(both)
    path = f"{tmp_path}/both.xpt"
    assert [(m.name, m.rows) for m in members_of(path)] == [("ONE", 9), ("TWO", 9)]
    with pytest.raises(CodecError):
        read_xpt(spark, path)
    assert read_xpt(spark, path, member="two").meta.dataset["name"] == "TWO" and read_xpt(spark, path, member=1).df.count() == 9
    assert pane.xpt_members(spark, path).count() == 2
    assert [r.file for r in pane.members(spark, str(tmp_path)).collect()] == ["ONE.xpt", "TWO.xpt", "both.xpt", "both.xpt"]


def test_published_bytes():
    want = {1.0: "4110000000000000", 2.0: "4120000000000000", 0.5: "4080000000000000", -1.0: "c110000000000000", 0.0: "0000000000000000"}
    for v, h in want.items():
        assert to_ibm(np.array([v])).tobytes().hex() == h
    rng = np.random.default_rng(0)
    v = rng.standard_normal(1000) * 10.0 ** rng.integers(-60, 60, 1000)
    assert (from_ibm(to_ibm(v))[0] == v).all()
    tags = [None, ".", "._", ".A", ".Z"]
    got, back = from_ibm(to_ibm(np.full(5, np.nan), tags))
    assert np.isnan(got).all() and back.tolist() == [None, None, "._", ".A", ".Z"]
    assert sas_stamp(dt.datetime(2020, 1, 1)) == "01JAN20:00:00:00"


def test_what_transport_files_refuse(spark, tmp_path):
    bad = {
        "lowercase name": ("a double", [(1.0,)]), "case twins": ("A double, `a` double", [(1.0, 1.0)]), "infinite": ("A double", [(float("inf"),)]),
        "too large": ("A double", [(1e76,)]), "too small": ("A double", [(1e-80,)]), "nested": ("A array<int>", [([1],)]), "too wide": ("A string", [("x" * 201,)]),
    }
    for schema, rows in bad.values():
        with pytest.raises((Condition, Exception)) as e:
            write_xpt(spark.createDataFrame(rows, schema), f"{tmp_path}/b.xpt")
        assert isinstance(e.value, Condition) or "AMBIGUOUS" in str(e.value), e.value
    assert not list(tmp_path.iterdir())
    with pytest.raises(CodecError):
        write_xpt(spark.createDataFrame([("é",)], "A string"), f"{tmp_path}/b.xpt", encoding="ascii")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        write_xpt(spark.createDataFrame([("é",)], "A string"), f"{tmp_path}/b.xpt", encoding="wlatin1")
    assert xpt.detect_encoding(spark, f"{tmp_path}/b.xpt") == "WINDOWS-1252" and read_xpt(spark, f"{tmp_path}/b.xpt").df.first().A == "é"


def test_adversarial_texts(spark, tmp_path):
    texts = ['a","b', "x],[y", "back\\slash", "t\tab", 'q"uote', '","', "café ÅÉ", "", None, "new\nline"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "I int, TXT string").coalesce(1)
    for name in ("a.json", "a.ndjson"):
        io.write_dataset(d, f"{tmp_path}/{name}")
        assert [r.TXT for r in io.read_dataset(spark, f"{tmp_path}/{name}").df.orderBy("I").collect()] == texts
        raw = (tmp_path / name).read_text()
        rows = json.loads(raw)["rows"] if name == "a.json" else [json.loads(x) for x in raw.splitlines()[1:]]
        assert [r[1] for r in rows] == texts


def test_damaged_files_are_typed_errors(spark, tmp_path):
    rng, x = random.Random(9), slice_of(spark)
    y = Dataset(x.df.coalesce(1), x.meta)
    write_xpt(y, f"{tmp_path}/f.xpt")
    raw = (tmp_path / "f.xpt").read_bytes()
    for k in [*range(0, len(raw), 240), *(rng.randrange(len(raw)) for _ in range(6))]:
        flipped = bytearray(raw)
        flipped[k] ^= 1 << rng.randrange(8)
        for data in (raw[:k], bytes(flipped)):
            (tmp_path / "g.xpt").write_bytes(data)
            try:
                members_of(f"{tmp_path}/g.xpt")
            except Condition:
                pass
    for name, text in (("n.ndjson", "no json\n[1]\n"), ("n.json", "{}"), ("o.json", "[1")):
        (tmp_path / name).write_text(text)
        with pytest.raises(CodecError):
            io.read_dataset(spark, f"{tmp_path}/{name}").df.collect()
    io.write_dataset(spark.createDataFrame([(1, "a")], "A int, B string"), f"{tmp_path}/r.ndjson")
    with open(f"{tmp_path}/r.ndjson", "a") as f:
        f.write("\n[1]\n")
    with pytest.raises(Exception, match="cells of 2"):
        io.read_dataset(spark, f"{tmp_path}/r.ndjson").df.collect()


def test_registry_and_arguments(spark, tmp_path):
    assert io.resolve("a/b.ndjson.gz").name == "ndjson" and io.resolve("x.dat", "xpt").name == "xpt"
    for path in ("x.xpt.gz", "x.doc", "x"):
        with pytest.raises(InputError):
            io.resolve(path)
    with pytest.raises(CodecError):
        io.resolve("x.rds")
    for bad in ({"col_select": "A"}, {"col_select": []}, {"n_max": -1}, {"n_max": 1.5}):
        with pytest.raises(InputError):
            io.read_dataset(spark, "x.xpt", **bad)
    io.write_dataset(spark.createDataFrame([(1,)], "A int"), f"{tmp_path}/a.ndjson.gz")
    assert gzip.open(f"{tmp_path}/a.ndjson.gz").readline().startswith(b"{")
    with pytest.raises(InputError):
        io.read_dataset(spark, f"{tmp_path}/a.ndjson.gz", col_select=["B"])
    with pytest.raises(CodecError):
        io.read_dataset(spark, f"{tmp_path}/missing.ndjson")
    with pytest.raises(CodecError):
        io.write_dataset(spark.createDataFrame([(float("nan"),)], "A double"), f"{tmp_path}/n.json")


def test_wide_frames(spark, tmp_path):
    n = 250
    d = spark.range(20).coalesce(1).select(*[(F.format_string("v%d", "id") if i % 3 == 0 else F.col("id").cast("int" if i % 3 == 1 else "double")).alias(f"VAR{i:04d}") for i in range(n)])
    io.write_dataset(d, f"{tmp_path}/w.xpt")
    assert len(io.read_dataset(spark, f"{tmp_path}/w.xpt").names) == n
    assert len(pane.columns(d).rows) == n and "VAR0000" in str(pane.columns(d))


def small(spark, path, lines, **columns):
    head = {"datasetJSONVersion": "1.1.0", "name": "D", "columns": [{"itemOID": n, "name": n, "label": n, "dataType": t} for n, t in columns.items()]}
    text = "\n".join([json.dumps(head), *lines]) + "\n"
    (gzip.open if path.endswith(".gz") else open)(path, "wt", encoding="utf-8").write(text)
    return text


@pytest.mark.parametrize("line", ['{"damaged": ["row"', '{"datasetJSONVersion": "1.1.0"}', '["a"]', '["a", "x"]', '["a", 1, 2]', "plain"])
def test_damaged_lines_are_errors(spark, tmp_path, line):
    small(spark, f"{tmp_path}/d.ndjson", ['["a", 1]', line, '["b", 2]'], A="string", N="integer")
    with pytest.raises(Exception, match="d.ndjson"):
        io.read_dataset(spark, f"{tmp_path}/d.ndjson").df.collect()


def test_text_in_a_number_is_an_error_in_json_too(spark, tmp_path):
    doc = {"datasetJSONVersion": "1.1.0", "name": "D", "columns": [{"itemOID": n, "name": n, "label": n, "dataType": t} for n, t in (("A", "float"), ("B", "boolean"))]}
    for row, ok in (([1.5, True], True), ([None, None], True), (["abc", None], False), ([None, "perhaps"], False)):
        (tmp_path / "d.json").write_text(json.dumps(doc | {"rows": [row]}))
        if ok:
            assert [tuple(r) for r in io.read_dataset(spark, f"{tmp_path}/d.json").df.collect()] == [tuple(row)]
        else:
            with pytest.raises(Exception, match="can't hold"):
                io.read_dataset(spark, f"{tmp_path}/d.json").df.collect()


def test_gzip_and_character_sets_by_content(spark, tmp_path):
    text = small(spark, f"{tmp_path}/a.ndjson", ['["é€", 1]', '["b", 2]'], A="string", N="integer")
    (tmp_path / "zipped.ndjson").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "latin.ndjson").write_bytes(text.encode("cp1252"))
    for name, options in (("a", {}), ("zipped", {}), ("latin", {"encoding": "windows-1252"})):
        x = io.read_dataset(spark, f"{tmp_path}/{name}.ndjson", **options)
        assert [tuple(r) for r in x.df.collect()] == [("é€", 1), ("b", 2)]
        assert x.meta.dataset.get("encoding") == ("WINDOWS-1252" if options else None)
        assert io.read_dataset(spark, f"{tmp_path}/{name}.ndjson", n_max=1, **options).df.collect()[0][0] == "é€"


def test_first_rows_of_several_parts(spark, tmp_path):
    d = spark.range(0, 4000, 1, 7).select(F.col("id").cast("int").alias("N"), F.col("id").cast("string").alias("T"))
    write_ndjson(d, f"{tmp_path}/p.ndjson", layout="parts")
    write_ndjson(d, f"{tmp_path}/f.ndjson")
    io.write_dataset(d, f"{tmp_path}/q.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for f in ("p.ndjson", "f.ndjson", "q.parquet"):
            got = [r.N for r in io.read_dataset(spark, f"{tmp_path}/{f}", n_max=1500).df.collect()]
            assert sorted(got) == list(range(1500)), f
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_metadata_in_a_footer(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    head = {"datasetJSONVersion": "1.1.0", "name": "ADSL", "label": "Subjects", "columns": [{"itemOID": "IT.A", "name": "A", "label": "First", "dataType": "string", "length": 5, "keySequence": 1}]}
    t = pa.table({"A": ["x", "y"], "MORE": [1, 2]}).replace_schema_metadata({"metadata_json": json.dumps(head)})
    pq.write_table(t, f"{tmp_path}/x.parquet")
    x = io.read_dataset(spark, f"{tmp_path}/x.parquet")
    assert x.meta.dataset["label"] == "Subjects" and x.meta.columns["A"]["label"] == "First" and x.meta.keys == ["A"]
    assert list(x.meta.columns) == ["A", "MORE"] and x.df.count() == 2


def test_parquet_text_that_a_character_set_lacks(spark, tmp_path):
    d = spark.createDataFrame([("é",), ("Ω",)], "T string")
    with pytest.raises(CodecError, match="lacks"):
        io.write_dataset(d, f"{tmp_path}/x.parquet", encoding="windows-1252")
    io.write_dataset(d, f"{tmp_path}/x.parquet", encoding="windows-1252", on_invalid="replace")
    x = io.read_dataset(spark, f"{tmp_path}/x.parquet")
    assert sorted(r[0] for r in x.df.collect()) == ["?", "é"] and x.meta.dataset["encoding"] == "WINDOWS-1252"


def test_plain_text_meets_no_python(spark, tmp_path):
    """Only columns that hold a text which composing might change are sent to Python."""
    from veraframe.sources.json_rows import row_text

    d = spark.createDataFrame([("plain", "café"), ("x", "y")], "A string, B string")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan(row_text(Dataset(d, meta_from_frame(d))))
    odd = spark.createDataFrame([("plain", "café")], "A string, B string")
    assert "ArrowEvalPython" in plan(row_text(Dataset(odd, meta_from_frame(odd))))
    io.write_dataset(odd, f"{tmp_path}/o.parquet")
    assert io.read_dataset(spark, f"{tmp_path}/o.parquet").df.first()[1] == "café"


def test_json_rows_are_found_in_pieces(spark, tmp_path, monkeypatch):
    """Cuts anywhere: in texts, behind backslashes, between brackets; the rows member needn't be the last."""
    from veraframe.sources import pieces

    columns = [{"itemOID": f"IT.{n}", "name": n, "label": "", "dataType": t} for n, t in (("A", "string"), ("N", "integer"))]
    rows = [['x]"[\\', 1], ["\\\\", None], [None, 2], ['],["rows": [', 3], ["é\n{", 4]]
    doc = {"datasetJSONVersion": "1.1.0", "other": [[1, 2], "rows"], "name": "T", "columns": columns, "rows": rows, "more": {"rows": [[0]]}}
    texts = [json.dumps(doc, ensure_ascii=False), json.dumps(doc, indent=1)]
    for size in (41, 64):
        monkeypatch.setattr(pieces, "PIECE", size)
        for i, text in enumerate(texts):
            path = tmp_path / f"{size}-{i}.json"
            path.write_text(text, encoding="utf-8")
            x = io.read_dataset(spark, str(path))
            assert x.df.rdd.getNumPartitions() == -(-path.stat().st_size // size) and x.meta.dataset["name"] == "T"
            assert [list(r) for r in x.df.collect()] == rows
            assert [list(r) for r in io.read_dataset(spark, str(path), n_max=3).df.collect()] == rows[:3]
    for i, wrong in enumerate((texts[0].replace(', [null, 2]', ' [null, 2]'), texts[0].replace(', [null, 2]', ', x [null, 2]'), texts[0].replace("[null, 2]", "[null 2]"))):
        (tmp_path / f"w{i}.json").write_text(wrong, encoding="utf-8")
        with pytest.raises(Exception, match="rows can't be read|is no Dataset-JSON"):
            io.read_dataset(spark, f"{tmp_path}/w{i}.json").df.collect()


def test_gzip_members_are_read_apart(spark, tmp_path, monkeypatch):
    """Members that tell their sizes are read by a task each, wherever they are cut; others as one stream; all tools unpack both."""
    from veraframe.sources import pieces
    from veraframe.sources.files import gzip_member, gzip_members

    columns = [{"itemOID": f"IT.{n}", "name": n, "label": "", "dataType": t} for n, t in (("A", "string"), ("N", "integer"))]
    rows = [['x]"[\\', 1], ["\\\\", None], [None, 2], ['],["rows": [', 3], ["é\n{", 4]]
    head = {"datasetJSONVersion": "1.1.0", "name": "T", "columns": columns}
    texts = {"json": json.dumps(head | {"rows": rows}, ensure_ascii=False), "ndjson": "\n".join(json.dumps(x, ensure_ascii=False) for x in (head, *rows))}
    monkeypatch.setattr(pieces, "PIECE", 1)
    for name, text in texts.items():
        raw = text.encode()
        for size in (23, 60):
            path = tmp_path / f"{size}.{name}.gz"
            path.write_bytes(b"".join(gzip_member(raw[i : i + size]) for i in range(0, len(raw), size)))
            assert gzip.open(path).read() == raw and [r.value for r in spark.read.text(str(path)).collect()] == text.split("\n")
            x = io.read_dataset(spark, str(path))
            assert x.df.rdd.getNumPartitions() == -(-len(raw) // size) and [list(r) for r in x.df.collect()] == rows
            assert [list(r) for r in io.read_dataset(spark, str(path), n_max=3).df.collect()] == rows[:3]
        (tmp_path / f"one.{name}.gz").write_bytes(gzip.compress(raw))
        assert gzip_members(f"{tmp_path}/one.{name}.gz") is None
        assert [list(r) for r in io.read_dataset(spark, f"{tmp_path}/one.{name}.gz").df.collect()] == rows
        # The writer's own files: tasks' parts are members.
        io.write_dataset(x, f"{tmp_path}/own.{name}.gz")
        assert len(gzip_members(f"{tmp_path}/own.{name}.gz")) > 2
        assert [list(r) for r in io.read_dataset(spark, f"{tmp_path}/own.{name}.gz").df.collect()] == rows
