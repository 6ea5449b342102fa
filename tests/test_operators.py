import datetime as dt

import pytest
from pyspark.sql import functions as F

from veraframe.errors import CodelistError, CoercionWarning, ConformanceError, ConformanceWarning, InputError, OrderWarning, TypeVocabularyError
from veraframe.functions.temporal import iso_ok, iso_text, realized
from veraframe.functions.text import PUNCTUATION, ascii_folds, charset, cut_bytes, to_charset
from veraframe.meta import Dataset, get_meta, is_iso_text, meta_from_frame, parse, set_meta, sync_meta, to_json
from veraframe.operators.check import Checks, check_spec, check_study, is_checks, mandatory, outside
from veraframe.operators.conform import apply_spec, conformance
from veraframe.operators.decode import decode_column
from veraframe.rules import findings_frame
from veraframe.spec import make_spec

def date_texts(rng, part=None):
    """Texts of the ISO 8601 grammar for a date: any component may be absent, from the right or as a hyphen, but not all."""
    y, m, d = f"{rng.randint(1000, 2999)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
    return rng.choice([y, f"{y}-{m}", f"{y}-{m}-{d}", f"{y}---{d}", f"--{m}-{d}", f"{y}-{m}-{d}"]) if part is None else f"{y}-{m}-{d}"


def time_texts(rng):
    h, m, s = (f"{rng.randint(0, 23):02d}", *(f"{rng.randint(0, 59):02d}" for _ in range(2)))
    return rng.choice([h, f"{h}:{m}", f"{h}:{m}:{s}", f"{h}:{m}:{s}.{rng.randint(0, 999)}", f"-:{m}"])


def broken(rng, text):
    """A text of the grammar made wrong: a component beyond its range, another sign, a digit less, something after it."""
    full = date_texts(rng, "full") if text == "date" else time_texts(rng)
    y, m, d = date_texts(rng, "full").split("-")
    wrong = [f"{y}-{rng.randint(13, 99)}-{d}", f"{y}-{m}-{rng.randint(32, 99)}", f"{y}-02-3{rng.randint(0, 1)}", f"{y}/{m}/{d}", f"{y}-{int(m)}-", f"{d}JAN{y}", f"{y}-{m}-{d}\nx", full + "x"]
    return rng.choice(wrong) if text == "date" else rng.choice([f"{rng.randint(24, 99)}:00", f"12:{rng.randint(60, 99)}", f"12:30:{rng.randint(61, 99)}", "-", "x", full + "x"])


def test_iso_grammar(spark):
    rng = __import__("random").Random(1)
    good = {
        "date": [date_texts(rng) for _ in range(60)] + [None, "", f" {date_texts(rng)} "],
        "datetime": [date_texts(rng) for _ in range(20)] + [f"{date_texts(rng, 'full')}T{time_texts(rng)}" for _ in range(60)] + [f"{date_texts(rng, 'full')}T12:30{z}" for z in ("Z", "+05:30", "-11:00")],
        "time": [rng.choice(["", "T"]) + time_texts(rng) for _ in range(40)],
    }
    bad = {
        "date": [broken(rng, "date") for _ in range(60)],
        "datetime": [broken(rng, "date") for _ in range(30)] + [f"{date_texts(rng, 'full')}T{broken(rng, 'time')}" for _ in range(40)] + [f"{y}-{m:02d}T13" for y, m in ((1999, 1), (2030, 12))],
        "time": [broken(rng, "time") for _ in range(40)],
    }
    for kind in good:
        for want, texts in ((True, good[kind]), (False, bad[kind])):
            got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", iso_ok(F.col("t"), kind).alias("ok")).collect()
            assert [r.t for r in got if r.ok != want] == []


def test_epochs(spark):
    d = spark.createDataFrame([(0.0,), (366.0,), (21915.0,), (-1.0,)], "n double")
    assert [r.d for r in d.select(realized(F.col("n"), "date", text=False).alias("d")).collect()] == [dt.date(1960, 1, 1), dt.date(1961, 1, 1), dt.date(2020, 1, 1), dt.date(1959, 12, 31)]
    d = spark.createDataFrame([(1.0,), (0.5,)], "n double")
    assert [r.d for r in d.select(realized(F.col("n"), "datetime", text=False).alias("d")).collect()] == [dt.datetime(1960, 1, 1, 0, 0, 1), dt.datetime(1960, 1, 1, 0, 0, 0, 500000)]
    d = spark.createDataFrame([("30:00:01.5",), ("-01:02:03",), ("1:2:3",), ("25:61:00",)], "t string")
    assert [r.t for r in d.select(iso_text(realized(F.col("t"), "time", text=True), "time").alias("t")).collect()] == ["30:00:01.5", "-01:02:03", None, None]


def spec(**more):
    v = [
        {"dataset": "AE", "variable": "SUBJ", "data_type": "string", "length": 4},
        {"dataset": "AE", "variable": "SEQ", "data_type": "integer"},
        {"dataset": "AE", "variable": "SEV", "data_type": "string", "codelist_id": "CL", "mandatory": more.pop("mandatory", None)},
    ]
    return make_spec([{"dataset": "AE", "keys": "SUBJ SEQ"}], v, [{"codelist_id": "CL", "term": t, "decode": t.title(), "extended": more.get("extended", False)} for t in ("MILD", "MODERATE", "SEVERE")])


def frame(spark, rows):
    return spark.createDataFrame(rows, "SUBJ string, SEQ int, SEV string")


def checks_of(found):
    return [f.check for f in found]


def test_codelists(spark):
    d = frame(spark, [("1", 1, " MILD "), ("2", 1, "mild"), ("3", 1, "BAD"), ("4", 1, "BAD")])
    f = check_spec(d, spec(), "AE")
    assert checks_of(f) == ["codelist_membership"] and f[0].message == "2 distinct values are outside codelist CL: BAD, mild"
    assert checks_of(check_spec(d, spec(extended=True), "AE")) == ["codelist_membership_extensible"]
    blank = frame(spark, [("1", 1, None), ("2", 1, "")])
    assert check_spec(blank, spec(), "AE")[0].message.endswith(": , <NA>")
    assert check_spec(blank, spec(mandatory=False), "AE") == []
    d = frame(spark, [("1", 1, "Mild")])
    assert check_spec(d, spec(), "AE", decode="to_decode") == [] and checks_of(check_spec(d, spec(), "AE", decode="to_code")) == ["codelist_membership"]


def test_toggles_and_keys(spark):
    d = frame(spark, [("1", 1, "MILD"), ("1", 1, "MILD"), ("1", None, "MILD"), ("1", None, "MILD"), ("2", 1, "MILD")])
    assert check_spec(d, spec(), "AE")[0].message.startswith("4 rows")
    assert check_spec(d, spec(), "AE", checks=Checks(key_uniqueness=False)) == []
    with pytest.raises(InputError):
        Checks(key_uniqueness=1)
    assert is_checks(Checks()) and "key_uniqueness: on" in str(Checks())
    assert [mandatory({"mandatory": x}) for x in (None, True, False, "No", "yes", "")] == [True, True, False, False, True, True]


def test_empty_and_all_null_frames(spark):
    assert check_spec(frame(spark, []), spec(), "AE") == []
    assert apply_spec(frame(spark, []), spec(), "AE").df.count() == 0
    assert checks_of(check_spec(frame(spark, [(None, None, None)]), spec(), "AE")) == ["codelist_membership"]


def test_one_scan_for_all_value_checks(spark):
    d = frame(spark, [("1", 1, "MILD")])
    v = [{"dataset": "AE", "variable": n, "data_type": "string", "length": 1} for n in ("SUBJ", "SEV")]
    assert checks_of(check_spec(d, make_spec([{"dataset": "AE"}], v), "AE")) == ["extra_variable", "length_overflow"]
    assert outside(F.col("x"), [], False) is not None


def test_findings_frame_and_study(spark):
    found = check_study({"AE": frame(spark, [("12345", 1, "BAD")])}, spec())
    assert findings_frame(spark, found).columns == ["check", "dimension", "severity", "dataset", "variable", "message"]
    assert checks_of(found) == ["length_overflow", "codelist_membership"]
    with pytest.raises(InputError):
        check_study({"XX": frame(spark, [])}, spec())


def test_conforming(spark):
    d = spark.createDataFrame([("b", "2", "MILD", 1), ("a", " 1", "MILD", 2), (None, "3", "MILD", 3)], "SUBJ string, SEQ string, SEV string, extra int").select("extra", "SEV", "SEQ", "SUBJ")
    x = apply_spec(d, spec(), "AE", conformance="off")
    assert x.names == ["SUBJ", "SEQ", "SEV", "extra"] and dict(x.df.dtypes)["SEQ"] == "int"
    assert [r.SUBJ for r in x.df.collect()] == [None, "a", "b"]
    assert [r.SUBJ for r in apply_spec(d, spec(), "AE", conformance="off", na_position="last", extra="drop").df.collect()] == ["a", "b", None]
    assert x.meta.keys == ["SUBJ", "SEQ"] and x.df.schema["SUBJ"].metadata["itemOID"] == "IT.AE.SUBJ"
    with pytest.warns(ConformanceWarning):
        y = apply_spec(d, spec(), "AE")
    assert "extra_variable" in checks_of(conformance(y))
    with pytest.raises(ConformanceError) as e:
        apply_spec(d.withColumn("SEV", F.lit("X")), spec(), "AE", conformance="abort")
    assert "codelist_membership" in checks_of(e.value.findings)
    with pytest.raises(InputError):
        apply_spec(d, spec(), "AE", extra="maybe")


def test_losses_stop_before_casting(spark):
    d = spark.createDataFrame([("1", "1.5", "MILD"), ("2", "3e9", "MILD"), ("3", "x", "MILD")], "SUBJ string, SEQ string, SEV string")
    with pytest.raises(TypeVocabularyError) as e:
        apply_spec(d, spec(), "AE")
    assert {(v["variable"], v["reason"], v["n"]) for v in e.value.variables} == {("SEQ", "truncated", 1), ("SEQ", "overflowed", 1)}
    with pytest.warns(CoercionWarning):
        x = apply_spec(d, spec(), "AE", conformance="off", on_coercion_loss="keep")
    assert [r.SEQ for r in x.df.orderBy("SUBJ").collect()] == [1, None, None]


def test_temporal_text_is_read_whole_or_not(spark):
    v = [{"dataset": "DM", "variable": "D", "data_type": "date", "target_data_type": "integer"}, {"dataset": "DM", "variable": "T", "data_type": "date", "order": 1}]
    s = make_spec([{"dataset": "DM"}], v)
    full = spark.createDataFrame([("2020-01-01", "2020"), (None, "2020-01-01")], "D string, T string")
    with pytest.warns(OrderWarning):
        x = apply_spec(full, s, "DM", conformance="off")
    assert dict(x.df.dtypes) == {"T": "string", "D": "date"} and is_iso_text(x.meta.columns["T"])
    part = spark.createDataFrame([("2020-01", "2020"), ("2020-01-02", "2020")], "D string, T string")
    with pytest.warns(OrderWarning):
        assert dict(apply_spec(part, s, "DM", conformance="off").df.dtypes)["D"] == "string"


def test_decoding(spark):
    d = frame(spark, [("1", 1, "MILD"), ("2", 2, " severe"), ("3", 3, None)])
    with pytest.raises(CodelistError) as e:
        decode_column(d, spec(), "AE", "SEV", "TXT")
    assert e.value.values == [" severe"]
    with pytest.warns(Warning):
        got = decode_column(d, spec(), "AE", "SEV", "TXT", ignore_case=True)
    assert got.columns == ["SUBJ", "SEQ", "SEV", "TXT"] and [r.TXT for r in got.orderBy("SUBJ").collect()] == ["Mild", "Severe", None]
    x = decode_column(set_meta(d, meta_from_frame(d)), spec(), "AE", "SEV", no_match="na")
    assert isinstance(x, Dataset) and x.names == ["SUBJ", "SEQ", "SEV"]


def test_repeated_terms_never_multiply_rows(spark):
    s = make_spec([{"dataset": "A"}], [{"dataset": "A", "variable": "V", "data_type": "string", "codelist_id": "C"}], [{"codelist_id": "C", "term": "x", "decode": "first"}, {"codelist_id": "C", "term": "x", "decode": "second"}])
    got = decode_column(spark.createDataFrame([("x",), ("x",)], "V string"), s, "A", "V", "D").collect()
    assert [r.D for r in got] == ["first", "first"]


def test_metadata(spark):
    d = spark.createDataFrame([("a", 1.0)], "A string, B double")
    x = set_meta(d, meta_from_frame(d, "XX"))
    m, special = parse(to_json(x.meta, {"B": {"rows": [1], "tags": [".A"]}}))
    assert m == x.meta and special == {"B": {"rows": [1], "tags": [".A"]}}
    y = x.transform(lambda df: df.select("B").withColumn("C", F.lit(1)))
    assert list(y.meta.columns) == ["B", "C"] and sync_meta(y).meta == y.meta
    assert get_meta(x) == x.meta
    with pytest.raises(InputError):
        get_meta(d)


def test_charsets(spark):
    assert charset("wlatin1") == "WINDOWS-1252" and charset("latin9") == "ISO-8859-15" and charset("utf8") == "UTF-8"
    with pytest.raises(InputError):
        charset("klingon")
    assert len(PUNCTUATION) == 12 and len(ascii_folds()) == 86
    d = spark.createDataFrame([("aé—漢ß",)], "t string")
    out = {p: d.select(to_charset(F.col("t"), "ascii", p).alias("t")).first().t for p in ("translit", "fold", "replace", "ignore")}
    assert out == {"translit": "ae-?ss", "fold": "a?-??", "replace": "a????", "ignore": "a"}
    assert cut_bytes("aéé", 4) == "aé"


def test_microseconds_of_far_instants_and_long_times(spark):
    """Beyond 285 years from the epoch, a product of seconds and a million isn't exact in double precision."""
    halves = [3336021 * 86399.5, -3336021 * 86399.5, 53999999 * 86399.5, 0.5, -0.5]
    d = spark.createDataFrame([(x,) for x in halves], "s double")
    zero = F.lit("1960-01-01 00:00:00").cast("timestamp_ntz")
    got = d.select("s", F.timestamp_diff("MICROSECOND", zero, realized(F.col("s"), "datetime", text=False)).alias("m"), iso_text(realized(F.col("s"), "time", text=False), "time").alias("t")).collect()
    assert [r.m for r in got] == [int(x * 2) * 500_000 for x in halves]
    clocks = [f"{'-' if x < 0 else ''}{int(abs(x)) // 3600:02d}:{int(abs(x)) // 60 % 60:02d}:{int(abs(x)) % 60:02d}" for x in halves]
    assert [r.t for r in got] == [c + ".5" * (x % 1 != 0) for c, x in zip(clocks, halves, strict=True)]
