import json

import pytest

from veraframe.errors import CodecError, InputError, SpecError, SpecWarning, TypeVocabularyError
from veraframe.plans.specs import flawed, lineitem, orders
from veraframe.rules import catalog, finding, report
from veraframe.operators.validate import scope, validate_spec
from veraframe.sources.spec_files import read_spec, sheets_of, write_spec
from veraframe.spec import Spec, is_spec, make_spec, repair_spec, set_type, split_keys
from veraframe.types import ALIASES, DATE_FORMATS, DATETIME_FORMATS, TIME_FORMATS, canonical_type, family, parse_format


def base(**more):
    return {"datasets": [{"dataset": "DM", "keys": "SUBJ, SEQ"}], "variables": [{"dataset": "DM", "variable": "SUBJ", "data_type": "text"}, {"dataset": "DM", "variable": "SEQ", "data_type": "Integer(8)", "length": "8", "mandatory": "Yes"}]} | more


def test_types():
    assert len(ALIASES) == 29 and canonical_type(" Text(20) ") == "string" and canonical_type("partialDate") == "date" and canonical_type("URL") == "URI"
    assert (len(DATE_FORMATS), len(DATETIME_FORMATS), len(TIME_FORMATS)) == (79, 25, 13) or len(DATE_FORMATS) > 70
    with pytest.raises(TypeVocabularyError):
        canonical_type("blob")
    assert parse_format("F8.2") == ("F", 8, 2) and parse_format("DATE9.") == ("DATE", 9, None) and parse_format("$CHAR20.") == ("$CHAR", 20, None)
    assert [family(f) for f in ("DATE9.", "datetime20.", "TIME8.", "E8601DA.", "F8.2", None)] == ["date", "datetime", "time", "date", None, None]


def test_catalog():
    rules = catalog()
    assert len(rules) == 61
    assert sum(r.engine == "data" for r in rules.values()) == 18 and sum(r.status == "deferred" for r in rules.values()) == 3
    assert sum(r.engine == "spec" and r.status == "implemented" for r in rules.values()) == 40


def test_every_spec_rule_fires_or_needs_data():
    fired = {f.check for f in validate_spec(flawed()).findings}
    assert {r.id for r in catalog().values() if r.engine == "spec" and r.status == "implemented" and not r.needs_data} == fired


def test_a_sound_spec_has_no_errors():
    assert not [f for f in validate_spec(orders(), dataset="ORDERS").findings if f.severity == "error"]


def test_scoped_rules_leave_out_the_rest():
    whole = {f.check for f in validate_spec(flawed()).findings}
    part = validate_spec(flawed(), dataset="BB").findings
    assert "method_unused" in whole and not {"method_unused", "cross_dataset_type"} & {f.check for f in part}
    assert all(f.dataset in (None, "BB") for f in part)
    assert len(scope(flawed(), "AA").methods) == 0


def test_construction():
    s = make_spec(**base())
    assert is_spec(s) and s.keys("DM") == ["SUBJ", "SEQ"]
    assert [v["key_sequence"] for v in s.variables] == [1, 2] and s.variables[1]["length"] == 8 and s.variables[1]["mandatory"] is True
    assert split_keys(" A,  B\tC ") == ["A", "B", "C"]
    given = base()
    given["variables"][1]["key_sequence"] = 7
    assert [v["key_sequence"] for v in make_spec(**given).variables] == [None, 7]
    assert make_spec(**base(study={"Study": "X", "protocol": "P"})).study == {"study_name": "X", "protocol_name": "P"}


@pytest.mark.parametrize(
    "change",
    [
        {"datasets": [{"label": "x"}]},
        {"datasets": [{"dataset": "AE"}]},
        {"variables": [{"dataset": "DM", "variable": "A", "data_type": "text"}] * 2},
        {"variables": [{"dataset": "DM", "variable": "A", "data_type": "text", "codelist_id": "NO"}]},
        {"variables": [{"dataset": "DM", "variable": "A", "data_type": "text", "length": "wide"}]},
        {"variables": [{"dataset": "DM", "variable": "A", "data_type": "text", "target_data_type": "text"}]},
        {"study": {"study": "A", "study_name": "B"}},
        {"standard": "A", "study": {"standard": "B"}},
    ],
)
def test_contradictions_stop_it(change):
    with pytest.raises(SpecError):
        make_spec(**base(**change))


def test_changes_are_new_objects():
    s = make_spec(**base())
    t = set_type(s, "DM", SUBJ="url")
    assert s.variable("DM", "SUBJ")["data_type"] == "string" and t.variable("DM", "SUBJ")["data_type"] == "URI"
    r = repair_spec(s, [finding("integer_fraction", "", "DM", "SEQ"), finding("label_match", "", "DM", "SUBJ")])
    assert r.variable("DM", "SEQ")["data_type"] == "float"
    with pytest.raises(InputError):
        set_type(s, "DM", NOPE="text")


def test_accessors():
    s = lineitem()
    assert len(s.codelist("CL.FLAG")) == 2 and s.variable("LINES", "nope") is None
    for call in (lambda: s.codelist("NO"), lambda: s.variables_of("NO"), lambda: s.study_field("NO")):
        with pytest.raises(InputError):
            call()
    assert "LINES" in str(s) and "no findings" in report([], "x")


def test_json_round_trip(tmp_path):
    for s in (orders(), flawed(), make_spec(**base(values=[{"dataset": "DM", "variable": "SUBJ", "where_clause": "x", "own": 1}]))):
        path = str(tmp_path / "s.json")
        write_spec(s, path)
        assert read_spec(path) == s
    x = json.loads(open(path).read()) | {"specVersion": "9"}
    (tmp_path / "v.json").write_text(json.dumps(x))
    with pytest.warns(SpecWarning):
        read_spec(str(tmp_path / "v.json"))


def test_workbook_round_trip(tmp_path):
    path = str(tmp_path / "s.xlsx")
    write_spec(orders(), path)
    s = read_spec(path)
    assert isinstance(s, Spec) and s.standard == "TEST 1.0" and s.study["study_name"] == "TRADE"
    assert [v["variable"] for v in s.variables] == [v["variable"] for v in orders().variables] and len(s.codelists) == 2
    assert s.variable("ORDERS", "o_orderkey")["mandatory"] is True and s.variable("ORDERS", "o_orderkey")["data_type"] == "float"
    assert set(sheets_of(path)) == {"Define", "Datasets", "Variables", "ValueLevel", "Codelists", "Methods", "Comments", "Documents"}


def test_duplicate_variables(tmp_path):
    x = {"datasets": [{"dataset": "DM"}], "variables": [{"dataset": "DM", "variable": "A", "data_type": "text"}, {"dataset": "DM", "variable": "A", "data_type": "float"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(x))
    with pytest.raises(SpecError):
        read_spec(str(path))
    with pytest.warns(SpecWarning):
        assert read_spec(str(path), on_duplicate="warn").variables[0]["data_type"] == "string"
    assert len(read_spec(str(path), on_duplicate="first").variables) == 1


DEFINE = """<?xml version="1.0"?><ODM xmlns="http://www.cdisc.org/ns/odm/v1.3" xmlns:def="http://www.cdisc.org/ns/def/v2.1" xmlns:xlink="http://www.w3.org/1999/xlink"><Study OID="S"><GlobalVariables><StudyName>ST</StudyName><StudyDescription>d</StudyDescription><ProtocolName>P</ProtocolName></GlobalVariables>
<MetaDataVersion OID="M" def:DefineVersion="2.1.0"><def:Standards><def:Standard OID="x" Name="SDTMIG" Type="IG" Version="3.3"/></def:Standards>
<ItemGroupDef OID="IG.DM" Name="DM" def:Structure="one per subject"><Description><TranslatedText>Demographics</TranslatedText></Description><ItemRef ItemOID="IT.A" KeySequence="2" Mandatory="Yes"/><ItemRef ItemOID="IT.B" KeySequence="1" Mandatory="No" MethodOID="MT.B"/><def:Class Name="SPECIAL PURPOSE"/></ItemGroupDef>
<ItemDef OID="IT.A" Name="SEX" DataType="text" Length="1"><CodeListRef CodeListOID="CL.S"/><def:ValueListRef ValueListOID="VL.A"/></ItemDef><ItemDef OID="IT.B" Name="SUBJ" DataType="partialDatetime"><CodeListRef CodeListOID="CL.X"/><def:Origin Type="Derived"/></ItemDef><ItemDef OID="IT.V" Name="SEXV" DataType="integer" Length="3"/>
<def:ValueListDef OID="VL.A"><ItemRef ItemOID="IT.V" Mandatory="Yes"><def:WhereClauseRef WhereClauseOID="WC"/></ItemRef></def:ValueListDef>
<def:WhereClauseDef OID="WC"><RangeCheck Comparator="IN" def:ItemOID="IT.B"><CheckValue>a</CheckValue><CheckValue>b</CheckValue></RangeCheck></def:WhereClauseDef>
<CodeList OID="CL.S" Name="Sex" DataType="text"><CodeListItem CodedValue="F"><Decode><TranslatedText>Female</TranslatedText></Decode></CodeListItem><EnumeratedItem CodedValue="M" def:ExtendedValue="Yes"/></CodeList><CodeList OID="CL.X"><ExternalCodeList Dictionary="X"/></CodeList>
<MethodDef OID="MT.B" Name="m" Type="Computation"><Description><TranslatedText>by hand</TranslatedText></Description></MethodDef><def:leaf ID="LF" xlink:href="a.pdf"><def:title>A</def:title></def:leaf></MetaDataVersion></Study></ODM>"""


def test_define_xml(tmp_path):
    path = tmp_path / "define.xml"
    path.write_text(DEFINE)
    s = read_spec(str(path))
    assert s.keys("DM") == ["SUBJ", "SEX"] and s.standard == "SDTMIG 3.3" and s.dataset("DM")["class"] == "SPECIAL PURPOSE"
    assert s.variable("DM", "SUBJ")["data_type"] == "datetime" and s.variable("DM", "SUBJ")["codelist_id"] is None
    assert [(c["term"], c["decode"], c["extended"]) for c in s.codelists] == [("F", "Female", False), ("M", None, True)]
    assert s.values[0]["where_clause"] == "SUBJ IN (a, b)" and s.documents[0]["href"] == "a.pdf" and s.methods[0]["description"] == "by hand"
    path.write_text(DEFINE.replace("2.1.0", "1.0"))
    with pytest.raises(CodecError):
        read_spec(str(path))
    path.write_text(DEFINE.replace('ItemOID="IT.A" Key', 'ItemOID="IT.Z" Key'))
    with pytest.raises(CodecError):
        read_spec(str(path))
