"""Specifications for the benchmark's tables, with defects that the checks must find."""

from __future__ import annotations

from ..spec import Spec, make_spec


def _v(dataset: str, variable: str, data_type: str, **more) -> dict:
    return {"dataset": dataset, "variable": variable, "data_type": data_type, **more}


def orders() -> Spec:
    """A closed codelist that lacks P, a length that is too short, and a column that isn't declared."""
    return make_spec(
        datasets=[{"dataset": "ORDERS", "label": "Orders", "keys": "o_orderkey"}],
        variables=[
            _v("ORDERS", "o_orderkey", "double", order=1, mandatory=True),
            _v("ORDERS", "o_orderstatus", "string", order=2, length=1, codelist_id="CL.STATUS"),
            _v("ORDERS", "o_totalprice", "float", order=4),
            _v("ORDERS", "o_orderdate", "datetime", order=3, display_format="DATETIME20."),
            _v("ORDERS", "o_orderpriority", "string", order=5, length=8),
            _v("ORDERS", "o_comment", "string", order=6, mandatory=False),
        ],
        codelists=[{"codelist_id": "CL.STATUS", "term": "F", "decode": "Filled"}, {"codelist_id": "CL.STATUS", "term": "O", "decode": "Open"}],
        study={"study": "TRADE"},
        standard="TEST 1.0",
    )


def lineitem() -> Spec:
    """Keys that aren't unique, integers that have fractions, an extensible codelist, a format of another family."""
    return make_spec(
        datasets=[{"dataset": "LINES", "label": "Lines", "keys": "l_orderkey, l_linenumber"}],
        variables=[
            _v("LINES", "l_orderkey", "double"),
            _v("LINES", "l_linenumber", "integer"),
            _v("LINES", "l_quantity", "integer"),
            _v("LINES", "l_discount", "integer"),
            _v("LINES", "l_returnflag", "string", codelist_id="CL.FLAG"),
            _v("LINES", "l_shipdate", "datetime", display_format="DATE9."),
        ],
        codelists=[{"codelist_id": "CL.FLAG", "term": "A", "decode": "Accepted", "extended": True}, {"codelist_id": "CL.FLAG", "term": "N", "decode": "None", "extended": False}],
    )


def nations() -> Spec:
    """Numeric codes, for lookups both ways."""
    return make_spec(
        datasets=[{"dataset": "NATION", "keys": "n_nationkey"}],
        variables=[_v("NATION", "n_nationkey", "integer"), _v("NATION", "n_regionkey", "integer", codelist_id="CL.REGION"), _v("NATION", "region", "string", label="Region name", codelist_id="CL.REGION"), _v("NATION", "code", "integer", codelist_id="CL.REGION")],
        codelists=[{"codelist_id": "CL.REGION", "term": str(i), "decode": n} for i, n in enumerate(("Africa", "America", "Asia"))] + [{"codelist_id": "CL.REGION", "term": "0", "decode": "never used"}],
    )


def flawed() -> Spec:
    """Something wrong for each rule about the specification itself."""
    return make_spec(
        datasets=[{"dataset": "AA", "label": "First", "keys": "K1 GONE", "comment_id": "C.NONE"}, {"dataset": "BB", "keys": "K2 K1"}],
        variables=[
            _v("AA", "K1", "string", label="Key", key_sequence=1, order=1, itemoid="IT.SAME", length=0),
            _v("AA", "K2", "string", key_sequence=3, order=1, significant_digits=-1),
            _v("AA", "DERIVED", "float", label="Derived", origin="Derived", order=-2, comment_id="C.NONE"),
            _v("AA", "LONGNAMED", "integer", label="L" * 41, method_id="M.NONE"),
            _v("BB", "K1", "float", label="Another", key_sequence=1, itemoid="IT.SAME", method_id="M.TWICE", comment_id="C.BLANK"),
            _v("BB", "K2", "string", label="Key", key_sequence=2, length=8, codelist_id="CL.NOTHING", comment_id="C.TWICE"),
        ],
        codelists=[{"codelist_id": "CL.NOTHING", "term": " ", "comment_id": "C.NONE"}],
        methods=[{"method_id": "M.TWICE", "document_id": "D.NONE", "description": "by rule"}, {"method_id": "M.TWICE", "description": " "}, {"method_id": "M.IDLE", "description": "x"}],
        comments=[{"comment_id": "C.BLANK", "document_id": "D.TWICE"}, {"comment_id": "C.TWICE", "description": "x", "document_id": "D.NONE"}, {"comment_id": "C.TWICE", "description": "y"}, {"comment_id": "C.IDLE", "description": "x"}],
        documents=[{"document_id": "D.TWICE", "title": "t"}, {"document_id": "D.TWICE", "title": "u"}, {"document_id": "D.IDLE", "title": "v"}],
        values=[{"dataset": "BB", "variable": "K1", "where_clause": " ", "method_id": "M.NONE", "comment_id": "C.NONE", "codelist_id": "CL.NONE"}, {"dataset": "BB", "variable": "NOWHERE", "where_clause": "K1 EQ 1"}],
    )
