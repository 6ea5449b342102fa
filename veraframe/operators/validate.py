"""Is a specification sound in itself, and do data agree with its codelists?"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError, ValidationError, ValidationWarning, warn
from ..functions.numbers import code_text
from ..functions.temporal import is_blank, trimmed
from ..meta import Dataset
from ..rules import Finding, by_severity, finding, report
from ..spec import Row, Spec, blank, split_keys
from ..types import storage
from .check import LABEL_LIMIT, NAME_LIMIT, mandatory, offenders, outside


@dataclass(frozen=True)
class SpecCheck:
    """Findings of the spec rules, and what they were about."""

    findings: tuple[Finding, ...]
    datasets: tuple[str, ...]
    study: str | None

    @property
    def summary(self) -> dict[str, int]:
        return by_severity(list(self.findings))

    def __str__(self) -> str:
        return report(list(self.findings), f"specification of {self.study or 'a study without a name'}: {', '.join(self.datasets)}")


def ids(rows: Iterable[Row], column: str) -> set[str]:
    """The distinct references in a column, blank ones left out."""
    return {r[column] for r in rows if not blank(r.get(column))}


def scope(spec: Spec, dataset: str | None) -> Spec:
    """The part of a specification that some dataset refers to: its rows, and what these name, directly or not."""
    if dataset is not None:
        spec.check_dataset(dataset)
    own = lambda rows: tuple(r for r in rows if dataset is None or r.get("dataset") == dataset)
    d, v, values = own(spec.datasets), own(spec.variables), own(spec.values)
    lists = ids(v, "codelist_id") | ids(values, "codelist_id")
    codelists = tuple(c for c in spec.codelists if c["codelist_id"] in lists)
    methods = tuple(m for m in spec.methods if m["method_id"] in ids(v, "method_id") | ids(values, "method_id"))
    comments_used = ids(d, "comment_id") | ids(v, "comment_id") | ids(values, "comment_id") | ids(codelists, "comment_id")
    comments = tuple(c for c in spec.comments if c["comment_id"] in comments_used)
    documents = tuple(x for x in spec.documents if x["document_id"] in ids(methods, "document_id") | ids(comments, "document_id"))
    parts = {"datasets": d, "variables": v, "values": values, "codelists": codelists, "methods": methods, "comments": comments, "documents": documents}
    out = object.__new__(Spec)  # a part needn't be closed under its references, which is what the rules look at
    for k, x in (vars(spec) | parts).items():
        object.__setattr__(out, k, x)
    return out


def _twice(names: Iterable[str]) -> list[str]:
    return [k for k, n in Counter(names).items() if n > 1]


def _spec_rules(s: Spec, whole: Spec) -> Iterable[Finding]:
    """All rules about one scope. References are looked up in the whole specification."""
    if blank(s.study.get("study_name")):
        yield finding("study_name_present", "the study has no name")
    comments, methods, documents = ids(whole.comments, "comment_id"), ids(whole.methods, "method_id"), ids(whole.documents, "document_id")
    for d in s.datasets:
        n = d["dataset"]
        own = [v for v in s.variables if v["dataset"] == n]
        names = {v["variable"] for v in own}
        if blank(d["label"]):
            yield finding("dataset_label_present", "dataset has no label", n)
        lost = [k for k in split_keys(d["keys"]) if k not in names]
        if lost:
            yield finding("dataset_keys_resolve", f"keys are not variables of the dataset: {', '.join(lost)}", n)
        if not blank(d["comment_id"]) and d["comment_id"] not in comments:
            yield finding("dataset_comment_resolves", f"comment {d['comment_id']} is not defined", n)
        yield from _keys(d, own)
    for v in s.variables:
        yield from _variable(v, methods, comments)
    for n in s.dataset_names():
        orders = _twice(str(v["order"]) for v in s.variables if v["dataset"] == n and v["order"] is not None)
        if orders:
            yield finding("variable_order_unique", f"orders of more than one variable: {', '.join(orders)}", n)
    for oid in _twice(v["itemoid"].strip() for v in s.variables if not blank(v["itemoid"])):
        holders = [f"{v['dataset']}.{v['variable']}" for v in s.variables if not blank(v["itemoid"]) and v["itemoid"].strip() == oid]
        yield finding("itemoid_unique", f"item OID {oid} names {', '.join(holders)}")
    yield from _values(s, methods, comments, ids(whole.codelists, "codelist_id"))
    yield from _supporting(s, comments, documents)


def _keys(d: Row, own: list[Row]) -> Iterable[Finding]:
    by = sorted((v["key_sequence"], v["variable"]) for v in own if v["key_sequence"] is not None)
    numbers = [k for k, _ in by]
    if numbers and numbers != list(range(1, len(numbers) + 1)):
        yield finding("key_sequence_contiguous", f"key sequence is {', '.join(map(str, numbers))}", d["dataset"])
    keys = split_keys(d["keys"])
    if numbers and keys and [v for _, v in by] != keys:
        yield finding("key_sequence_matches_keys", f"key sequence gives {', '.join(v for _, v in by)}, keys are {', '.join(keys)}", d["dataset"])


def _variable(v: Row, methods: set[str], comments: set[str]) -> Iterable[Finding]:
    at = (v["dataset"], v["variable"])
    if blank(v["label"]):
        yield finding("variable_label_present", "variable has no label", *at)
    if v["length"] is not None and v["length"] <= 0:
        yield finding("variable_length_positive", f"length is {v['length']}", *at)
    if v["significant_digits"] is not None and v["significant_digits"] < 0:
        yield finding("variable_sigdigits_nonneg", f"significant digits are {v['significant_digits']}", *at)
    if not blank(v["method_id"]) and v["method_id"] not in methods:
        yield finding("variable_method_resolves", f"method {v['method_id']} is not defined", *at)
    if not blank(v["comment_id"]) and v["comment_id"] not in comments:
        yield finding("variable_comment_resolves", f"comment {v['comment_id']} is not defined", *at)
    if not blank(v["origin"]) and v["origin"].strip().upper() == "DERIVED" and blank(v["method_id"]):
        yield finding("variable_derived_has_method", "derived variable has no method", *at)
    if v["order"] is not None and v["order"] <= 0:
        yield finding("variable_order_positive", f"order is {v['order']}", *at)
    if v["data_type"] == "string" and v["length"] is None:
        yield finding("variable_length_for_text", "text variable has no length", *at)
    if len(v["variable"]) > NAME_LIMIT:
        yield finding("variable_name_length", f"name has {len(v['variable'])} characters, a transport file holds {NAME_LIMIT}", *at)
    if not blank(v["label"]) and len(v["label"].encode()) > LABEL_LIMIT:
        yield finding("variable_label_length", f"label has {len(v['label'].encode())} bytes, a transport file holds {LABEL_LIMIT}", *at)


def _values(s: Spec, methods: set[str], comments: set[str], codelists: set[str]) -> Iterable[Finding]:
    pairs = {(v["dataset"], v["variable"]) for v in s.variables}
    for r in s.values:
        at = (r.get("dataset"), r.get("variable"))
        if blank(r.get("where_clause")):
            yield finding("value_whereclause_present", "value-level row has no where-clause", *at)
        if at not in pairs:
            yield finding("value_variable_resolves", "value-level row is of no variable of the dataset", *at)
        for rule, column, known in (("value_method_resolves", "method_id", methods), ("value_comment_resolves", "comment_id", comments), ("value_codelist_resolves", "codelist_id", codelists)):
            if not blank(r.get(column)) and r[column] not in known:
                yield finding(rule, f"{column.removesuffix('_id')} {r[column]} is not defined", *at)


def _supporting(s: Spec, comments: set[str], documents: set[str]) -> Iterable[Finding]:
    by: dict[str, list[Row]] = {}
    for c in s.codelists:
        by.setdefault(c["codelist_id"], []).append(c)
    for k, rows in by.items():
        for c in sorted(ids(rows, "comment_id") - comments):
            yield finding("codelist_comment_resolves", f"codelist {k}: comment {c} is not defined")
        if all(blank(r["term"]) for r in rows):
            yield finding("codelist_terms_present", f"codelist {k} has no terms")
    for kind, rows in (("method", s.methods), ("comment", s.comments)):
        for k in _twice(r[f"{kind}_id"] for r in rows):
            yield finding(f"{kind}_id_unique", f"{kind} {k} is defined more than once")
        for r in rows:
            if blank(r["description"]):
                yield finding(f"{kind}_description_present", f"{kind} {r[f'{kind}_id']} has no description")
            if not blank(r["document_id"]) and r["document_id"] not in documents:
                yield finding(f"{kind}_document_resolves", f"{kind} {r[f'{kind}_id']}: document {r['document_id']} is not defined")
    for k in _twice(r["document_id"] for r in s.documents):
        yield finding("document_id_unique", f"document {k} is defined more than once")


def _whole_rules(s: Spec) -> Iterable[Finding]:
    """Rules about datasets taken together."""
    used = scope(s, None)
    for kind in ("method", "comment", "document"):
        known = {r[f"{kind}_id"] for r in getattr(used, f"{kind}s")}
        for k in dict.fromkeys(r[f"{kind}_id"] for r in getattr(s, f"{kind}s")):
            if k not in known:
                yield finding(f"{kind}_unused", f"{kind} {k} is referred to by nothing")
    for rule, column in (("cross_dataset_label", "label"), ("cross_dataset_type", "data_type")):
        seen: dict[str, dict[str, list[str]]] = {}
        for v in s.variables:
            if not blank(v[column]):
                seen.setdefault(v["variable"], {}).setdefault(v[column], []).append(v["dataset"])
        for name, texts in seen.items():
            if len(texts) > 1:
                yield finding(rule, "; ".join(f"{x!r} in {', '.join(ds)}" for x, ds in texts.items()), variable=name)


def _data_rules(s: Spec, dataset: str, x: DataFrame | Dataset) -> Iterable[Finding]:
    """Values against codelists, both ways, in one pass over the data for all coded variables."""
    df = x.df if isinstance(x, Dataset) else x
    coded = []
    for v in s.variables_of(dataset):
        if v["variable"] not in df.columns:
            yield finding("variable_present_in_data", "variable has no column in the data", dataset, v["variable"])
        elif not blank(v["codelist_id"]):
            coded.append(v)
    if not coded:
        return
    tests, sets, lists = {}, [], {}
    for i, v in enumerate(coded):
        kind = df.schema[v["variable"]].dataType
        text = code_text(F.col(f"`{v['variable']}`"), "double" if storage(kind) == "double" and not isinstance(kind, T.LongType) else "text")
        rows = [c for c in s.codelists if c["codelist_id"] == v["codelist_id"]]
        terms = [c["term"].strip(" \t\r\n") for c in rows if not blank(c["term"])]
        lists[v["variable"]] = list(dict.fromkeys(terms))
        if not any(c["extended"] for c in rows):
            tests[v["variable"]] = (text, outside(text, terms, mandatory(v)))
        # Only values that are terms are gathered, so a set is no larger than its codelist.
        sets.append(F.collect_set(F.when(~is_blank(text) & trimmed(text).isin(terms), trimmed(text)) if terms else F.lit(None).cast("string")).alias(f"_{i}"))
    bad = offenders(df, tests)
    present = df.agg(*sets).first()
    for i, v in enumerate(coded):
        n = v["variable"]
        if n in bad:
            yield finding("ct_value_in_codelist", f"{bad[n][0]} distinct values are outside codelist {v['codelist_id']}: {', '.join(bad[n][1])}", dataset, n)
        idle = [t for t in lists[n] if t not in set(present[i])]
        if idle:
            yield finding("ct_term_unused", f"{len(idle)} terms of codelist {v['codelist_id']} are not in the data: {', '.join(idle[:5])}", dataset, n)


def validate_spec(spec: Spec, data: DataFrame | Dataset | dict[str, DataFrame | Dataset] | None = None, dataset: str | None = None, on_error: str = "off") -> SpecCheck:
    """Findings of the forty spec rules; those about data only with data, those about all datasets only without ``dataset``."""
    if on_error not in ("off", "warn", "abort"):
        raise InputError("on_error is off, warn or abort", on_error=on_error)
    if data is not None and not isinstance(data, dict):
        if dataset is None:
            raise InputError("a bare frame needs the name of its dataset")
        data = {dataset: data}
    unknown = [d for d in data or {} if d not in spec.dataset_names()]
    if unknown:
        raise InputError(f"not in the specification: {', '.join(unknown)}", datasets=unknown)
    part = scope(spec, dataset)
    found = list(_spec_rules(part, spec))
    for d in part.dataset_names():
        if d in (data or {}):
            found += _data_rules(spec, d, data[d])
    if dataset is None:
        found += _whole_rules(spec)
    out = SpecCheck(tuple(found), tuple(part.dataset_names()), spec.study.get("study_name"))
    errors = [f for f in found if f.severity == "error"]
    if errors and on_error == "abort":
        raise ValidationError(str(replace(out, findings=tuple(errors))), findings=found)
    if errors and on_error == "warn":
        warn(ValidationWarning, str(replace(out, findings=tuple(errors))))
    return out
