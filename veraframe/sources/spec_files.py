"""Specifications as JSON, as a workbook of sheets, and as Define-XML. All are small and stay on the driver."""

from __future__ import annotations

import json
import os
import re
import zipfile
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from ..errors import CodecError, InputError, SpecError, SpecWarning, inform, warn
from ..spec import SLOTS, Row, Spec, blank, make_spec
from ..types import DEFINE_TYPES
from .files import check_path, local

SPEC_VERSION = "1.0"
_SLOTS = (*SLOTS, "values")

#: Sheets of a workbook by the names they go by, and the columns of each by their headers.
SHEETS = {
    "study": ("define", "study"),
    "datasets": ("datasets",),
    "variables": ("variables",),
    "values": ("valuelevel", "values"),
    "codelists": ("codelists",),
    "methods": ("methods",),
    "comments": ("comments",),
    "documents": ("documents",),
}
HEADERS: dict[str, dict[str, str]] = {
    "datasets": {"Dataset": "dataset", "Label": "label", "Class": "class", "SubClass": "subclass", "Structure": "structure", "Key Variables": "keys", "Standard": "standard", "Comment": "comment_id"},
    "variables": {
        "Order": "order", "Dataset": "dataset", "Variable": "variable", "Label": "label", "Data Type": "data_type", "Length": "length",
        "Significant Digits": "significant_digits", "Format": "display_format", "Mandatory": "mandatory", "Codelist": "codelist_id",
        "Origin": "origin", "Source": "source", "Pages": "pages", "Method": "method_id", "Predecessor": "predecessor", "Role": "role",
        "Assigned Value": "assigned_value", "Comment": "comment_id",
    },
    "values": {"Order": "order", "Dataset": "dataset", "Variable": "variable", "Where Clause": "where_clause", "Label": "label", "Data Type": "data_type", "Length": "length", "Mandatory": "mandatory", "Codelist": "codelist_id", "Method": "method_id", "Comment": "comment_id"},
    "codelists": {"ID": "codelist_id", "Order": "order", "Term": "term", "Decoded Value": "decode", "Comment": "comment_id"},
    "methods": {"ID": "method_id", "Name": "name", "Type": "type", "Description": "description", "Expression Context": "expression_context", "Expression Code": "expression_code", "Document": "document_id", "Pages": "pages"},
    "comments": {"ID": "comment_id", "Description": "description", "Document": "document_id", "Pages": "pages"},
    "documents": {"ID": "document_id", "Title": "title", "Href": "href"},
}
_FILLED = {"variables": "dataset", "values": "dataset", "codelists": "codelist_id"}
_STUDY = {"study_name": "StudyName", "study_description": "StudyDescription", "protocol_name": "ProtocolName"}


def read_spec(path: str, datasets: list[str] | None = None, on_duplicate: str = "error") -> Spec:
    """Read a specification: .json, .xlsx or .xml (Define-XML 2). ``datasets`` keeps only some of its datasets."""
    if on_duplicate not in ("error", "first", "warn"):
        raise InputError("on_duplicate is error, first or warn", on_duplicate=on_duplicate)
    path = local(check_path(path))
    if not os.path.isfile(path):
        raise InputError(f"{path} does not exist", path=path)
    kind = path.lower().rsplit(".", 1)[-1]
    readers = {"json": _read_json, "xlsx": _read_workbook, "xml": _read_define}
    if kind not in readers:
        raise InputError(f"{path}: a specification is .json, .xlsx or .xml", path=path)
    try:
        tables = readers[kind](path)
    except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError) as e:
        raise CodecError(f"{path}: {e}", path=path) from e
    if datasets is not None:
        unknown = [d for d in datasets if d not in {r.get("dataset") for r in tables["datasets"]}]
        if unknown:
            raise InputError(f"{path} has no dataset {', '.join(unknown)}", datasets=unknown)
        for slot in ("datasets", "variables", "values"):
            tables[slot] = [r for r in tables.get(slot) or [] if r.get("dataset") in datasets]
    tables["variables"] = _once(tables["variables"], on_duplicate)
    for slot in _SLOTS:
        for r in tables.get(slot) or []:
            r.pop("_row", None)
    return make_spec(**tables)


def _once(rows: list[Row], on_duplicate: str) -> list[Row]:
    """The first row of each variable; more than one is an error unless they may be resolved."""
    first: dict[tuple, Row] = {}
    twice: dict[tuple, list] = {}
    for r in rows:
        k = (r.get("dataset"), r.get("variable"))
        if k in first:
            twice.setdefault(k, [first[k].get("_row")]).append(r.get("_row"))
        else:
            first[k] = r
    if twice:
        text = "; ".join(f"{d}.{v}" + (f" in rows {', '.join(map(str, at))}" if all(at) else "") for (d, v), at in twice.items())
        if on_duplicate == "error":
            raise SpecError(f"variables defined more than once: {text}", duplicates=sorted(map(str, twice)))
        if on_duplicate == "warn":
            warn(SpecWarning, f"kept the first of: {text}")
    return list(first.values())


# -- JSON -----------------------------------------------------------------------


def _read_json(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8-sig") as f:
        x = json.load(f)
    if not isinstance(x, dict) or "datasets" not in x or "variables" not in x:
        raise ValueError("no datasets or variables")
    if x.get("specVersion", SPEC_VERSION) != SPEC_VERSION:
        warn(SpecWarning, f"{path} is of version {x['specVersion']}, this engine writes {SPEC_VERSION}")
    return {s: x.get(s) or [] for s in _SLOTS} | {"study": x.get("study") or None, "standard": x.get("standard")}


def write_spec(spec: Spec, path: str) -> Spec:
    """Write a specification: .json keeps all of it, .xlsx what a workbook has columns for."""
    path = local(check_path(path))
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in ("json", "xlsx"):
        raise InputError(f"{path}: a specification is written as .json or .xlsx", path=path)
    temporary = f"{path}.new"
    try:
        if kind == "json":
            x = {"specVersion": SPEC_VERSION, "standard": spec.standard, "study": spec.study} | {s: list(getattr(spec, s)) for s in _SLOTS}
            with open(temporary, "w", encoding="utf-8") as f:
                json.dump(x, f, ensure_ascii=False, indent=2)
        else:
            _write_workbook(spec, temporary)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return spec


# -- workbook -------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets_of(path: str) -> dict[str, list[tuple[int, list[str | None]]]]:
    """Rows of each sheet, with their numbers, as text."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[s.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for i, r in enumerate(root.iter(f"{_MAIN}row"), 1):
                cells: list[str | None] = []
                for c in r.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if kind == "b" else v.text
                rows.append((int(r.get("r") or i), cells))
            out[s.get("name")] = rows
        return out


def _same(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def _table(rows: list[tuple[int, list[str | None]]]) -> list[Row]:
    """Rows as mappings by header; rows without anything go, the sheet's row number stays."""
    if not rows:
        return []
    head = [(h or "").strip() for h in rows[0][1]]
    out = []
    for n, cells in rows[1:]:
        r = {h: (c if c is not None and c.strip(" \t\r\n") else None) for h, c in zip(head, cells + [None] * (len(head) - len(cells)), strict=False) if h}
        if any(v is not None for v in r.values()):
            out.append(r | {"_row": n})
    return out


def _read_workbook(path: str) -> dict[str, Any]:
    sheets = {_same(k): v for k, v in sheets_of(path).items()}
    found = {slot: next((sheets[a] for a in names if a in sheets), None) for slot, names in SHEETS.items()}
    for slot in ("datasets", "variables"):
        if found[slot] is None:
            raise SpecError(f"{path} has no sheet {slot}", sheet=slot)
    tables: dict[str, Any] = {}
    for slot, headers in HEADERS.items():
        by = {_same(h): c for h, c in headers.items()}
        rows = [{by.get(_same(k), k): v for k, v in r.items()} for r in _table(found[slot] or [])]
        if found[slot] is None:
            inform("p21_sheet", f"{path} has no sheet {slot}")
        if slot in _FILLED:  # a merged cell's text stands in its first row only
            last = None
            for r in rows:
                last = r[_FILLED[slot]] = r.get(_FILLED[slot]) or last
        for r in rows:
            for k in [k for k in r if k == "dataset" or k == "variable" or k.endswith("_id")]:
                r[k] = r[k].strip(" \t\r\n") if isinstance(r[k], str) else r[k]
        tables[slot] = rows
    for slot in ("methods", "comments", "documents"):
        tables[slot] = [r for r in tables[slot] if not blank(r.get(f"{slot[:-1]}_id"))]
    for r in tables["variables"]:
        lost = [c for c in ("dataset", "variable", "data_type") if blank(r.get(c))]
        if lost:
            raise SpecError(f"variables, row {r['_row']}: no {', '.join(lost)}", row=r["_row"], columns=lost)
    tables["codelists"] = [r | {"term": r.get("term")} for r in tables["codelists"] if not blank(r.get("term"))]
    known = {r["codelist_id"] for r in tables["codelists"]}
    for r in tables["variables"]:
        r["codelist_id"] = r.get("codelist_id") if r.get("codelist_id") in known else None
    study: dict[str, Any] = {}
    for r in _table(found["study"] or []):
        key = next((v for k, v in r.items() if _same(k) == "attribute"), None)
        if key:
            study.setdefault(key.strip(), next((v for k, v in r.items() if _same(k) == "value"), None))
    return tables | {"study": study or None}


def _sheet(rows: list[list[Any]]) -> str:
    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        text = "Yes" if v is True else "No" if v is False else str(v)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def _write_workbook(spec: Spec, path: str) -> None:
    titles = {"values": "ValueLevel"}
    pages = {"Define": [["Attribute", "Value"], *([_STUDY.get(k, k), v] for k, v in spec.study.items())]}
    for slot, headers in HEADERS.items():
        rows = [dict(r) for r in getattr(spec, slot)]
        for r in rows:
            if r.get("data_type"):
                r["data_type"] = DEFINE_TYPES.get(r["data_type"], r["data_type"])
            if slot == "datasets" and not r.get("standard"):
                r["standard"] = spec.standard
        more = list(dict.fromkeys(k for r in rows for k in r if k not in headers.values() and k not in SLOTS.get(slot, ((), {}))[1]))
        pages[titles.get(slot, slot.capitalize())] = [[*headers, *more], *([r.get(c) for c in [*headers.values(), *more]] for r in rows)]
    base = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(pages) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(pages, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{base}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(pages) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{base}/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(pages.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))


# -- Define-XML -----------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if _local(x.tag) == name]


def _kids(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if _local(x.tag) == name]


def _attr(node: ET.Element | None, name: str) -> str | None:
    """An attribute whatever its namespace; empty ones are absent."""
    if node is None:
        return None
    return next((v.strip() for k, v in node.attrib.items() if _local(k) == name and v.strip()), None)


def _text(node: ET.Element | None, *path: str) -> str | None:
    for p in path:
        node = next(iter(_kids(node, p)), None) if node is not None else None
    text = re.sub(r"\s+", " ", "".join(node.itertext())).strip() if node is not None else ""
    return text or None


def _origin(node: ET.Element) -> dict[str, str | None]:
    o = next(iter(_kids(node, "Origin")), None)
    pages = next((_attr(p, "PageRefs") for p in (_all(o, "PDFPageRef") if o is not None else [])), None)
    return {"origin": _attr(o, "Type"), "source": _attr(o, "Source"), "pages": pages, "predecessor": _text(o, "Description", "TranslatedText") if _attr(o, "Type") == "Predecessor" else None}


def _read_define(path: str) -> dict[str, Any]:
    root = ET.parse(path).getroot()
    versions = next((v for x in _all(root, "MetaDataVersion") for k, v in x.attrib.items() if _local(k) == "DefineVersion"), None)
    if versions is None or not versions.startswith("2"):
        raise CodecError(f"{path}: Define-XML of version 2 is read, this is {versions or 'of none'}", path=path)
    items = {_attr(i, "OID"): i for i in _all(root, "ItemDef")}
    lists = {_attr(c, "OID"): c for c in _all(root, "CodeList") if not _kids(c, "ExternalCodeList")}
    wheres = {_attr(w, "OID"): w for w in _all(root, "WhereClauseDef")}
    value_lists = {_attr(v, "OID"): v for v in _all(root, "ValueListDef")}
    datasets, variables, values = [], [], []
    for g in _all(root, "ItemGroupDef"):
        name = _attr(g, "Name")
        refs = _kids(g, "ItemRef")
        keyed = sorted(((int(_attr(r, "KeySequence")), r) for r in refs if _attr(r, "KeySequence")), key=lambda x: x[0])
        missing = [_attr(r, "ItemOID") for r in refs if _attr(r, "ItemOID") not in items]
        if missing:
            raise CodecError(f"{path}: {name} refers to items that aren't defined: {', '.join(missing)}", items=missing)
        label = _text(g, "Description", "TranslatedText")
        kind = _attr(next(iter(_kids(g, "Class")), None), "Name") or _attr(g, "Class")
        datasets.append({"dataset": name, "label": label, "class": kind, "structure": _attr(g, "Structure"), "keys": " ".join(_attr(items[_attr(r, "ItemOID")], "Name") for _, r in keyed) or None, "comment_id": _attr(g, "CommentOID")})
        for i, r in enumerate(refs, 1):
            d = items[_attr(r, "ItemOID")]
            variables.append(_item(d, lists) | {"dataset": name, "variable": _attr(d, "Name"), "itemoid": _attr(d, "OID"), "order": int(_attr(r, "OrderNumber") or i), "key_sequence": int(_attr(r, "KeySequence")) if _attr(r, "KeySequence") else None, "mandatory": _attr(r, "Mandatory") == "Yes", "method_id": _attr(r, "MethodOID"), "role": _attr(r, "Role")})
            for link in _kids(d, "ValueListRef"):
                for j, vr in enumerate(_kids(value_lists[_attr(link, "ValueListOID")], "ItemRef"), 1):
                    v = items[_attr(vr, "ItemOID")]
                    clause = " AND ".join(_where(wheres[_attr(w, "WhereClauseOID")], items) for w in _kids(vr, "WhereClauseRef"))
                    values.append({k: x for k, x in _item(v, lists).items() if k in ("label", "data_type", "length", "codelist_id", "comment_id")} | {"dataset": name, "variable": _attr(d, "Name"), "where_clause": clause or None, "method_id": _attr(vr, "MethodOID"), "order": j, "mandatory": _attr(vr, "Mandatory") == "Yes"})
    codelists = []
    for oid, c in lists.items():
        for i, item in enumerate([x for x in c if _local(x.tag) in ("CodeListItem", "EnumeratedItem")], 1):
            codelists.append({"codelist_id": oid, "term": _attr(item, "CodedValue"), "decode": _text(item, "Decode", "TranslatedText"), "order": int(_attr(item, "OrderNumber") or i), "extended": _attr(item, "ExtendedValue") == "Yes", "comment_id": _attr(c, "CommentOID")})
    described = lambda x: _text(x, "Description", "TranslatedText")
    document = lambda x: next((_attr(r, "leafID") for r in _all(x, "DocumentRef")), None)
    expr = lambda m: next(iter(_kids(m, "FormalExpression")), None)
    study = next(iter(_all(root, "GlobalVariables")), None)
    standard = next((" ".join(filter(None, (_attr(s, "Name"), _attr(s, "Version")))) for s in _all(root, "Standard") if _attr(s, "Type") == "IG"), None)
    return {
        "datasets": datasets, "variables": variables, "values": values, "codelists": codelists,
        "methods": [{"method_id": _attr(m, "OID"), "name": _attr(m, "Name"), "type": _attr(m, "Type"), "description": described(m), "expression_context": _attr(expr(m), "Context"), "expression_code": _text(expr(m)) if expr(m) is not None else None, "document_id": document(m)} for m in _all(root, "MethodDef")],
        "comments": [{"comment_id": _attr(c, "OID"), "description": described(c), "document_id": document(c)} for c in _all(root, "CommentDef")],
        "documents": [{"document_id": _attr(x, "ID"), "title": _text(x, "title"), "href": _attr(x, "href")} for x in _all(root, "leaf")],
        "study": {"study_name": _text(study, "StudyName"), "study_description": _text(study, "StudyDescription"), "protocol_name": _text(study, "ProtocolName")} if study is not None else None,
        "standard": standard,
    }


def _item(d: ET.Element, lists: dict[str | None, ET.Element]) -> Row:
    ref = next((_attr(c, "CodeListOID") for c in _kids(d, "CodeListRef")), None)
    number = lambda n: int(_attr(d, n)) if _attr(d, n) else None
    return {"label": _text(d, "Description", "TranslatedText"), "data_type": _attr(d, "DataType"), "length": number("Length"), "significant_digits": number("SignificantDigits"), "display_format": _attr(d, "DisplayFormat"), "codelist_id": ref if ref in lists else None, "comment_id": _attr(d, "CommentOID"), **_origin(d)}


def _where(w: ET.Element, items: dict[str | None, ET.Element]) -> str:
    """A condition as text; it is carried, never evaluated."""
    parts = []
    for r in _kids(w, "RangeCheck"):
        name = _attr(items[_attr(r, "ItemOID")], "Name") if _attr(r, "ItemOID") in items else _attr(r, "ItemOID")
        checked, sign = [_text(c) or "" for c in _kids(r, "CheckValue")], _attr(r, "Comparator")
        parts.append(f"{name} {sign} ({', '.join(checked)})" if sign in ("IN", "NOTIN") else f"{name} {sign} {', '.join(checked)}")
    return " AND ".join(parts)
