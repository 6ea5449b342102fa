"""Operator 10, personal data: anchors by Aho-Corasick, expanded by local parsers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, table, text_of

#: Kinds of the base rules, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("url", "iban", "account")
#: Cues of account numbers, as written or capitalised.
CUES = ("account", "acct", "konto", "cuenta", "compte", "ssn", "passport")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IP_SIGNS, _CARD_SIGNS = frozenset("0123456789."), frozenset("0123456789 -")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}\Z")
_URL = re.compile(r"[^\s<>\"'`]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:\x20?(?:no\.?|number|nr\.?|#))?\x20?[:=#]?\x20?([0-9](?:[0-9-]{4,20})[0-9])")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """All anchors: signs, digit pairs by rule, and cues."""
    a = ahocorasick.Automaton()
    found: dict[str, str] = {"@": "email", "://": "url", "IBAN": "iban"}
    for d in "0123456789":
        found[f"+{d}"] = "phone"
        for e in "0123456789":
            found[f"{d}.{e}"] = "ip"
            for gap in ("", " ", "-"):
                found[f"{d}{gap}{e}"] = "card"
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found[form] = "account"
    for sign, kind in found.items():
        a.add_word(sign, (kind, len(sign)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _zone(text: str, at: int, signs: frozenset) -> tuple[int, int]:
    """The run of ``signs`` around a place."""
    lo = hi = at
    while lo and text[lo - 1] in signs:
        lo -= 1
    while hi < len(text) and text[hi] in signs:
        hi += 1
    return lo, hi


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind and start.

    Each anchor is expanded to the run of signs that any match around it must lie in, so what the parser finds there
    is what a search of the whole text finds. A run is parsed once.
    """
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    done = {k: 0 for k in spans}
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "email":
            lo = at
            while lo > done[kind] and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                spans[kind].append((lo, m.end()))
                done[kind] = m.end()
        elif at < done[kind]:
            continue
        elif kind == "ip":
            lo, hi = _zone(text, at, _IP_SIGNS)
            done[kind] = hi
            spans[kind] += [m.span() for m in _IP.finditer(text, lo, hi) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        elif kind == "card":
            lo, hi = _zone(text, at, _CARD_SIGNS)
            done[kind] = hi
            for m in _CARD.finditer(text, lo, hi):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans[kind].append(m.span())
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans[kind].append(m.span())
        elif kind == "url":
            head = _SCHEME.search(text, max(0, at - 16), at)
            tail = _URL.match(text, at + 3)
            if head and tail:
                end = at + 3 + len(tail[0].rstrip(".,;:!?)]}"))
                if end > at + 3:
                    spans[kind].append((head.start(), end))
                    done[kind] = end
        elif kind == "iban":
            if m := _IBAN.search(text, last + 1, last + 48):
                code = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    spans[kind].append(m.span())
                    done[kind] = m.end()
        elif kind == "account" and (m := _ACCOUNT.match(text, last + 1)):
            spans[kind].append(m.span(1))
            done[kind] = m.end()
    return [(k, *s) for k, v in spans.items() for s in v]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, for each whole text.

    Null and empty texts have none. Null and repeated ids get a row each; extra columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                spans = find(t)
                base = [s for s in spans if s[0] in BASE]
                for column, v in zip(out, [*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)], strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])], [b.schema.names[0], *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    d, (i, t) = by_place(docs, id_col, text_col)
    rows = d.select(F.col(i).alias(id_col), text_of(t).alias("_text"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(search, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for k, s, e in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join([*out, text[at:]])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
