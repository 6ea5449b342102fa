"""Character sets and the folding of characters that a set lacks."""

from __future__ import annotations

import codecs
import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import InputError

#: Names of character sets as sessions and files give them.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "ansi": "US-ASCII",
    "wlatin1": "WINDOWS-1252", "wlt1": "WINDOWS-1252", "cp1252": "WINDOWS-1252", "wlatin2": "WINDOWS-1250",
    "wlt2": "WINDOWS-1250", "cp1250": "WINDOWS-1250", "wcyrillic": "WINDOWS-1251", "wcyr": "WINDOWS-1251",
    "cp1251": "WINDOWS-1251", "wgreek": "WINDOWS-1253", "wgrk": "WINDOWS-1253", "wturkish": "WINDOWS-1254",
    "wtur": "WINDOWS-1254", "whebrew": "WINDOWS-1255", "warabic": "WINDOWS-1256", "wara": "WINDOWS-1256",
    "wbaltic": "WINDOWS-1257", "wbal": "WINDOWS-1257", "wvietnamese": "WINDOWS-1258", "wvie": "WINDOWS-1258",
    "latin1": "ISO-8859-1", "lat1": "ISO-8859-1", "latin2": "ISO-8859-2", "lat2": "ISO-8859-2", "latin3": "ISO-8859-3",
    "cyrillic": "ISO-8859-5", "arabic": "ISO-8859-6", "greek": "ISO-8859-7", "hebrew": "ISO-8859-8",
    "turkish": "ISO-8859-9", "thai": "ISO-8859-11", "latin7": "ISO-8859-13", "latin9": "ISO-8859-15",
    "lat9": "ISO-8859-15", "latin10": "ISO-8859-16", "pcoem437": "CP437", "pcoem850": "CP850", "pcoem852": "CP852",
    "pcoem858": "CP858", "pcoem862": "CP862", "pcoem866": "CP866", "msdos737": "CP737", "shift-jis": "SHIFT_JIS",
    "sjis": "SHIFT_JIS", "ms-932": "CP932", "euc-jp": "EUC-JP", "jeuc": "EUC-JP", "ms-936": "CP936", "euc-cn": "EUC-CN",
    "ms-949": "CP949", "euc-kr": "EUC-KR", "ms-950": "CP950", "windows-1252": "WINDOWS-1252",
    "windows-1250": "WINDOWS-1250", "windows-1251": "WINDOWS-1251", "iso-8859-1": "ISO-8859-1",
    "iso-8859-2": "ISO-8859-2", "iso-8859-15": "ISO-8859-15",
}

#: One set by its names in R, SAS and Python, and what it is for.
ENCODINGS = (
    ("UTF-8", "UTF-8", "utf_8", "Unicode, for any language"),
    ("US-ASCII", "ASCII", "ascii", "seven bits, as regulators ask of transport files"),
    ("windows-1252", "WLATIN1", "cp1252", "Western Europe on Windows"),
    ("windows-1250", "WLATIN2", "cp1250", "Central Europe on Windows"),
    ("windows-1251", "WCYRILLIC", "cp1251", "Cyrillic on Windows"),
    ("ISO-8859-1", "LATIN1", "latin_1", "Western Europe on Unix"),
    ("ISO-8859-15", "LATIN9", "iso8859_15", "Western Europe with the euro sign"),
    ("CP437", "PCOEM437", "cp437", "DOS, United States"),
    ("CP850", "PCOEM850", "cp850", "DOS, Western Europe"),
    ("Shift_JIS", "SHIFT-JIS", "shift_jis", "Japanese"),
    ("CP932", "MS-932", "cp932", "Japanese on Windows"),
    ("EUC-JP", "EUC-JP", "euc_jp", "Japanese on Unix"),
    ("EUC-KR", "EUC-KR", "euc_kr", "Korean"),
    ("CP936", "MS-936", "gbk", "simplified Chinese on Windows"),
    ("CP950", "MS-950", "cp950", "traditional Chinese on Windows"),
)

#: Typographic punctuation and its plain form.
PUNCTUATION = {
    "‚": ",", "„": '"', "…": "...", "‹": "<", "‘": "'", "’": "'", "“": '"',
    "”": '"', "•": "*", "–": "-", "—": "-", "›": ">",
}
#: Western letters and signs that lose more than an accent.
SIGNS = {
    "ƒ": "f", "ˆ": "^", "Œ": "OE", "˜": "~", "œ": "oe", " ": " ", "¡": "!",
    "©": "(C)", "«": "<<", "­": "-", "®": "(R)", "±": "+/-", "»": ">>", "¼": " 1/4",
    "½": " 1/2", "¾": " 3/4", "¿": "?", "Æ": "AE", "Ð": "D", "×": "*", "Ø": "O",
    "Þ": "TH", "ß": "ss", "æ": "ae", "ð": "d", "÷": "/", "ø": "o", "þ": "th",
}


@lru_cache(1)
def ascii_folds() -> dict[str, str]:
    """Signs, and by rule the accented letters of Western Europe without their accent."""
    accented = [*map(chr, range(0xC0, 0x100)), "Š", "Ž", "š", "ž", "Ÿ"]
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in accented if len(unicodedata.normalize("NFD", c)) == 2}
    return SIGNS | plain


@lru_cache(256)
def charset(name: str) -> str:
    """The canonical name of a character set; an unknown one is an error."""
    known = CHARSETS.get(name.strip().lower(), name.strip())
    try:
        codecs.lookup(python_codec(known))
    except LookupError:
        raise InputError(f"{name!r} is no character set that is known here", encoding=name) from None
    return known.upper()


def python_codec(name: str) -> str:
    return {"WINDOWS-1252": "cp1252", "EUC-CN": "gb2312", "ISO-8859-11": "iso8859_11", "US-ASCII": "ascii"}.get(name.upper(), re.sub(r"^WINDOWS-", "cp", name.upper()).lower())


def fold(c: Column, table: dict[str, str]) -> Column:
    """Replace single characters: one-to-one pairs in one pass, then those that become several."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values())) if single else c
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in table.items() if len(v) != 1), out)


def fold_punctuation(c: Column) -> Column:
    return fold(c, PUNCTUATION)


def fold_ascii(c: Column) -> Column:
    return fold(fold_punctuation(c), ascii_folds())


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def composable(c: Column) -> Column:
    """Whether composing might change a text: only characters from U+0300 on compose or are composed otherwise."""
    return F.coalesce((F.octet_length(c) != F.length(c)) & F.regexp_like(c, F.lit("[^\\x{0}-\\x{2ff}]")), F.lit(False))


def nfc(c: Column) -> Column:
    """Unicode's composed form. Spark runs a Python function over all rows whatever stands around it, so those that can't change go there as nulls."""
    return F.coalesce(_nfc(F.when(composable(c), c)), c)


def encodable(name: str):
    """A function of a text column: whether the character set has all its characters."""
    codec = python_codec(charset(name))

    @F.pandas_udf("boolean")
    def check(x: pd.Series) -> pd.Series:
        def one(v: str) -> bool:
            try:
                v.encode(codec)
            except UnicodeEncodeError:
                return False
            return True

        return x.map(one, na_action="ignore")

    return lambda c: F.coalesce(check(F.when(F.octet_length(c) != F.length(c), c)), F.lit(True))


#: What to do with characters that a set lacks.
POLICIES = ("error", "translit", "fold", "replace", "ignore")


def to_charset(c: Column, name: str, policy: str = "error") -> Column:
    """Text that the character set can hold, after a policy: folds first where asked, then one ``?`` for a character, or none.

    ``error`` leaves the text; the caller counts what is not encodable and stops.
    """
    if policy not in POLICIES:
        raise InputError(f"on_invalid is one of {', '.join(POLICIES)}", policy=policy)
    if policy == "error" or charset(name) == "UTF-8":
        return nfc(c)
    codec = python_codec(charset(name))
    handler = "ignore" if policy == "ignore" else "replace"
    table = {"fold": PUNCTUATION, "translit": PUNCTUATION | ascii_folds()}.get(policy, {})

    @F.pandas_udf("string")
    def change(x: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            v = unicodedata.normalize("NFC", v)
            out = []
            for ch in v:
                try:
                    ch.encode(codec)
                    out.append(ch)
                except UnicodeEncodeError:
                    out.append(table.get(ch, ch).encode(codec, handler).decode(codec))
            return "".join(out)

        return x.map(one, na_action="ignore")

    return F.coalesce(change(F.when(F.octet_length(c) != F.length(c), c)), c)


def cut_bytes(text: str, most: int, codec: str = "utf-8") -> str:
    """The longest start of a text of at most ``most`` bytes that splits no character."""
    while len(text.encode(codec)) > most:
        text = text[: min(len(text) - 1, most)]
    return text

