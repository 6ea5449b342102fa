"""Token ids by a public tokenizer, for use inside tasks.

A byte-level BPE splits a text into pieces by a pattern and merges within pieces, so a piece has the same ids
wherever it stands. Pieces are looked up in a bounded cache which the library itself fills. That is done only for
texts whose every character is among those for which the split is certain; other texts, and those that hold the
string of a special token, go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np

#: Printable ASCII, tab, line feed, carriage return, Latin-1 without its odd spaces, Latin Extended, common punctuation.
PLAIN = "[\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*"
_SPACE, _NUMBER = r"\t\n\r\x20", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Fixed value: the split pattern of the vocabulary's pre-tokenizer, its classes spelt out for the signs of PLAIN.
SPLIT = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Pieces a cache holds; it is emptied when full.
CACHE = 800_000


class Counter:
    """Ids of whole texts as ``tokenizers`` gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.split, self.plain = re.compile(SPLIT), re.compile(PLAIN)
        self.by_piece: dict[str, bytes] = {}
        self.quick = self._has_pattern()

    def _has_pattern(self) -> bool:
        """Whether the vocabulary is a byte-level one that the cache is right for."""
        import json

        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex", True))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, plain = self.by_piece, self.plain.fullmatch
        special = [s for s in self.special if any(s in t for t in texts)]
        quick = [self.quick and plain(t) is not None and not any(s in t for s in special) for t in texts]
        pieces = [self.split.findall(t) if q else None for t, q in zip(texts, quick, strict=True)]
        if len(known) > CACHE:
            known.clear()
        new = list(set().union(*(p for p in pieces if p)).difference(known))
        known.update(zip(new, self._library(new), strict=True))
        rest = iter(self._library([t for t, q in zip(texts, quick, strict=True) if not q]))
        return [b"".join(map(known.__getitem__, p)) if p is not None else next(rest) for p in pieces]


def version_digest(path: str) -> str:
    """Names a tokenizer: its file's bytes, the library's version and how it is called."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|tokenizers {tokenizers.__version__}|plain".encode()).hexdigest()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One Counter for each Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]
