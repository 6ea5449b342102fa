import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veraframe.llm.packing import op7_packing, pack
from veraframe.llm.token_counts import count_tokens, op1_token_counts
from veraframe.llm.tokens import Counter

from .helpers import MIDDLE, SMALL, empty_documents, odd_documents, rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library):
    mine, rng = Counter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    signs = list("ab Z9'séçß \n\t\r.,!?-_  ’\x1c\x85\x0b€١漢😀") + ["<|endoftext|>", "  ", "'ll", " the"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(mine.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_library(spark, library):
    got = {r.doc_id: r for r in op1_token_counts(spark, MIDDLE).collect()}
    for r in rows(spark, "documents", MIDDLE).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 512)


def test_second_run_encodes_nothing(spark, tmp_path):
    docs, cache = rows(spark, "documents"), str(tmp_path / "cache")
    first = count_tokens(docs, cache).collect()
    stored = spark.read.parquet(cache).count()
    assert stored == docs.select("text").distinct().count()
    assert sorted(count_tokens(docs, cache).collect()) == sorted(first)
    assert spark.read.parquet(cache).count() == stored
    more = docs.selectExpr("doc_id", "concat(text, ' more') text")
    assert count_tokens(docs.select("doc_id", "text").union(more), cache).count() == 2 * docs.count()
    assert spark.read.parquet(cache).count() == 2 * stored


def test_odd_counts(spark, tmp_path, library):
    docs = odd_documents(spark)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs, str(tmp_path / "c")).collect())
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert got == want
    assert count_tokens(empty_documents(spark), str(tmp_path / "d")).count() == 0


def check_packing(pieces, docs, library, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += p.length
        assert at == len(ids)
    last = max(by_sequence, default=-1)
    assert sorted(by_sequence) == list(range(last + 1))
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == last and at < length


def test_packing_round_trip(spark, library):
    check_packing(op7_packing(spark, SMALL).collect(), rows(spark, "documents").collect(), library, 2048)
    docs = rows(spark, "documents").repartition(7)
    check_packing(pack(docs, length=100).collect(), docs.collect(), library, 100)


def test_odd_packing(spark, library):
    docs = odd_documents(spark)
    pieces = pack(docs, length=64, with_ids=True).collect()
    assert sum(p.length for p in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    assert pack(empty_documents(spark)).count() == 0
