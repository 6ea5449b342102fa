import random

import numpy as np
import pytest

from veraframe.llm.embedding_dedup import ProductCode, near_vectors, op3_embedding_dedup, tables_for
from veraframe.llm.minhash import COORDINATES, LEAST_MATCHES, PREFIX, TALLY_BITS, _tally, coordinate_values, near_duplicates, op5_minhash, prefix
from veraframe.llm.graph import components
from veraframe.llm.common import Scratch

from .helpers import MIDDLE, WORD, empty_documents, odd_documents, rows, union_find

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, union_find(pairs, ids)


def test_documents_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in rows(spark, "documents", MIDDLE).collect()]
    sets, want = linked(docs, 2)
    got = {r.doc_id: r for r in op5_minhash(spark, MIDDLE).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_chains_of_near_copies(spark):
    rng = random.Random(3)
    docs, at = [], 0
    for _ in range(6):
        w = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 300]))]
        for _ in range(25):
            docs.append((at, " ".join(w)))
            at += 1
            w = list(w)
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    for k in (2, 5):
        want = linked(docs, k)[1]
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=k).collect()}
        assert got == want


def test_prefixes_of_agreeing_signatures_meet():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (300, COORDINATES)).astype(np.uint32)
    y = x.copy()
    for row in y:
        at = rng.permutation(COORDINATES)[: COORDINATES - LEAST_MATCHES]
        row[at] = rng.integers(50, 90, len(at))
    tally = np.bincount(_tally(coordinate_values(np.concatenate([x, y]))).ravel(), minlength=1 << TALLY_BITS)
    for a, b in zip(prefix(x, tally)[1], prefix(y, tally)[1], strict=True):
        assert len(a) == PREFIX and set(a.tolist()) & set(b.tolist())


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = near_duplicates(docs, words=2).collect()
    assert len(got) == docs.count() and len({r.row for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[6] == [(0, 6)]
    assert by[8][0][1] == 1 and by[5][0][1] == 4 and by[10][0][1] == 9
    assert near_duplicates(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, num=70)
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_one_row_of_each_group(spark):
    """Repeated rows, repeated ids and null ids: the first row of a group is one of the smallest id."""
    t, u = (" ".join(f"{k}{i}" for i in range(40)) for k in "tu")
    data = [(1, t), (1, t), (3, t + " end"), (3, u), (None, u + " end"), (None, u), (None, "a b"), (None, "a b"), (5, ""), (5, "")]
    got = near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, TEXT int, `a.b` string")).collect()
    first = [r for r in got if r.row == r.first_row]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in first) == [(False, 1), (False, 3), (False, 5), (False, 5), (True, 0)]
    assert {r.component_id for r in got} == {1, 3, 5, None}


def brute_vectors(data, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in data if v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    links, pairs = {i: 0 for i, _ in data}, []
    for a, (i, x) in enumerate(ok):
        for j, y in ok[a + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return links, union_find(pairs, [i for i, _ in data])


def test_embeddings_against_all_pairs(spark):
    data = [(r.vec_id, r.embedding) for r in rows(spark, "embeddings", MIDDLE).collect()]
    links, want = brute_vectors(data)
    got = {r.vec_id: r for r in op3_embedding_dedup(spark, MIDDLE).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert all(got[i].n_links <= n for i, n in links.items())
    assert all(want[i] <= r.component_id for i, r in got.items())


def test_planted_vectors(spark):
    rng, data = np.random.default_rng(1), []
    for g in range(12):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        for i in range(30):
            z = rng.standard_normal(64)
            z -= (z @ x) * x
            c = rng.uniform(0.96, 0.999)
            data.append((100 * g + i, (c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist()))
        data.append((100 * g + 50, data[-1][1]))
    data += [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [None] * 64), (5004, [1.0] * 64), (5005, [2.0] * 64), (5006, [1.0, 1.0])]
    links, want = brute_vectors(data)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, v string")).collect()}
    assert len(got) == len(data)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(want[i] == r.component_id for i, r in got.items()) >= 0.98 * len(data)
    assert all(got[i].n_links == 0 and got[i].kept for i in (5000, 5001, 5002, 5003))
    assert got[5004].n_links == got[5005].n_links == 1
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decoding_lists_all_filters():
    for parts in (2, 4):
        code, rng = ProductCode(16, parts, 6, 2.0), np.random.default_rng(2)
        v = rng.standard_normal((20, 16))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        row, found = code.decode(v)
        for k, x in enumerate(v):
            r, sums = code.rotation @ x, np.zeros(1)
            for t, cut in zip(code.tables, code.cuts, strict=True):
                sums = (sums[:, None] + (t @ r[cut])[None, :]).ravel()
            assert found[row == k].tolist() == np.flatnonzero(sums >= code.height).tolist()


def test_codes_are_as_many_as_recall_takes():
    assert 5 < tables_for(64, 1024, 3, 0.95) < tables_for(64, 1024, 3, 0.8)
    assert tables_for(64, 4096, 3, 0.95) >= tables_for(64, 64, 3, 0.95)
    with pytest.raises(ValueError):
        tables_for(64, 1024, 3, 0.3)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test"), "t").collect())
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
