from collections import Counter, defaultdict

import pytest

from veraframe.llm.mixing import Mix, mix_documents, mixed_shards, op2_mixing, permuted

from .helpers import MIDDLE, WORD, empty_documents, odd_documents, rows


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 64, 290, 709, 4001):
        got = [[r.p for r in permuted(spark.range(n), "p", F.col("id"), F.lit(n), F.lit(seed)).orderBy("id").collect()] for seed in (3, 4)]
        assert all(sorted(g) == list(range(n)) for g in got)
        if n > 50:
            assert got[0] != got[1] and len({(b - a) % n for a, b in zip(got[0], got[0][1:], strict=False)}) > n // 4


@pytest.mark.parametrize("folder", [MIDDLE])
def test_mix(spark, folder):
    docs = rows(spark, "documents", folder)
    got = op2_mixing(spark, folder).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in got} == size
    by = defaultdict(int)
    for r in got:
        by[r.source] += r["size"]
    want = filled(by)
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(80, 0.02 * want[s])
    assert sorted(op2_mixing(spark, folder).collect()) == sorted(got)


def test_shards_are_drawn_and_set_right(spark):
    mix = Mix(rows(spark, "documents"), shard_slots=50)
    slots, sources = mix.slots.collect(), {r.source_no: r for r in mix.sources.collect()}
    n, last = len(slots), max(r.shard for r in slots)
    assert {(r.shard, r["at"]) for r in slots} == {divmod(k, 50) for k in range(n)}
    assert {(r.source_no, r.slot) for r in slots} == {(s.source_no, k) for s in sources.values() for k in range(s.slots)}
    for s in sources.values():
        passes = Counter(r.block for r in slots if r.source_no == s.source_no)
        assert set(passes) <= set(range(s.n)) and max(passes.values(), default=0) - (min(passes.values()) if len(passes) == s.n else 0) <= 1
    drawn = {(r.shard, r.source_no): r.blocks for r in mix.draws().collect()}
    assert sum(drawn.values()) == n and last > 3
    # A draw has the variance of a multinomial one, not that of a dealing of equal strides.
    big = max(sources.values(), key=lambda s: s.slots)
    p = big.slots / n
    spread = [(drawn.get((k, big.source_no), 0) - 50 * p) ** 2 / (50 * p * (1 - p)) for k in range(last)]
    assert 0.5 < sum(spread) / len(spread) < 1.7


def test_taken_against_slots(spark):
    """Taken words by plain counting: the words of a document that lie in a block, for each slot of that block."""
    docs = rows(spark, "documents")
    mix = Mix(docs)
    slots = defaultdict(list)
    for r in mix.slots.collect():
        slots[r.source_no, r.block].append(r.shard)
    want = Counter()
    for d in mix.docs.collect():
        hits = [slots[d.source_no, (d.start + k) // 64] for k in range(d["size"])]
        want[d.doc_id, sum(map(len, hits)), min((x for h in hits for x in h), default=None)] += 1
    assert Counter((r.doc_id, r.taken, r.first_shard) for r in mix.taken().collect()) == want
    for s in mix.sources.collect():
        at = sorted((d.start, d["size"]) for d in mix.docs.where(f"source_no = {s.source_no} and size > 0").collect())
        assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]


def test_repeated_rows_of_a_source_that_is_cut(spark):
    rng, word = __import__("random").Random(4), lambda: f"w{rng.randrange(999)}"
    data = [(i, " ".join(word() for _ in range(rng.randrange(1, 160))), "big" if i % 2 else "small") for i in range(80)]
    data = [(None if i % 10 == 3 else i // 3, t, s) for i, t, s in data]
    data += data[:40] + data[1:9:2] * 7
    docs = spark.createDataFrame([(*r, "s1", 5) for r in data], "doc_id long, text string, source string, Source_ string, `a.b` int")
    taken, got, dealt = Counter(), Counter(), Counter()
    settings = {"weights": (1, 5), "block_words": 16, "shard_slots": 32}
    for r in Mix(docs, **settings).taken().collect():
        taken[r.doc_id] += r.taken
    for r in mix_documents(docs, **settings).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    places = defaultdict(int)
    for r in mixed_shards(docs, **settings).collect():
        dealt[r.doc_id] += len(WORD.findall(r.text))
        places[r.shard, r["at"]] += len(WORD.findall(r.text))
    words = sum(len(t.split()) for _, t, _ in data)
    assert got == dealt == Counter({k: v for k, v in taken.items() if v}) and 0.97 * words < sum(got.values()) < 1.03 * words
    assert max(places.values()) <= 16 and len(places) == len({(k // 32, k % 32) for k in range(len(places))})


def test_mixed_texts_hold_what_is_taken(spark):
    docs = rows(spark, "documents")
    taken = {r.doc_id: r.taken for r in Mix(docs).taken().collect()}
    got = Counter()
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = Mix(docs).taken().collect()
    assert len(got) == docs.count()
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mix_documents(docs).columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mix_documents(docs).collect())
    assert words == sum(r.taken for r in got)
    assert Mix(empty_documents(spark)).taken().count() == 0
    assert mix_documents(empty_documents(spark)).count() == 0
