import zlib
from collections import Counter

from veraframe.llm.quality_classifier import classify, fit_quality, keep_quality, op6_quality_classifier
from veraframe.llm.quality_rules import apply_rules, calibrate, counts, fit_rules, op8_quality_rules

import numpy as np

from veraframe.llm.words import Features, Ftrl, margin

from .helpers import MIDDLE, WORD, empty_documents, odd_documents, rows


def brute(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts():
    for text in ("", " ", "a b c d e a b c d e", "x\nx\n\n\nx y\nx y #|", "é ü z\x0b\x85 q", "a " * 40):
        assert counts(text) == brute(text), text


def test_rules_of_documents(spark):
    text = {r.doc_id: r.text or "" for r in rows(spark, "documents", MIDDLE).collect()}
    quality = {r.doc_id: r.quality for r in rows(spark, "labels", MIDDLE).collect()}
    right, n = 0, 0
    for r in op8_quality_rules(spark, MIDDLE).collect():
        want = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
        if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            n += 1
            right += (r.probability >= 0.5) == bool(quality[r.doc_id])
    assert n > 50 and right >= 0.95 * n


def test_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in rows(spark, "labels", MIDDLE).collect()}
    got = op6_quality_classifier(spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 50


def test_calibration_is_monotone_and_centred():
    rng = np.random.default_rng(0)
    m = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * m - 1)))).astype(int)
    slope, shift = calibrate(m, y)
    assert abs(slope - 3) < 0.4 and abs(shift + 1) < 0.3
    assert calibrate(m, np.ones(4000, int)) == (1.0, 0.0)


def test_updates_against_a_plain_loop():
    """Follow-the-regularised-leader written out for one coordinate at a time, and scores as plain sums."""
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5), int(rng.random() < 0.5)) for _ in range(200)]
    model = Ftrl(30)
    z, n = [0.0] * 31, [0.0] * 31
    weight = lambda i: 0.0 if abs(z[i]) <= 0.001 else -(z[i] - (0.001 if z[i] > 0 else -0.001)) / ((1 + n[i] ** 0.5) + 0.01)
    for at, x, y in rows:
        model.learn(at, x, y, 1.5)
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (30, 1.0)]
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in pairs)))
        for i, v, w in [(i, v, weight(i)) for i, v in pairs]:
            g = (p - y) * v * 1.5
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) * w
            n[i] += g * g
    want = np.array([weight(i) for i in range(31)])
    assert np.allclose(model.weights(), want)
    at, x, _ = rows[0]
    assert abs(margin(want, at, x) - (sum(want[i] * v for i, v in zip(at, x, strict=True)) + want[30])) < 1e-12


def test_features_against_a_plain_count():
    f = Features(bits=18, words=2)
    at, x = f("one two one two three")
    grams = Counter(["one", "two", "one", "two", "three"]) + Counter([("one", "two"), ("two", "one"), ("one", "two"), ("two", "three")])
    assert np.allclose(np.sort(x), np.sort([(n / 9) ** 0.5 for n in grams.values()])) and len(set(at.tolist())) == len(grams)


def test_probabilities_are_those_of_the_margin(spark):
    docs, labels = rows(spark, "documents"), rows(spark, "labels")
    v = fit_rules(docs, labels)
    f = Features(18, 2, 4)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in apply_rules(docs, v).collect():
        at, x = f(text[r.doc_id])
        m = sum(float(v.weights[i]) * w for i, w in zip(at, x, strict=True)) + float(v.weights[-1])
        assert abs(r.probability - 1 / (1 + np.exp(-np.clip(v.slope * m + v.shift, -30, 30)))) < 1e-4
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_odd_rows(spark):
    docs, labels = odd_documents(spark), rows(spark, "labels", MIDDLE)
    w = fit_quality(rows(spark, "documents", MIDDLE), labels)
    assert classify(docs, w).count() == docs.count() == apply_rules(docs, fit_rules(docs, labels)).count()
    assert keep_quality(docs, w).columns == docs.columns
    none = fit_quality(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(empty_documents(spark), w).count() == 0 == apply_rules(empty_documents(spark), fit_rules(docs, labels)).count()
