import random

import corpus_pipeline
from veraframe.llm.line_dedup import dedup_lines, op9_line_dedup

from .helpers import SMALL, WORD, empty_documents, odd_documents, rows


def longest_earlier(docs):
    """By a plain suffix array: for each (place in docs, line) the most lines that it shares with an earlier suffix."""
    lines = [t.split("\n") for _, t in docs]
    at = [(d, i) for d, ls in enumerate(lines) for i in range(len(ls))]
    rest = {(d, i): lines[d][i:] for d, i in at}
    order = sorted(at, key=lambda p: (rest[p], p))

    def common(p, q):
        n = 0
        while n < min(len(rest[p]), len(rest[q])) and rest[p][n] == rest[q][n]:
            n += 1
        return n

    lcp = [common(p, q) for p, q in zip(order, order[1:], strict=False)]
    longest = {}
    for k, p in enumerate(order):
        best = 0
        for step in (-1, 1):
            shared, x = len(rest[p]), k
            while shared > best and 0 <= x + step < len(order):
                shared = min(shared, lcp[min(x, x + step)])
                x += step
                if order[x] < p:
                    best = max(best, shared)
                    break
        longest[p] = best
    return lines, longest


def brute(docs, least):
    """Texts without the later copies of maximal repeated runs that hold ``least`` words; ``docs`` in order."""
    lines, longest = longest_earlier(docs)
    gone = {d: set() for d in range(len(docs))}
    for (d, i), m in longest.items():
        if m and sum(len(WORD.findall(x)) for x in lines[d][i : i + m]) >= least:
            gone[d].update(range(i, i + m))
    return {docs[d][0]: "\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls in enumerate(lines)}


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_runs_against_a_suffix_array(spark):
    rng = random.Random(7)
    few, many = ["a b", "c", "", "d e f", "g h i j", "k", "l m n o p q r"], [f"own {i} x" for i in range(40)]
    for lines, docs_, longest in ((few, 40, 9), (["x", "", "y z"], 12, 30), (few + many, 60, 12)):
        docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, longest)))) for i in range(docs_)]
        docs += [(docs_ + i, docs[i][1] + "\n" + docs[i + 1][1]) for i in range(6)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        for least in (1, 4, 9) if lines is few else (3,):
            assert texts_of(dedup_lines(df, least)) == brute(docs, least)


def test_corpus(spark):
    docs = sorted((r.doc_id, r.text) for r in rows(spark, "documents").collect())
    df = rows(spark, "documents")
    assert texts_of(op9_line_dedup(spark, SMALL)) == brute(docs, 1)
    assert texts_of(dedup_lines(df, 10)) == brute(docs, 10)


def test_very_many_blank_lines(spark):
    """Spans are united, not unfolded: a text of L blank lines would else give L * L / 2 lines to delete."""
    blank = "\n" * 100_000
    docs = [(1, f"first\n{blank}last"), (2, f"first\n{blank}last"), (3, f"own\n{blank}end")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "" and got[2].emptied and got[3].text == docs[2][1]


def test_short_runs_go_from_op9_and_the_pipeline(spark, tmp_path):
    docs = [(i, f"own text {i}\nall rights reserved\n\nmore of {i}\nhome") for i in range(1, 6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t if i == 1 else f"own text {i}\nmore of {i}" for i, t in docs}
    assert {r.doc_id: r.text for r in op9_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, rows(spark, "documents", tmp_path), str(tmp_path)).collect()} == want


def test_corpus_keeps_one_copy_of_each_line(spark):
    docs = [(r.doc_id, r.text) for r in rows(spark, "documents").collect()]
    got = {r.doc_id: r.text for r in op9_line_dedup(spark, SMALL).collect()}
    left = [x for t in got.values() for x in t.split("\n") if WORD.search(x)]
    assert len(left) == len(set(left)) and set(left) == {x for _, t in docs for x in t.split("\n") if WORD.search(x)}


def test_first_copy_of_a_long_passage_stays(spark):
    passage = "\n".join(" ".join(f"w{i}_{j}" for j in range(9)) for i in range(7))
    docs = [(1, f"intro one\n{passage}\nend one"), (2, f"intro two\n{passage}\nend two"), (3, "a clean text of its own\nwith lines")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "intro two\nend two" and got[3].text == docs[2][1]
    assert (got[2].n_removed, got[2].n_lines, got[2].emptied) == (7, 9, False)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == docs.count()
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[2, None].text is None and by[3, "b"].text == "" and by[6, "c"].text == " \n\t " and by[5, "c"].emptied
    assert by[1, "a"].n_removed == 0 and by[8, "z"].n_removed == 0
    assert dedup_lines(empty_documents(spark)).count() == 0
