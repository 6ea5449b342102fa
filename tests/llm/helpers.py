"""What the tests of the corpus operators share."""

import re

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def odd_documents(spark, extra="sig string, start long, size long, text_2 string, `a.b` string, TEXT int"):
    """Nulls in each column, empty and very long texts, repeated rows and ids, and extra columns of clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000)) + "\n" + "x" * 50_000
    data = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda\nsecond line here", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda\nsecond line here", "en", "a", 10),
        (1, "another text under an id that is taken", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "text of a row without an id", "en", None, 1),
        (None, None, None, None, None),
        (4, long, "de", "b", len(long)),
        (5, long, "de", "c", len(long)),
        (6, " \n\t ", "fr", "c", 4),
        (7, "é ü ñ \U0001f600 <|endoftext|>  x\x1c\x85y", "fr", "é", 4),
        (8, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda\nsecond line here", "en", "z", 10),
        (9, "one", "en", "z", 1),
        (10, "one", "en", "z", 1),
    ]
    return spark.createDataFrame([(*r, "s", 1, 2, "t", "dot", 3) for r in data], f"{DOCS}, {extra}")


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
