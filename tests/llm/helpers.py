"""Small tables with every awkward case, shared by the tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id int, size string, fp string, bucket int, order string, slot int, line_no int, part int, kind string"
CLASH = ("k", 1, "s", "f", 2, "o", 3, 4, 5, "x")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    long = "\n".join(words(rng, 12) for _ in range(4000))
    rows = [(i, words(rng, 5 + i % 40), "en" if i % 2 else "fr", f"s{i % 3}", 100) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s0", 4), (None, "a lone text without a key", "en", None, 3)]
    rows += [(103, long, "en", "s0", len(long)), (104, "...!!!", None, "s1", None), (105, "é", "fr", "s2", -5)]
    rows += [rows[3], rows[3], rows[5]]
    return spark.createDataFrame([r + CLASH for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def benchmark(spark, rows=((1, "alpha beta gamma"), (None, "null id item"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(40)] + [(None, 1), (5, None), (7, 0)], "doc_id bigint, quality int")
