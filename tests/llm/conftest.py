import random

import pytest
from pyspark.sql import types as T

SMOKE = "/root/testdata/sf0.001"
# documents plus columns whose names operators use inside
DOCS = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("slot", T.StringType()), ("rec", T.StringType()), ("digest", T.StringType()),
    ("at", T.StringType()), ("label", T.StringType()), ("kept", T.StringType()), ("score", T.StringType()),
    ("n_lines", T.StringType()), ("host", T.StringType()), ("first", T.StringType())]])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "src0")[len(r) - 2:])[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * 10))
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a very long one, ties, repeated rows, null id, language and source."""
    rnd = random.Random(5)
    long = " ".join(f"word{rnd.randrange(4000)}" for _ in range(40_000))
    plain = "one two three four five six seven eight nine ten eleven twelve"
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, plain), (5, plain), (6, plain), (7, plain + " thirteen"),
            (8, plain, None, None), (None, plain), (None, None), (9, "a"), (10, "naïve 中文 😀 <|endoftext|> x"),
            (11, "x" * 50_000), (12, "the " * 20_000)]
