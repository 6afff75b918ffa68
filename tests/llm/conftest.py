import random

import pytest
from pyspark.sql import types as T

#: Columns whose names clash with those the operators use inside.
CLASH = ["id", "key", "node", "hash", "tokens", "size", "label", "bucket", "rank", "score_", "row_key", "blob", "found"]


def make_docs(spark, rows, extra=True):
    """A documents table of (doc_id, text) rows, with extra columns of clashing names."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    names = CLASH if extra else []
    fields += [T.StructField(c, T.StringType()) for c in names]
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], T.StructType(fields))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    long_text = " ".join(r.choice(words) for _ in range(60_000))
    plain = " ".join(words[:120])
    return [(1, plain), (2, None), (3, ""), (4, " \t\n "), (5, long_text), (6, plain), (6, plain), (None, "no id here " * 9),
            (None, None), (7, "Ünï cödé 中文 \U0001f600 'S don't"), (8, "a" * 5000), (9, plain.upper()), (10, "one"), (11, "one two")]
