import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Extra columns with the names that operators use inside.
CLASHES = ("uid", "row", "size", "fp", "k_text", "seed", "score", "lang_pred", "sid", "vslot", "taken", "id_", "text_", "found", "letter", "x", "n", "root", "shard", "crc_", "times", "block", "key", "cid", "point")
DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])

PASSAGE = "Ein Satz über zwölf Wörter, der in vielen Texten steht und überall derselbe bleibt, damit man ihn findet und prüft. " * 3


def messy_rows():
    long = " ".join(f"word{k * k % 977}" for k in range(40_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and then runs far away from here", "en", "a"),
        (2, "the QUICK brown fox jumps over the lazy dog and then runs far away from here", "en", "a"),
        (3, None, "en", "b"), (4, "", None, "b"), (5, " \t\n\r ", "de", None), (6, "12 34 !!", "de", None),
        (7, "Ein Satz über Größe und Maß", "de", "é"), (7, "Ein Satz über Größe und Maß", "de", "é"), (7, "Ein Satz über Größe und Maß", "de", "é"),
        (None, "no id at all but words", "en", "a"), (None, None, None, None), (None, None, None, None),
        (8, long, "en", "c"), (9, long, "en", "c"), (10, PASSAGE + "one", "de", "b"), (11, "two " + PASSAGE, "de", "b"), (12, "mid " + PASSAGE + " dle", None, "b"),
        (13, "日本語のテキスト です ね", "ja", "d"), (14, "x", "en", "d"), (15, "x y", "en", "d"), (16, "ab" * 400, "en", "e"),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    """A frame of odd documents with clashing extra columns."""
    return spark.createDataFrame(messy_rows(), DOC_SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture()
def folder(spark):
    """Writes frames as the tables of a data folder."""
    from furlong.session import scratch_path

    def write(**tables):
        path = scratch_path(spark, "tests", uuid.uuid4().hex[:12])
        for name, frame in tables.items():
            frame.write.parquet(os.path.join(path, f"{name}.parquet"))
        return path

    return write


@pytest.fixture(scope="session")
def small_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def groups_of(n, links):
    """Smallest member of each node's component."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]
