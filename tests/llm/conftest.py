import os

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text[, lang, source]) rows, with extra columns of clashing names."""
    def make(rows, extra=True):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("id", "score", "ids", "rank", "k1", "class_id", "_p", "block", "share", "_host", "host_n", "_c0", "_start", "phases"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"


def assert_lost_nothing(out, docs):
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, (r.doc_id for r in docs.select("doc_id").collect())))


os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
