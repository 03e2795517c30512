import unicodedata

import pytest
from pyspark.sql import functions as F

from photoloom.functions.keys import EMPTY_SHA256, category_key, content_key, place_key
from photoloom.functions.sql import place_sql

PATHS = [None, "", "  ", "/a/b.jpg", "a\\B.JPG ", "\ta//./b.jpg", "./a/b.jpg", "a/b.jpg/", "/", ".", "/é/x", unicodedata.normalize("NFD", "/é/x"), "/É/X", "a/.b/..c", "x" * 5000, "/a/../b", " / a / b "]


def place(p):
    """The definition, word for word."""
    if p is None:
        return None
    p = unicodedata.normalize("NFC", p).strip().replace("\\", "/")
    return "/".join(s for s in p.split("/") if s not in ("", ".")).lower() or None


def test_place_key(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, p string")
    got = {r["i"]: r["k"] for r in df.select("i", place_key(F.col("p")).alias("k")).collect()}
    assert [got[i] for i in range(len(PATHS))] == [place(p) for p in PATHS]


@pytest.mark.parametrize("p", [p for p in PATHS if p is not None])
def test_place_sql(p):
    import duckdb

    assert duckdb.execute(f"SELECT {place_sql('$1')}", [p]).fetchone()[0] == place(p)


def test_content_and_category(spark):
    h = "ab" * 32
    rows = [(h, " Landscape\t"), (h.upper(), "LANDSCAPE"), (f"sha256:{h} ", ""), ("", " "), (None, None), (EMPTY_SHA256.upper(), "x"), ("ab" * 31, "x")]
    df = spark.createDataFrame(rows, "h string, c string").select(content_key(F.col("h")), category_key(F.col("c")))
    assert [tuple(r) for r in df.collect()] == [(h, "landscape"), (h, "landscape"), (h, None), (None, None), (None, None), (None, "x"), (None, "x")]
