import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photoloom.llm.leaks import leaked_items, normalise, passages, source_offsets, words

W = [f"w{i}" for i in range(40)]


def brute(docs, items):
    out = set()
    split = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower()) if t else []
    for i, item in items:
        a = split(item)
        k = min(12, len(a))
        grams = {tuple(a[j : j + k]) for j in range(len(a) - k + 1)} if k else set()
        for d, text in docs:
            b = split(text)
            if any(tuple(b[j : j + k]) in grams for j in range(len(b) - k + 1) if k):
                out.add((i, d))
    return out


DOCS = [
    (1, "+ " + "\n+    ".join(W[:12])),
    (2, " ".join(W[:11])),
    (3, "x " + "_".join(w.upper() for w in W[5:20]) + " y"),
    (4, "Why does the ﬁsh swim?"),
    (5, "why does the fish, really, swim"),
    (6, None),
    (7, ""),
    (8, "---"),
    (9, " ".join(W[:11] + ["z"] + W[11:30])),
    (10, "é " * 20_000 + " ".join(W[20:34])),
    (11, "xwhy does the fish swimx"),
    (1, "again " + " ".join(W)),
]
ITEMS = [(1, " ".join(W)), (2, "Why does the fish swim?"), (3, None), (4, " -- "), (5, " ".join(W[20:40])), (6, "straße")]


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id int, item_text string").withColumn("text", F.lit("clash"))
    return leaked_items(d, "doc_id", "text", i, "item_id", "item_text", **more)


def test_against_brute_force(spark):
    got = [(r["item_id"], r["doc_id"]) for r in run(spark, DOCS, ITEMS).collect()]
    assert set(got) == brute(DOCS, ITEMS) and (2, 4) in got and (1, 2) not in got and (1, 3) in got
    assert {(r["item_id"], r["doc_id"]) for r in run(spark, DOCS, ITEMS, automaton_chars=10).collect()} == set(got)
    assert run(spark, DOCS[:0], ITEMS).count() == run(spark, DOCS, ITEMS[:0]).count() == 0


def test_texts_are_read_once_however_many_lots(spark):
    """Items in several lots are scanned for in one pass over the texts."""
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id int, item_text string")
    for chars in (10, 10**6):
        plan = leaked_items(d, "doc_id", "text", i, "item_id", "item_text", automaton_chars=chars)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Union" not in plan and "Exchange" not in plan


def test_ids_of_one_name(spark):
    docs = spark.createDataFrame([(7, "a b c")], "id long, text string")
    items = spark.createDataFrame([(1, "B c")], "id int, text string")
    assert [tuple(r) for r in leaked_items(docs, "id", "text", items, "id", "text").collect()] == [(1, 7)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    got = {(r["item_id"], r["doc_id"]) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "item_text").collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [(r["item_id"], r["item_text"]) for r in items.collect()]) and got


def test_spans(spark):
    text = "ẛ̣ ﬁrst: " + " é ".join([]) + "A" + " ".join(w.upper() for w in [*W[3:17]]) + "; end"
    text = text.replace("A" + W[3].upper(), "é " + W[3].upper())
    r = run(spark, [(1, text)], [(1, " ".join(W))], spans=True).first()
    assert text[r["start"] : r["end"]] == " ".join(w.upper() for w in W[3:17]) and r["n_words"] == 14
    two = " ".join(W[:12]) + " and " + " ".join(W[20:33])
    got = sorted((r["start"], r["end"], r["n_words"]) for r in run(spark, [(1, two)], [(1, " ".join(W))], spans=True).collect())
    assert [n for _, _, n in got] == [12, 13] and two[got[1][0] : got[1][1]] == " ".join(W[20:33])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_offsets_follow_the_text(text):
    at = source_offsets(text)
    assert at == sorted(at) and len(at) == len(normalise(text))


def test_words_and_passages():
    assert words("A_b-c's Ⅷ ½ 3x") == ["a", "b", "c", "s", "viii", "1", "2", "3x"]
    assert passages("a b", 12) == {" a b "} and passages("", 12) == set() and len(passages(" ".join(W), 12)) == 29
