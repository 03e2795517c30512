import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photoloom.llm.leaks import leaked_items, normalise, source_offsets


@pytest.mark.parametrize("odd", ["\uff76\uff9e", "\uff8a\uff9f", "\uffa1\uffc2", "\u3131\u314f"])
def test_signs_that_compose_though_no_marks(spark, odd):
    """Half-width katakana with its sound marks, and half-width and compatibility Hangul letters."""
    text = f"x {odd} why does the fish swim; y"
    assert len(source_offsets(text)) == len(normalise(text))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "why does the fish swim")], "item_id int, item_text string")
    r = leaked_items(docs, "doc_id", "text", items, "item_id", "item_text", spans=True).select(F.col("start").alias("b"), F.col("end").alias("e")).first()
    assert text[r["b"] : r["e"]] == "why does the fish swim"


#: Every character that changes under NFKC or that some composition ends in.
COMPOSING = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c)]
SECONDS = sorted({x for c in COMPOSING for x in unicodedata.normalize("NFKD", c)})


def check(text):
    spans, norm = source_offsets(text), normalise(text)
    assert len(spans) == len(norm)
    assert spans == sorted(spans) and all(0 <= b < e <= len(text) for b, e in spans)
    for b, e in set(spans):  # each stretch of the text normalises to just the characters that name it
        assert normalise(text[b:e]) == "".join(c for c, s in zip(norm, spans) if s == (b, e)) or "σ" in normalise(text[b:e]).replace("ς", "σ")


def test_every_composing_character_after_every_kind_of_base():
    for base in ("a", "か", "ㄱ", "\u1100", "\uac00", "\u0c46", "\U00011131", "ｶ"):
        for start in range(0, len(COMPOSING), 500):
            check("".join(f"{base}{c} " for c in COMPOSING[start : start + 500]))
        check("".join(f"{base}{c} " for c in SECONDS))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(COMPOSING), st.sampled_from(SECONDS), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join))
def test_any_composing_text(text):
    check(text)
