import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photoloom.llm.tokenizer import PATTERN, VOCABULARY, Automaton, Splitter, byte_aliases, encode_corpus

SPLIT = regex.compile(PATTERN)
BUILT = Automaton.load()


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


LIBRARY = library()
TEXTS = ["", "a", "<|endoftext|> is text", "   \n\n  x", "don't WON'T I'LL", "a" * 3000, " " * 999 + "b", "é ☃ \U0001f600‍\U0001f600", "\x00\x01﻿", "x\r\n\ty", "ﬁ½ ١٢٣", "0123456789" * 40, "=" * 700, "ab" * 500]


def ids(text):
    return BUILT.encode(SPLIT.findall(text))


def test_equals_the_library():
    assert [ids(t) for t in TEXTS] == [e.ids for e in LIBRARY.encode_batch(TEXTS, add_special_tokens=False)]
    assert [BUILT.decode(ids(t)) for t in TEXTS] == TEXTS


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" aeinrst'\n0_-é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library_on_any_text(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert BUILT.decode(ids(text)) == text


def greedy(word, merges, tokens):
    """Byte-pair merging as it is defined: always the first merge of the list that applies, leftmost first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    for a, b in merges:
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [tokens[p] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_automaton_of_any_merges(data):
    made, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 9))):
        a, b = data.draw(st.sampled_from(made)), data.draw(st.sampled_from(made))
        if a + b not in made:
            made.append(a + b)
            merges.append((a, b))
    tokens = {t: i for i, t in enumerate(made)}
    automaton = Automaton(tokens, merges)
    word = data.draw(st.text(alphabet="abc", min_size=1, max_size=14)).encode()
    wanted = greedy(word, merges, tokens)
    assert automaton.encode_word(word) == wanted


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["\n", "\r\n", " ", "\t", "a", "it's", "é", "12", "½", "--", "\x1c", "\x1f", "\u2028", "\u3000", "'ll"]), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join))
def test_ascii_stretches_are_split_like_the_whole(text):
    assert Splitter().split(text) == SPLIT.findall(text)


def test_ascii_signs():
    text = "".join(map(chr, range(128))) * 2 + "\n" + "".join(f"a{chr(i)}{chr(j)}" for i in range(128) for j in range(128))
    assert Splitter().split(text) == SPLIT.findall(text)
    assert Splitter(r"\p{L}+|.").split("aé b") == ["aé", " ", "b"]


def test_tables_say_what_the_merges_do():
    """A pair of tokens may follow one another just if merging their text gives that pair back."""
    tokens = {t: i for i, t in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"abca"])}
    merges = [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"c", b"a"), (b"ab", b"ca")]
    built = Automaton(tokens, merges)
    for x, i in tokens.items():
        for y, j in tokens.items():
            if greedy(x, merges, tokens) == [i] and greedy(y, merges, tokens) == [j]:
                assert built.arc(built.behind[i], j) == (greedy(x + y, merges, tokens) == [i, j]), (x, y)


def test_alias_table():
    alias = byte_aliases()
    assert len(alias) == 256 and alias["A"] == 65 and alias["Ġ"] == 32


def test_corpus(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x"), (4, "q" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df, "doc_id", "text")
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    by = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert len(by) == 6 and by.count((1, ids("a b"))) == 2 and (2, []) in by and (3, []) in by and (None, ids("x")) in by
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    wanted = LIBRARY.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    assert all(got[r["doc_id"]] == w.ids for r, w in zip(rows, wanted)) and len(got) == len(rows)
