"""Evaluation texts inside corpus documents, by one Aho-Corasick automaton over normalised words."""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

#: Consecutive words of an item that make a leak; of a shorter item all its words.
WINDOW = 12
#: Characters of items that one automaton holds.
AUTOMATON_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall(normalise(text)) if text else []


def passages(item_text: str | None, window: int = WINDOW) -> set[str]:
    """The word sequences that show a leak of an item, each between single spaces."""
    w = words(item_text)
    k = min(window, len(w))
    return {f" {' '.join(w[i : i + k])} " for i in range(len(w) - k + 1)} if k else set()


@cache
def _joining() -> frozenset[str]:
    """Characters that may compose with what is before them, though they are no marks: the second halves of compositions."""
    second = {p[1] for i in range(0x110000) if len(p := unicodedata.decomposition(chr(i)).split()) == 2 and not p[0].startswith("<")}
    return frozenset(chr(int(x, 16)) for x in second) | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _begins(c: str) -> bool:
    """Whether the normal form of ``c`` stands for itself, whatever is before it."""
    first = unicodedata.normalize("NFKD", c)[0]
    return not unicodedata.combining(first) and first not in _joining()


def source_offsets(text: str) -> list[tuple[int, int]]:
    """For every character of ``normalise(text)``, the span of ``text`` that it comes from."""
    at: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        # No character below U+0300 joins the one before it.
        while j < n and text[j] >= "\u0300" and not _begins(text[j]):
            j += 1
        at += [(i, j)] * len(normalise(text[i:j]))
        i = j
    return at


def _automaton(patterns: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, items in patterns.items():
        a.add_word(p, (len(p), items))
    a.make_automaton()
    return a


def _lots(items: DataFrame, item_id: str, item_text: str, window: int, chars: int) -> Iterator[dict[str, list[int]]]:
    """Patterns of all items, in lots of at most ``chars`` characters of items (or one item)."""
    lot: dict[str, set] = defaultdict(set)
    held = 0
    for i, text in items.select(item_id, item_text).toLocalIterator():
        if lot and held + len(text or "") > chars:
            yield {p: sorted(x) for p, x in lot.items()}
            lot, held = defaultdict(set), 0
        held += len(text or "")
        for p in passages(text, window):
            lot[p].add(i)
    if lot:
        yield {p: sorted(x) for p, x in lot.items()}


#: The automaton that a worker keeps for all its tasks, by the id of the query's items.
_KEPT: dict[str, object] = {}


def _kept(key: str, lot) -> object:
    """The worker's automaton of a broadcast lot. A function of the module, so that all tasks of a worker share what it keeps."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _automaton(pickle.loads(lot.value))
    return _KEPT[key]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, spans: bool = False, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Every document with every item it leaks: ``item_id, doc_id``, with ``spans`` also ``start, end, n_words``.

    A document leaks an item if its text holds ``window`` consecutive words of it, or all words of a shorter item
    in order without others between. ``start`` and ``end`` are the offsets in the original text of each unbroken
    stretch of the item that is found; ``n_words`` its words. Texts or items that are null or have no word leak
    nothing. Repeated rows of ``docs`` give repeated results; repeated items count once.

    Whole texts are read once, in one narrow pass without a shuffle. The patterns of all items make one automaton,
    which is built once per worker. Only items of more than ``automaton_chars`` characters are sent in lots of that
    size, each a broadcast of its own; a worker then holds one lot's automaton at a time and scans the texts it has read
    with each of them.
    """
    sc = docs.sparkSession.sparkContext
    kind_of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"item_id {kind_of(items, item_id)}, doc_id {kind_of(docs, doc_id)}" + ", start int, end int, n_words int" * spans
    shipped = [sc.broadcast(pickle.dumps(lot)) for lot in _lots(items, item_id, item_text, window, automaton_chars)]
    own = uuid.uuid4().hex

    def automata() -> Iterator:
        for k, lot in enumerate(shipped):
            yield _kept(f"{own}:{k}", lot)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = [(doc, t, f" {' '.join(words(t))} ") for doc, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) if t]
            found: dict[int, list] = defaultdict(list)
            for a in automata():
                for k, (_, _, line) in enumerate(lines):
                    found[k] += [(end - n + 1, end, its) for end, (n, its) in a.iter(line)]
            out = []
            for k, hits in found.items():
                doc, t, line = lines[k]
                if spans:
                    out += [(i, doc, *s) for i, s in _stretches(t, line, hits)]
                else:
                    out += [(i, doc) for i in sorted({i for _, _, its in hits for i in its})]
            yield pd.DataFrame(out, columns=["item_id", "doc_id"] + ["start", "end", "n_words"] * spans)

    return docs.select(doc_id, text).mapInPandas(run, schema)


def _stretches(text: str, line: str, hits: list[tuple[int, int, list]]) -> Iterator[tuple[object, tuple[int, int, int]]]:
    """Hits in ``line`` joined to unbroken stretches per item, as offsets in ``text``."""
    norm = normalise(text)
    at = source_offsets(text)
    if len(at) != len(norm):
        raise AssertionError("the offsets don't follow the normalised text")
    spots = [m.span() for m in _WORD.finditer(norm)]
    number, k = {}, 0  # word number by its start in line
    for n, (b, e) in enumerate(spots):
        number[k + 1] = n
        k += e - b + 1
    runs = defaultdict(list)
    for b, e, its in sorted(hits, key=lambda h: h[:2]):
        first = number[b + 1]
        last = first + line.count(" ", b + 1, e)
        for i in its:
            r = runs[i]
            if r and first <= r[-1][1] + 1:
                r[-1][1] = max(r[-1][1], last)
            else:
                r.append([first, last])
    for i in sorted(runs):
        for first, last in runs[i]:
            b, e = spots[first][0], spots[last][1]
            yield i, (at[b][0], at[e - 1][1], last - first + 1)
