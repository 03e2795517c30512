"""Byte-level BPE by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts as one state with an arc for
every byte; each merge (a, b) -> c then adds one gadget: the state behind arc a is copied without its arc b, all
arcs a lead to the copy, and every state with an arc a gets an arc c to where b led. All arcs of one token lead to
the same state.

The compiled form is a set of tables. A byte trie holds the tokens. The arcs of a state are kept by what it lacks: the
table of a state has the tokens whose arcs were taken away and the merge that took each. A token made by merges came
with the arc of its first part, so its arc is missing too if the table has one of its first parts, taken away while that
part stood for the token. The tables of all states that an arc leads to are filled when the merges are compiled.

A word is encoded by one walk: from every position the trie is followed over the bytes, and of all tokens that end
at a position just one continues the accepted sequence of its start. The labels of the arcs taken are the ids.
"""

from __future__ import annotations

import json
import os
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How this vocabulary splits text before its merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest vocabulary file that is compiled and sent.
MAX_VOCABULARY = 64_000_000
#: Words whose ids a worker keeps; then it starts anew.
KEPT_WORDS = 200_000


def byte_aliases() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, tokens: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        size = max(tokens.values(), default=0) + 1
        self.left = [-1] * size  # first part of a merged token
        self.made = [-1] * size  # its merge; -1 for bytes
        self.behind = behind = [0] * size  # the state behind a token's arcs
        copied, without, since = [-1], [-1], [-1]

        def arc(state: int, token: int) -> bool:
            while state:
                if without[state] == token:
                    return False
                if self.made[token] < since[state]:
                    state = copied[state]  # the arc is as old as the copied state's
                else:
                    token = self.left[token]  # the arc came with its first part's
            return True

        for k, (x, y) in enumerate(merges):
            a, b, c = tokens[x], tokens[y], tokens[x + y]
            if self.made[c] >= 0 or len(x + y) == 1 or not arc(behind[a], b):
                continue  # a merge that can't happen adds nothing
            self.left[c], self.made[c] = a, k
            behind[c] = behind[b]
            copied.append(behind[a])
            without.append(b)
            since.append(k)
            behind[a] = len(copied) - 1
        usable = {t: i for t, i in tokens.items() if len(t) == 1 or self.made[i] >= 0}
        self._compile_arcs(usable.values(), copied, without, since)
        self._compile_trie(usable)
        self._bytes = {i: t for t, i in tokens.items()}
        self._words: dict[str, list[int]] = {}

    def _compile_arcs(self, tokens: Iterable[int], copied: list[int], without: list[int], since: list[int]) -> None:
        """For every state that an arc leads to, the tokens whose arcs it lost and by which merge."""
        table: dict[int, int] = {}
        for row, first in enumerate(sorted({self.behind[t] for t in tokens})):
            table[first] = row
        self.behind = [table.get(s, 0) for s in self.behind]
        self.lost: list[dict[int, int]] = [{} for _ in table]
        for state, row in table.items():
            while state:
                self.lost[row][without[state]] = since[state]
                state = copied[state]

    def _compile_trie(self, tokens: dict[bytes, int]) -> None:
        """``child[node * 256 + byte]`` and the token that ends at each node, -1 for none."""
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for t, i in tokens.items():
            node = 0
            for byte in t:
                at = node * 256 + byte
                node = self.child.get(at, -1)
                if node < 0:
                    node = self.child[at] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Automaton:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> Automaton:
        """From the text of a vocabulary file."""
        model = json.loads(text)["model"]
        alias = byte_aliases()
        raw = lambda s: bytes(alias[ch] for ch in s)
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        tokens = {raw(t): i for t, i in model["vocab"].items() if all(ch in alias for ch in t)}
        return cls(tokens, [(raw(x), raw(y)) for x, y in merges])

    def arc(self, state: int, token: int) -> bool:
        """Whether a state of the tables has an arc ``token``."""
        lost, made, left = self.lost[state], self.made, self.left
        until = 1 << 60
        while token >= 0:
            if token in lost and made[token] < lost[token] <= until:
                return False
            until = made[token]
            token = left[token]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        child, ends, behind, lost_by, made, left = self.child, self.ends, self.behind, self.lost, self.made, self.left
        for j in range(n):
            lost = lost_by[behind[last[j]]] if j else None  # the first state has all arcs
            node = 0
            for i in range(j, n):
                node = child.get(node * 256 + word[i], 0)
                if not node:
                    break
                t = ends[node]
                if t < 0 or last[i + 1] >= 0:
                    continue
                if lost:
                    x, until = t, 1 << 60
                    while x >= 0:
                        if x in lost and made[x] < lost[x] <= until:
                            break
                        until = made[x]
                        x = left[x]
                    if x >= 0:
                        continue
                last[i + 1], start[i + 1] = t, j
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        ids.reverse()
        return ids

    def encode(self, words: Iterable[str]) -> list[int]:
        """Ids of a text that is split into words."""
        kept, out = self._words, []
        for w in words:
            ids = kept.get(w)
            if ids is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                ids = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    kept[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: the labels of the arcs in order."""
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")

    def shipped(self) -> bytes:
        """The tables as bytes for the workers."""
        self._words = {}
        return pickle.dumps(self, protocol=5)


class Splitter:
    """Splits texts by a pattern. With PATTERN stretches of ASCII are split by an ASCII form of it, which is faster.

    A word of PATTERN is white space or ends before white space, and what matches at a position doesn't depend on
    what is before it; so a text may be cut wherever white space begins.
    """

    def __init__(self, pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        self.ascii = None
        if pattern == PATTERN:
            kept = lambda p: "".join(re.escape(c) for c in map(chr, range(128)) if regex.match(p, c))
            letters, digits, blanks = kept(r"\p{L}"), kept(r"\p{N}"), kept(r"\s")
            plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
            self.ascii = re.compile(plain.replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")).findall

    def split(self, text: str) -> list[str]:
        if self.ascii is None:
            return self.find(text)
        if text.isascii():
            return self.ascii(text)
        out: list[str] = []
        held, plain = [], True  # lines of one kind

        def flush() -> None:
            if held:
                out.extend((self.ascii if plain else self.find)("".join(held)))
                held.clear()

        for line in _CUT.split(text):
            if line.isascii() != plain:
                flush()
                plain = not plain
            held.append(line)
        flush()
        return out


#: Line ends before which there is no white space.
_CUT = re.compile(r"(?<=[!-~])(?=\n)")
#: What a worker has unpacked, for all its tasks.
_UNPACKED: dict[str, Automaton] = {}


def _unpacked(key: str, tables: bytes) -> Automaton:
    """A worker's automaton. A function of the module, so that all tasks of a worker share what it keeps."""
    if key not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[key] = pickle.loads(tables)
    return _UNPACKED[key]


@cache
def _compiled(vocabulary: str, changed: float) -> bytes:
    return Automaton.load(vocabulary).shipped()


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of the whole text, without special tokens.

    A null or empty text has an empty list. Strings that look like special tokens are ordinary text. Repeated ids
    give repeated rows. One narrow pass without a shuffle; ``vocabulary`` is compiled on the driver, and its tables (some
    MB, whatever the corpus; a vocabulary file of more than MAX_VOCABULARY bytes is refused) are sent to the workers, each
    of which unpacks them once.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} bytes is not sent to the workers")
    shipped = df.sparkSession.sparkContext.broadcast(_compiled(vocabulary, os.path.getmtime(vocabulary)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, splitter = _unpacked(key, shipped.value), Splitter(pattern)
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat += automaton.encode(splitter.split(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>")
