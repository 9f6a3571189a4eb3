"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, of up to so many characters, whose counts a task remembers.
REMEMBERED, SHORT = 300_000, 64
_SYMBOLS = 1 << 8
_WORD = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """Counts the pieces of greedy longest-match in one pass over a word's bytes.

    A trie of the vocabulary; each node has a failure link and the number of
    pieces that are popped on the way there. A failing step follows links, each of which
    settles pieces for good, so the work is linear in the word and pieces are never built.
    ``pieces`` are (first, bytes): whether a piece may start a word or only
    continue it; None for both.
    """

    def __init__(self, pieces: Iterable[tuple[bool | None, bytes]]):
        #: Node 0 starts a word, node 1 continues it.
        self.next: dict[int, int] = {}
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        whole = bytearray(2)
        above: list[tuple[int, int]] = [(-1, -1)] * 2
        depth = [0, 0]
        for first, piece in pieces:
            for root in (0, 1) if first is None else ((0,) if first else (1,)):
                at = root
                for symbol in piece:
                    to = self.next.get(at * _SYMBOLS + symbol)
                    if to is None:
                        to = self.next[at * _SYMBOLS + symbol] = len(above)
                        above.append((at, symbol))
                        depth.append(depth[at] + 1)
                        whole.append(0)
                    at = to
                if at > 1:
                    whole[at] = 1
        n = len(above)
        self.fail += [-1] * (n - 2)
        self.pops += [0] * (n - 2)
        for v in sorted(range(2, n), key=depth.__getitem__):
            if whole[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            u, symbol = above[v]
            popped, z = self.pops[u], self.fail[u]
            while z >= 0 and z * _SYMBOLS + symbol not in self.next:
                popped += self.pops[z]
                z = self.fail[z]
            self.fail[v] = self.next[z * _SYMBOLS + symbol] if z >= 0 else -1
            self.pops[v] = popped

    def count(self, word: bytes) -> int:
        """Number of pieces; -1 if the pieces can't spell the word."""
        at = total = 0
        step, fail, pops = self.next, self.fail, self.pops
        for symbol in word:
            while (to := step.get(at * _SYMBOLS + symbol)) is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = to
        while at > 1:
            total += pops[at]
            at = fail[at]
        return total if at >= 0 else -1


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_pieces(path: str) -> list[tuple[bool | None, bytes]]:
    """Pieces of a byte-level tokenizer file, special tokens left out."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [(None, bytes(letters[c] for c in piece)) for piece in model["model"]["vocab"] if piece not in special]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", word_start: str = " ") -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown (long) of each whole text.

    A word is a run of letters, digits and underscores, or one other character
    that isn't white space; its pieces are found with ``word_start`` before it.
    ``n_tokens`` adds up the pieces of each word, 1 for a word that the pieces
    can't spell; those are ``n_unknown``. Null and empty
    texts have zeros. Each row is counted on its own; columns of ``docs`` with the names of the counts are replaced, all others stay. ``tokenizer_path`` is a file that the executors have too.
    """

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(read_pieces(tokenizer_path))
        known: dict[str, int] = {}

        def of(word: str) -> int:
            n = automaton.count((word_start + word).encode())
            if len(word) <= SHORT:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = n
            return n

        for texts in batches:
            rows = []
            for text in texts:
                words = _WORD.findall(text) if text else []
                counts = list(map(known.get, words))
                if None in counts:
                    counts = [of(w) if (n := known.get(w)) is None else n for w in words]
                unknown = counts.count(-1)
                rows.append((len(words), sum(counts) + 2 * unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    made = ("n_words", "n_tokens", "n_unknown")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    counted = docs.select(row, run(docs[text_col]).alias("counts"))
    return counted.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in made), *(F.col("counts").getField(c).alias(c) for c in made))
