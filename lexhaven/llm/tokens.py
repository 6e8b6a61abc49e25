"""Token counts by a longest-match automaton.

A word is cut from the left into the longest pieces of a vocabulary. The automaton reads each
character once: where the trie has no way on, a failure link leads to the node of what remains
after cutting pieces off, and the number of these pieces, known beforehand, is added. Pieces
themselves are never built, so the count takes time linear in the word whatever the vocabulary.

Method: linear-time longest match with failure links (Song et al., 2021, "Fast WordPiece
Tokenization").
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexhaven.llm.common import batches_of

# Fixed value: how the vocabulary's tokenizer splits a lower-cased text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "\0"
# Words a task remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 400_000


class Automaton:
    """Counts the pieces of words over one vocabulary; `END` marks the end of a word in it."""

    def __init__(self, pieces: Iterable[str]):
        children: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for char in piece:
                step = children[node].get(char)
                if step is None:
                    step = len(children)
                    children[node][char] = step
                    children.append({})
                    final.append(False)
                node = step
            final[node] = node != 0
        # Failure link and pieces cut off on the way; -1: no piece fits.
        link, popped = [-1] * len(children), [0] * len(children)
        queue = [0]
        for node in queue:
            for char, child in children[node].items():
                queue.append(child)
                if final[child]:
                    link[child], popped[child] = 0, 1
                    continue
                at, cut = link[node], popped[node]
                while at >= 0 and char not in children[at]:
                    cut += popped[at]
                    at = link[at]
                if at >= 0:
                    link[child], popped[child] = children[at][char], cut
        self.children, self.link, self.popped = children, link, popped

    def count(self, word: str) -> int:
        """Pieces of a word; a word that cannot be cut whole counts as one unknown piece."""
        children, link, popped = self.children, self.link, self.popped
        node, n = 0, 0
        for char in word:
            while (step := children[node].get(char)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = step
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a tokenizer file with word ends, `END` for the end of a word."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    marked = lambda piece: piece.removesuffix(suffix) + END if suffix and piece.endswith(suffix) else piece
    return [marked(piece) for piece in model["vocab"] if piece != suffix]


@lru_cache(maxsize=2)
def counter_of(path: str) -> Callable[[str | None], tuple[int, int]]:
    """A function from a text to its words and pieces, made once per Python worker."""
    automaton = Automaton(read_vocabulary(path))
    letters = {b: letter for b, letter in byte_letters().items()}
    table = str.maketrans({chr(b): letter for b, letter in letters.items()})
    find = regex.compile(PRETOKEN).findall
    known: dict[str, int] = {}

    def length(word: str) -> int:
        return automaton.count(word.encode("utf-8").decode("latin-1").translate(table) + END)

    # Most words come with white space around them and end in a mark; a chunk between
    # white space is counted once and remembered.
    def chunk(part: str) -> int:
        return sum(length(w) for w in find(part))

    def count(text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        parts = text.lower().split()
        try:
            return len(parts), sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for part in set(parts).difference(known):
                known[part] = chunk(part)
            return len(parts), sum(map(known.__getitem__, parts))

    return count


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, words between white space, and greedy pieces over the vocabulary file.

    NULL and empty texts have none of either. Repeated rows are counted each; other columns,
    whatever their names, take no part.
    """
    source = df.select(df[key].alias("key"), df[text].alias("text"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(vocabulary)
        for batch in batches:
            for part in batches_of(batch):
                found = np.array([count(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(found[:, 0]), pa.array(found[:, 1])],
                    ["key", "n_words", "n_tokens"],
                )

    out = source.mapInArrow(run, f"key {key_type}, n_words long, n_tokens long")
    return out.withColumnRenamed("key", key)
