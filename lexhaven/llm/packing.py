"""Harmonic packing of token sequences.

A text's ids are cut into pieces, and each piece goes to a class by its length: class k holds
pieces between capacity / (k + 1) and capacity / k, and a bin of class k takes exactly k of
them. Classes need no look at other bins, so every task packs what it reads on its own, keeps
at most k - 1 pieces of each class waiting, and nothing is shuffled. Full-length pieces fill a
bin alone. A remainder whose slot would waste too much is cut once more, so that its head fills
the next class's slot to the end. What waits in a task at its end is laid end to end.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, hash_words, text_buffer, word_bounds
from lexhaven.llm.tokens import byte_letters

CAPACITY = 2048
BYTE_LETTERS = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})
# Share of a slot that may stay empty before a piece is cut again.
WASTE = 1 / 32
# Chunks, their ids and parts of chunks a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_PARTS = 1_200_000, 8_000_000, 50_000
# Bytes of text coded at a time.
BLOCK_BYTES = 1 << 21
_PART = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?|")] = True
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def closing_apart(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds with a last mark after an ASCII letter as a word of its own.

    The splitter cuts there too, and far fewer different words remain to be learned.
    """
    before = data[np.maximum(stops - 2, 0)] | 32
    closed = _CLOSING[data[stops - 1]] & (stops - starts > 1) & (before >= 97) & (before <= 122)
    at = np.flatnonzero(closed) + 1
    shifted = first + np.searchsorted(at, first, "right")
    begins = np.insert(starts, at, stops[closed] - 1)
    ends = np.insert(np.where(closed, stops - 1, stops), at, stops[closed])
    return begins, ends, shifted


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, equal to the tokenizer's on whole texts.

    The tokenizer drops white space and never joins characters across it, so a text's ids are
    those of its chunks between ASCII white space, one after the other. Chunks come back often
    and are remembered here by their hash, in arrays, as a worker keeps them for long: some 30
    bytes a chunk. A run of letters goes to the tokenizer's model at once; all else goes through
    its normalizer and splitter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[bytes, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        # Hashes in order, where the ids of each begin in the pool, and how many they are.
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, coded: list[bytes]) -> None:
        """Remember the ids of new chunks, given by their hashes in order."""
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = np.searchsorted(self.known, hashes)
        self.begin = np.insert(self.begin, at, len(self.pool) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.known = np.insert(self.known, at, hashes)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), "<u4")])

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are not remembered."""
        at = np.searchsorted(self.known, hashes)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == hashes[there]
        return np.flatnonzero(~there)

    def _letters(self, text: str) -> bytes:
        """Ids of lower-case letters in composed form, which the splitter leaves whole."""
        return b"".join(t.id.to_bytes(4, "little") for t in self.tokenize(text))

    def _rest(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return self._letters(part.decode("latin-1").translate(BYTE_LETTERS))
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        return b"".join(i.to_bytes(4, "little") for i in coded.ids)

    def _parts(self, chunk: bytes) -> list[bytes]:
        """Parts of a lower-cased chunk that the tokenizer codes one by one."""
        if chunk.isascii():
            return _PART.findall(chunk)
        head = chunk.rstrip(_MARKS)
        # A letter whose normal form ends in a combining mark, as that of U+0130 does, joins the marks after it.
        if head and head != chunk and unicodedata.normalize("NFC", head.decode()).lower()[-1].isalpha():
            return [head, chunk[len(head) :]]
        return [chunk]

    def _special(self, chunk: bytes) -> bytes:
        """Ids of a chunk that may hold a special token; their spelling counts, so its case stays."""
        coded = self.tokenizer.encode(chunk.decode(), add_special_tokens=False)
        return b"".join(i.to_bytes(4, "little") for i in coded.ids)

    def _part(self, part: bytes) -> bytes:
        """Ids of one of several parts of a chunk; marks and digits come back often."""
        if part.isalpha():
            return self._letters(part.decode())
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED_PARTS:
                self.parts.clear()
            ids = self.parts[part] = self._rest(part)
        return ids

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of one lower-cased chunk."""
        if chunk.isalpha():
            return self._letters(chunk.decode())
        parts = self._parts(chunk)
        return b"".join([self._part(p) for p in parts]) if len(parts) > 1 else self._rest(chunk)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the place of each text's first, with the end at last."""
        if len(self.known) > REMEMBERED or len(self.pool) > REMEMBERED_IDS:
            self._forget()
        data, offsets = text_buffer(texts)
        starts, stops, first = closing_apart(data, *word_bounds(data, offsets))
        hashes = hash_words(data, starts, stops)
        raw = data.data
        # Chunks with the beginning of a special token are told apart by case as well.
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) else []
        special = np.unique(np.searchsorted(starts, marks, "right") - 1) if len(marks) else np.zeros(0, np.int64)
        special = special[(special >= 0)]
        for i in special.tolist():
            digest = hashlib.blake2b(bytes(raw[starts[i] : stops[i]]), digest_size=8).digest()
            hashes[i] = int.from_bytes(digest, "little")
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._unknown(distinct)
        if len(new):
            coded, at = [], sample[new]
            for low, high, exact in zip(starts[at].tolist(), stops[at].tolist(), np.isin(at, special).tolist(), strict=True):
                chunk = bytes(raw[low:high])
                coded.append(self._special(chunk) if exact else self.chunk(chunk.lower()))
            self._learn(distinct[new], coded)
        found = np.searchsorted(self.known, distinct)
        counts = self.size[found][which].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(ends[-1]) + np.repeat(self.begin[found][which] - ends[:-1], counts)
        return self.pool[places], ends[first]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(size: int, capacity: int, waste: float) -> Iterator[tuple[int, int, int]]:
    """Start, length and class of a text's pieces; class 0 fills a bin alone."""
    at = 0
    while size - at >= capacity:
        yield at, capacity, 0
        at += capacity
    while (rest := size - at) > 0:
        kind = capacity // rest
        slot = capacity // kind
        head = capacity // (kind + 1)
        if slot - rest > waste * slot and 0 < head < rest:
            yield at, head, kind + 1
            at += head
        else:
            yield at, rest, kind
            at = size


class Packer:
    """Fills bins and gives their pieces as (document, start, ids, bin, offset)."""

    def __init__(self, prefix: int, capacity: int, waste: float):
        self.next, self.capacity, self.waste = prefix << 36, capacity, waste
        self.waiting: dict[int, list[tuple]] = {}

    def _bin(self, pieces: list[tuple]) -> Iterator[tuple]:
        number, offset = self.next, 0
        self.next += 1
        for row, start, ids in pieces:
            yield row, start, ids, number, offset
            offset += len(ids) // 4

    def add(self, row: tuple, ids: bytes) -> Iterator[tuple]:
        for start, length, kind in pieces_of(len(ids) // 4, self.capacity, self.waste):
            piece = (row, start, ids[4 * start : 4 * (start + length)])
            if kind < 2:
                yield from self._bin([piece])
                continue
            waiting = self.waiting.setdefault(kind, [])
            waiting.append(piece)
            if len(waiting) == kind:
                yield from self._bin(self.waiting.pop(kind))

    def finish(self) -> Iterator[tuple]:
        """Lay what waits end to end, longest class first, cut where a bin is full."""
        bin_, room = [], self.capacity
        for kind in sorted(self.waiting):
            for row, start, ids in self.waiting[kind]:
                while ids:
                    head, ids = ids[: 4 * room], ids[4 * room :]
                    bin_.append((row, start, head))
                    start += len(head) // 4
                    room -= len(head) // 4
                    if not room:
                        yield from self._bin(bin_)
                        bin_, room = [], self.capacity
        if bin_:
            yield from self._bin(bin_)
        self.waiting = {}


def pack(
    df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
    capacity: int = CAPACITY, end_id: int = 1, waste: float = WASTE,
) -> DataFrame:
    """Pieces of all texts with their ids (binary, little-endian 32-bit), bin and offset in it.

    Every text's ids end with `end_id`; NULL and empty texts are that id alone. Repeated rows
    are packed each. Bins have unique numbers made of the task's and a count, so that a task
    that runs again gives the same ones; they are not consecutive. Other columns take no part.
    An empty table gives no pieces.
    """
    source = df.select(df[key].alias("key"), df[text].alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    names = ["key", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), capacity, waste)

        def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0][0] for r in rows], kind),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[0][1] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names,
            )

        kind = None
        for batch in batches:
            kind = batch.column("key").type
            for part in batches_of(batch, limit=BLOCK_BYTES):
                rows: list[tuple] = []
                keys = part.column("key").to_pylist()
                ids_of_all, first = encoder.encode(part.column("text"))
                for i, k in enumerate(keys):
                    ids = ids_of_all[first[i] : first[i + 1]].tobytes() + end
                    rows.extend(packer.add((k, len(ids) // 4), ids))
                yield table(rows, kind)
        if kind is not None:
            yield table(list(packer.finish()), kind)
        # The worker stays, and idles beside the next stages.
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(
        run, f"key {key_type}, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("key", key)


def piece_length(ids: str = "ids") -> Column:
    """Tokens of a piece."""
    return (F.octet_length(F.col(ids)) / 4).cast("long")
