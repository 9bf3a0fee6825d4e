"""Sum-of-squares packing of token ids into windows.

Each task packs the documents that it reads, one after another, so that nothing is shuffled. A level array counts the
partly filled windows of each fill; a document's last piece goes to the level (or to a new window) with which the sum of
the squared counts is least, which keeps the fills spread and lets later pieces find their fit. At a task's end, windows
that are left open are filled from the emptiest ones, cutting documents; what remains of the last is cut into windows of
a power of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlattice.llm.common import bound_batches, octet_of

WIDTH, END_ID = 2048, 1
#: Words that a task remembers the ids of at most.
MEMO = 300_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a cut before each space and newline could change the pieces: three white spaces, or two at the end; and characters on which libraries differ.
_WHOLE = re.compile(r"[\x00\x1c-\x1f]|\s\s(?!\S)")


class ByteEncoder(dict):
    """Ids (little-endian unsigned 32-bit) of a text for a byte-level BPE in the tokenizers library's format.

    A piece never reaches over the start of a space or newline run, so that words are encoded once and remembered. Words go
    through a faster library with the same vocabulary, texts with special tokens through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        octet = octet_of()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(octet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.words = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.words._core_bpe.encode_single_piece
        self.path = path
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizers library, some 50 MB, loaded for the first text that needs it."""
        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def __missing__(self, word: str) -> bytes:
        if word[1:].isalpha() and word[0] == " ":  # one piece
            found = array("I", self.piece(word.encode())).tobytes()
        elif word[1:-1].isalpha() and word[0] == " " and word[-1] in ".,":  # two pieces
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = array("I", self.words.encode_ordinary(word)).tobytes()
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.special.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if _WHOLE.search(text):
            return array("I", self.words.encode_ordinary(text)).tobytes()
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")))


@lru_cache(1)
def encoder(path: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(path)


class Packer:
    """Windows of `width` ids. A piece is (document, start, ids, ids of the document)."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.opened = width, 0
        self.levels = np.zeros(width + 1, np.int64)
        self.open: dict[int, list[tuple[int, list]]] = {}

    def place(self, doc, ids: bytes) -> Iterator[tuple[int, list]]:
        """Yields (window, pieces) for each window that becomes full."""
        total = len(ids) // 4
        at = total - total % self.width
        for start in range(0, at, self.width):
            yield self._new(), [(doc, start, ids[4 * start : 4 * (start + self.width)], total)]
        if size := total - at:
            window, pieces, fill = self._choose(size)
            pieces.append((doc, at, ids[4 * at :], total))
            if fill + size == self.width:
                yield window, pieces
            else:
                self.levels[fill + size] += 1
                self.open.setdefault(fill + size, []).append((window, pieces))

    def _new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def _choose(self, size: int) -> tuple[int, list, int]:
        left, right = self.levels[1 : self.width - size + 1], self.levels[size + 1 : self.width + 1]
        best, change = 0, 2 * int(self.levels[size]) + 1
        if len(left):
            changes = np.where(left > 0, 2 * (right - left) + 2, np.iinfo(np.int64).max)
            changes[-1] -= 1  # a full window counts no more
            at = len(changes) - 1 - int(np.argmin(changes[::-1]))  # of equals the fullest
            if left[at] and changes[at] <= change:
                best = at + 1
        if not best:
            return self._new(), [], 0
        self.levels[best] -= 1
        return *self.open[best].pop(), best

    def close(self) -> Iterator[tuple[int, list]]:
        """Fills up what is open; one window at most is left over, and cut by powers of two."""
        windows = [[fill, *w] for fill in sorted(self.open) for w in self.open[fill]]
        low = 0
        for high in range(len(windows) - 1, -1, -1):
            if high < low:
                break
            while windows[high][0] < self.width and low < high:
                giver, gap = windows[low], self.width - windows[high][0]
                doc, start, ids, total = giver[2].pop()
                size = len(ids) // 4
                if size > gap:
                    giver[2].append((doc, start, ids[: 4 * (size - gap)], total))
                    start, ids, size = start + size - gap, ids[4 * (size - gap) :], gap
                windows[high][2].append((doc, start, ids, total))
                windows[high][0] += size
                giver[0] -= size
                low += not giver[0]
            if windows[high][0] == self.width:
                yield windows[high][1], windows[high][2]
            elif windows[high][0]:
                yield from self._by_powers(*windows[high])

    def _by_powers(self, fill: int, window: int, pieces: list) -> Iterator[tuple[int, list]]:
        rest, out = list(pieces), []
        while fill:
            want, out = 1 << (fill.bit_length() - 1), []
            fill -= want
            while want:
                doc, start, ids, total = rest.pop(0)
                size = len(ids) // 4
                if size > want:
                    rest.insert(0, (doc, start + want, ids[4 * want :], total))
                    ids, size = ids[: 4 * want], want
                out.append((doc, start, ids, total))
                want -= size
            yield window, out
            window = self._new()


def packed(documents: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one and has the end id alone. Repeated rows are packed each; an empty table gives no rows.
    `sequence_id` is unique, not gapless: the task's number and a number in it. A task that is run again reads the same
    rows in the same order and so packs them alike.
    """
    bound_batches(documents.sparkSession)
    end = array("I", [end_id]).tobytes()
    kind = documents.schema["doc_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base, rows = encoder(tokenizer), Packer(width), TaskContext.get().partitionId() << 33, []

        def add(windows) -> None:
            for window, pieces in windows:
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + window, offset))
                    offset += len(ids) // 4

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc in enumerate(docs):
                add(packer.place(doc, encode.ids(texts[i].as_py() or "") + end))
            if rows:
                yield table(rows, batch.schema.field("doc_id").type)
                rows.clear()
            last = batch.schema.field("doc_id").type
        add(packer.close())
        encode.clear()
        if rows:
            yield table(rows, last)

    def table(rows: list[tuple], doc: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], doc), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return documents.select("doc_id", F.col("text")).mapInArrow(pack, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
