"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie in one array of symbols, one after another. In each round every sequence merges the
pair that has the lowest rank in it, all sequences at once and all places of the pair from the left; what has no pair left
to merge drops out with the number of its symbols. A pair that a merge makes has a higher rank than the merge itself
(checked on loading), so that merging all places of a pair in one round gives what merging them one by one gives.

Pre-tokens come from the library's own pre-tokenizer. Texts are cut at spaces and newlines before that, where no
pre-token reaches over, so that words are counted once in a task and remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlattice.llm.common import bound_batches, octet_of

LIMIT = 512
#: Words that a task remembers at most, characters that are cut into words at a time, symbols that are merged at a time.
MEMO, SEGMENT, BLOCK = 300_000, 1 << 20, 1 << 20
#: The rank of what is no pair.
NONE = np.int32(np.iinfo(np.int32).max)
#: Where a cut before each space and newline could part a pre-token: three white spaces, or two at the end; and NUL, which marks the cuts.
_WHOLE = re.compile(r"[\x00\x1c-\x1f]|\s\s(?!\S)")
#: A space between two characters that are none: a pre-token always begins there.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class TokenCounter:
    """Counts for a byte-level BPE in the tokenizers library's format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, self.special = spec["model"]["vocab"], re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.first = np.zeros(1 << 16, np.int32)
        for character in octet_of():
            self.first[ord(character)] = vocabulary[character]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.size = len(vocabulary)
        left, right = (np.array([vocabulary[p[side]] for p in pairs], np.int64) for side in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        since = np.full(self.size, -1)
        since[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(since[left], since[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge comes before what it merges")
        keys = left * self.size + right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE if nothing merges it."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[np.minimum(at, len(self.order) - 1)], NONE)

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """How many symbols are left of each pre-token (in the vocabulary's characters, none of them empty)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left, ends = lengths.copy(), np.cumsum(lengths)
        symbols = self.first[np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2")]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NONE
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            target = np.repeat(least, sizes)
            if (least == NONE).any():
                going = target != NONE
                symbols, owner, rank, target = symbols[going], owner[going], rank[going], target[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == target)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
            at = at[(at - run) % 2 == 0]  # in a run of one symbol, from the left
            left -= np.bincount(owner[at], minlength=len(left))
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # where they are after that
            symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = near[near < len(symbols) - 1]
            rank[near] = NONE
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        return left

    def _learn(self, pieces: Iterable[str]) -> None:
        block, size = [], 0
        for piece in pieces:
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                self.pieces.update(zip(block, self.survivors(block).tolist(), strict=True))
                block, size = [], 0
        if block:
            self.pieces.update(zip(block, self.survivors(block).tolist(), strict=True))

    def _sum(self, parts: list[list[str]]) -> list[int]:
        """The tokens of each list of pre-tokens."""
        self._learn({p for part in parts for p in part} - self.pieces.keys())
        return [sum(map(self.pieces.__getitem__, part)) for part in parts]

    def _split(self, text: str) -> list[str]:
        return [piece for piece, _ in self.split(text)]

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if len(self.words) > MEMO or len(self.pieces) > MEMO:
            self.words.clear()
            self.pieces.clear()
        totals, cut, whole = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            plain = self.special.split(text)
            totals[i] = len(plain) - 1
            for part in plain:
                for segment in segments(part):
                    if _WHOLE.search(segment):
                        whole.append((i, segment))
                    elif segment:
                        cut.append((i, segment.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")))
        fresh = list({word for _, words in cut for word in words} - self.words.keys())
        self.words.update(zip(fresh, self._sum([self._split(word) for word in fresh]), strict=True))
        for i, words in cut:
            totals[i] += sum(map(self.words.__getitem__, words))
        for i, segment in whole:
            totals[i] += self._sum([self._split(segment)])[0]
        return totals


def segments(text: str) -> Iterator[str]:
    """The text in parts of SEGMENT characters or more, cut where a pre-token begins."""
    at = 0
    while len(text) - at > SEGMENT and (safe := _SAFE.search(text, at + SEGMENT)):
        yield text[at : safe.start()]
        at = safe.start()
    yield text[at:]


@lru_cache(1)
def counter(path: str) -> TokenCounter:
    """One for each Python worker."""
    return TokenCounter(path)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > `limit`).

    Strings of special tokens within a text count as those tokens, as the library does by default. A null text is an empty
    one: no bytes, no tokens. Repeated rows are answered each, null ids too; an empty table gives no rows. No other column
    of `documents` is read. A text is cut into words a million characters at a time, however long it is. Nothing is
    shuffled.
    """
    bound_batches(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            tokens = own.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counted, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
