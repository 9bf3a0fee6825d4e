"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut by a rolling hash. A chunk that occurs more than once is encoded once and joined to the documents that hold
it; other chunks are encoded where they are. A cut may part a word, so that an encoded chunk keeps the text before its
first and after its last white space apart. At each join that text is put together and encoded again; the window grows
until white space bounds it on both sides, from where on the ids agree with those of the whole text, since no piece of the
tokenizer holds white space.

Which chunks occur more than once is a join in Spark; tasks know it from a Bloom filter of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlattice.llm import chunks
from turnlattice.llm.common import octet_of, row_ids, sliced, utf8, written

#: Words that a task remembers at most.
MEMO = 200_000
_ODD = re.compile(r"[\x1c-\x1f]")  # white space to Python, but not to Unicode
_WHITE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")
_ENCODED = "head binary, body binary, tail binary, whole boolean"


def words(text: str) -> list[str]:
    """The text without its white space."""
    return [w for w in _WHITE.split(text) if w] if _ODD.search(text) else text.split()


class WordEncoder(dict):
    """Word -> its ids in decimal, joined by spaces; `shown` has its tokens, joined by spaces.

    Plain words of letters below U+0250, with or without marks after them, are pieces that no normalisation but lower case
    changes; they go to a faster library with the same vocabulary, in which the byte 0xFF, which no UTF-8 text holds, stands
    for the end of a word and merges first. All others go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.shown: dict[str, str] = {}
        special = set(self.library.get_added_tokens_decoder())
        octets = octet_of()
        ranks = {bytes(octets[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for i, t in enumerate(self.tokens) if i not in special}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> str:
        plain = _PLAIN.fullmatch(word) if max(word) < "\u0250" else None
        if plain and plain[1].isalpha() and "\u0130" not in word:
            letters, marks = plain.groups()
            ids = self.piece(letters.lower().encode() + b"\xff")
            if marks:
                ids = ids + self.piece(marks.encode() + b"\xff")
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        found = self[word] = " ".join(map(str, ids))
        self.shown[word] = " ".join(map(self.tokens.__getitem__, ids))
        return found

    def encode(self, text: str) -> str:
        return self.both(text)[0]

    def both(self, text: str) -> tuple[str, str]:
        """The ids of a text, and its decoded form: without a decoder, the library joins the tokens by spaces."""
        if len(self) > MEMO:
            self.clear()
            self.shown.clear()
        found = words(text)
        ids = " ".join(map(self.__getitem__, found))
        return ids, " ".join(map(self.shown.__getitem__, found))

    def decode(self, ids: str) -> str:
        return " ".join(map(self.tokens.__getitem__, map(int, ids.split(" ")))) if ids else ""


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def encoded_chunk(encode: WordEncoder, chunk: bytes) -> tuple[bytes, bytes, bytes, bool]:
    """(text before the first white space, ids of what is between, text after the last, if there is no white space)."""
    text = chunk.decode()
    white = _WHITE.search(text)
    if not white:
        return chunk, b"", b"", True
    begin, end = white.start(), _last_white(text)
    ids = encode.encode(text[begin:end])
    return text[:begin].encode(), np.array(ids.split(" ") if ids else [], np.uint16).tobytes(), text[end:].encode(), False


def _last_white(text: str) -> int:
    """The place after the last white space."""
    at = len(text)
    while not _WHITE.match(text, at - 1):
        at -= 1
    return at


def joined(encode: WordEncoder, parts: list[tuple[bytes, bytes, bytes, bool]]) -> str:
    """Ids of a whole text from its encoded chunks; each join is encoded anew."""
    ids, open_text = [], b""
    for head, body, tail, whole in parts:
        open_text += head
        if whole:  # no white space yet: the window grows
            continue
        ids.append(encode.encode(open_text.decode()))
        ids.append(" ".join(map(str, np.frombuffer(body, np.uint16).tolist())))
        open_text = tail
    ids.append(encode.encode(open_text.decode()))
    return " ".join(x for x in ids if x)


def _result(ids: str, decoded: str) -> tuple[int, str, str]:
    return (ids.count(" ") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoded(documents: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one: no ids. Repeated rows are answered each; an empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = row_ids(documents.select("doc_id", utf8().alias("data")))
    known = rows.sparkSession.sparkContext.broadcast(chunks.shared_filter(rows, characters=True))

    def parted(data: bytes) -> list[tuple[bytes, bytes, bool]]:
        ends = chunks.cuts(data, characters=True)
        parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        digests = [chunks.digest(p) for p in parts]
        return list(zip(parts, digests, chunks.members(known.value, chunks.keys(digests)).tolist(), strict=True))

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            out: list[tuple] = []
            docs, numbers, column = batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), batch.column("data")
            for i, (doc, row) in enumerate(zip(docs, numbers, strict=True)):
                data = column[i].as_py()
                parts = parted(data)
                if any(p[2] for p in parts):
                    out += [(row, doc, k, len(parts), d if shared else None, *((None, None, None, None) if shared else encoded_chunk(encode, part)), None, None, None) for k, (part, d, shared) in enumerate(parts)]
                else:
                    out.append((row, doc, 0, 1, None, None, None, None, None, *_result(*encode.both(data.decode()))))
            types = [pa.int64(), batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            names = ["_row", "doc_id", "_k", "_n", "digest", "head", "body", "tail", "whole", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in sliced(batches):
            out: dict[bytes, bytes] = {}
            for i in range(batch.num_rows):
                out |= {d: part for part, d, shared in parted(batch.column("data")[i].as_py()) if shared and d not in seen}
            seen |= out.keys()
            if len(seen) > MEMO:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], ["digest", "chunk"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            found = [encoded_chunk(encode, c.as_py()) for c in batch.column("chunk")]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, t) for c, t in zip(columns, [pa.binary()] * 3 + [pa.bool_()], strict=True))], ["digest", "head", "body", "tail", "whole"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            results = []
            for i in range(batch.num_rows):
                parts = sorted(batch.column("parts")[i].as_py(), key=lambda p: p["_k"])
                if len(parts) != parts[0]["_n"]:
                    raise ValueError("a chunk is missing")
                ids = joined(encode, [(p["head"], p["body"], p["tail"], p["whole"]) for p in parts])
                results.append(_result(ids, encode.decode(ids)))
            columns = list(zip(*results, strict=True)) if results else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string()], strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    result = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    first = written(rows.mapInArrow(in_place, f"_row long, doc_id {kind}, _k int, _n int, digest binary, {_ENCODED}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
    store = rows.select("data").mapInArrow(offered, "digest binary, chunk binary").dropDuplicates(["digest"]).mapInArrow(once, f"digest binary, {_ENCODED}")
    pieces = first.filter("n_tokens is null")
    lent = pieces.filter("digest is not null").select("_row", "doc_id", "_k", "_n", "digest").join(store, "digest")
    part = F.struct("_k", "_n", "head", "body", "tail", "whole")
    # a document's chunks at most come together
    whole = pieces.filter("digest is null").select("_row", "doc_id", part.alias("part")).unionByName(lent.select("_row", "doc_id", part.alias("part"))).groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.collect_list("part").alias("parts"))
    return first.filter("n_tokens is not null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(whole.select("doc_id", "parts").mapInArrow(assembled, result))
