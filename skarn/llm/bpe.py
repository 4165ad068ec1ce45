"""Byte-level BPE: encoding by tree concatenation, decoding, and their queries' digests.

The ids are those of the tokenizers library for the same vocabulary file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after which white space or the end follows isn't always the start of a pre-token.
UNSAFE = re.compile(r" \s| \Z")
#: A pre-token of more bytes is encoded as a tree of halves.
LEAF = 4096


def _byte_chars() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + i) for i, b in enumerate(other))]}


class Cache(dict):
    """What encode() gives for a word (the text after a space). Two generations bound it: `most` words each.

    The first tier, a table of frequent words, belongs to no generation: it stays.
    """

    def __init__(self, encode: Callable[[str], object], most: int = 250_000) -> None:
        self.encode, self.most, self.old, self.first = encode, most, {}, {}

    def give(self, first: dict[str, object]) -> None:
        self.first = first
        self.update(first)

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.encode(" " + word)
        if len(word) <= 48:
            if len(self) - len(self.first) >= self.most:
                self.old = dict(self)
                self.clear()
                self.update(self.first)
            self[word] = got
        return got


class Codec:
    """Encodes and decodes as the library does, without adding special tokens.

    Special strings in a text are cut out first and get their ids, as the library does by default.
    The text between is split into pre-tokens; a long one that nothing splits is encoded as a tree.
    """

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("merges aren't in the order of ids")
        self.vocab = vocab
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})  # splits nothing
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.unsplit = {n: re.compile(r"\S{%d}|\s{%d}" % (n, n)) for n in (LEAF, LEAF // 4)}
        self.counts = Cache(lambda t: len(self.pack(t)) // 4)
        self.tier: object = None  # the table that counts has as its first tier

    def pack(self, text: str) -> bytes:
        """ids of a text without special strings, as little-endian unsigned 32-bit integers."""
        least = LEAF if text.isascii() else LEAF // 4  # characters of a pre-token of over LEAF bytes, less its space
        long = len(text) > least and self.unsplit[least].search(text)
        return np.array(self._long(text) if long else self.engine.encode_ordinary(text), "<u4").tobytes()

    def _long(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for m in regex.finditer(PATTERN, text):
            piece = m.group().encode()
            out += self.tree(piece) if len(piece) > LEAF else self.engine.encode_ordinary(m.group())
        return out

    def tree(self, piece: bytes, leaf: int = LEAF, threads: int = 2) -> list[int]:
        """ids of one pre-token: its leaves (whole characters) are encoded side by side, then joined in pairs."""
        if piece in self.vocab:
            return [self.vocab[piece]]
        n = 1
        while len(piece) / n > leaf:
            n *= 2
        edges = [len(piece) * i // n for i in range(n + 1)]
        for i in range(1, n):
            while piece[edges[i]] & 0xC0 == 0x80:
                edges[i] -= 1
        leaves = [piece[a:b].decode() for a, b in zip(edges, edges[1:])]
        with ThreadPoolExecutor(threads) as pool:  # encode_ordinary() works outside the interpreter's lock
            parts = list(pool.map(self.whole.encode_ordinary, leaves))
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        return parts[0]

    def merge(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if piece in self.vocab:
            return [self.vocab[piece]]
        return self.engine._encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """ids of the concatenated bytes of two encodings.

        A window around the join is encoded anew, and grows until its first id is the left side's
        and its last id the right side's at the same places. All neighbours in the result then stand
        beside each other in some BPE encoding, which makes the whole a BPE encoding, the only one.
        """
        if not left or not right:
            return left + right
        w = 4
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = b"".join(self.bytes_of[i] for i in left[a:] + right[:b])
            got = self.merge(window)
            if (a == 0 or (got[0] == left[a] and len(got) > 1)) and (b == len(right) or (got[-1] == right[b - 1] and len(got) > 1)):
                return left[:a] + got + right[b:]
            if a == 0 and b == len(right):
                return got
            w *= 2

    def encode(self, text: str) -> bytes:
        """ids of a text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(p.to_bytes(4, "little") if p.__class__ is int else self.pack(p) for p in self._parts(text))

    def count(self, text: str) -> int:
        """The number of ids of a text, from the lengths of its words."""
        return sum(1 if p.__class__ is int else self._count(p) for p in self._parts(text))

    def _parts(self, text: str) -> Iterator[str | int]:
        """The texts between special strings, and the special strings' ids."""
        at = 0
        while self.split and (found := self.split.search(text, at)):
            yield text[at : found.start()]
            yield self.special[found.group()]
            at = found.end()
        yield text[at:]

    def _count(self, text: str) -> int:
        """Each space between two other characters begins a pre-token, so counts of the parts between add up."""
        if " " not in text or UNSAFE.search(text):
            return len(self.pack(text)) // 4
        first, *rest = text.split(" ")
        return (len(self.pack(first)) // 4 if first else 0) + sum(map(self.counts.__getitem__, rest))

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def words(self, text: str) -> Iterator[str]:
        """The words of a text whose counts count() looks up."""
        for p in self._parts(text):
            if p.__class__ is str and " " in p and not UNSAFE.search(p):
                yield from p.split(" ")[1:]


@lru_cache(maxsize=4)
def codec(source: str) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(source)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB, whatever the corpus) for all executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def each_text(batch: pa.RecordBatch, column: int = 0, step: int = 512) -> Iterator[str]:
    """The texts of a column, few at a time; null is empty."""
    for i in range(0, batch.num_rows, step):
        for t in batch.column(column).slice(i, step).to_pylist():
            yield t or ""


def _round_trip(source: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            n, ids, back = [], [], []
            for text in each_text(batch):
                packed = c.encode(text)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from encoding and decoding it.

    A null or empty text has no tokens. Texts of any length are encoded whole. Repeated rows and null
    ids are rows like others; other columns are not read.
    """
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(id_col).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    run = _round_trip(vocabulary(docs.sparkSession, path))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(source: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids = [np.frombuffer(c.encode(t), "<i4") for t in each_text(part)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], tokens], names=[*part.schema.names[1:], "ids"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with its text column replaced by `ids`, an array of ints (a clashing `ids` column is replaced too)."""
    rest = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(F.col(text).cast("string").alias("_text"), *rest)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encode(vocabulary(docs.sparkSession, path)), schema)


def _decode(source: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            texts = [c.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    return run


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with their ids replaced by `text`. Null ids give an empty text."""
    rest = [c for c in rows.columns if c not in (ids, "text")]
    rows = rows.select(F.col(ids).cast("array<int>").alias("_ids"), *rest)
    fields = [f for f in rows.schema.fields if f.name != "_ids"]
    return rows.mapInArrow(_decode(vocabulary(rows.sparkSession, path)), T.StructType([*fields, T.StructField("text", T.StringType())]))
