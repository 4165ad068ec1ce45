"""Exact deduplication by compressed radix tries that own every distinct text."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.common import attach, stored

NODE_BYTES = 400


class Spill:
    """A subtree on disk, in Spark's own scratch folder: it ends with the task, as a sort's spill does."""

    def __init__(self) -> None:
        where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.file = tempfile.TemporaryFile(dir=where)

    def write(self, key: bytes, ident: int | None, count: int) -> None:
        self.file.write(struct.pack("<Q?qq", len(key), ident is not None, ident or 0, count))
        self.file.write(key)

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.file.seek(0)
        while head := self.file.read(25):
            size, has, ident, count = struct.unpack("<Q?qq", head)
            yield self.file.read(size), ident if has else None, count
        self.file.close()


class RadixTrie:
    """Full byte strings in a Patricia trie. A terminal node has the smallest id and the number of rows.

    A node is [label, children by first byte or a Spill, terminal or None]. Beyond `limit` bytes
    the heaviest subtree of the first branching node leaves memory: to a Spill, which later strings
    below that node follow, or to `flush`, the caller's sink for partial results.
    """

    def __init__(self, limit: int, flush=None) -> None:
        self.root: list = [b"", {}, None]
        self.limit, self.flush, self.size = limit, flush, 0

    def insert(self, key: bytes, ident: int | None, count: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            children = node[1]
            child = children.get(key[at])
            if child is None:
                children[key[at]] = node = [key[at:], {}, None]
                self.size += end - at + NODE_BYTES
                break
            label = child[0]
            if key.startswith(label, at):
                if child[1].__class__ is Spill:
                    child[1].write(key, ident, count)
                    return
                at += len(label)
                node = child
                continue
            low, high = 1, min(len(label), end - at)  # the first differing byte, by halving
            while low < high:
                mid = (low + high + 1) // 2
                if label[:mid] == key[at : at + mid]:
                    low = mid
                else:
                    high = mid - 1
            children[key[at]] = node = [label[:low], {label[low]: child}, None]
            child[0] = label[low:]
            self.size += NODE_BYTES
            at += low
        if node[2] is None:
            node[2] = [ident, count]
        else:
            mine = node[2]
            mine[1] += count
            if ident is not None and (mine[0] is None or ident < mine[0]):
                mine[0] = ident
        if self.size > self.limit:
            self._shed()

    def _weight(self, node: list) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            if n[1].__class__ is not Spill:
                total += len(n[0]) + NODE_BYTES
                stack += n[1].values()
        return total

    def _shed(self) -> None:
        while self.size > self.limit // 2:
            node, prefix = self.root, b""
            while node[2] is None and len(node[1]) == 1 and (only := next(iter(node[1].values())))[1].__class__ is not Spill and only[1]:
                prefix, node = prefix + only[0], only
            if node[2] is None and len(node[1]) == 1 and not self.flush:  # one string: nothing to part
                return
            heavy = max(((self._weight(c), b) for b, c in node[1].items() if c[1].__class__ is not Spill), default=None)
            if heavy is None:  # what is left lies on disk already, or is one string
                return
            weight, byte = heavy
            child = node[1].pop(byte)
            if self.flush:
                self.flush(self._walk(child, prefix))
            else:
                spill = Spill()
                for x in self._walk(child, prefix):
                    spill.write(*x) if x.__class__ is tuple else [spill.write(*y) for y in x]
                node[1][byte] = [bytes([byte]), spill, None]
            self.size -= weight

    def _walk(self, node: list, prefix: bytes) -> Iterator:
        """(string, id, count) of each terminal; a Spill as it is."""
        stack = [(node, prefix)]
        while stack:
            n, p = stack.pop()
            if n[1].__class__ is Spill:
                yield n[1]
                continue
            p += n[0]
            if n[2] is not None:
                yield p, n[2][0], n[2][1]
            stack += [(c, p) for c in n[1].values()]

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        for x in self._walk(self.root, b""):
            if x.__class__ is tuple:
                yield x
            else:
                below = RadixTrie(self.limit)
                for y in x:
                    below.insert(*y)
                yield from below.drain()


def _owners_of_batches(limit: int):
    """Map side: the distinct texts of a task, each with its smallest id and number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        trie = RadixTrie(limit, flush=out.extend)
        for batch in batches:
            for text, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trie.insert(text, ident)
            if out:
                yield from _batches(out)
                out.clear()
        out.extend(trie.drain())
        yield from _batches(out)

    return run


def _batches(rows: list, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    i = 0
    while i < len(rows):
        size, j = 0, i
        while j < len(rows) and (j == i or size < most):
            size += len(rows[j][0])
            j += 1
        key, ident, count = zip(*rows[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(ident, pa.int64()), pa.array(count, pa.int64())], names=["text", "keep_id", "group_size"])
        i = j


def _owners(limit: int):
    """Reduce side: the owner of every distinct text of a length-and-hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(limit)
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(*x)
        rows: list = []
        for key, ident, count in trie.drain():
            rows.append((hashlib.sha256(key).hexdigest(), ident, count))
            if len(rows) == 20_000:
                yield _digests(rows)
                rows.clear()
        if rows:
            yield _digests(rows)

    return run


def _digests(rows: list) -> pa.RecordBatch:
    sha, ident, count = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(ident, pa.int64()), pa.array(count, pa.int64())], names=["text_sha256", "keep_id", "group_size"])


def normalised(text: Column) -> Column:
    """One space for each run of white space. Runs that are one space already aren't touched, for speed."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), runs, " ")


def owners(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = 96 << 20) -> DataFrame:
    """text_sha256, keep_id and group_size of every distinct normalised text.

    A task's own tries come first, so a text that a third of all rows have is shuffled once a task.
    Then partitions by length and content hash insert the full strings; tries hold `limit` bytes.
    """
    rows = docs.select(normalised(F.col(text)).cast("binary").alias("text"), F.col(id_col).cast("long").alias("keep_id"))
    schema = "text binary, keep_id long, group_size long"
    local = rows.mapInArrow(_owners_of_batches(limit), schema)
    spread = local.repartition(F.octet_length("text"), F.xxhash64("text"))
    return spread.mapInArrow(_owners(limit), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = 96 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; a null
    text counts as empty. The smallest id of a group stays. A null id is larger than any other;
    in a group of null ids only, keep_id is null and its rows are kept. Rows that repeat both the
    kept id and its text are the same document and count as kept. Other columns are not read, so
    their names don't matter. An empty table gives no rows.
    """
    groups = stored(owners(docs, text, id_col, limit), "owners")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"))
    out = attach(rows, groups, "text_sha256", F.col("doc_id"), "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = 96 << 20) -> DataFrame:
    """The rows of docs, whole, that exact_dedup() keeps; of rows that repeat an id and its text, one."""
    result = stored(exact_dedup(docs, text, id_col, limit), "copies")
    drop = result.filter(~F.col("kept")).select(F.col("doc_id").cast("long").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    names = [f"_in_{i}" for i in range(len(docs.columns))]  # the input's own names can't clash with those of the join
    ident, t = (F.col(names[docs.columns.index(c)]) for c in (id_col, text))
    rows = docs.toDF(*names).withColumn("_mine", F.sha2(normalised(t).cast("binary"), 256))
    rows = rows.join(drop, ident.cast("long").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_sha")), "left_anti")
    repeated = result.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count()
    if repeated:
        by = Window.partitionBy(ident, "_mine").orderBy(F.lit(0))
        rows = rows.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1")
    return rows.select(*names).toDF(*docs.columns)
