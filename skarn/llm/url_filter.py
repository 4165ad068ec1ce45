"""URL filters: a sorted, memory-mapped array of 64-bit digests, confirmed by the stored strings."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_open: dict[str, Index] = {}


class Index:
    """Rules as files: <name>.keys (sorted digests), .ends and .text (the rules in that order), .block, .lengths."""

    def __init__(self, path: str) -> None:
        self.keys = np.load(f"{path}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{path}.ends.npy", mmap_mode="r")
        self.block = np.load(f"{path}.block.npy", mmap_mode="r")
        self.text = np.load(f"{path}.text.npy", mmap_mode="r")
        self.lengths = np.load(f"{path}.lengths.npy").tolist()

    @staticmethod
    def build(rules: list[tuple[str, str]], path: str) -> list[str]:
        """rules: (verdict, 'host/path'). The rule's host ends at its first slash."""
        text = [r.encode() for _, r in rules]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in text], np.uint64)
        order = np.argsort(keys, kind="stable")
        np.save(f"{path}.keys.npy", keys[order])
        np.save(f"{path}.ends.npy", np.cumsum([0, *(len(text[i]) for i in order)]))
        np.save(f"{path}.text.npy", np.frombuffer(b"".join(text[i] for i in order), np.uint8))
        np.save(f"{path}.block.npy", np.array([rules[i][0] == "block" for i in order], bool))
        np.save(f"{path}.lengths.npy", np.array(sorted({len(r) - r.index("/") for _, r in rules}, reverse=True), np.int64))
        return [f"{path}.{x}.npy" for x in ("keys", "ends", "text", "block", "lengths")]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The rule of each candidate, or -1: binary search of all digests at once, then the strings decide."""
        want = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys):
            return found
        at = np.searchsorted(self.keys, want)
        live = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want))
        for i in live:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:  # more than one only if digests collide
                if self.rule(k) == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def rule(self, k: int) -> bytes:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes()


def _judge(name: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            while len(_open) >= 8:
                _open.pop(next(iter(_open)))
            _open[name] = Index(os.path.join(SparkFiles.getRootDirectory(), name))
        index = _open[name]
        for batch in batches:
            hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            candidates: list[bytes] = []
            row: list[int] = []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                usable = [n for n in index.lengths if n <= len(path)]
                if not usable or not host:
                    continue
                tail: str | None = host
                while tail is not None:
                    for n in usable:
                        candidates.append((tail + path[:n]).encode())
                        row.append(i)
                    tail = tail.partition(".")[2] if "." in tail else None
            rules: list = [None] * len(hosts)
            verdict = [default] * len(hosts)
            if candidates:
                found = index.probe(candidates)
                for j in np.flatnonzero(found >= 0):
                    i, text = row[j], candidates[j].decode()
                    if rules[i] is None or len(text) > len(rules[i]):
                        rules[i], verdict[i] = text, "block" if index.block[found[j]] else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return run


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    rules are (allow or block, 'host/path-prefix'); a rule fits its host and all subdomains, where the
    path starts with the rule's. The longest rule wins; of equal rules, the first given. Without a
    fitting rule, rule is null and the verdict is `default`. A null or empty url, or one without ://,
    has an empty host and path and fits no rule. Repeated rows are judged each. Other columns are not
    read. The rule files are sent to each executor once (SparkContext.addFile) and memory-mapped.
    """
    distinct = list({r: v for v, r in reversed(rules)}.items())
    name = f"rules-{hashlib.sha256(repr(distinct).encode()).hexdigest()[:32]}"  # the same rules are sent once a session
    folder = os.path.join(SparkFiles.getRootDirectory(), f"made-{name}")  # the driver's own folder of files to send
    if not os.path.exists(folder):
        os.makedirs(folder)
        for f in Index.build([(v, r) for r, v in distinct], os.path.join(folder, name)):
            pages.sparkSession.sparkContext.addFile(f)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_judge(name, default), f"page_id {kind}, host string, path string, rule string, verdict string")
