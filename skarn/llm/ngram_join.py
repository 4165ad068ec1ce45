"""Exact Jaccard self-join of n-gram sets by prefix trees.

Documents with one set are one class. Classes exchange their n-grams by hash partitions, which count in
how many classes each n-gram is; one that no other class has can't be in an intersection, so sets shrink
to their shared n-grams, in the global order from rare to common. Two sets that are similar enough
share one of the first n - ceil(t n) + 1 of that order. Classes that meet there come together in a
block, whose sets are stored in a trie that all of them traverse at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm import kernel
from skarn.llm.common import attach, partitions, stored, text_hash
from skarn.llm.components import connected_components

U64, MASK48 = np.uint64, np.uint64((1 << 48) - 1)
NO_ID = -(1 << 63)
FLUSH = 3_000_000
#: An n-gram that so many classes of one flush have is hot: it goes to its classes' partitions without passing its own.
HOT = 32
#: What stands for the number of classes of every n-gram that is hot in some flush.
HOT_DF = 65_535
ROWS = "part int, kind int, a binary, b binary, c binary, d binary, e binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["part", "kind", "a", "b", "c", "d", "e"])


def _in_parts(rows: list[tuple], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    i = size = 0
    for j, r in enumerate(rows):
        size += sum(len(x) for x in r[2:] if x)
        if size > most:
            yield _rows(rows[i : j + 1])
            i, size = j + 1, 0
    if i < len(rows):
        yield _rows(rows[i:])


def _pack48(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each document, each one's document, the set sizes and the sets' digests."""
    data = kernel.lowered(data)
    starts, ends, counts = kernel.words(data, offsets)
    h, doc = kernel.whole_or_shingles(kernel.word_hashes(data, starts, ends), counts, k)
    n = np.bincount(doc, minlength=len(counts)).astype(np.int64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(kernel.mix(h ^ U64(0xC0FFEE)), dtype=U64)])
    edge = np.concatenate([[0], np.cumsum(n)])
    return h, doc, n, kernel.mix((sums[edge[1:]] - sums[edge[:-1]]) + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def _by_owner(owner: np.ndarray, item: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part that occurs: its owners, their number of items, and the items in that order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 65_535 else part, kind="stable")
    owner, item, part = owner[order], item[order], part[order]
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
        if lo < hi:
            own = owner[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield int(part[lo]), own[first], np.diff(np.append(first, hi - lo)), item[lo:hi]


def _emit(parts: int, k: int, least: int):
    """Map side: the n-grams of the task's distinct sets by hash partition, and a line for each document."""

    def flush(held: list, ids: list) -> Iterator[pa.RecordBatch]:
        h, n, e = (np.concatenate(x) for x in zip(*held))
        doc, digest = (np.concatenate(x) for x in zip(*ids))
        rows = [(int(np.sum(doc[:1], dtype=np.int64)) % parts, 0, doc.tobytes(), n.astype("<i4").tobytes(), e.tobytes(), digest.astype("<i4").tobytes(), None)]
        which = np.lexsort((n, e))
        new = np.ones(len(e), bool)
        new[1:] = (e[which][1:] != e[which][:-1]) | (n[which][1:] != n[which][:-1])
        use = np.zeros(len(e), bool)
        use[which[new]] = True
        use &= n > 0
        own = np.repeat(np.arange(len(n)), n)
        keep = use[own]
        h, own = h[keep], own[keep]
        order = np.argsort(h)
        edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
        many = np.diff(edge) >= least
        if many.any():
            first = order[edge[:-1][many]]
            for p, _, _, items in _by_owner(np.zeros(len(first), np.int64), h[first] // U64(parts), h[first] % U64(parts), parts):
                rows.append((p, 3, _pack48(items & MASK48), None, None, None, None))
            hot = np.zeros(len(h), bool)
            hot[order] = np.repeat(many, np.diff(edge))
            token = (h[hot] // U64(parts) & MASK48) * U64(parts) + h[hot] % U64(parts)
            for q, o, c, items in _by_owner(own[hot], token, e[own[hot]] % U64(parts), parts):
                rows.append((q, 2, items.tobytes(), np.full(len(items), HOT_DF, "<u2").tobytes(), e[o].tobytes(), n[o].astype("<i4").tobytes(), c.astype("<i4").tobytes()))
            h, own = h[~hot], own[~hot]
        for p, o, c, items in _by_owner(own, h // U64(parts), h % U64(parts), parts):
            rows.append((p, 1, _pack48(items & MASK48), c.astype("<u2" if c.max() < 65_536 else "<u4").tobytes(), e[o].tobytes(), n[o].astype("<i4").tobytes(), None))
        yield from _in_parts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        ids: list = []
        size = 0
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(0))
            who, digest = batch.column(1).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy()
            for i, j in kernel.slices(offsets):
                h, _, n, e = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                held.append((h, n, e))
                ids.append((who[i:j], digest[i:j]))
                size += len(h) + j - i
                if size > FLUSH:
                    yield from flush(held, ids)
                    held, ids, size = [], [], 0
        if held:
            yield from flush(held, ids)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple], dict[int, list[tuple]]]:
    """The rows that only pass (lines of documents, hot n-grams of classes) as they are, and the other rows by part."""
    lines, by = [], {}
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[1] in (0, 2):
                lines.append(r)
            else:
                by.setdefault(r[0], []).append(r)
    return lines, by


def _classes(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (digest, size), and the place of each row's among them."""
    order = np.lexsort((n, e))
    e, n = e[order], n[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (n[1:] != n[:-1])
    at = np.empty(len(e), np.int64)
    at[order] = np.cumsum(new) - 1
    return e[new], n[new], at


def _shared(parts: int):
    """By n-gram partition: the n-grams that two classes or more have, with that number, sent to the classes' partitions.

    Of a hot n-gram only the classes of flushes where it isn't hot come here: fewer than that of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, by = _gather(batches)
        yield from _in_parts([(r[0], r[1] and 1, *r[2:]) for r in lines])
        for p, rows in by.items():
            hot = np.unique(np.concatenate([np.zeros(0, U64), *[_unpack48(r[2]) for r in rows if r[1] == 3]]))
            rows = [r for r in rows if r[1] == 1]
            if not rows:
                continue
            token = np.concatenate([_unpack48(r[2]) for r in rows])
            sizes = [len(r[4]) // 8 for r in rows]
            count = np.concatenate([np.frombuffer(r[3], "<u2" if len(r[3]) == 2 * s else "<u4") for r, s in zip(rows, sizes)]).astype(np.int64)
            e, n, at = _classes(np.concatenate([np.frombuffer(r[4], U64) for r in rows]), np.concatenate([np.frombuffer(r[5], "<i4") for r in rows]))
            del rows
            own = np.repeat(at, count)
            order = np.argsort(token, kind="stable")
            token, own = token[order], own[order]
            same = token[1:] == token[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if len(hot):
                more |= hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token
            token, own = token[more], own[more]
            order = np.lexsort((own, token))
            token, own = token[order], own[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            token, own = token[new], own[new]  # a class from two tasks counts once
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            df = np.minimum(np.repeat(size, size), HOT_DF - 1)
            if len(hot):
                df[hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token] = HOT_DF
            keep = df > 1
            token, own, df = token[keep] * U64(parts) + U64(p), own[keep], df[keep]
            order = np.argsort(own, kind="stable")
            token, own, df = token[order], own[order], df[order]
            out = []
            for q, o, c, i in _by_owner(own, np.arange(len(own)), e[own] % U64(parts), parts):
                out.append((q, 1, token[i].tobytes(), df[i].astype("<u2").tobytes(), e[o].tobytes(), n[o].astype("<i4").tobytes(), c.astype("<i4").tobytes()))
            yield from _in_parts(out)

    return run


def _reduced(percent: int):
    """By class partition: documents' rows, and of each class that may be similar to another its shared n-grams in order."""
    names = ["doc_id", "text_hash", "entity", "n", "prefix", "tokens", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, by = _gather(batches)
        for r in lines:
            doc, e, n = np.frombuffer(r[2], np.int64), np.frombuffer(r[4], np.int64), np.frombuffer(r[3], "<i4")
            nothing = [pa.nulls(len(doc), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(np.frombuffer(r[5], "<i4")), pa.array(e), pa.array(n), *nothing], names=names)
        for rows in by.values():
            token = np.concatenate([np.frombuffer(r[2], U64) for r in rows])
            df = np.concatenate([np.frombuffer(r[3], "<u2") for r in rows])
            count = np.concatenate([np.frombuffer(r[6], "<i4") for r in rows])
            e, n, at = _classes(np.concatenate([np.frombuffer(r[4], U64) for r in rows]), np.concatenate([np.frombuffer(r[5], "<i4") for r in rows]))
            del rows
            own = np.repeat(at, count)
            total = np.bincount(own, minlength=len(e))  # with a hot n-gram as often as flushes sent it
            keep = (100 * total >= percent * n)[own]
            token, df, own = token[keep], df[keep], own[keep]
            order = np.lexsort((token, df, own))
            token, df, own = token[order], df[order], own[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            token, df, own = token[new], df[new], own[new]
            total = np.bincount(own, minlength=len(e)).astype(np.int64)
            able = (100 * total >= percent * n) & (total > 0)
            keep = able[own]
            token, df = token[keep], df[keep]
            out, lo = [], 0
            for i in np.flatnonzero(able).tolist():
                hi = lo + int(total[i])
                size = int(n[i])
                prefix = size - -(-percent * size // 100) + 1 - (size - (hi - lo))
                out.append((int(e[i].astype(np.int64)), size, prefix, token[lo:hi].tobytes(), df[lo:hi].tobytes()))
                lo = hi
            for i in range(0, len(out), 1000):
                cols = list(zip(*out[i : i + 1000]))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cols[0]), pa.int64()), pa.nulls(len(cols[0]), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    return run


def _postings(parts: int):
    """The classes' prefixes by n-gram partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, n, prefix, tokens = (batch.column(i) for i in range(4))
            if not batch.num_rows:
                continue
            k = prefix.to_numpy()
            token = np.concatenate([np.frombuffer(t, U64)[:m] for t, m in zip(tokens.to_pylist(), k)])
            own = np.repeat(np.arange(len(k)), np.minimum(k, [len(t) // 8 for t in tokens.to_pylist()]))
            e, n = e.to_numpy().view(U64), n.to_numpy()
            out = [(p, 1, i.tobytes(), c.astype("<i4").tobytes(), e[o].tobytes(), n[o].astype("<i4").tobytes(), None) for p, o, c, i in _by_owner(own, token, kernel.mix(token) % U64(parts), parts)]
            yield from _in_parts(out)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By n-gram: the smallest class of those that have it in their prefix names the block where they meet.

    A row is a block's member, or (member null) some of the n-grams that name the block.
    """
    _, by = _gather(batches)
    names = ["head", "head_n", "entity", "n", "tokens"]
    for rows in by.values():
        token = np.concatenate([np.frombuffer(r[2], U64) for r in rows])
        count = np.concatenate([np.frombuffer(r[3], "<i4") for r in rows])
        e, n, at = _classes(np.concatenate([np.frombuffer(r[4], U64) for r in rows]), np.concatenate([np.frombuffer(r[5], "<i4") for r in rows]))
        del rows
        own = np.repeat(at, count)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        head = np.repeat(own[first], size)
        keep = np.repeat(size, size) > 1
        pair = np.unique(head[keep].astype(U64) << U64(32) | own[keep].astype(U64))
        h, m = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(e[h].view(np.int64)), pa.array(n[h]), pa.array(e[m].view(np.int64)), pa.array(n[m]), pa.nulls(len(h), pa.binary())], names=names)
        t, h = token[first[size > 1]], own[first[size > 1]]
        order = np.argsort(h, kind="stable")
        t, h = t[order], h[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else []
        for i in range(0, len(edges), 5000):
            lo = edges[i : i + 5000]
            hi = [*edges[i + 1 : i + 5000], edges[i + 5000] if i + 5000 < len(edges) else len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(e[h[lo]].view(np.int64)), pa.array(n[h[lo]]), pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.int32()), pa.array([t[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary())], names=names)


class Block:
    """A block's sets in a trie. Its order is from common to rare in the block, so similar sets share long paths."""

    def __init__(self, sets: list[np.ndarray], dfs: list[np.ndarray], n: np.ndarray, prefix: np.ndarray, named: np.ndarray, chunk: np.ndarray, across: bool, percent: int) -> None:
        self.n, self.percent, self.chunk, self.across = n.astype(np.int64), percent, chunk, across
        size = np.array([len(s) for s in sets])
        token, df, own = np.concatenate(sets), np.concatenate(dfs), np.repeat(np.arange(len(sets)), size)
        distinct, at, inverse, count = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, df[at]))  # local numbers follow the global order
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        item = local[inverse]
        self.width, self.size = len(distinct), size
        self.named = np.zeros(len(distinct), bool)
        self.named[local[np.isin(distinct, named)]] = True
        rank = np.empty(len(order), np.int64)
        by_count = np.lexsort((np.arange(len(order)), -count[order]))
        rank[by_count] = np.arange(len(order))
        self.of_rank = by_count
        edge = np.concatenate([[0], np.cumsum(size)])
        self.items = [item[a:b] for a, b in zip(edge, edge[1:])]
        self.first = [x[:k] for x, k in zip(self.items, prefix)]
        seqs = [np.sort(rank[x]) for x in self.items]
        self.order = sorted(range(len(sets)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.seqs = [seqs[i] for i in self.order]

    def links(self, most: int = 48 << 20) -> Iterator[tuple[np.ndarray, int]]:
        """(queries, set): all pairs of different sets that are similar and whose first common prefix n-gram names this block."""
        step = max(1, most // max(1, self.width))
        for i in range(0, len(self.n), step):
            yield from self._traverse(np.arange(i, min(i + step, len(self.n))))

    def _traverse(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        has = np.zeros((len(queries), self.width), bool)
        for r, q in enumerate(queries):
            has[r, self.items[q]] = True
        lead = None
        n, size = self.n[queries], self.size[queries]
        lengths = np.array([len(s) for s in self.seqs])
        counts = self.n[self.order]
        stack = [(0, len(self.seqs), 0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            lo, hi, depth, active, overlap = stack.pop()
            a, b = self.seqs[lo], self.seqs[hi - 1]  # sorted, so these two share what all between them do
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            if end > depth:
                overlap = overlap + np.count_nonzero(has[active[:, None], self.of_rank[a[depth:end]]], axis=1)
            most = overlap + np.minimum(size[active] - overlap, lengths[lo:hi].max() - end)
            able = (100 + self.percent) * most >= self.percent * (n[active] + counts[lo:hi].min())
            active, overlap = active[able], overlap[able]
            if not len(active):
                continue
            while lo < hi and lengths[lo] == end:
                y = self.order[lo]
                ok = (100 * overlap >= self.percent * (n[active] + self.n[y] - overlap)) & (queries[active] != y)
                if self.across:
                    ok &= self.chunk[queries[active]] != self.chunk[y]
                if ok.any():
                    if lead is None:
                        lead = np.zeros_like(has)
                        for r, q in enumerate(queries):
                            lead[r, self.first[q]] = True
                    mine = np.sort(self.first[y])
                    common = lead[active[ok][:, None], mine]
                    hit = common.any(axis=1) & self.named[mine[common.argmax(axis=1)]]
                    if hit.any():
                        yield queries[active[ok][hit]], y
                lo += 1
            while lo < hi:
                token, up = self.seqs[lo][end], lo + 1
                while up < hi and self.seqs[up][end] == token:
                    up += 1
                stack.append((lo, up, end, active, overlap))
                lo = up


def _join(percent: int):
    """By block, sorted: for each class with a link, the documents linked to it here and the root of its tree of links here."""

    def one(rows: list[tuple]) -> tuple[list, list, list]:
        named = [np.frombuffer(r[5], U64) for r in rows if r[6] is None]
        sets = [r for r in rows if r[6] is not None]
        if len(sets) < 2 or not named:
            return [], [], []
        block = Block([np.frombuffer(r[5], U64) for r in sets], [np.frombuffer(r[6], "<u2") for r in sets], np.array([r[3] for r in sets]), np.array([r[4] for r in sets]), np.concatenate(named), np.array([r[9] for r in sets]), rows[0][10] != rows[0][11], percent)
        size = np.array([r[7] for r in sets], np.int64)
        linked, root = np.zeros(len(sets), np.int64), list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for xs, y in block.links():
            linked[xs] += size[y]
            b = find(y)
            for x in np.unique([find(x) for x in xs.tolist()]).tolist():
                root[x] = b
        some = np.flatnonzero(linked)
        top: dict[int, int] = {}
        for i in some.tolist():
            if sets[i][8] is not None:
                top[find(i)] = min(sets[i][8], top.get(find(i), sets[i][8]))
        return [sets[i][2] for i in some], [sets[i][3] for i in some], [(int(linked[i]), sets[i][8], top.get(find(i))) for i in some.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                now = (r[0], r[1], r[10], r[11])
                if now != key and held:
                    for a, b in zip(out, one(held)):
                        a.extend(b)
                    held = []
                key = now
                held.append(r)
            yield _found(*out)
        if held:
            yield _found(*one(held))

    return run


def _found(e: list, n: list, more: list) -> pa.RecordBatch:
    linked, low, root = zip(*more) if more else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(n, pa.int32()), *[pa.array(x, pa.int64()) for x in (linked, low, root)]], names=["entity", "n", "linked", "low", "root"])


def ngram_join(docs: DataFrame, percent: int = 70, k: int = 3, text: str = "text", id_col: str = "doc_id", block: int = 1024, block_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id, text_hash (32 bits, to tell rows of one id apart).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a set is the distinct k-word shingles, or the
    whole sequence of fewer words. Two documents link when their Jaccard similarity is at least
    percent / 100. n_similar counts a document's links, copies included; component_id is the smallest
    id that links reach. A null or empty text has no shingles and no link. Null ids never name a component, unless
    there is no other; documents should have ids of their own, and rows that share one are one node of the
    components. Other columns are not read. n-grams are 64-bit hashes, of which 48 bits and the partition
    take part: two different n-grams of one pair of documents agree with a chance below 1e-9.

    A class that many documents share is sent once a task, and an n-gram that `hot` classes of a task's flush or more share goes to them
    directly. A block with more than `block` classes or `block_bytes` bytes is split into chunks by set size and then by hash, and those pairs of its
    chunks whose sizes allow a link are joined as blocks of their own.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    t = F.col(text).cast("string")
    rows = docs.select(t.alias("_text"), F.col(id_col).cast("long").alias("doc_id"), text_hash(t).alias("text_hash"))
    tokens = rows.mapInArrow(_emit(parts, k, hot), ROWS).repartitionById(parts, F.col("part"))
    back = tokens.mapInArrow(_shared(parts), ROWS).repartitionById(parts, F.col("part"))
    reduced = stored(back.mapInArrow(_reduced(percent), "doc_id long, text_hash int, entity long, n int, prefix int, tokens binary, df binary"), "reduced")
    lines = reduced.filter("prefix is null").select("doc_id", "text_hash", "entity", "n")
    classes = lines.groupBy("entity", "n").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("low"))
    sets = reduced.filter("prefix is not null").select("entity", "n", "prefix", "tokens", "df")

    met = sets.select("entity", "n", "prefix", "tokens").mapInArrow(_postings(parts), ROWS).repartitionById(parts, F.col("part"))
    stars = stored(met.mapInArrow(_stars, "head long, head_n int, entity long, n int, tokens binary"), "stars")
    members = stars.filter("entity is not null").select("head", "head_n", "entity", "n").distinct()
    members = members.withColumn("bucket", _bucket(percent))
    chunks = _chunks(members, block, block_bytes)
    full = sets.join(classes, ["entity", "n"])
    member = members.join(chunks, ["head", "head_n", "bucket"])
    member = member.withColumn("chunk", F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("bucket") * CHUNKS + F.pmod(F.xxhash64("entity", "n"), F.col("_c"))).cast("long"))
    partners = F.when(F.col("_whole"), F.array(F.lit(0).cast("long"))).otherwise(F.concat(_numbers("bucket", "_c"), _numbers("bucket - 1", "_low"), _numbers("bucket + 1", "_up")))
    member = member.withColumn("_o", F.explode(partners)).withColumn("i", F.least("chunk", "_o")).withColumn("j", F.greatest("chunk", "_o"))
    cols = ["head", "head_n", "entity", "n", "prefix", "tokens", "df", "size", "low", "chunk", "i", "j"]
    member = member.join(full, ["entity", "n"]).select(cols)
    whole = chunks.filter("_whole").select("head", "head_n", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")).distinct()
    split = chunks.filter("not _whole").withColumn("i", F.explode(_numbers("bucket", "_c")))
    split = split.withColumn("j", F.explode(F.concat(F.filter(_numbers("bucket", "_c"), lambda x: x >= F.col("i")), _numbers("bucket + 1", "_up"))))
    named = stars.filter("entity is null").join(whole.unionAll(split.select(whole.columns)), ["head", "head_n"])
    none = {c: F.lit(None) for c in ("prefix", "df", "size", "low", "chunk")}
    named = named.withColumns(none).select([F.col(c).cast(dict(member.dtypes)[c]) for c in cols])
    blocks = member.unionAll(named).repartition(parts, "head", "head_n", "i", "j").sortWithinPartitions("head", "head_n", "i", "j")
    found = stored(blocks.mapInArrow(_join(percent), "entity long, n int, linked long, low long, root long"), "found")

    linked = found.groupBy("entity", "n").agg(F.sum("linked").alias("linked"))
    component = connected_components(found.select(F.col("low").alias("u"), F.col("root").alias("v")))
    groups = classes.join(linked, ["entity", "n"], "left").filter("n > 0 and (size > 1 or linked is not null)")
    groups = groups.join(component, F.col("low") == F.col("node"), "left")
    groups = groups.select(_key().alias("key"), "size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("component", "low").alias("component_id"))
    out = attach(lines.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), _key().alias("key")), stored(groups, "similar"), "key", F.col("doc_id"), "size", lines.count())
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


#: More chunks than a size bucket of a block ever has.
CHUNKS = 1 << 24


def _bucket(percent: int) -> F.Column:
    """Sets whose sizes allow a link lie in one bucket or in neighbouring ones. The width is a little more than the widest ratio, for safety from rounding."""
    if percent >= 100:
        return F.col("n").cast("long")
    return F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / percent)))


def _numbers(bucket: str, count: str) -> F.Column:
    return F.expr(f"CASE WHEN {count} > 0 THEN transform(sequence(0, {count} - 1), x -> cast(({bucket}) * {CHUNKS} + x as bigint)) ELSE cast(array() as array<bigint>) END")


def _chunks(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """By block and size bucket: whether the block stays whole; else the number of chunks here, and in the buckets below and above. An n-gram takes 10 bytes."""
    w = Window.partitionBy("head", "head_n")
    o = w.orderBy("bucket")
    by = members.groupBy("head", "head_n", "bucket").agg(F.count(F.lit(1)).alias("_rows"), (10 * F.sum("n")).alias("_bytes"))
    by = by.withColumn("_whole", (F.sum("_rows").over(w) <= block) & (F.sum("_bytes").over(w) <= block_bytes))
    by = by.withColumn("_c", F.when(F.col("_whole"), F.lit(1)).otherwise(F.ceil(F.greatest(F.col("_rows") / block, F.col("_bytes") / block_bytes))).cast("int"))
    for name, other, step in (("_low", F.lag, -1), ("_up", F.lead, 1)):
        by = by.withColumn(name, F.when(other("bucket").over(o) == F.col("bucket") + step, other("_c").over(o)).otherwise(F.lit(0)))
    return by.select("head", "head_n", "bucket", "_whole", "_c", "_low", "_up")


def _key() -> F.Column:
    return F.concat_ws("/", F.hex("entity"), F.col("n"))


def drop_similar(docs: DataFrame, percent: int = 70, k: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, less those that similarity links to a smaller id. A row with a null id can't be named and stays."""
    result = ngram_join(docs, percent, k, text, id_col)
    drop = result.filter("component_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    names = [f"_in_{i}" for i in range(len(docs.columns))]  # the input's own names can't clash with those of the join
    ident, t = (F.col(names[docs.columns.index(c)]) for c in (id_col, text))
    rows = docs.toDF(*names)
    return rows.join(drop, (ident.cast("long") == F.col("_id")) & (text_hash(t.cast("string")) == F.col("_hash")), "left_anti").toDF(*docs.columns)
