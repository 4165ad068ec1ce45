"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Minimisers of k-word windows are exchanged by hash. An occurrence links to the first document that has the
seed: first the first of its task, and that to the first of all, so links grow with the seeds and not
with pairs. Links of two documents are chained with a gap cost through a Fenwick tree, and the
chains are aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm import kernel
from skarn.llm.common import partitions, stored, text_hash
from skarn.llm.ngram_join import ROWS, U64, _gather, _in_parts

FLUSH = 2_000_000
#: A document is an id and a hash of its text, so that unlike texts under one id are documents of their own.
DOC = np.dtype([("id", "<i8"), ("text", "<i4")])


def minimisers(data: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds: hash, document and first word. Two equal runs of k + w - 1 words have one in common at the same place."""
    starts, ends, counts = kernel.words(data, offsets)
    h, doc, at = kernel.shingles(kernel.word_hashes(data, starts, ends), counts, k)
    if len(h) < w:
        return h[:0], doc[:0], at[:0]
    inside = np.flatnonzero(doc[: len(h) - w + 1] == doc[w - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(h, w)[inside].argmin(axis=1) + inside
    pick = np.zeros(len(h), bool)
    pick[least] = True
    begin = np.concatenate([[0], np.cumsum(counts)])
    return h[pick], doc[pick], at[pick] - begin[doc[pick]]


def _link_rows(doc: np.ndarray, pos: np.ndarray, owner: np.ndarray, place: np.ndarray, parts: int, kind: int) -> list[tuple]:
    part = (kernel.mix(doc["id"].astype(np.int64).view(U64) + doc["text"].astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in range(parts):
        i = order[edges[p] : edges[p + 1]]
        if len(i):
            out.append((p, kind, doc[i].tobytes(), pos[i].astype("<i4").tobytes(), owner[i].tobytes(), place[i].astype("<i4").tobytes(), None))
    return out


def _to_first(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by seed, document and place; each one's first; and whether it lies in the first's document."""
    order = np.lexsort((pos, doc["text"], doc["id"], h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return order, first, doc == doc[first]


def _seeds(parts: int, k: int, w: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h, doc, pos = (np.concatenate(x) for x in zip(*held))
        order, first, own = _to_first(h, doc, pos)
        h, doc, pos = h[order], doc[order], pos[order]
        rest = ~own
        rows = _link_rows(doc[rest], pos[rest], doc[first[rest]], pos[first[rest]], parts, 0)
        h, doc, pos = h[own], doc[own], pos[own]
        part = (h % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            i = order[edges[p] : edges[p + 1]]
            i = i[np.lexsort((doc["text"][i], doc["id"][i]))]
            if len(i):
                d = doc[i]
                lead = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rows.append((p, 1, h[i].tobytes(), pos[i].astype("<i4").tobytes(), d[lead].tobytes(), np.diff(np.append(lead, len(i))).astype("<i4").tobytes(), None))
        yield from _in_parts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(0))
            who = np.empty(batch.num_rows, DOC)
            who["id"], who["text"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j in kernel.slices(offsets):
                h, doc, pos = minimisers(kernel.lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], k, w)
                held.append((h, who[i:j][doc], pos))
                size += len(h)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _links(parts: int):
    """By seed: a link from each occurrence to the first document's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, by = _gather(batches)
        yield from _in_parts([(r[0], 1, *r[2:]) for r in lines])
        for rows in by.values():
            h = np.concatenate([np.frombuffer(r[2], U64) for r in rows])
            pos = np.concatenate([np.frombuffer(r[3], "<i4") for r in rows])
            doc = np.concatenate([np.repeat(np.frombuffer(r[4], DOC), np.frombuffer(r[5], "<i4")) for r in rows])
            order, first, own = _to_first(h, doc, pos)
            doc, pos, rest = doc[order], pos[order], ~own
            yield from _in_parts(_link_rows(doc[rest], pos[rest], doc[first[rest]], pos[first[rest]], parts, 1))

    return run


def chain(a: np.ndarray, b: np.ndarray, k: int, gap: float) -> list[np.ndarray]:
    """Chains of seeds that ascend in both documents, best first, as indices into a and b.

    A seed is worth k words; a step from (a', b') to (a, b) costs gap x (a - a' + b - b'). That cost adds up
    from its ends, so the best step before a seed is a prefix maximum over b in a Fenwick tree.
    """
    order = np.lexsort((-b, a))
    if (np.diff(a[order]) > 0).all() and (np.diff(b[order]) > 0).all():
        return [order]  # in order already: with costs that add up, no chain beats the one through all
    rank = np.unique(b, return_inverse=True)[1] + 1
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(a) + 1)
    score, back = np.zeros(len(a)), np.full(len(a), -1)
    for i in order.tolist():
        best, r = (-np.inf, -1), int(rank[i]) - 1
        while r > 0:
            best = max(best, tree[r])
            r &= r - 1
        here = gap * float(a[i] + b[i])
        score[i] = k
        if best[1] >= 0 and best[0] - here > 0:
            score[i] += best[0] - here
            back[i] = best[1]
        value, r = (float(score[i]) + here, i), int(rank[i])
        while r <= len(a):
            if tree[r][0] < value[0]:
                tree[r] = value
            r += r & -r
    used = np.zeros(len(a), bool)
    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = int(back[i])
        if path:
            out.append(np.array(path[::-1]))
    return out


CHAINS = "doc long, doc_text int, owner long, owner_text int, no int, lo int, hi int, owner_lo int, owner_hi int, a binary, b binary"


def _chains(k: int, gap: float, widest: int, reach: int):
    """By document: chains of seeds, cut at gaps of more than `widest` words, with the words to fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, by = _gather(batches)
        for rows in by.values():
            doc, owner = (np.concatenate([np.frombuffer(r[i], DOC) for r in rows]) for i in (2, 4))
            pos, place = (np.concatenate([np.frombuffer(r[i], "<i4") for r in rows]) for i in (3, 5))
            order = np.lexsort((place, pos, owner["text"], owner["id"], doc["text"], doc["id"]))
            doc, owner, pos, place = doc[order], owner[order], pos[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])]))
            size = np.diff(np.append(first, len(doc)))
            out: list[tuple] = []
            for lo, n in zip(first.tolist(), size.tolist()):
                a, b = pos[lo : lo + n], place[lo : lo + n]
                who = (*doc[lo].item(), *owner[lo].item())
                no = 0
                for c in chain(a, b, k, gap):
                    cut = np.flatnonzero((np.diff(a[c]) > widest + k) | (np.diff(b[c]) > widest + k)) + 1
                    for part in np.split(c, cut):
                        x, y = a[part], b[part]
                        out.append((*who, no, max(0, int(x[0]) - reach), int(x[-1]) + k + reach, max(0, int(y[0]) - reach), int(y[-1]) + k + reach, x.astype("<i4").tobytes(), y.astype("<i4").tobytes()))
                        no += 1
                if len(out) > 5000:
                    yield _table(out, CHAINS)
                    out = []
            if out:
                yield _table(out, CHAINS)

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


WORDS = "doc long, doc_text int, owner long, owner_text int, no int, side int, lo int, a binary, b binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, the text before its requests: each request's words, as 32-bit hashes."""
    now, text, words = None, None, None
    for batch in batches:
        out: list[tuple] = []
        for ident, digest, kind, t, doc, doc_text, owner, owner_text, no, side, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if (ident, digest) != now:
                    now, text, words = (ident, digest), t, None
                continue
            if words is None:
                data, offsets = kernel.buffers(pa.array([text or ""], pa.large_string()))
                data = kernel.lowered(data)
                starts, ends, _ = kernel.words(data, offsets)
                words = kernel.word_hashes(data, starts, ends).astype(np.uint32)
            out.append((doc, doc_text, owner, owner_text, no, side, lo, words[lo:hi].tobytes(), None))
        yield _table(out, WORDS)


#: Words left out or added at one place that the ends of an alignment may have beyond the chain.
SHIFTS = (0, 1, -1, 2, -2, 3, -3)


def tail(x: np.ndarray, y: np.ndarray, identity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the alignment of x and y from their first words on: at each unequal word it takes the shift after which most is gained."""
    xs, ys, same = [], [], []

    def add(u: int, v: int, n: int) -> None:
        xs.append(np.arange(u, u + n))
        ys.append(np.arange(v, v + n))
        same.append(x[u : u + n] == y[v : v + n])

    u = v = 0
    while True:
        m = min(len(x) - u, len(y) - v)
        equal = x[u : u + m] == y[v : v + m]
        t = m if equal.all() else int(equal.argmin())
        add(u, v, t)
        if t == m:
            break
        u, v = u + t, v + t
        best, shift, upto = 1e-9, None, 0
        for d in SHIFTS:
            i, j = u + max(d, 0), v + max(-d, 0)
            n = min(len(x) - i, len(y) - j)
            if n > 0:
                gain = np.cumsum(np.where(x[i : i + n] == y[j : j + n], 1 - identity, -identity))
                top = int(gain.argmax())
                if gain[top] - identity * abs(d) > best:
                    best, shift, upto = gain[top] - identity * abs(d), d, top + 1
        if shift is None:
            add(u, v, m - t)
            break
        xs.append(u + np.arange(abs(shift)) * (shift > 0))
        ys.append(v + np.arange(abs(shift)) * (shift < 0))
        same.append(np.zeros(abs(shift), bool))
        u, v = u + max(shift, 0), v + max(-shift, 0)
        add(u, v, upto)
        u, v = u + upto, v + upto
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(same)


def columns(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, identity: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alignment along a chain: for each column, the next word of x and of y, and whether they are equal.

    Seeds on one diagonal are compared word by word;
    where the diagonal changes, the words between are compared from both ends. The words before the first seed and after the last
    are compared word by word too; with three seeds or more, tail() looks for left out and added words there.
    """
    wide = len(a) > 2
    n = int(min(a[0], b[0]))
    if wide:
        p, q, s = tail(x[: a[0]][::-1], y[: b[0]][::-1], identity)
        xs, ys, same = [a[0] - 1 - p[::-1]], [b[0] - 1 - q[::-1]], [s[::-1]]
    else:
        xs, ys = [np.arange(a[0] - n, a[0])], [np.arange(b[0] - n, b[0])]
        same = [x[a[0] - n : a[0]] == y[b[0] - n : b[0]]]

    def compare(s: int, t: int, m: int) -> None:
        xs.append(np.arange(s, s + m))
        ys.append(np.arange(t, t + m))
        same.append(x[s : s + m] == y[t : t + m])

    turn = np.flatnonzero(np.diff(a - b)) + 1
    u, v = int(a[0]), int(b[0])
    for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(a)]):
        s, t, end = int(a[lo]), int(b[lo]), int(a[hi - 1]) + k
        skip = max(0, u - s, v - t)
        s, t = s + skip, t + skip
        m, extra = min(s - u, t - v), abs((s - u) - (t - v))
        if m or extra:
            fits = x[u : u + m] == y[v : v + m]
            head = m if fits.all() else int(fits.argmin())
            compare(u, v, head)
            more = s - u > t - v  # words of one side only
            xs.append(u + head + np.arange(extra) * more)
            ys.append(v + head + np.arange(extra) * (not more))
            same.append(np.zeros(extra, bool))
            compare(s - (m - head), t - (m - head), m - head)
        if end > s:
            compare(s, t, end - s)
            u, v = end, t + end - s
        else:
            u, v = max(u, s), max(v, t)
    if wide:
        p, q, s = tail(x[u:], y[v:], identity)
        xs, ys, same = [*xs, u + p], [*ys, v + q], [*same, s]
    else:
        compare(u, v, min(len(x) - u, len(y) - v))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(same)


def best_parts(same: np.ndarray, identity: float) -> list[tuple[int, int]]:
    """All maximal scoring runs of columns (Ruzzo and Tompa), where an equal one scores 1 - identity and another -identity.

    In each such run at least `identity` of the columns are equal.
    """
    edge = np.flatnonzero(np.diff(same)) + 1
    edge = [0, *edge.tolist(), len(same)]
    parts: list[tuple[int, int, float, float]] = []  # first, end, score before, score after
    total = 0.0
    for lo, hi in zip(edge, edge[1:]):
        if lo == hi:
            continue
        before = total
        total += (hi - lo) * ((1 - identity) if same[lo] else -identity)
        if not same[lo]:
            continue
        now = (lo, hi, before, total)
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][2] >= now[2]:
                j -= 1
            if j < 0 or parts[j][3] >= now[3]:
                parts.append(now)
                break
            now = (parts[j][0], now[1], parts[j][2], now[3])
            del parts[j:]
    return [(lo, hi) for lo, hi, _, _ in parts]


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Start and end in x, start and end in y, and equal words, of each part of k words or more along a chain."""
    xs, ys, same = columns(x, y, a, b, k, identity)
    return [
        (int(xs[lo]), int(xs[hi - 1]) + 1, int(ys[lo]), int(ys[hi - 1]) + 1, int(np.count_nonzero(same[lo:hi])))
        for lo, hi in best_parts(same, identity)
        if hi - lo >= k
    ]


SEGMENTS = "doc long, doc_text int, owner long, start int, end int, owner_start int, owner_end int, equal int"


def _align(k: int, identity: float):
    """Rows sorted by chain: the chain (side 0), the document's words (1), the owner's (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seeds, mine = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for doc, doc_text, owner, owner_text, no, side, lo, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, doc_text, owner, owner_text, no) != key:
                    key, seeds, mine = (doc, doc_text, owner, owner_text, no), None, None
                if side == 0:
                    seeds = np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4")
                elif side == 1:
                    mine = lo, np.frombuffer(a, np.uint32)
                elif seeds is not None and mine is not None:
                    x, y = mine[1], np.frombuffer(a, np.uint32)
                    s = seeds[0] - mine[0], seeds[1] - lo
                    for start, end, ostart, oend, equal in align(x, y, *s, k, identity):
                        out.append((doc, doc_text, owner, start + mine[0], end + mine[0], ostart + lo, oend + lo, equal))
            yield _table(out, SEGMENTS)

    return run


def segments(docs: DataFrame, k: int = 8, w: int = 8, gap: float = 0.1, widest: int = 48, identity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Aligned pairs: words start..end of doc are words owner_start..owner_end of owner, an earlier document.

    A document is an id with a text (doc_text is the text's 32-bit hash); documents are ordered by both.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    t = F.col(text).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull()).select(t.alias("text"), F.col(id_col).cast("long").alias("id"), text_hash(t).alias("digest"))
    seeds = rows.mapInArrow(_seeds(parts, k, w), ROWS).repartitionById(parts, F.col("part"))
    links = seeds.mapInArrow(_links(parts), ROWS).repartitionById(parts, F.col("part"))
    chains = stored(links.mapInArrow(_chains(k, gap, widest, 64), CHAINS), "chains")
    key = ["doc", "doc_text", "owner", "owner_text", "no"]
    none = {"doc": "long", "doc_text": "int", "owner": "long", "owner_text": "int", "no": "int", "side": "int", "lo": "int", "hi": "int"}
    texts = rows.select("id", "digest", F.lit(0).alias("kind"), "text", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    wanted = [
        chains.select(F.col(who).alias("id"), F.col(f"{who}_text").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), *key, F.lit(side).alias("side"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        for who, side, lo, hi in (("doc", 1, "lo", "hi"), ("owner", 2, "owner_lo", "owner_hi"))
    ]
    both = texts.unionAll(wanted[0]).unionAll(wanted[1]).repartition(parts, "id", "digest").sortWithinPartitions("id", "digest", "kind")
    words = both.mapInArrow(_fetch, WORDS)
    lines = chains.select(*key, F.lit(0).alias("side"), F.lit(0).alias("lo"), "a", "b")
    pairs = words.unionAll(lines).repartition(parts, *key).sortWithinPartitions(*key, "side")
    return pairs.mapInArrow(_align(k, identity), SEGMENTS)


def repeated_passages(docs: DataFrame, words: int = 50, join: int = 3, k: int = 8, w: int = 8, gap: float = 0.1, widest: int = 48, identity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per passage: doc_id, start_word, end_word (exclusive), n_words, owner_id, owner_ids, text_hash.

    A passage is a run of at least `words` words of a document that documents with smaller ids have too,
    nearly or exactly; of each passage the first document's stays unlisted. Its parts may come from
    several owners (owner_ids; owner_id has the longest part): aligned segments, of which a part
    `identity` of the words is equal, are merged if at most `join` words lie between. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Null, empty and short texts have no passage; rows with a null id take no part.
    Rows that share an id and a text are one document. Unlike texts under one id are documents of their own, told
    apart by text_hash (32 bits), by which they are also ordered; an owner then may have the same id. Other columns are not read.
    """
    found = stored(segments(docs, k, w, gap, widest, identity, text, id_col), "segments")
    by = Window.partitionBy("doc", "doc_text").orderBy("start", "end", "owner")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("_new", F.when(F.col("start") > before + join, 1).otherwise(0))
    run = new.withColumn("_run", F.sum("_new").over(by))
    got = run.groupBy("doc", "doc_text", "_run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max_by("owner", F.struct(F.col("end") - F.col("start"), -F.col("owner"))).alias("owner_id"), F.sort_array(F.collect_set("owner")).alias("owner_ids"))
    got = got.withColumn("n_words", F.col("end_word") - F.col("start_word")).filter(F.col("n_words") >= words)
    return got.select(F.col("doc").alias("doc_id"), "start_word", "end_word", "n_words", "owner_id", "owner_ids", F.col("doc_text").alias("text_hash"))


def _cut(at: int):
    def left_of(t: str, spans: list[dict]) -> str:
        raw = t.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, _, _ = kernel.words(data, np.array([0, len(data)]))
        out, last = [], 0
        for lo, hi in sorted((c["start_word"], c["end_word"]) for c in spans):
            out.append(raw[last : starts[lo]])
            last = starts[hi] if hi < len(starts) else len(raw)
        return b"".join([*out, raw[last:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *cols, spans = batch.columns
            names = batch.schema.names[:-1]
            cut = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(cut):
                texts = cols[at].to_pylist()
                keep = np.ones(batch.num_rows, bool)
                for i in cut.tolist():
                    texts[i] = left_of(texts[i], spans[i].as_py())
                    keep[i] = bool(texts[i].strip(" \t\n\r\x0b\x0c"))
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def cut_passages(docs: DataFrame, passages: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without their listed passages, each cut from the text it was found in. A document of which no word is left goes; others keep all their columns."""
    spans = passages.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    at = docs.columns.index(text)
    rows = docs.toDF(*[f"_in_{i}" for i in range(len(docs.columns))])  # the input's own names can't clash with those of the join
    mine = F.col(f"_in_{docs.columns.index(id_col)}").cast("long") == F.col("_id")
    rows = rows.join(spans, mine & (text_hash(F.col(f"_in_{at}").cast("string")) == F.col("_hash")), "left").select(*rows.columns, "_spans")
    return rows.mapInArrow(_cut(at), rows.drop("_spans").schema).toDF(*docs.columns)
