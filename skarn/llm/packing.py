"""Best-fit packing of documents into sequences by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.bpe import codec, each_text, vocabulary
from skarn.llm.common import spread_rank, stored

Pattern = tuple[tuple[int, ...], int]


class Completion:
    """An incumbent by bin completion over counts of lengths: each bin takes the first filling of least waste, and is never reconsidered.

    Bins of one filling are made together. `effort` bounds the steps of one bin's search (None: no bound).
    """

    def __init__(self, counts: dict[int, int], cap: int, effort: int | None = 4000) -> None:
        self.cap, self.effort = cap, float("inf") if effort is None else effort
        self.count = [0] * (cap + 1)
        for length, n in counts.items():
            self.count[length] = n
        self.below = list(range(cap + 1))  # the largest length in stock that is no longer, as a forest
        self.reach = 0

    def find(self, x: int) -> int:
        root = x
        while root and not self.count[root]:
            root = self.below[root - 1] if self.below[root] == root else self.below[root]
        while x and x != root and not self.count[x]:
            self.below[x], x = root, (self.below[x] if self.below[x] != x else x - 1)
        return root

    def _reachable(self) -> None:
        """Bit r: lengths in stock (as often as wanted) can fill r exactly. A stale set only has more bits, so its bounds hold."""
        mask, bits = (1 << (self.cap + 1)) - 1, 1
        for length in range(1, self.cap + 1):
            if self.count[length]:
                step = length
                while step <= self.cap:
                    bits |= (bits << step) & mask
                    step *= 2
        self.reach = bits

    def least_waste(self, room: int) -> int:
        low = self.reach & ((1 << (room + 1)) - 1)
        return room - (low.bit_length() - 1)

    def fill(self, room: int) -> list[int]:
        """The undominated filling of least waste. Longer pieces come first, so that of fillings with the
        same waste the one with the longest pieces wins: it dominates those that split a piece's place.
        The first descent is the best-fit solution, the incumbent; a branch that can't waste less is cut.
        """
        best: list[int] = []
        best_waste, nodes = room + 1, 0
        used: dict[int, int] = {}
        chosen: list[int] = []
        stack = [(room, room)]  # what is left, and the longest piece allowed next
        while stack:
            left, longest = stack.pop()
            piece = self.find(min(left, longest))
            while piece and self.count[piece] <= used.get(piece, 0):
                piece = self.find(piece - 1)
            if piece == 0 or self.least_waste(left) >= best_waste or nodes > self.effort:
                if left < best_waste:
                    best, best_waste = list(chosen), left
                    if best_waste == 0 or best_waste == self.least_waste(room):
                        return best
                if chosen:  # back: the piece taken last is now forbidden at its place
                    last = chosen.pop()
                    used[last] -= 1
                    if nodes <= self.effort:
                        left_before, _ = stack.pop()
                        stack.append((left_before, last - 1))
                    else:
                        return best
                continue
            nodes += 1
            chosen.append(piece)
            used[piece] = used.get(piece, 0) + 1
            stack.append((left, longest))
            stack.append((left - piece, piece))
        return best

    def solve(self) -> list[Pattern]:
        patterns: list[Pattern] = []
        while largest := self.find(self.cap):
            if len(patterns) % 32 == 0:
                self._reachable()
            self.count[largest] -= 1
            filling = [largest, *self.fill(self.cap - largest)]
            self.count[largest] += 1
            need = {x: filling.count(x) for x in set(filling)}
            times = min(self.count[x] // n for x, n in need.items())
            for x, n in need.items():
                self.count[x] -= n * times
            patterns.append((tuple(filling), times))
        return patterns


def best_fit(counts: dict[int, int], cap: int) -> list[Pattern]:
    """An incumbent by best fit, longest first: a piece goes where it leaves the least room. Equal bins are filled together."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted

    def put(room: int, p: Pattern) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(p)

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                lengths, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, lengths, times = cap, (), left
            each = room // x
            bins = min(times, left // each)
            if bins == 0:  # the rest goes into one bin
                each, bins = left, 1
            if room != cap and times > bins:
                put(room, (lengths, times - bins))
            put(room - each * x, (lengths + (x,) * each, bins))
            left -= each * bins
    return [p for ps in open_.values() for p in ps]


def bins_at_least(counts: np.ndarray, cap: int) -> int:
    """A lower bound of the number of bins: the better of two.

    Long pieces need a bin each, short ones what those leave too little of (Martello and Toth). And sizes may be rounded to parts of k of a bin, up or down,
    so that no full bin gets more than one (dual feasible functions): of pieces above a third, no bin has three.
    """
    n, s = np.cumsum(counts), np.cumsum(counts * np.arange(cap + 1))
    low = np.arange(cap // 2 + 1)
    half, half_sum = n[cap - low] - n[cap // 2], s[cap - low] - s[cap // 2]
    small = s[cap // 2] - np.where(low > 0, s[low - 1], 0)
    by_length = int((n[cap] - n[cap // 2] + np.maximum(0, -(-(small - (half * cap - half_sum)) // cap))).max())
    k, rounded = _rounded(cap)
    return max(by_length, int((-(-(rounded @ counts) // (k * cap))).max()))


@lru_cache(maxsize=4)
def _rounded(cap: int, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """For k = 1 to `most`, what each length counts of k * cap: k times itself if (k + 1) / cap times it is whole, else that rounded down, times cap."""
    k, x = np.arange(1, most + 1)[:, None], np.arange(cap + 1)[None, :]
    return k[:, 0], np.where((k + 1) * x % cap == 0, k * x, (k + 1) * x // cap * cap)


class Branches:
    """Bin completion by branch and bound over whole packings.

    At each node the longest piece left is completed by every undominated filling, from the least waste on; a filling is
    made as often as stock allows first, and once after that, so that all numbers of it come up. A node is cut if its waste
    exceeds what any better packing may have, or if its bins and the lower bound of the rest reach the incumbent.
    The search ends when the incumbent meets the lower bound, when it is exhausted (`proven`: no packing has fewer bins), or after `effort` steps.
    """

    def __init__(self, counts: dict[int, int], cap: int, effort: int | None) -> None:
        self.cap = cap
        self.count = np.zeros(cap + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.total = int((self.count * np.arange(cap + 1)).sum())
        self.bound = bins_at_least(self.count, cap)
        self.left = float("inf") if effort is None else effort
        some = [best_fit(counts, cap), Completion(counts, cap, None if effort is None else 4000).solve()]
        self.best = min(some, key=lambda p: sum(n for _, n in p))
        self.fewest = sum(n for _, n in self.best)
        self.used = self.waste = 0
        self.proven = self.fewest == self.bound

    def _room_for_waste(self) -> int:
        """What a packing with a bin less than the incumbent may still waste."""
        return (self.fewest - 1) * self.cap - self.total - self.waste

    def _fillings(self, room: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(waste, runs of lengths) of the undominated fillings of a room from the stock, the least waste first."""
        stock = np.flatnonzero(self.count[: room + 1]).tolist()
        self.left -= len(stock) // 10  # what the node itself takes
        kinds = sum(1 << x for x in np.flatnonzero(self.count).tolist())
        bits = [1]  # bit r of bits[i]: the first i lengths, as often as wanted, fill r exactly
        mask = (1 << (room + 1)) - 1
        for x in stock:
            b, step = bits[-1], x
            while step <= room:
                b |= (b << step) & mask
                step *= 2
            bits.append(b)

        def exact(left: int, i: int) -> Iterator[list[tuple[int, int]]]:
            """Fillings of exactly `left` from the first i lengths, those with the longest pieces first."""
            self.left -= 1
            if left == 0:
                yield []
                return
            while i > 0 and self.left > 0:
                i -= 1
                x = stock[i]
                if not bits[i + 1] >> left & 1:
                    return
                for n in range(min(int(self.count[x]), left // x), 0, -1):
                    if bits[i] >> (left - n * x) & 1:
                        for rest in exact(left - n * x, i):
                            yield [(x, n), *rest]

        waste = 0
        while waste <= min(room, self._room_for_waste()) and self.left > 0:
            if bits[-1] >> (room - waste) & 1:
                for runs in exact(room - waste, len(stock)):
                    if not self._dominated(runs, waste, kinds):
                        yield waste, runs
            waste += 1

    def _dominated(self, runs: list[tuple[int, int]], waste: int, kinds: int) -> bool:
        """Whether a piece left over could take the place of some of the filling (or of nothing) and waste less, or as much with fewer pieces."""
        for x, n in runs:
            if n == self.count[x]:
                kinds &= ~(1 << x)
        one = more = 0  # sums of one piece, and of two or more
        for x, n in runs:
            for _ in range(n):
                more |= (more << x) | (one << x)
                one |= 1 << x
        reach = 1
        while reach < waste + 1:  # sums of two or more, and up to `waste` above them
            step = min(reach, waste + 1 - reach)
            more |= more << step
            reach += step
        wider, reach = one << 1, 1
        while reach < waste:
            step = min(reach, waste - reach)
            wider |= wider << step
            reach += step
        return bool(kinds & (more | (wider if waste else 0) | (((1 << (waste + 1)) - 1) & ~1)))

    def _choices(self) -> Iterator[tuple[tuple[int, ...], dict[int, int], int, int]]:
        largest = int(np.flatnonzero(self.count)[-1])
        self.count[largest] -= 1
        fillings = self._fillings(self.cap - largest)
        while True:
            got = next(fillings, None)
            self.count[largest] += 1
            if got is None:
                return
            waste, runs = got
            need = dict(runs)
            need[largest] = need.get(largest, 0) + 1
            times = min(int(self.count[x]) // n for x, n in need.items())
            if waste:
                times = min(times, self._room_for_waste() // waste)
            filling = (largest, *(x for x, n in runs for _ in range(n)))
            for t in [times, 1] if times > 1 else [times]:
                if t > 0:
                    yield filling, need, waste, t
            self.count[largest] -= 1

    def _apply(self, choice: tuple, sign: int) -> None:
        _, need, waste, times = choice
        for x, n in need.items():
            self.count[x] -= sign * n * times
        self.used += sign * times
        self.waste += sign * waste * times

    def solve(self) -> list[Pattern]:
        if self.proven or not self.total:
            return self.best
        path: list[tuple] = []
        stack = [self._choices()]
        while stack and self.left > 0 and self.fewest > self.bound:
            choice = next(stack[-1], None)
            if choice is None:
                stack.pop()
                if path:
                    self._apply(path.pop(), -1)
                continue
            self._apply(choice, 1)
            path.append(choice)
            done = not self.count.any()
            if done and self.used < self.fewest:
                self.best, self.fewest = [(c[0], c[3]) for c in path], self.used
            if done or self._room_for_waste() < 0 or self.used + bins_at_least(self.count, self.cap) >= self.fewest:
                self._apply(path.pop(), -1)
                continue
            stack.append(self._choices())
        self.proven = self.fewest == self.bound or self.left > 0
        return self.best


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, runs of pieces by rank: length, rank of the first, its sequence, offset."""
    rows, base, seen = [], 0, {}
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, seen.get(x, 0), base, offset))
            seen[x] = seen.get(x, 0) + times
            offset += x
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _pieces(source: Broadcast, cap: int, end: int):
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(each_text(batch)):
                packed = c.encode(text) + tail
                n = len(packed) // 4
                start, piece = 0, 0
                while start < n:
                    length = n % cap or cap if start == 0 else cap
                    rows.append((i, piece, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
                    start += length
                    piece += 1
            a = np.array(rows, np.int64).reshape(-1, 5)
            ids = batch.column(1).take(pa.array(a[:, 0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(a[:, 1].astype(np.int32)), *[pa.array(a[:, k]) for k in (2, 3, 4)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(plan: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        edges = np.searchsorted(p["length"], np.arange(p["length"].max() + 2)) if len(p["length"]) else np.zeros(1, np.int64)
        key = p["length"] << 40 | p["first"]
        wide = bool(len(p["first"]) and p["first"].max() >= 1 << 40)
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            if wide:
                at = np.array([edges[n] + np.searchsorted(p["first"][edges[n] : edges[n + 1]], r, "right") - 1 for n, r in zip(length, rank)], np.int64)
            else:
                at = np.searchsorted(key, length << 40 | rank, "right") - 1
            sequence = p["sequence"][at] + rank - p["first"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(p["offset"][at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, cap: int = 2048, end: int = 0, text: str = "text", id_col: str = "doc_id", effort: int | None = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then the id `end`; a null or empty text is that one id. Only a document
    of more than cap ids is cut: into pieces of cap, after a first piece of what is left over. The
    counts of piece lengths (at most cap numbers) reach the driver, which makes the plan of all
    sequences; pieces find their place by their rank among those of their length. Where the plan isn't proven to have the
    fewest sequences possible at once (by a lower bound), the branch and bound goes on for `effort` steps, or with None
    until it is. Repeated rows are
    pieces like others. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(id_col).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(_pieces(vocabulary(spark, path), cap, end), schema), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(slots(Branches(counts, cap, effort).solve()))
    ranked = spread_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInArrow(_place(plan), schema + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, path: str, end: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """sequence_id and ids: the token ids of every sequence that pack() planned, whole. doc_id must be unique."""
    from skarn.llm.bpe import encode

    ids = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), path)
    ids = ids.select("doc_id", F.concat("ids", F.array(F.lit(end))).alias("ids"))
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids"))
    got = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return got.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
