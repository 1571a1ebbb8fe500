"""Best-fit packing by linear grouping.

The plan is made from the histogram of piece lengths, which has at most `capacity` entries at any corpus size:

1. lengths above a share of the capacity are large (LARGE_SHARES are tried); sorted, they are cut into groups of equal cardinality and each is
   rounded up to the largest of its group, so that only a few sizes remain;
2. configurations of these few sizes are optimised: the linear program of how often each is used, solved by column
   generation (each new configuration is the best filling by the sizes' prices, found by dynamic programming). Whole
   multiples are taken; what is left of the groups is filled, largest size first, as full as possible;
3. the actual lengths take the places of the rounded ones, which gives the true gaps;
4. small lengths go, longest first, to the tightest gap that holds them.

A plan without large lengths is best-fit decreasing; it is made too, and the plan with fewer sequences is taken, so that
rounding never costs a sequence. All steps work on runs of equal sequences, so the plan is a short list of rows (length, first rank, count, first
sequence, offset). Documents get a rank among those of their length from counts for each task and length, and look
their place up in the plan: nothing but the histogram and the plan passes the driver.

Cases: null or empty texts hold the end id only; repeated doc_ids are separate rows with pieces of their own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import arrow_map, materialize, release, sliced, table

CAPACITY = 2048
END_ID = 0
#: Shares of the capacity above which lengths are large; each is tried and the plan with fewest sequences is taken.
LARGE_SHARES = (0.4, 0.5)
GROUPS = 128
#: Configurations that column generation tries at most; it ends by itself when none improves the program.
COLUMNS = 300


def _best_fill(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (largest first) fill the room best, within the counts."""
    reach = [1]  # bit masks of the sums that can be reached with the first sizes
    full = (1 << (room + 1)) - 1
    for size, count in zip(sizes, counts, strict=True):
        mask, left, step = reach[-1], min(count, room // size), 1
        while left > 0:
            take = min(step, left)
            mask |= (mask << (take * size)) & full
            left, step = left - take, step * 2
        reach.append(mask)
    at, picked = reach[-1].bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i] >> at & 1:
            picked[i] += 1
            at -= sizes[i]
    return picked


class _Fillings:
    """Finds the configuration with the largest sum of prices, by dynamic programming over its number of items."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        room = np.arange(capacity + 1, dtype=np.int32)[:, None] - sizes.astype(np.int32)
        self.rest, self.shut = np.maximum(room, 0), room < 0

    def best(self, prices: np.ndarray) -> tuple[float, list[int]]:
        every, best, layers = np.arange(self.capacity + 1), np.zeros(self.capacity + 1), []
        for _ in range(self.capacity // int(self.sizes.min())):
            # one more item: for each room the best item before the best filling of what it leaves
            value = best[self.rest] + prices
            value[self.shut] = 0.0
            pick = value.argmax(axis=1)
            more = value[every, pick]
            gain = more > best + 1e-12
            layers.append(np.where(gain, pick, -1))
            best = np.where(gain, more, best)
        chosen, room = [], self.capacity
        for pick in reversed(layers):
            if pick[room] >= 0:
                chosen.append(int(pick[room]))
                room -= int(self.sizes[pick[room]])
        return float(best[self.capacity]), chosen


def optimised(sizes: list[int], counts: list[int], capacity: int, columns: int = COLUMNS) -> list[tuple[dict[int, int], int]]:
    """Configurations (items of each group) and how often each is used, within the counts: the program's whole multiples."""
    if not sizes:
        return []
    size, demand, n = np.array(sizes), np.array(counts, float), len(sizes)
    basis = np.diag((capacity // size).astype(float))  # one column for each configuration in use
    fillings = _Fillings(size, capacity)
    for _ in range(columns):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, items = fillings.best(prices)
        if value <= 1 + 1e-9:
            break
        column = np.bincount(items, minlength=n).astype(float)
        amount, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = column
    used = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(int)
    out = []
    left = list(counts)
    for k in np.argsort(-used, kind="stable"):
        config = {i: int(c) for i, c in enumerate(basis[:, k]) if c}
        times = min([int(used[k]), *(left[i] // c for i, c in config.items())])
        if times > 0:
            out.append((config, times))
            for i, c in config.items():
                left[i] -= c * times
    return out


class _Plan:
    """Runs of equal sequences and the placements in them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank, count, sequence, offset
        self.used: dict[int, int] = defaultdict(int)  # ranks given out for each length
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, count)
        self.open = 0  # bit mask of the gaps that have runs

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count

    def leave(self, gap: int, sequence: int, count: int) -> None:
        if gap:
            self.gaps[gap].append((sequence, count))
            self.open |= 1 << gap

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            tight = self.open >> length
            if not tight:
                runs = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.new(runs), runs)
                continue
            gap = length + (tight & -tight).bit_length() - 1
            sequence, many = self.gaps[gap].pop()
            if not self.gaps[gap]:
                self.open ^= 1 << gap
            take = min(many, count)
            if take < many:
                self.leave(gap, sequence + take, many - take)
            self.place(length, take, sequence, self.capacity - gap)
            self.leave(gap - length, sequence, take)
            count -= take


Placement = tuple[int, int, int, int, int]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_shares: tuple[float, ...] = LARGE_SHARES) -> tuple[list[Placement], int]:
    """Placements (length, first rank, count, first sequence, offset) and the number of sequences: of the best grouped plan, or of best-fit decreasing if that has fewer."""
    best = min((_planned(histogram, capacity, groups, share) for share in (*large_shares, 1.0)), key=lambda p: p.sequences)
    return best.rows, best.sequences


def _planned(histogram: dict[int, int], capacity: int, groups: int, large_share: float) -> _Plan:
    plan = _Plan(capacity)
    if full := histogram.get(capacity, 0):
        plan.place(capacity, full, plan.new(full), 0)
    large = sorted((n for n in histogram if capacity * large_share < n < capacity and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in large)
    # groups of equal cardinality; a length whose copies cross a border is in both
    members: list[list[list[int]]] = [[]]
    room = width = max(1, -(-total // groups))
    for length in large:
        left = histogram[length]
        while left:
            take = min(left, room)
            members[-1].append([length, take])
            left, room = left - take, room - take
            if not room:
                members.append([])
                room = width
    members = [g for g in members if g]
    sizes, counts = [g[0][0] for g in members], [sum(c for _, c in g) for g in members]

    def use(config: dict[int, int], times: int) -> None:
        base = plan.new(times)
        # each slot takes the next members of its group; runs end where a slot's actual length changes
        slots = []
        for i, k in config.items():
            counts[i] -= k * times
            for _ in range(k):
                runs, need = [], times
                while need:
                    take = min(members[i][0][1], need)
                    runs.append([members[i][0][0], take])
                    members[i][0][1] -= take
                    need -= take
                    if not members[i][0][1]:
                        members[i].pop(0)
                slots.append(runs)
        done = 0
        while done < times:
            take, offset = min(runs[0][1] for runs in slots), 0
            for runs in slots:
                plan.place(runs[0][0], take, base + done, offset)
                offset += runs[0][0]
                runs[0][1] -= take
                if not runs[0][1]:
                    runs.pop(0)
            plan.leave(capacity - offset, base + done, take)
            done += take

    for config, times in optimised(sizes, counts, capacity):
        use(config, times)
    while any(counts):
        alive = [i for i, c in enumerate(counts) if c]
        first = alive[0]
        rest = _best_fill([sizes[i] for i in alive], [counts[i] - (i == first) for i in alive], capacity - sizes[first])
        config = {i: k + (i == first) for i, k in zip(alive, rest, strict=True) if k + (i == first)}
        use(config, min(counts[i] // k for i, k in config.items()))
    for length in sorted((n for n in histogram if n <= capacity * large_share and n < capacity), reverse=True):
        if histogram[length]:
            plan.best_fit(length, histogram[length])
    return plan


def _by_length(rows: list[tuple[int, int, int, int, int]]) -> dict[int, tuple]:
    """For each length the first ranks, sequences and offsets of its runs, by rank."""
    found = defaultdict(list)
    for length, rank, _, sequence, offset in rows:
        found[length].append((rank, sequence, offset))
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(own), strict=True)) for n, own in found.items()}


_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, part_rank long"


def cut(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, with its rank among the pieces of its length in its task."""
    tokenizer = tokenizer or tokens.default_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ranks = tokens.encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end, wide = np.uint32(end_id).tobytes(), 4 * capacity
        for batch in sliced(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), wide)):
                    own = ids[at : at + wide]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, ranks[length]))
                    ranks[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), pieces, _PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    # written once: ranks must not change between the histogram and the placement
    rows = materialize(cut(docs, tokenizer, end_id, capacity), "pieces")
    counts = rows.groupBy("part", "length").agg((F.max("part_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = plan_packing(histogram, capacity)
    release()
    plan = spark.sparkContext.broadcast(_by_length(placed))  # bounded: its size depends on the capacity and the groups

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(3), dtype=np.int64), np.asarray(batch.column(5), dtype=np.int64)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                ranks, sequences, places = plan.value[int(n)]
                i = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own], offset[own] = sequences[i] + rank[own] - ranks[i], places[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(length), batch.column(4), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # merged, not broadcast: it has a row for each length in each task
    ranked = rows.join(bases.select("part", "length", "base").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("part_rank")).alias("rank"))
    return arrow_map(ranked, look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
