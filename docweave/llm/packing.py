"""Filling fixed-capacity containers with items, by non-negative least squares.

The plan is made on the histogram of sizes, never on the items.  Combinations
of at most three sizes that fill a container (within a small window) are the
columns of a least-squares problem whose right-hand side is the histogram; its
non-negative solution, rounded down, says how often to repeat each
combination.  What the plan leaves over is packed greedily, largest first, into
the tightest remaining gap, again on counts.  The items are then numbered
within their size and look up the place that the plan holds for that number.

Everything on the driver has at most one entry per size (capacity + 1) or per
combination in use, whatever the number of items.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from docweave.session import cut

#: Tokens that one container holds, unless stated.
CAPACITY = 2048
#: Grains at which combinations are sought: sizes are rounded up to so many units of the capacity, and a combination may leave
#: so many units empty.  A plan is made for each grain and the one with the fewest containers is taken.
GRAINS = ((32, 1), (64, 0), (64, 1), (128, 0))
#: Slots of a plan that are broadcast, some 32 bytes each.
BROADCAST_SLOTS = 100_000
#: Items numbered by one task.
NUMBERED_AT_ONCE = 500_000


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least squares over non-negative repeat counts (active set method).

    ``columns[s]`` lists the rows to which one repeat of ``s`` adds 1.  It ends
    when no column has a gradient left, or when a step no longer brings the
    solution nearer to the target than the arithmetic can tell.
    """
    rows = len(target)
    width = max((len(c) for c in columns), default=0)
    index = np.full((len(columns), max(width, 1)), rows)  # row ``rows`` is a dummy of weight 0
    for s, c in enumerate(columns):
        index[s, : len(c)] = c
    w = np.append(weight, 0.0)

    def column(s: int) -> np.ndarray:
        a = np.zeros(rows + 1)
        np.add.at(a, index[s], w[index[s]])
        return a[:rows]

    b = target * weight
    norm = np.sqrt(np.maximum((w[index] ** 2).sum(axis=1), 1e-12))
    x = np.zeros(len(columns))
    active: list[int] = []
    matrix = np.zeros((rows, 0))
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    nearest = np.inf
    while True:
        residual = np.append(b - matrix @ x[active], 0.0)
        distance = float(residual @ residual)
        if distance >= nearest * (1 - 1e-12):
            break
        nearest = distance
        gradient = (residual * w)[index].sum(axis=1) / norm
        gradient[active] = -np.inf
        s = int(np.argmax(gradient)) if len(columns) else -1
        if s < 0 or gradient[s] <= tolerance:
            break
        active.append(s)
        matrix = np.column_stack([matrix, column(s)])
        while True:
            z = np.linalg.lstsq(matrix, b, rcond=None)[0]
            if z.min() > 0:
                x[active] = z
                break
            now = x[active]
            negative = z <= 0
            ratio = now[negative] / np.maximum(now[negative] - z[negative], 1e-300)
            x[active] = now + ratio.min() * (z - now)
            keep = x[active] > 1e-12
            if keep.all():  # the new column alone is at its bound
                keep[-1] = False
            for s_out in [a for a, k in zip(active, keep) if not k]:
                x[s_out] = 0.0
            active = [a for a, k in zip(active, keep) if k]
            matrix = matrix[:, keep]
            if not active:
                break
    return x


def combinations(present: list[int], units: int, window: int) -> list[tuple[int, ...]]:
    """Multisets of one to three sizes (in units) whose sum lies within ``window`` below ``units``."""
    there = set(present)
    out: list[tuple[int, ...]] = [(a,) for a in present if units - window <= a <= units]
    for a in present:
        for rest in range(units - window - a, units - a + 1):
            if rest >= a and rest in there:
                out.append((a, rest))
        for b in present:
            if b < a or a + b >= units:
                continue
            for rest in range(units - window - a - b, units - a - b + 1):
                if rest >= b and rest in there:
                    out.append((a, b, rest))
    return out


@dataclass
class Pattern:
    """``count`` containers that hold the same sizes."""

    sizes: tuple[int, ...]
    count: int


@dataclass
class Plan:
    capacity: int
    patterns: list[Pattern] = field(default_factory=list)
    planned: int = 0  # containers that come from the least-squares solution, later topped up or not
    planned_items: int = 0

    @property
    def containers(self) -> int:
        return sum(p.count for p in self.patterns)

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(size, first, last, container, each): items of ``size`` numbered first..last-1 go, ``each`` at a time, to containers from ``container``."""
        out, base, used = [], 0, {}
        for p in self.patterns:
            for size in sorted(set(p.sizes)):
                each = p.sizes.count(size)
                start = used.get(size, 0)
                used[size] = start + each * p.count
                out.append((size, start, used[size], base, each))
            base += p.count
        return out


def plan(histogram: dict[int, int], capacity: int, grains: tuple[tuple[int, int], ...] = GRAINS) -> Plan:
    """Containers for ``histogram`` (size -> number of items, sizes 1..capacity); the best of the plans by grain."""
    return min((_plan(histogram, capacity, units, window) for units, window in grains), key=lambda p: p.containers)


def _plan(histogram: dict[int, int], capacity: int, units: int, window: int) -> Plan:
    left = {s: n for s, n in sorted(histogram.items()) if n > 0 and 0 < s <= capacity}
    result = Plan(capacity)
    units = min(units, capacity)
    unit = lambda size: -(-size * units // capacity)
    runs: dict[int, list[int]] = {}
    for size in left:  # ascending, so the largest size of a unit is last
        runs.setdefault(unit(size), []).append(size)
    present = sorted(runs)
    columns = combinations(present, units, window)
    if columns:
        row = {u: i for i, u in enumerate(present)}
        target = np.array([sum(left[s] for s in runs[u]) for u in present], dtype=float)
        # Short items fit anywhere later, so their residual weighs less.
        weight = np.array([1.0 if u > units // 8 else 0.1 for u in present])
        repeats = np.floor(nnls([tuple(row[u] for u in c) for c in columns], target, weight) + 1e-9).astype(int)
        for c, n in sorted(zip(columns, repeats), key=lambda x: -x[1]):
            while n > 0:
                sizes = []
                for u in c:  # the largest size of each unit that is still there
                    size = next((s for s in reversed(runs[u]) if left[s] > sizes.count(s)), None)
                    if size is None:
                        break
                    sizes.append(size)
                if len(sizes) < len(c):
                    break
                times = min([n, *(left[s] // sizes.count(s) for s in sizes)])
                for s in sizes:
                    left[s] -= times
                result.patterns.append(Pattern(tuple(sizes), int(times)))
                n -= times
    result.planned = result.containers
    result.planned_items = sum(len(p.sizes) * p.count for p in result.patterns)
    _fill(result, left)
    return result


def _fill(result: Plan, left: dict[int, int]) -> None:
    """Greedy packing of what is left, largest first, into the tightest gap; all on counts."""
    capacity = result.capacity
    by_gap: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(p: Pattern) -> None:
        gap = capacity - sum(p.sizes)
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        # Equal contents are one pattern, which keeps their number small.
        for q in by_gap[gap]:
            if q.sizes == p.sizes:
                q.count += p.count
                return
        by_gap[gap].append(p)

    for p in result.patterns:
        put(Pattern(tuple(sorted(p.sizes)), p.count))
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                each = min(capacity // size, n)
                times = n // each
                put(Pattern((size,) * each, times))
                n -= each * times
                continue
            gap = gaps[at]
            p = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            each = min(gap // size, n)
            times = min(p.count, n // each)
            if p.count > times:
                put(Pattern(p.sizes, p.count - times))
            put(Pattern(tuple(sorted(p.sizes + (size,) * each)), times))
            n -= each * times
    result.patterns = [p for ps in by_gap.values() for p in ps]


def pack(items: DataFrame, key: str, size_column: str, capacity: int = CAPACITY) -> DataFrame:
    """Assign sized items to containers of ``capacity``.

    Result: ``key``, ``piece_no``, ``n_pieces``, ``start``, ``size``,
    ``container_id`` (from 0).  An item larger than the capacity is cut into
    full pieces and a rest, no other item is cut.  Items of size 0, negative or
    null take no space and go to an arbitrary container (0 if there is none).
    Repeated rows are packed once each.  Extra columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces, histogram = _pieces(items, key, size_column, capacity)
    spark = items.sparkSession
    made = plan(histogram, capacity)
    total = sum(histogram.values())

    # Numbers within a size: within (size, salt) first, then moved by the counts of the salts before.
    salts = max(1, -(-total // NUMBERED_AT_ONCE))
    salted = pieces.where("size > 0").withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)))
    counts = salted.groupBy("size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("size", "_salt", (F.sum("_n").over(Window.partitionBy("size").orderBy("_salt")) - F.col("_n")).alias("_before"))
    # counts has at most (capacity + 1) * salts rows, one for half a million items per size.
    numbered = salted.withColumn("_k", F.row_number().over(Window.partitionBy("size", "_salt").orderBy(key, "piece_no")) - 1).join(before, ["size", "_salt"])
    # One row per size: an item meets the slots of its size as one sorted array, and takes the one that holds its number.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, first, last, base, each in made.slots():
        slots.setdefault(int(size), []).append((int(first), int(last), int(base), int(each)))
    by_size = spark.createDataFrame([(s, sorted(x)) for s, x in slots.items()], "size int, _slots array<struct<first: long, last: long, base: long, each: long>>")
    held = sum(map(len, slots.values()))
    # Broadcast up to a checked size; a plan of more slots is joined by size, where AQE splits the frequent ones.
    placed = numbered.withColumn("_rank", F.col("_k") + F.col("_before")).join(F.broadcast(by_size) if held <= BROADCAST_SLOTS else by_size, "size")
    slot = F.element_at(F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["last"])), 1)
    placed = placed.withColumn("_slot", slot)
    container = (F.col("_slot.base") + F.floor((F.col("_rank") - F.col("_slot.first")) / F.col("_slot.each"))).cast("long").alias("container_id")
    columns = [key, "piece_no", "n_pieces", "start", "size"]
    empty = pieces.where("size <= 0").select(*columns, F.pmod(F.xxhash64(key), F.lit(max(1, made.containers))).alias("container_id"))
    return placed.select(*columns, container).unionByName(empty)


def _pieces(items: DataFrame, key: str, size_column: str, capacity: int) -> tuple[DataFrame, dict[int, int]]:
    """Items as pieces of at most the capacity, and how many there are of each size."""
    size = F.greatest(F.coalesce(F.col(size_column).cast("long"), F.lit(0)), F.lit(0)).alias("_size")
    sized = cut(items.select(F.col(key), size))
    parts = F.greatest(F.ceil(F.col("_size") / F.lit(capacity)).cast("int"), F.lit(1))
    pieces = (
        sized.withColumn("n_pieces", parts)
        .select(key, "_size", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
        .withColumn("start", F.col("piece_no") * F.lit(capacity).cast("long"))
        .withColumn("size", F.least(F.col("_size") - F.col("start"), F.lit(capacity).cast("long")).cast("int"))
        .drop("_size")
    )
    counted = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows
    histogram = {r["size"]: r["n"] for r in counted}
    return pieces, histogram


def plan_report(items: DataFrame, size_column: str, capacity: int = CAPACITY) -> list[tuple[str, int, int, int, float]]:
    """How each way of planning does on the sizes of ``items``.

    Rows of (way, containers, least possible containers, containers from the
    least-squares solution, share of the pieces that these hold); the ways are
    the grains, and ``greedy``: the residual packer alone.
    """
    _, histogram = _pieces(items.withColumn("_item", F.lit(0)), "_item", size_column, capacity)
    sizes = {s: n for s, n in histogram.items() if s > 0}
    least = -(-sum(s * n for s, n in sizes.items()) // capacity)
    pieces = sum(sizes.values())
    alone = Plan(capacity)
    _fill(alone, dict(sorted(sizes.items())))
    ways = [("greedy", alone), *[(f"{units} units, window {window}", _plan(sizes, capacity, units, window)) for units, window in GRAINS]]
    return [(name, int(p.containers), int(least), int(p.planned), round(float(p.planned_items / pieces), 6) if pieces else 0.0) for name, p in ways]


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """:func:`pack` of texts, sized in tokens of a public tokenizer; null and empty texts have size 0."""
    return pack(count_tokens(documents, key, text_column, vocabulary), key, "n_tokens", capacity)


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, pieces, tokens and the share of space used."""
    used = packed.where("size > 0").groupBy("container_id").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.lit(capacity)), 6).cast(T.DoubleType()).alias("fill"),
    )
