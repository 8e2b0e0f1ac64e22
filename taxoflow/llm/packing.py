"""Items of varying size put into containers of fixed capacity with little unused room."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.session import checkpointed

#: Neighbouring sizes that the linear program treats as one, and rounds of weight updates.
CLASS_WIDTH, ROUNDS = 4, 400
#: Rows of one size that a sort may meet in one task; beyond it they are ranked in hashed buckets.
BUCKET_ROWS = 500_000


def _best_pattern(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size in the heaviest filling of one container: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        n = fits[room]
        gain = value[room - sizes[:n]] + weights[:n]
        k = int(gain.argmax())
        value[room], choice[room] = gain[k], k
        if value[room - 1] > value[room]:
            value[room], choice[room] = value[room - 1], -2
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0 and choice[room] != -1:
        if choice[room] == -2:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return counts


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[int, np.ndarray]]:
    """Whole copies of patterns from the configuration linear program: cover all items by fewest containers.

    Multiplicative weights: sizes little covered so far weigh most, and the knapsack prices the pattern that
    covers most weight. A pattern is taken as often as leaves every class covered by a share more at most. The
    fractional solution is scaled to cover each class once on average and rounded down, never taking more
    items than there are.
    """
    share = 0.1
    cover, use = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        weights = np.exp(-4.0 * (cover / demand - (cover / demand).min())) * sizes / capacity
        pattern = _best_pattern(weights * (1 + 1e-9 * np.arange(len(sizes))), sizes, capacity)
        held = pattern > 0
        step = max(share * float((demand[held] / pattern[held]).min()), 1e-9)
        cover += step * pattern
        key = pattern.tobytes()
        use[key] = use.get(key, 0.0) + step
    scale = float((demand * sizes).sum() / max((cover * sizes).sum(), 1e-9))
    left, out = demand.copy(), []
    for key, x in sorted(use.items(), key=lambda kv: -kv[1]):
        pattern = np.frombuffer(key, dtype=np.int64)
        held = pattern > 0
        copies = min(int(x * scale), int((left[held] // pattern[held]).min()))
        if copies:
            left -= copies * pattern
            out.append((copies, pattern))
    return out


def _fill_rest(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns for what the rounding left: the largest size that fits goes in first, equal fillings together."""
    left = {s: n for s, n in left.items() if n > 0}
    sizes, out = sorted(left), []
    while sizes:
        room, pattern, upto = capacity, {}, len(sizes)
        while upto := min(upto, bisect_right(sizes, room)):
            size = sizes[upto - 1]
            take = min(left[size], room // size)
            pattern[size] = take
            room -= take * size
            upto -= 1
        copies = min(left[s] // n for s, n in pattern.items())
        out.append((copies, pattern))
        for s, n in pattern.items():
            left[s] -= copies * n
            if not left[s]:
                sizes.remove(s)
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where the r-th item of each size goes, and the number of containers.

    Rows of (size, first rank, container of the first, items per container, shift): the item of that size and
    rank r goes to ``container + (r + shift) // per``. Its length depends on the capacity, not on the items.
    """
    full = histogram.get(capacity, 0)
    rows, used = [], 0
    taken = {s: 0 for s in histogram}
    small = sorted(s for s in histogram if s < capacity and histogram[s] > 0)
    if small:
        # Each class is as large as its largest size; its items are taken from the largest on.
        members: dict[int, list[int]] = {}
        for s in small:
            members.setdefault((s - 1) // CLASS_WIDTH, []).append(s)
        classes = sorted(members)
        tops = np.array([max(members[c]) for c in classes], dtype=np.int64)
        demand = np.array([sum(histogram[s] for s in members[c]) for c in classes], dtype=np.int64)
        if int((demand * tops).sum()) > 8 * capacity:
            at = {c: 0 for c in classes}
            for copies, pattern in solve(demand, tops, capacity):
                for k in np.flatnonzero(pattern):
                    c, per = classes[k], int(pattern[k])
                    first, last = at[c], at[c] + copies * per
                    begin = 0
                    for s in reversed(members[c]):
                        low, high = max(first, begin), min(last, begin + histogram[s])
                        if low < high:
                            rows.append((s, low - begin, used, per, begin - first))
                            taken[s] = high - begin
                        begin += histogram[s]
                    at[c] = last
                used += copies
        for copies, filling in _fill_rest({s: histogram[s] - taken[s] for s in small}, capacity):
            for s, per in filling.items():
                rows.append((s, taken[s], used, per, -taken[s]))
                taken[s] += copies * per
            used += copies
    if full:
        rows.append((capacity, 0, used, 1, 0))
        used += full
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5), used


def pack(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(``container``, key, ``part``, ``start``, ``size``): every item in a container of the given capacity.

    An item is divided only if it alone exceeds the capacity: into parts that fill a container each and a
    last, smaller one. Items of size 0 or null take no room and go to container 0. Every row is assigned,
    repeated rows each on their own; an empty table gives an empty result.

    The driver sees only the histogram of sizes, at most ``capacity`` numbers. Items of one size are ranked
    in buckets by the key's hash, with the buckets' counts added up, so no task sorts all of a frequent size.
    """
    rows = checkpointed(sized.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    cap = F.lit(capacity).cast("long")
    parts = rows.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / cap) - 1, F.lit(0)).cast("long"))))
    parts = parts.select("k", F.col("p").cast("int").alias("part"), (F.col("p") * cap).alias("start"), F.least(cap, F.col("n") - F.col("p") * cap).alias("size"))
    histogram = {r["size"]: r["count"] for r in parts.where("size > 0").groupBy("size").count().collect()}
    table, _ = plan(histogram, capacity)
    total = sum(histogram.values())
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    salted = parts.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("k", "part"), F.lit(buckets)).cast("int"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("k", "part")).cast("long") - 1)
    if buckets > 1:
        counts = salted.groupBy("size", "bucket").agg(F.count("*").alias("c"))
        before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, ["size", "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    width = total + 1
    starts = table[:, 0] * width + table[:, 1]

    def place(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        s, r = sizes.to_numpy(), ranks.to_numpy()
        row = table[np.searchsorted(starts, s * width + r, side="right") - 1]
        return pd.Series(row[:, 2] + (r + row[:, 4]) // row[:, 3])

    placed = ranked.withColumn("container", F.pandas_udf(place, "long")("size", "r"))
    empty = parts.where("size <= 0").withColumn("container", F.lit(0).cast("long"))
    columns = ["container", "k", "part", "start", "size"]
    return placed.select(columns).unionByName(empty.select(columns)).withColumnRenamed("k", key)
