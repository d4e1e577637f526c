"""Best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. The lengths' histogram,
at most ``capacity`` numbers whatever the corpus, goes to the driver. There the
linear program over configurations (multisets of lengths that fit a sequence)
is solved by multiplicative weights: each round prices the lengths, a knapsack
dynamic program finds valuable configurations without waste, each is used to a
share of the demand it meets, and the lengths that it covers get cheaper, until
all are covered. The solution is rounded down. What is left is placed longest
first, each time with the pieces that fill its sequence best, found exactly by
their sums. The
plan is a table of ranges, bounded by rounds and capacity; the pieces, ranked
within each length, look up their place.

Ranks need no sort of a length's pieces: a task counts its pieces of each length,
and running sums over the tasks' counts (not the pieces) give the offsets.

Defined results
---------------
* A null text is empty; every document ends with token 0, so it has a token at least.
* A special token's string in a text becomes that token, as the tokenizers library does by default.
* A text of any length is encoded whole. Pieces of equal length take their places in the order of tasks and rows.
* Pieces of full length are sequences of their own.
* Repeated rows are packed each; a null doc_id is kept.
* An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import tokens
from plumbline.llm.base import documents, stored, text_of

CAPACITY = 2048
END = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place counts a task's pieces of one length."""
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        from pyspark import TaskContext

        encoder, task, used = tokens.encoder(path), TaskContext.get().partitionId(), {}
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
        for batch in batches:
            done = 0
            for texts in tokens.limited(batch.column(1)):
                out = []
                for k, ids in enumerate(encoder.ids(texts), done):
                    ids += END
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = n % capacity or capacity if start == 0 else capacity  # the first may be shorter
                        place = used[length] = used.get(length, -1) + 1
                        out.append((k, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, place))
                        start, piece = start + length, piece + 1
                done += len(texts)
                cols = np.array(out, dtype=np.int64).reshape(-1, 7).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *[pa.array(c) for c in cols[2:]]], names=names)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, task long, place long")


def fills(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most valuable fill of every room up to ``capacity``: an unbounded knapsack.

    ``sizes`` ascend. value[c] is the best for room c, pick[c] the size to take
    there or -1; one vector step for each c.
    """
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        got = value[c - sizes[: upto[c]]] + prices[: upto[c]]
        j = int(got.argmax())
        if got[j] > value[c - 1]:
            value[c], pick[c] = got[j], j
        else:
            value[c] = value[c - 1]
    return value, pick


def configurations(sizes: np.ndarray, prices: np.ndarray, room: np.ndarray, capacity: int, *, share: float, waste: float) -> list[tuple[dict[int, int], float]]:
    """Valuable fills (index -> count) and how often to use each; together they use ``share`` of each size's ``room`` at most.

    For every size, the most valuable first, the fill that holds it. Where a
    size is used up, the fill takes the next smaller room's; a fill that leaves
    more than ``waste`` of the capacity empty is left out.
    """
    value, pick = fills(sizes, prices, capacity)
    budget, found = share * room, []
    least = 0.05 * budget  # smaller steps are left to a later round
    for first in np.argsort(-(prices + value[capacity - sizes]), kind="stable").tolist():
        if budget[first] <= least[first]:
            continue
        counts, c, lost = {first: 1}, capacity - int(sizes[first]), 0
        while c > 0 and lost <= waste * capacity:
            j = int(pick[c])
            if j >= 0 and budget[j] > least[j] and counts.get(j, 0) < max(room[j], 1):
                counts[j] = counts.get(j, 0) + 1
                c -= int(sizes[j])
                continue
            lost += 1
            c -= 1
        if lost > waste * capacity:
            continue
        times = min(budget[k] / n for k, n in counts.items())
        found.append((counts, times))
        for k, n in counts.items():
            budget[k] -= n * times
    return found


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, share: float = 0.9, tolerance: float = 0.02) -> list[tuple[dict[int, int], float]]:
    """Configurations (index -> count) and how often to use each: a fractional cover of the demand by multiplicative weights.

    Prices start near the size: what fills a sequence is worth its room, and a
    longer piece, harder to place, a little more. A length's price falls as
    exp(-covered / demand). A round uses configurations up to ``share`` of what
    each length still lacks. Lengths that are covered but for ``tolerance`` are
    worth nothing. Only configurations without waste are used, until there are
    none or all is covered; lengths that have no such one, such as long ones
    without short ones beside them, are left to the rounding.
    """
    covered, found = np.zeros(len(sizes)), {}
    while True:
        at = np.flatnonzero(covered < (1 - tolerance) * demand)
        if not len(at):
            break
        prices = sizes[at] * (1 + sizes[at] / capacity) * np.exp(-covered[at] / demand[at])
        new = configurations(sizes[at], prices, (demand - covered)[at], capacity, share=share, waste=0.0)
        if not new:
            break
        for counts, times in new:
            config = tuple(sorted((int(at[k]), n) for k, n in counts.items()))
            found[config] = found.get(config, 0.0) + times
            for k, n in config:
                covered[k] += n * times
    return [(dict(config), times) for config, times in found.items()]


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: (size -> count, times) for each kind of sequence."""
    left, found = left.copy(), []
    at = {int(s): k for k, s in enumerate(sizes)}
    for k in range(len(sizes) - 1, -1, -1):
        while left[k]:
            room, config = capacity, {}
            j = k
            while j >= 0:
                if left[j] - config.get(int(sizes[j]), 0) > 0 and sizes[j] <= room:
                    n = int(min(left[j] - config.get(int(sizes[j]), 0), room // sizes[j]))
                    config[int(sizes[j])] = config.get(int(sizes[j]), 0) + n
                    room -= n * int(sizes[j])
                j = min(j - 1, int(np.searchsorted(sizes, room, side="right")) - 1)
            times = int(min(left[at[s]] // n for s, n in config.items()))
            for s, n in config.items():
                left[at[s]] -= n * times
            found.append((config, times))
    return found


def exact_fill(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """The largest remaining piece ``first`` (an index) and those that leave the least room beside it, the longest before others.

    A bit for each sum that some of the pieces have: exact pricing where a
    piece is worth its length and no length may be used more often than it is left.
    """
    room = capacity - sizes[first]
    keep, reach, seen = (1 << (room + 1)) - 1, 1, []
    for k in range(first, -1, -1):
        n = left[k] - (k == first)
        if n <= 0 or sizes[k] > room:
            continue
        part, n = 1, min(n, room // sizes[k])
        while n:
            take = min(part, n)
            seen.append((k, take, reach))
            reach |= (reach << (take * sizes[k])) & keep
            n -= take
            part *= 2
        if reach >> room & 1:
            break
    total, counts = reach.bit_length() - 1, {first: 1}
    for k, take, before in reversed(seen):
        if not before >> total & 1:
            counts[k] = counts.get(k, 0) + take
            total -= take * sizes[k]
    return counts


def least_slack(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The longest piece left, each time, with the pieces that fill its sequence best."""
    sizes_, left_, found = sizes.tolist(), left.tolist(), []
    for first in range(len(sizes_) - 1, -1, -1):
        while left_[first]:
            counts = exact_fill(sizes_, left_, first, capacity)
            times = min(left_[k] // n for k, n in counts.items())
            for k, n in counts.items():
                left_[k] -= n * times
            found.append(({sizes_[k]: n for k, n in counts.items()}, times))
    return found


def rounded_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The linear program's configurations, rounded down (size -> count, times), and what they leave of the demand."""
    left, found = demand.copy(), []
    for counts, times in solve(sizes, demand.astype(float), capacity):
        whole = int(min(np.floor(times + 1e-9), min(left[k] // n for k, n in counts.items())))
        if whole > 0:
            for k, n in counts.items():
                left[k] -= n * whole
            found.append(({int(sizes[k]): n for k, n in counts.items()}, whole))
    return found, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole configurations (size -> count, times) that hold exactly the histogram's pieces.

    The program is rounded down, and what it leaves is filled exactly, piece by
    piece. Best-fit decreasing is the bar: no plan needs more sequences.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    found, left = rounded_program(sizes, demand, capacity)
    total = lambda configs: sum(times for _, times in configs)
    rest = min((f(sizes, left, capacity) for f in (least_slack, best_fit)), key=total)
    return min(found + rest, best_fit(sizes, demand, capacity), key=total)


def ranges(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, count in a sequence, offset in it), by length and rank."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for config, times in configs:
        offset = 0
        for size, count in config.items():
            out.append((size, rank.get(size, 0), base, count, offset))
            rank[size] = rank.get(size, 0) + count * times
            offset += size * count
        base += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def packed(docs: DataFrame, *, capacity: int = CAPACITY, **how) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    cut = stored(pieces(docs, capacity=capacity, **how))
    counts = stored(cut.filter(F.col("length") < capacity).groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    configs = plan(histogram, capacity)
    table = ranges(configs)
    sequences = sum(times for _, times in configs)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.filter(F.col("length") < capacity).join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "task", "place")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches):
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if len(rank) else np.zeros((0, 5), dtype=np.int64)
            within = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(row[:, 2] + within // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + within % np.maximum(row[:, 3], 1) * length)], names=[*names, "sequence_id", "offset"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.select(*names, "rank").mapInArrow(run, schema)
    # a full piece's sequence is numbered by its task and place in it, above the planned ones
    full = cut.filter(F.col("length") == capacity).select(*names, (F.lit(sequences) + F.col("task") * F.lit(1 << 40) + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
