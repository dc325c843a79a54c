"""Problem 6: texts of varying length in containers of fixed capacity.

Only the histogram of lengths is needed to plan: combinations of at most three lengths that exactly fill a window (the
container, or an equal part of it) are enumerated, non-negative least squares finds how often to repeat each so that they use
up the histogram, the repeats are rounded down to what there is, and what remains is packed greedily, largest first, again by
length and count. So the plan's size depends on the capacity, not on the number of texts; the driver sees the histogram only.
The texts are then dealt to the planned places by their number within their length, which needs no group in one task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, partitions, table
from .budget import VOCABULARY, token_counts

CAPACITY = 2048
QUANTUM = 4  # lengths are planned in steps of so many tokens, rounded up
WINDOWS = (1, 2, 4, 8)  # a container is one window, or so many equal ones
DEPTH = 3


def combinations(units: int, have: np.ndarray) -> list[tuple[int, ...]]:
    """All ascending combinations of at most DEPTH lengths (of which ``have`` has any) with the sum ``units``."""
    lengths = [int(v) for v in np.flatnonzero(have) if v <= units]
    there = set(lengths)
    found = [(units,)] if units in there else []
    for i, a in enumerate(lengths):
        if 2 * a <= units and units - a in there:
            found.append((a, units - a))
        for b in lengths[i:]:
            rest = units - a - b
            if rest < b:
                break
            if rest in there:
                found.append((a, b, rest))
    return found


def nnls(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, bool]:
    """x >= 0 that minimises |matrix x - wanted| (active sets: the column of the steepest descent enters, columns that
    turn negative leave), and whether it settled within ``rounds``."""
    n = matrix.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    rest = wanted.astype(float).copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0)))
    settled = False
    for _ in range(rounds):
        slope = matrix.T @ rest
        slope[used] = -np.inf
        best = int(np.argmax(slope)) if n else 0
        if not n or slope[best] <= tolerance:
            settled = True
            break
        used[best] = True
        while True:
            index = np.flatnonzero(used)
            part = matrix[:, index]
            gram = part.T @ part
            gram[np.diag_indices_from(gram)] += 1e-10
            solved = np.linalg.solve(gram, part.T @ wanted)
            if solved.min(initial=0) > -1e-12:
                x[:] = 0
                x[index] = np.maximum(solved, 0)
                break
            old = x[index]
            falling = solved < 0
            step = np.min(old[falling] / np.maximum(old[falling] - solved[falling], 1e-300))
            moved = old + step * (solved - old)
            moved[falling & (moved <= 1e-12)] = 0
            x[index] = np.maximum(moved, 0)
            gone = index[(x[index] <= 1e-12)]
            if len(gone) == 0:
                gone = index[[int(np.argmin(solved))]]
            used[gone] = False
            x[gone] = 0
            if best in gone:
                break
        new = wanted - matrix @ x
        if not used[best] and np.allclose(new, rest):
            settled = True
            break
        rest = new
    return x, settled


@dataclass
class Plan:
    """Places by unit length: the items ``start`` .. of a length go ``per`` at a time to containers from ``base`` on."""

    unit: np.ndarray
    start: np.ndarray
    per: np.ndarray
    base: np.ndarray
    containers: int
    settled: bool = True  # whether the least squares did; if not, the plan holds all the same, with more left to the greedy rest


def plan(histogram: np.ndarray, windows: tuple[int, ...] = WINDOWS) -> Plan:
    """``histogram[u]``: number of items of u units; its last index is the capacity."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    columns: list[tuple[tuple[int, ...], int]] = []
    for parts in windows:
        if units % parts == 0:
            columns += [(c, parts) for c in combinations(units // parts, left > 0)]
    rows: list[tuple[int, int, int, int]] = []
    next_start, base = np.zeros(units + 1, dtype=np.int64), 0

    def place(counts: dict[int, int], repeats: int) -> None:
        nonlocal base
        for unit, per in counts.items():
            rows.append((unit, int(next_start[unit]), per, base))
            next_start[unit] += per * repeats
            left[unit] -= per * repeats
        base += repeats

    total, settled = int(left.sum()), True
    if columns and total:
        matrix = np.zeros((units + 1, len(columns)))
        for j, (lengths, parts) in enumerate(columns):
            for v in lengths:
                matrix[v, j] += parts
        repeats, settled = nnls(matrix, left / total)
        repeats *= total
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] < 0.5:
                break
            lengths, parts = columns[j]
            counts = {v: lengths.count(v) * parts for v in dict.fromkeys(lengths)}
            often = min(int(round(repeats[j])), *[int(left[v]) // c for v, c in counts.items()])
            if often > 0:
                place(counts, often)
    while left.sum() > 0:  # largest first, then the largest that still fits
        room, counts = units, {}
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - np.array([counts.get(v, 0) for v in range(room + 1)]) > 0)
            if len(fits) == 0:
                break
            v = int(fits[-1])
            often = min(room // v, int(left[v]) - counts.get(v, 0))
            counts[v] = counts.get(v, 0) + often
            room -= v * often
        place(counts, min(int(left[v]) // c for v, c in counts.items()))
    found = np.array(rows, dtype=np.int64).reshape(-1, 4)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return Plan(found[:, 0], found[:, 1], found[:, 2], found[:, 3], base, settled)


def items(sized: DataFrame, identifier: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(identifier, part, n_parts, tokens): whole texts, and the capacity-sized parts of longer ones. Items of size 0 or
    null take no place and are left out; repeated identifiers are items of their own."""
    real = sized.where(F.col(size) > 0).select(identifier, F.col(size).cast("long").alias("__size"))
    parts = F.expr(f"cast((__size + {capacity - 1}) div {capacity} as int)")
    split = real.withColumn("n_parts", parts).withColumn("part", F.explode(F.expr("sequence(0, n_parts - 1)")))
    tokens = F.least(F.lit(capacity), F.col("__size") - F.col("part").cast("long") * capacity)
    return split.select(identifier, "part", "n_parts", tokens.alias("tokens"))


def pack(sized: DataFrame, identifier: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """(identifier, part, n_parts, tokens, container): every item in one container, no container above the capacity.

    An empty table gives an empty result.
    """
    buckets = partitions(sized.sparkSession)
    unit = F.expr(f"cast((tokens + {quantum - 1}) div {quantum} as int)")
    bucket = F.pmod(F.xxhash64(identifier, "part"), F.lit(buckets)).cast("int")
    placed = materialize(items(sized, identifier, size, capacity).withColumns({"unit": unit, "bucket": bucket}), "items")
    counts = placed.groupBy("unit", "bucket").agg(F.count("*").alias("n")).toPandas()  # at most capacity / quantum x buckets rows
    units = capacity // quantum
    grid = np.zeros((units + 1, buckets), dtype=np.int64)
    grid[counts["unit"].to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    before = np.cumsum(grid, axis=1) - grid
    layout = plan(grid.sum(axis=1))
    if not layout.settled:
        warnings.warn("the least squares of the packing plan did not settle; the containers may be less full", stacklevel=2)
    first = np.searchsorted(layout.unit, np.arange(units + 2))

    order = Window.partitionBy("unit", "bucket").orderBy(identifier, "part", "tokens")
    numbered = placed.withColumn("__rn", (F.row_number().over(order) - 1).cast("long"))
    names = [identifier, "part", "n_parts", "tokens"]
    schema = placed.select(*names).schema.add("container", "long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = layout.unit * (1 << 44) + layout.start
        for batch in batches:
            u, b, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("unit", "bucket", "__rn"))
            n = n + before[u, b]
            at = np.searchsorted(keys, u * (1 << 44) + n, side="right") - 1
            container = layout.base[at] + (n - layout.start[at]) // layout.per[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(container)], names=[*names, "container"])

    return numbered.mapInArrow(deal, schema)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", "text")
    return pack(token_counts(docs, ["doc_id"], VOCABULARY))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("n_parts > 1 and part = 0").select("doc_id")


def p6_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, and of every part of a text longer than a container."""
    return _packed(spark, folder)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Items, tokens and fill of every container."""
    packed = _packed(spark, folder).groupBy("container").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))
    return packed.withColumn("fill", F.round(F.col("tokens") / CAPACITY, 6))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, the least number there could be, items, divided texts, tokens, fill."""
    packed = _packed(spark, folder).groupBy("container").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if((F.col("n_parts") > 1) & (F.col("part") == 0)).alias("divided"))
    out = packed.agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("divided").alias("divided_texts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return out.withColumns({"least_containers": F.expr(f"(tokens + {CAPACITY - 1}) div {CAPACITY}"), "fill": F.round(F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY), 6)})


def p6_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """One row on packing the texts, measured in bytes, into containers of 2^16: items, divided texts, bytes, overfull containers,
    items with another number of places than one, and whether the containers are within 2 % of the least number."""
    capacity = 1 << 16
    docs = table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", F.octet_length("text").alias("bytes"))
    placed = pack(docs, "doc_id", "bytes", capacity, 128)
    each = placed.groupBy("container").agg(F.sum("tokens").alias("filled"))
    fill = each.agg(F.count("*").alias("containers"), F.count_if(F.col("filled") > capacity).alias("overfull"))
    items = placed.groupBy("doc_id", "part").agg(F.count("*").alias("places"), F.sum("tokens").alias("tokens"), F.max("n_parts").alias("n_parts"))
    out = items.agg(F.count("*").alias("items"), F.count_if((F.col("n_parts") > 1) & (F.col("part") == 0)).alias("divided_texts"), F.sum("tokens").alias("bytes"), F.count_if(F.col("places") != 1).alias("misplaced"))
    tight = F.col("containers") <= F.ceil(F.col("bytes") / capacity) * 1.02 + 1
    known = out.withColumns({c: fill.select(c).scalar() for c in ("containers", "overfull")})
    return known.select("items", "divided_texts", "bytes", "overfull", "misplaced", tight.alias("tight"))
