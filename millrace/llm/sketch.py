"""Problem 3: percentiles of very large columns from mergeable dyadic Count-sketches.

A value is encoded as a B-bit integer that keeps the order of numbers. A sketch has a signed Count-sketch (DEPTH rows of
WIDTH counters) for each of the LEVELS finest binary resolutions of the code, and exact counters at the resolution of 2^TOP
nodes, which take the place of the coarser ones. Every counter is a sum over the values, so sketches of days or partitions merge
by addition, and a negative weight deletes. The q-th percentile descends from the top: at each node the estimated count of the
left child decides the side.

A sketch of few codes is kept as the list of its codes and weights, from which the counters follow (at most SPARSE; then it
is smaller than they are); lists add to lists or to counters, and the counters are always what is read.

Errors. Value: a code is sign, octave and a 1,024th of an octave, so it lies within a factor 1 + 2^-10 of the value where
2^LOW <= |value| < 2^HIGH (smaller ones count as 0, larger ones as the last code). Rank: a descent can't leave the exactly counted
top node, so the count of that node bounds the error (``rank_bound``). The estimate of one node errs by about sqrt(F2 / WIDTH), with
F2 the sum of the squared counts at its resolution (itself estimated from the sketch); a descent adds up LEVELS such estimates.
``rank_error`` is 2 * sqrt(sum of F2 / WIDTH over the resolutions), about two standard deviations; the median of DEPTH rows makes
larger errors rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, table
from ..operators.records import labelled_records, usable_count, usable_loss

BITS, TOP, DEPTH, WIDTH = 17, 11, 5, 512
LEVELS = BITS - TOP
SPARSE = 4096  # codes up to which a sketch is kept as their list
ROWS = 1_000_000  # values that a task sums before it hands on its sketches
LOW, HIGH = -24, 40  # octaves of the codes: sign bit, 64 octaves, 1,024 steps in each


def _salts() -> np.ndarray:
    return np.random.default_rng(20260301).integers(1, 2**63, size=(LEVELS, DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def encode(values: np.ndarray) -> np.ndarray:
    """float32 -> codes 0 .. 2^BITS - 1 in the order of the numbers; -0.0 and 0.0 share the middle code."""
    raw = np.ascontiguousarray(values, dtype=np.float32).view(np.uint32).astype(np.int64)
    steps = ((raw & 0x7FFFFFFF) >> 13) - ((127 + LOW) << 10) + 1
    steps = np.clip(steps, 0, (1 << (BITS - 1)) - 1)
    return (1 << (BITS - 1)) + np.where(raw >> 31, -steps, steps)


def decode(codes: np.ndarray) -> np.ndarray:
    """The number of each code that is nearest to 0."""
    signed = np.asarray(codes, dtype=np.int64) - (1 << (BITS - 1))
    steps = np.abs(signed)
    raw = np.where(steps > 0, (steps - 1 + ((127 + LOW) << 10)) << 13, 0).astype(np.uint32)
    return np.where(signed < 0, -1, 1).astype(np.float32) * raw.view(np.float32)


def _cells(level: int, row: int, nodes: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each node."""
    with np.errstate(over="ignore"):
        x = (nodes.astype(np.uint64) + np.uint64(1)) * salts[level, row, 0]
        x ^= x >> np.uint64(29)
        x *= salts[level, row, 1]
        x ^= x >> np.uint64(32)
    return (x & np.uint64(WIDTH - 1)).astype(np.int64), np.where(x >> np.uint64(63), -1, 1)


def build(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A sketch as one vector: 2^TOP exact counters, then LEVELS x DEPTH x WIDTH signed ones (from fine to coarse)."""
    salts = _salts()
    out = np.zeros((1 << TOP) + LEVELS * DEPTH * WIDTH, dtype=np.int64)
    np.add.at(out, codes >> LEVELS, weights)
    sketch = out[1 << TOP :].reshape(LEVELS, DEPTH, WIDTH)
    for level in range(LEVELS):
        nodes = codes >> level
        for row in range(DEPTH):
            cell, sign = _cells(level, row, nodes, salts)
            sketch[level, row] += np.bincount(cell, weights=sign * weights, minlength=WIDTH).astype(np.int64)
    return out


def _estimate(sketch: np.ndarray, level: int, node: int, salts: np.ndarray) -> float:
    found = []
    for row in range(DEPTH):
        cell, sign = _cells(level, row, np.array([node]), salts)
        found.append(sign[0] * sketch[level, row, cell[0]])
    return float(np.median(found))


def quantile(vector: np.ndarray, rank: int) -> tuple[int, int]:
    """The code at which the cumulative count reaches ``rank`` (1-based), and the exact count of its top node."""
    salts = _salts()
    sketch = vector[1 << TOP :].reshape(LEVELS, DEPTH, WIDTH)
    upper = np.cumsum(vector[: 1 << TOP])
    node = int(np.searchsorted(upper, rank))
    node = min(node, (1 << TOP) - 1)
    exact = int(vector[node])
    parent = float(exact)
    rest = rank - (float(upper[node]) - parent)
    for level in range(LEVELS - 1, -1, -1):
        left, right = _estimate(sketch, level, 2 * node, salts), _estimate(sketch, level, 2 * node + 1, salts)
        left, right = max(left, 0.0), max(right, 0.0)
        # both children sum to the parent, which is exact at the top: share the difference of the two estimates
        left = min(max((left + parent - right) / 2, 0.0), parent)
        if rest <= left or left >= parent:
            node, parent = 2 * node, left
        else:
            node, rest, parent = 2 * node + 1, rest - left, parent - left
    return node, exact


def rank_error(vector: np.ndarray) -> float:
    sketch = vector[1 << TOP :].reshape(LEVELS, DEPTH, WIDTH).astype(np.float64)
    f2 = np.median((sketch**2).sum(axis=2), axis=1)
    return float(2 * np.sqrt(f2.sum() / WIDTH))


class Sums:
    """A sketch in the making: codes and weights while they are few, then counters."""

    def __init__(self) -> None:
        self.codes, self.weights, self.counters = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> Sums:
        if self.counters is not None:
            self.counters += build(codes, weights)
            return self
        self.codes, place = np.unique(np.concatenate((self.codes, codes)), return_inverse=True)
        summed = np.zeros(len(self.codes), np.int64)
        np.add.at(summed, place, np.concatenate((self.weights, weights)))
        self.weights = summed
        if len(self.codes) > SPARSE:
            self.counters, self.codes, self.weights = build(self.codes, self.weights), None, None
        return self

    def merge(self, blob: bytes) -> Sums:
        kind, numbers = blob[:1], np.frombuffer(zlib.decompress(blob[1:]), np.int64)
        if kind == b"S":
            return self.add(*np.split(numbers, 2))
        if self.counters is None:
            self.counters = build(self.codes, self.weights)
        self.counters += numbers
        return self

    def pack(self) -> bytes:
        if self.counters is not None:
            return b"C" + zlib.compress(self.counters.tobytes(), 1)
        return b"S" + zlib.compress(np.concatenate((self.codes, self.weights)).tobytes(), 1)

    def vector(self) -> np.ndarray:
        return self.counters if self.counters is not None else build(self.codes, self.weights)


def _summed(rows: pa.Table, keys: Sequence[str], names: list[str]) -> pa.RecordBatch:
    """One sketch for each key of the values ``__v`` with weights ``__n``."""
    ids = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        column = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        ids = ids * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(ids, return_index=True, return_inverse=True)
    cells, place = np.unique((group << BITS) + encode(rows.column("__v").to_numpy()), return_inverse=True)
    weights = np.zeros(len(cells), np.int64)
    np.add.at(weights, place, rows.column("__n").to_numpy())
    cuts = np.searchsorted(cells, np.arange(1, len(first)) << BITS)
    parts = zip(np.split(cells & ((1 << BITS) - 1), cuts), np.split(weights, cuts))
    made = [(int(w.sum()), Sums().add(c, w).pack()) for c, w in parts]
    named = rows.select(list(keys)).take(pa.array(first)).combine_chunks()
    columns = [*(c.combine_chunks() for c in named.columns), pa.array([n for n, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def sketches(values: DataFrame, group: Sequence[str], part: str, value: str = "value", weight: str | None = None) -> DataFrame:
    """One sketch per group and part (a day, say): group, part, ``n``, ``sketch``.

    Each task sums its own values by code, ROWS at a time, into sketches of every group and part it meets; only those are
    shuffled, and added as they stream in. So neither a task nor a group ever holds more than ROWS values, and however many a
    group has, its sketches are of bounded size. ``weight`` (1 by default) may be negative to delete earlier values. Null and NaN
    values are left out; infinities have codes of their own; a null group or part is a group of its own.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    clean = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("float")))
    keys = [*group, part]
    slim = clean.select(*keys, F.col(value).cast("float").alias("__v"), F.coalesce(amount, F.lit(0)).alias("__n"))
    schema = values.select(*keys).schema.add("n", "long").add("sketch", "binary")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield _summed(pa.Table.from_batches(held), keys, schema.names)
                held, size = [], 0
        if size:
            yield _summed(pa.Table.from_batches(held), keys, schema.names)

    return merge(slim.mapInArrow(make, schema), keys)


def merge(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add up the sketches of each group as they stream in: group, ``n``, ``sketch``. One sketch is held at a time."""
    schema = parts.select(*group).schema.add("n", "long").add("sketch", "binary")

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Sums(), 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for blob in batch.column("sketch"):
                total.merge(blob.as_py())
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([n], pa.int64()), pa.array([total.pack()], pa.binary())], names=schema.names)

    return parts.select(*group, "n", "sketch").groupBy(*group).applyInArrow(add, schema)


def percentiles(merged: DataFrame, group: Sequence[str], points: Sequence[float]) -> DataFrame:
    """group, ``n``, ``q``, ``value``, ``rank_error`` and ``rank_bound`` (shares of n) for every percentile in ``points``; needs n > 0."""
    schema = merged.select(*group).schema.add("n", "long").add("q", "double").add("value", "double").add("rank_error", "double").add("rank_bound", "double")

    def read(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if row.n <= 0:
                    continue
                vector = Sums().merge(row.sketch).vector()
                error = rank_error(vector)
                for q in points:
                    code, exact = quantile(vector, max(1, int(np.ceil(q * row.n / 100 - 1e-9))))
                    out.append([*[getattr(row, c) for c in group], row.n, float(q), float(decode(np.array([code]))[0]), error / row.n, exact / row.n])
            yield pd.DataFrame(out, columns=[*group, "n", "q", "value", "rank_error", "rank_bound"])

    return merged.mapInPandas(read, schema)


def measures(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """source, topic, day, measure, value: the usable losses and counts of the records, as rows."""
    records = labelled_records(scores, catalog, ["source", "topic", "mean_loss", "n_pred", "n_tokens", "scored_at"])
    day = F.to_date("scored_at").alias("day")
    pairs = F.array(F.struct(F.lit("mean_loss").alias("measure"), usable_loss().alias("value")), F.struct(F.lit("n_tokens").alias("measure"), usable_count().cast("float").alias("value")))
    return records.select("source", "topic", day, F.inline(pairs)).where("value is not null")


GROUP = ["source", "topic", "measure"]
POINTS = [5, 25, 50, 75, 90, 95, 99]


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    values = measures(table(spark, folder, "scores"), table(spark, folder, "doc_counts"))
    return merge(sketches(values, GROUP, "day"), GROUP)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    points = percentiles(_merged(spark, folder).where("n >= 50"), GROUP, [50, 90, 95])
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    wide = points.groupBy(*GROUP).agg(at(50).alias("p50"), at(90).alias("p90"), at(95).alias("p95"))
    skewed = ((F.col("measure") == "mean_loss") & (F.col("p90") >= 1.5 * F.col("p50"))) | ((F.col("measure") == "n_tokens") & (F.col("p95") >= 6 * F.col("p50")))
    return wide.where(skewed).select(*GROUP)


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of losses and token counts per source and topic, with the estimated error and the bound of their ranks."""
    return percentiles(_merged(spark, folder), GROUP, POINTS)


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The partial results: size and bytes of the sketch of every group and day."""
    values = measures(table(spark, folder, "scores"), table(spark, folder, "doc_counts"))
    return sketches(values, GROUP, "day").select(*GROUP, "day", "n", F.length("sketch").alias("bytes"))


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Per group: usable values, and whether the exact rank of every estimated percentile lies within its bound."""
    values = materialize(measures(table(spark, folder, "scores"), table(spark, folder, "doc_counts")), "values")
    points = percentiles(merge(sketches(values, GROUP, "day"), GROUP), GROUP, POINTS)
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"v.{c}"))
    x, step = F.col("v.value").cast("double"), 1 + 2.0**-9
    met = points.alias("p").join(values.alias("v"), same)  # a group has as many rows as POINTS
    counted = met.groupBy(*[F.col(f"p.{c}").alias(c) for c in GROUP], "q").agg(
        F.first("p.n").alias("n"), F.first("rank_bound").alias("bound"), F.count_if(x < F.col("p.value") / step).alias("low"), F.count_if(x <= F.col("p.value") * step).alias("high"),
    )
    rank, slack = F.greatest(F.ceil(F.col("q") * F.col("n") / 100), F.lit(1)), F.col("bound") * F.col("n") + 1e-6
    within = (F.col("low") - slack <= rank) & (rank <= F.col("high") + slack)
    return counted.groupBy(*GROUP).agg(F.first("n").alias("n"), F.bool_and(within).alias("within"))
