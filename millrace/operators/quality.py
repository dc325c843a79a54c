"""Quality rules on texts: repetition and plausibility rules with reasons, score thresholds, scan statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip, qc_passes, reached
from ..functions.hashing import let
from .prefix import exact_quantiles

# The thresholds of the repetition and quality rules, and the stop words.
DUPLICATE_LIMITS = {"dup_line_frac": 0.30, "dup_para_frac": 0.30, "dup_line_char_frac": 0.20, "dup_para_char_frac": 0.20}
TOP_NGRAM_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
QUALITY_LIMITS = {"min_words": 25, "min_mean_length": 3, "max_mean_length": 10, "symbols": 0.1, "bullets": 0.9, "ellipses": 0.3, "stop_words": 2}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def _repeated(parts: Column) -> tuple[Column, Column]:
    """Number of parts that repeat an earlier one, and their characters; from the sorted array, without a quadratic search."""

    def repeats(ordered: Column) -> Column:
        return F.filter(F.transform(ordered, lambda p, i: F.when((i > 0) & (p == F.get(ordered, i - 1)), p)), lambda p: p.isNotNull())

    again = let(F.sort_array(parts), repeats)
    return F.size(again), _sum(F.transform(again, lambda p: F.length(p)))


def text_features(text: Column) -> dict[str, Column]:
    """Line and paragraph repetition, and the quality measures, of a text. A null text gives nulls, an empty one zeros."""
    trimmed = F.trim(text)
    lines, paragraphs = F.split(text, r"\n+"), F.split(trimmed, r"\n{2,}")
    n_lines, line_chars = _repeated(lines)
    n_paras, para_chars = _repeated(paragraphs)
    chars = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    proper = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")), lambda w: w != "")
    n_words = F.size(words)
    plain = F.filter(F.split(text, r"\n"), lambda v: F.trim(v) != "")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    count = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return {
        "n_words": n_words,
        "mean_word_length": ratio(_sum(F.transform(proper, lambda w: F.length(w))), F.size(proper)),
        "stop_words": F.size(F.array_intersect(F.transform(proper, lambda w: F.lower(w)), F.array(*[F.lit(w) for w in STOP_WORDS]))),
        "symbol_ratio": F.greatest(ratio(count("#"), n_words), ratio(count(r"\.\.\.|…"), n_words)),
        "bullet_ratio": ratio(F.size(F.filter(plain, lambda v: F.ltrim(v).rlike("^[•-]"))), F.size(plain)),
        "ellipsis_ratio": ratio(F.size(F.filter(plain, lambda v: F.rtrim(v).rlike(r"(\.\.\.|…)$"))), F.size(plain)),
        "dup_line_frac": ratio(n_lines, F.size(lines)),
        "dup_para_frac": ratio(n_paras, F.size(paragraphs)),
        "dup_line_char_frac": ratio(line_chars, chars),
        "dup_para_char_frac": ratio(para_chars, chars),
    }


def quality_reason(prefix: str = "") -> Column:
    """The first quality rule that a row of ``text_features`` columns fails; null if it passes."""
    c = lambda name: F.col(prefix + name)
    q = QUALITY_LIMITS
    return (
        F.when(c("n_words") < q["min_words"], "short")
        .when((c("mean_word_length") < q["min_mean_length"]) | (c("mean_word_length") > q["max_mean_length"]), "word_length")
        .when(c("symbol_ratio") > q["symbols"], "symbols")
        .when(c("bullet_ratio") > q["bullets"], "bullets")
        .when(c("ellipsis_ratio") > q["ellipses"], "ellipses")
        .when(c("stop_words") < q["stop_words"], "stop_words")
    )


def _top_ngram(ends: np.ndarray, grams: np.ndarray, n: int) -> int:
    """Characters of all occurrences of the most frequent n-gram (words and single spaces); the longest, if several are."""
    _, first, counts = np.unique(grams, return_index=True, return_counts=True)
    most = counts.max()
    start = first[counts == most]
    return int((ends[start + n] - ends[start]).max() + n - 1) * int(most)


def _repeated_ngrams(grams: np.ndarray, ends: np.ndarray, n: int) -> int:
    """Characters of words in n-grams that repeat an earlier one; after a repeat the search goes on behind it."""
    if len(np.unique(grams)) == len(grams):
        return 0
    seen: set[int] = set()
    values, total, i = grams.tolist(), 0, 0
    while i < len(values):
        if values[i] in seen:
            total += int(ends[i + n] - ends[i])
            i += n
        else:
            seen.add(values[i])
            i += 1
    return total


def ngram_shares(text: str) -> list[float]:
    """Share of the characters in the top n-gram (TOP_NGRAM_LIMITS) and in repeated n-grams (DUP_NGRAM_LIMITS) of a text."""
    words = text.split()
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.uint64)
    ends = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled, out = np.zeros(len(words) + 1, np.uint64), {}
    with np.errstate(over="ignore"):
        for n in range(1, max(*TOP_NGRAM_LIMITS, *DUP_NGRAM_LIMITS) + 1):  # n-gram hashes from those of n - 1
            size = len(words) - n + 1
            if size <= 0:
                break
            rolled = (rolled[:size] ^ (rolled[:size] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[n - 1 : n - 1 + size]
            if n in TOP_NGRAM_LIMITS:
                out[n] = _top_ngram(ends, rolled, n)
            elif n in DUP_NGRAM_LIMITS:
                out[n] = _repeated_ngrams(rolled, ends, n)
    return [out.get(n, 0) / max(1, len(text)) for n in (*TOP_NGRAM_LIMITS, *DUP_NGRAM_LIMITS)]


NGRAM_NAMES = [f"top_{n}gram" for n in TOP_NGRAM_LIMITS] + [f"dup_{n}gram" for n in DUP_NGRAM_LIMITS]


def ngram_features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, and per n the share of characters in the top n-gram (2 to 4) and in repeated n-grams (5 to 10); zeros for a null text.

    The words of a text are numbered once, and its n-gram hashes follow from those of n - 1 on arrays; only texts that repeat
    an n-gram are searched in order.
    """
    schema = docs.select(*keep).schema
    for n in NGRAM_NAMES:
        schema = schema.add(n, T.DoubleType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([ngram_shares(t or "") for t in batch.column(len(keep)).to_pylist()]).reshape(-1, len(NGRAM_NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(NGRAM_NAMES)))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(measure, schema)


def repetition_reason() -> Column:
    """The first repetition rule that a row of the line, paragraph and n-gram features fails; null if it passes."""
    out = F.lit(None).cast("string")
    limits = {**DUPLICATE_LIMITS, **{f"top_{n}gram": v for n, v in TOP_NGRAM_LIMITS.items()}, **{f"dup_{n}gram": v for n, v in DUP_NGRAM_LIMITS.items()}}
    for name, limit in reversed(limits.items()):
        out = F.when(F.col(name) > limit, name).otherwise(out)
    return out


def filtered(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """identifier and ``drop_reason``: the first repetition or else quality rule that the text fails; null if it is kept.

    A null text is dropped as ``short``; repeated identifiers are rows of their own. One pass: the line and paragraph features are
    columns that go with the text to the n-gram pass, so nothing is shuffled.
    """
    features = text_features(F.coalesce(F.col(text), F.lit("")))
    measured = docs.select(F.col(identifier), F.col(text).alias("__t"), *[c.alias(n) for n, c in features.items()])
    return ngram_features(measured, [identifier, *features], "__t").select(identifier, F.coalesce(repetition_reason(), quality_reason()).alias("drop_reason"))


def step_counts(reasons: DataFrame) -> DataFrame:
    """Per filter step, in order: texts that come in, that it drops, and that go on. One row per step."""
    order = [*DUPLICATE_LIMITS, *NGRAM_NAMES, "short", "word_length", "symbols", "bullets", "ellipses", "stop_words"]
    counted = reasons.groupBy("drop_reason").agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("drop_reason")) for k, name in enumerate(order)])
    all_steps = reasons.sparkSession.range(1).select(F.inline(steps)).join(counted, "drop_reason", "left").fillna(0, ["n"])
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # twenty rows
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    left = total - F.sum("n").over(before)
    return all_steps.select("step", "drop_reason", (left + F.col("n")).alias("texts"), F.col("n").alias("dropped"), left.alias("kept"))


def scan_stats(docs: DataFrame, group: str, size: str, score: str, limit: float) -> DataFrame:
    """Per group and in all (``ALL``): documents, size, scored documents, kept documents and kept size under a threshold."""
    keep = qc_passes(F.col(score), limit)
    rolled = docs.rollup(group).agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.count_if(F.col(score).isNotNull() & ~F.isnan(score)).alias("scored"),
        F.count_if(keep).alias("kept"), F.coalesce(F.sum(F.when(keep, F.col(size))), F.lit(0)).alias("kept_size"), F.grouping(group).alias("__all"),
    )
    return rolled.withColumn(group, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(group))).drop("__all")


def survival(scores: DataFrame, score: str, weight: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold: share of rows and of weight with score >= threshold.

    Each row falls in one cell between thresholds, so the rows are aggregated to at most that many cells, over which the
    cumulative sums run; NaN and null scores are left out.
    """
    spark = scores.sparkSession
    clean = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    cells = clean.groupBy(reached(F.col(score), sorted(thresholds)).alias("cell")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(thresholds))], "cell int, threshold double")
    above = Window.orderBy(F.col("cell").desc())  # one row per threshold
    joined = spark.range(len(thresholds) + 1).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left").join(grid, "cell", "left").fillna(0, ["n", "w"])
    summed = joined.withColumns({"n_above": F.sum("n").over(above), "w_above": F.sum("w").over(above), "n_all": F.sum("n").over(Window.partitionBy()), "w_all": F.sum("w").over(Window.partitionBy())})
    return summed.where("threshold is not null").select("threshold", F.round(F.try_divide("n_above", "n_all"), 6).alias("share_docs"), F.round(F.try_divide("w_above", "w_all"), 6).alias("share_weight"))


def tokens_left(curve: DataFrame, scored_tokens: float, other_tokens: float) -> DataFrame:
    """Tokens left in the mix if scores at or above, or below, each threshold are kept; other sources are always kept."""
    above = F.col("share_weight") * F.lit(float(scored_tokens))
    return curve.select("threshold", (above + F.lit(float(other_tokens))).alias("keep_above"), (F.lit(float(scored_tokens)) - above + F.lit(float(other_tokens))).alias("keep_below"))


def group_quality(scores: DataFrame, group: str, score: str, weight: str, high: float = 0.5) -> DataFrame:
    """Per group: median score, weighted share of scores of at least ``high``, share of the weight."""
    middle = exact_quantiles(scores, score, [0.5], group).select(F.col(group).alias("__group"), F.round("quantile", 6).alias("median"))
    totals = scores.groupBy(group).agg(F.round(F.try_divide(F.sum(F.when(F.col(score) >= high, F.col(weight)).otherwise(0)), F.sum(weight)), 6).alias("high_share"), F.sum(weight).alias("weight"))
    joined = totals.join(middle, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
    return joined.withColumn("weight_share", F.round(F.try_divide("weight", F.sum("weight").over(Window.partitionBy())), 6))


def clipped(score: Column, eps: float = 1e-6) -> Column:
    """A probability kept within (0, 1); null for null and NaN."""
    return F.when(score.isNotNull() & ~F.isnan(score), clip(score, eps, 1 - eps))


def calibration_rows(lines: DataFrame, every: int = 1000, line: str = "line") -> DataFrame:
    """Every n-th line of each file (from its first): the rows whose tokens calibrate tokens per character."""
    return lines.where(F.col(line) % every == 0)


def snippets(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text", every: int = 997, most: int = 4, chars: int = 600) -> DataFrame:
    """(path, line, snippet): the first characters of at most ``most`` of the lines 0, n, 2n, ... of each file."""
    place = Window.partitionBy(path).orderBy(line)
    picked = lines.where(F.col(line) % every == 0).withColumn("__rn", F.row_number().over(place)).where(F.col("__rn") <= most)
    return picked.select(path, line, F.substring(text, 1, chars).alias("snippet"))
