"""Token streams: boundaries, blocks, segments, windows, and scores by unigram and bigram models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import let
from .prefix import running_total

BOS, EOS = 128000, 128001  # fixed values: the tokens at the ends of a document


def word_ids(text: Column, vocabulary: int = 128_000) -> Column:
    """Ids below ``vocabulary`` of the words of a text (by hash): the built-in tokenizer where no vocabulary file is given."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def framed(ids: Column) -> Column:
    """BOS ids EOS."""
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def tokenized(docs: DataFrame, keep: list[str], text: str, encode: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """``keep`` and ``ids`` by any tokenizer: ``encode()`` is called once per task and gives a function of a batch of texts."""
    from pyspark.sql.types import ArrayType, IntegerType

    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(encoder(texts), pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def boundaries(ids: Column, strict: bool = True) -> Column:
    """0-based starts of the documents of a stream: BOS at 0 or after EOS, or any BOS if not ``strict``."""

    def starts(a: Column) -> Column:
        begins = lambda i: (F.get(a, i) == BOS) & ((i == 0) | (F.get(a, i - 1) == EOS) if strict else F.lit(True))
        return F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), begins)).otherwise(F.array().cast("array<int>"))

    return let(ids, starts)


def document_lengths(starts: Column, size: Column) -> Column:
    """Lengths from starts and the stream's size."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(size))
    return F.zip_with(starts, F.when(F.size(starts) > 0, ends).otherwise(F.array().cast("array<int>")), lambda a, b: b - a)


def starts_of(docs: DataFrame, order: list[str], size: str, name: str = "start") -> DataFrame:
    """Add the global offset at which each document begins in a stream by ``order``."""
    return running_total(docs, order, F.col(size).cast("long"), name="__end").withColumn(name, F.col("__end") - F.col(size)).drop("__end")


def blocks(docs: DataFrame, order: list[str], ids: str, block_size: int) -> DataFrame:
    """(``block_id``, ``ids``): the stream of all documents by ``order`` cut into blocks of equal size; the tail that fills
    no block is dropped. Documents know their offset, so each is cut where it is and only pieces are shuffled by block."""
    sized = starts_of(docs.withColumn("__n", F.size(ids)), order, "__n", "__start").where("__n > 0")
    first, last = F.expr(f"__start div {block_size}"), F.expr(f"(__start + __n - 1) div {block_size}")
    cut = sized.withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block_id") * block_size - F.col("__start"), F.lit(0)).cast("int")
    end = F.least((F.col("block_id") + 1) * block_size - F.col("__start"), F.col("__n").cast("long")).cast("int")
    pieces = cut.select("block_id", (F.col("__start") + begin).alias("at"), F.slice(F.col(ids), begin + 1, end - begin).alias("piece"))
    # a block holds at most block_size tokens, so its pieces are bounded
    joined = pieces.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    filled = joined.select("block_id", F.flatten(F.transform("p", lambda x: x["piece"])).alias("ids"))
    return filled.where(F.size("ids") == block_size)


def position_ids(ids: Column) -> Column:
    """Position of each token in its segment; segments start at the block's start and at every BOS."""
    spans = let(segment_starts(ids), lambda starts: F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: F.sequence(F.lit(0), F.get(starts, k) - F.get(starts, k - 1) - 1)))
    return F.when(F.size(ids) > 0, F.flatten(spans)).otherwise(F.array().cast("array<int>"))


def segment_starts(ids: Column) -> Column:
    """Starts of the segments of a block, and its size: cumulative sequence lengths."""
    return let(ids, lambda a: F.concat(F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) == BOS)), F.array(F.size(a))))


def window_chunks(ids: Column, window: int) -> Column:
    """A document's tokens in windows of at most ``window``; the last token of each has no target."""
    last = F.floor((F.size(ids) - 1) / window).cast("int")
    return F.when(F.size(ids) > 0, let(ids, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(a, k * window + 1, window))))


def token_counts(docs: DataFrame, ids: str, prefix: int | None = None, start: str | None = None) -> DataFrame:
    """(``token``, ``n``): unigram counts, of the documents that begin before ``prefix`` tokens if given."""
    rows = docs.where(F.col(start) < prefix) if prefix is not None and start else docs
    return rows.select(F.explode(ids).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def document_loss(docs: DataFrame, identifier: str, ids: str, window: int = 2048) -> DataFrame:
    """identifier, ``mean_loss``, ``n_pred``: mean of -ln p(token) over the predicted tokens, p by unigram counts of the
    same documents. The first token of each window is no target. Documents without target have a null loss.

    Equal tokens of a document are counted first, so the join with the counts sees each token once per document.
    """
    targets = docs.select(identifier, F.posexplode(ids).alias("pos", "token"))
    counts = targets.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    logs = counts.select("token", (-F.log(F.col("n") / total)).alias("loss"))
    each = targets.where(F.col("pos") % window != 0).groupBy(identifier, "token").agg(F.count("*").alias("k"))
    scored = each.join(logs, "token").groupBy(identifier).agg(F.sum(F.col("k") * F.col("loss")).alias("s"), F.sum("k").alias("n_pred"))
    return docs.select(identifier).distinct().join(scored, identifier, "left").select(identifier, F.try_divide("s", "n_pred").alias("mean_loss"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


def score_unique(rows: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score each distinct key once and give its score to all rows: ``scorer`` maps (key, ...) rows to (key, scores). The query
    fails if it gives a key two scores, which would multiply rows."""
    scored = scorer(rows.dropDuplicates([key]))
    values = [c for c in scored.columns if c != key]
    once = scored.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*values)).alias("__s"))
    fine = F.when(F.col("__n") == 1, F.col("__s")).otherwise(F.raise_error(F.lit("a key was scored twice")))
    return rows.join(once.select(key, fine.alias("__s")), key, "left").select(*rows.columns, *[F.col(f"__s.`{c}`").alias(c) for c in values])


def protocol_losses(blocks_: DataFrame, ids: str = "ids") -> DataFrame:
    """One row: mean bigram loss (add-one smoothing) over blocks if context crosses document boundaries, and if it stops there.

    ``concat``: every token but a block's first is predicted from the one before; ``doc``: predictions of a BOS are left out.
    """
    pairs = blocks_.select(F.posexplode(F.arrays_zip(F.slice(ids, 1, F.size(ids) - 1).alias("a"), F.slice(ids, 2, F.size(ids) - 1).alias("b"))).alias("pos", "p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    given = joint.groupBy("a").agg(F.sum("n").alias("na"))
    size = joint.agg(F.countDistinct("b")).scalar()
    scored = joint.join(given, "a").withColumn("loss", -F.log((F.col("n") + 1) / (F.col("na") + size)))
    inside = F.col("b") != BOS
    return scored.agg(
        F.try_divide(F.sum(F.col("n") * F.col("loss")), F.sum("n")).alias("concat_loss"), F.try_divide(F.sum(F.when(inside, F.col("n") * F.col("loss"))), F.sum(F.when(inside, F.col("n")))).alias("doc_loss"), F.sum("n").alias("predictions")
    )


def islands_of(flags: DataFrame, group: str, order: str, flag: Column) -> DataFrame:
    """Add ``segment``: running number of set flags within the group (a block or a document, so of bounded size)."""
    return flags.withColumn("segment", F.sum(flag.cast("int")).over(Window.partitionBy(group).orderBy(order)))


def truncated(ids: Column, prefix: int = 512) -> Column:
    """The first tokens of a document, as many as are scored."""
    return F.slice(ids, 1, prefix)


def aligned(a: Column, b: Column, names: tuple[str, str] = ("a", "b")) -> Column:
    """Two arrays zipped by position; the query fails if their lengths differ."""
    zipped = F.arrays_zip(a.alias(names[0]), b.alias(names[1]))
    return F.when(F.size(a) == F.size(b), zipped).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def copied_ranges(docs: DataFrame, chosen: DataFrame, identifier: str, order: list[str], ids: str = "ids") -> DataFrame:
    """The token ranges of the chosen documents (``identifier``), in ``order``: identifier, ``start`` in the new stream, ``n``, ids. The
    query fails if a range does not begin with BOS and end with EOS."""
    kept = docs.join(chosen.select(identifier).distinct(), identifier, "left_semi")
    whole = (F.get(ids, F.lit(0)) == BOS) & (F.element_at(ids, -1) == EOS)
    checked = F.when((F.size(ids) > 1) & whole, F.col(ids)).otherwise(F.raise_error(F.lit("a range is no whole document")))
    sized = kept.select(*dict.fromkeys([identifier, *order]), checked.alias(ids)).withColumn("n", F.size(ids))
    return starts_of(sized, order, "n")


def alignment(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """One row: documents, document boundaries in their tokens, and whether there is one for each."""
    counted = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(boundaries(F.col(ids)))), F.lit(0)).alias("boundaries"))
    return counted.withColumn("aligned", F.col("documents") == F.col("boundaries"))


Scorer = Callable[[], Callable[[list[list]], list[list[float]]]]


def score_stream(docs: DataFrame, identifier: str, ids: str, scorer: Scorer, window: int = 2048, batch_tokens: int = 65_536, per_token: bool = False) -> DataFrame:
    """identifier, ``mean_loss``, ``n_pred`` (and ``losses``, one per prediction) by any model of the next token.

    ``scorer()`` is called once per task and gives a function of a batch of windows: for each, the loss of every token but its
    first. Documents are cut into windows; batches hold whole windows of at most ``batch_tokens`` tokens (a longer one alone). A
    document without prediction has a null loss; null arrays count as empty.
    """
    schema = docs.select(identifier).schema.add("mean_loss", T.DoubleType()).add("n_pred", T.IntegerType())
    schema = schema.add("losses", T.ArrayType(T.DoubleType())) if per_token else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            found: list[list[float]] = [[] for _ in range(batch.num_rows)]
            held: list[tuple[int, list]] = []

            def flush() -> None:
                for (row, _), losses in zip(held, score([w for _, w in held]) if held else [], strict=True):
                    found[row].extend(losses)
                held.clear()

            size = 0
            for row, tokens in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(tokens or []), window):
                    part = tokens[at : at + window]
                    if held and size + len(part) > batch_tokens:
                        flush()
                        size = 0
                    held.append((row, part))
                    size += len(part)
            flush()
            columns = [batch.column(0), pa.array([sum(x) / len(x) if x else None for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, pa.list_(pa.float64()))] if per_token else [])], names=schema.names)

    return docs.select(identifier, ids).mapInArrow(run, schema)


MAX_VOCABULARY = 1_000_000


def unigram_scorer(docs: DataFrame, ids: str) -> Scorer:
    """Losses -ln p(token), p by the counts of all documents. The table goes to the tasks: a vocabulary of at most
    MAX_VOCABULARY tokens, else it fails; ``document_loss`` has no such bound."""
    rows = token_counts(docs, ids).limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} different tokens")
    total = sum(r.n for r in rows)
    losses = docs.sparkSession.sparkContext.broadcast({r.token: -math.log(r.n / total) for r in rows})
    return lambda: lambda windows: [[losses.value[t] for t in w[1:]] for w in windows]


def batch_check(docs: DataFrame, identifier: str, ids: str, scorer: Scorer, window: int = 2048, n: int = 20) -> DataFrame:
    """One row: documents checked (the first ``n`` with two tokens or more), and the greatest difference of their losses scored in
    batches and one by one."""
    few = docs.where(F.size(ids) >= 2).orderBy(identifier).limit(n)
    both = score_stream(few, identifier, ids, scorer, window).join(score_stream(few, identifier, ids, scorer, window, batch_tokens=1).withColumnRenamed("mean_loss", "__single"), identifier)
    return both.agg(F.count("*").alias("documents"), F.coalesce(F.max(F.abs(F.col("mean_loss") - F.col("__single"))), F.lit(0.0)).alias("max_difference"))
