"""Problem 2: usable tokens per source, topic and vigintile, and of texts by language."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical
from ..runtime import materialize, table
from ..operators.records import labelled_records, usable_count

CACHED = 500_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits a text into the pieces within which the vocabulary's merges happen.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# ISO 639-2 codes of the corpus languages and their ISO 639-1 codes.
LANGUAGES = {"eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de"}


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _lengths(encode_once: Callable[[], Callable[[str], int]]):
    """Lengths of pieces in tokens; ``encode_once()`` is called in each task and gives the length of a piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = encode_once()
        for batch in batches:
            pieces = batch.column(0)
            yield pa.record_batch([pieces, pa.array([length(p) for p in pieces.to_pylist()], pa.int64())], names=["piece", "length"])

    return count


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens``, the length of each whole ``text`` in tokens (null text: 0). One pass, no shuffle; a task encodes
    equal texts once (it remembers the lengths of up to CACHED texts by a 128-bit hash)."""
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoding(vocabulary).encode_ordinary, {}
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                key = xxhash.xxh3_128_digest(text) if text else None
                if key is not None and key not in known:
                    if len(known) >= CACHED:
                        known.clear()
                    known[key] = len(encode(text))
                found.append(known[key] if text else 0)
            lengths = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lengths], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(count, schema)


def language(label: Column) -> Column:
    """A written language label -> two letters; ``und`` where it is missing."""
    two = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    out = F.substring(two, 1, 2)
    for long, short in LANGUAGES.items():
        out = F.when(two == long, short).otherwise(out)
    return F.when(F.coalesce(two, F.lit("")) == "", "und").otherwise(out)


def slice_totals(counted: DataFrame, slices: list[str]) -> DataFrame:
    """Documents and tokens of each slice, and the tokens of all slices. The window sees one row per slice of the catalog."""
    totals = counted.groupBy(*slices).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return totals.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy()))


def record_tokens(scores: DataFrame, pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per record: source, topic, vigintile, tokens. A missing count comes from the pool row of the same rank
    (the greatest positive one, if its rows differ), else it is 0."""
    records = labelled_records(scores, catalog, ["source", "topic", "vigintile", "n_tokens"])
    known = records.withColumn("usable", usable_count())
    counts = pool.where("n_tokens_full > 0 and rank is not null").groupBy("rank").agg(F.max("n_tokens_full").cast("long").alias("pool_tokens"))
    return known.join(counts, "rank", "left").select("rank", "source", "topic", "vigintile", F.coalesce("usable", "pool_tokens", F.lit(0)).alias("tokens"))


def piece_length(vocabulary: str) -> Callable[[], Callable[[str], int]]:
    """The lengths of pieces under the tokenizer of a rank file."""
    return lambda: lambda piece, encode=encoding(vocabulary).encode_ordinary: len(encode(piece))


def byte_length() -> Callable[[str], int]:
    """The lengths of pieces under a byte tokenizer."""
    return lambda piece: len(piece.encode())


def text_token_totals(docs: DataFrame, slices: list[str], vocabulary: str = VOCABULARY, pattern: str = PIECES, lengths: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Exact tokens of the texts of each slice (``slices``, ``n_docs``, ``n_tokens``), without encoding the corpus; ``lengths`` gives the
    lengths of pieces where they don't come from a rank file.

    Texts are split into the tokenizer's pieces by its own pattern; merges never cross a piece, so each distinct piece is
    encoded once and its length joined with the piece's frequency in each slice. Partial aggregation leaves at most one row
    per task, slice and piece to shuffle, so frequent pieces don't make hot keys. Null and empty texts count as documents
    with 0 tokens.
    """
    pieces = docs.select(*slices, F.explode(F.regexp_extract_all(F.col("text"), F.lit("(?U)" + pattern), F.lit(0))).alias("piece"))
    frequent = materialize(pieces.groupBy(*slices, "piece").agg(F.count("*").alias("n")), "pieces")
    lengths = frequent.select("piece").distinct().mapInArrow(_lengths(lengths or piece_length(vocabulary)), "piece string, length long")
    tokens = frequent.join(lengths, "piece").groupBy(*slices).agg(F.sum(F.col("n") * F.col("length")).alias("__tokens"))
    sizes = docs.groupBy(*slices).agg(F.count("*").alias("n_docs"))
    same = None
    for c in slices:
        one = sizes[c].eqNullSafe(tokens[c])
        same = one if same is None else same & one
    return sizes.join(tokens, same, "left").select(*[sizes[c] for c in slices], "n_docs", F.coalesce("__tokens", F.lit(0)).alias("n_tokens"))


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    records = record_tokens(table(spark, folder, "scores"), table(spark, folder, "pool"), table(spark, folder, "doc_counts"))
    return slice_totals(records, ["source", "topic", "vigintile"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _slices(spark, folder).where("n_tokens * 300 >= all_tokens and n_docs > 0").select("source", "topic", "vigintile")


def p2_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Records and usable tokens of every slice of the scored documents."""
    return _slices(spark, folder).select("source", "topic", "vigintile", "n_docs", "n_tokens", F.round(F.try_divide(F.col("n_tokens"), F.col("all_tokens")), 6).alias("share"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = canonical(table(spark, folder, "documents", spread=True).select("source", "topic", "vigintile", "lang", "text"), table(spark, folder, "doc_counts"))
    return docs.withColumn("lang", language(F.col("lang")))


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the texts of ``documents`` by source, language and topic (the domain)."""
    return text_token_totals(_texts(spark, folder), ["source", "lang", "topic"])


def p2_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The same under a byte tokenizer, of which another engine can tell the totals."""
    return text_token_totals(_texts(spark, folder), ["source", "lang", "topic"], lengths=byte_length)
