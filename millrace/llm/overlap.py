"""Problem 4: texts of the evaluation splits that occur, exactly or almost, among the training records.

Two ways lead from a text to the training records, and both are taken. A record's key is the hash of its text where the text
has no other hash, so the keys of the evaluation texts are joined with those of all records (``key_matches``); that needs no
training text. Where ``documents`` has the text of a record, a cosine join finds the texts that are nearly the same.

The cosine join. A text is a vector of terms: five-word shingles of its normalised form, of which the k-th occurrence is a term
of its own. Texts of at most SHORT words, where one changed word takes most shingles away, have a second vector of three-word
shingles. A pair is a case if, by either kind, the longer vector shares at least LIMITS of its terms with the other. The share
is a lower bound of the cosine of unit weights, so it prunes as the cosine does, but exactly at every length of text, and no
pair is lost because its terms are common. True cases of the tables share 0.46 or more (longer texts) and 0.6 or more (short
ones), other pairs less than 0.38.

Terms are ordered from rare to frequent, the same way on both sides: terms that no evaluation text has, then by the bit maps of
terms that several (OFTEN) have, then by hash. If two vectors share enough, their first common term lies where the rest of
either vector (its residual norm) still makes up the share, and where the largest contributions that the other side can make to
the rest (its maximum weights) still sum to it. So the inverted lists hold only those prefixes, cut where the vectors are read,
and a pair that meets in them is a candidate, for which the dot products are counted exactly: with unit weights for the share,
and with weights that fall with the number of evaluation texts that have the term for the cosine that is reported.

Of the training side only terms matter that some evaluation text has. Bit maps of their hashes go to the tasks that read the
training texts: 16 bits a term, at most 2^MOST_BITS (128 MB); they have no false negatives, and false positives fall out in the
join. A text whose terms are mostly unknown to the map can't reach the share and is dropped where it is read.

Texts with the same terms are one vector, so copies are neither joined pair by pair nor make long lists; they come back with
the ranks at the end. Listed terms that many evaluation texts have, and keys that many records have, are split.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import blake2_key
from ..functions.labels import canonical
from ..operators.select import split_of
from ..runtime import materialize, small, spread_join, table

WORDS, SHORT_WORDS = 5, 3
SHORT = 64  # words of a text that has a second vector
LIMITS = (0.42, 0.49)  # share of the longer vector's terms, of five-word and three-word shingles
OFTEN = (2, 4, 8, 16, 64, 256)  # numbers of evaluation texts from which a term is more and more frequent, for order and weights
SPLITS = 16  # parts of the list of a term of the last class
MOST_BITS = 30
CHUNKS = 64

_TAG = re.compile(r"<[^<>\n]{1,200}>")
_BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MIXED = str.maketrans("0135", "oles")
_A, _B, _GOLD, _KIND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_BLANK = r"(?U)\A\s*\z"


def words(text: str) -> list[str]:
    """Words of the normalised text: compatibility forms, tags, line-break hyphens, case, digits read for letters."""
    plain = _BROKEN.sub("", _TAG.sub(" ", unicodedata.normalize("NFKC", text))).lower()
    return [w if w.isalpha() or w.isdigit() else w.translate(_MIXED) for w in _WORD.findall(plain)]


class Terms:
    """Text -> sorted term hashes; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        """Hashes of the words; of the text without white space if it has no word."""
        found, known = words(text), self.known
        if len(known) > 2_000_000:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out or [xxhash.xxh64_intdigest("".join(text.split()))], dtype=np.uint64)

    def of(self, text: str, size: int = WORDS) -> np.ndarray:
        return self.shingles(self.hashes(text), size)

    def forms(self, text: str) -> list[np.ndarray]:
        """The terms of the text's vector of each kind."""
        hashes = self.hashes(text)
        found = [self.shingles(hashes, WORDS)]
        if len(hashes) <= SHORT:
            found.append((self.shingles(hashes, SHORT_WORDS).view(np.uint64) ^ _KIND).view(np.int64))
        return found

    def shingles(self, h: np.ndarray, size: int) -> np.ndarray:
        """Sorted hashes of the shingles; a text of fewer words is one shingle."""
        if len(h) < size:
            h = np.concatenate((h, np.full(size - len(h), _GOLD)))
        last = len(h) - size + 1
        with np.errstate(over="ignore"):
            terms = h[:last] * _A
            for j in range(1, size):
                terms = (terms ^ (terms >> np.uint64(31))) * _B + h[j : j + last]
            terms = (terms ^ (terms >> np.uint64(29))) * _A
            terms.sort()
            first = np.concatenate(([True], terms[1:] != terms[:-1]))
            if not first.all():
                place = np.arange(len(terms))
                occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
                terms = terms + occurrence.astype(np.uint64) * _GOLD
                terms.sort()
        return terms.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def vectors(texts: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(id, ``vec``, ``kind``, ``n``, ``terms``): the vectors of every text (``id``, ``text``) that is neither null nor blank, with
    their identity and number of terms.

    With a bit map only its terms come, and no vector that can't reach the share: with m of n terms known, it is at most m / n.
    """
    sent = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)
    schema = texts.select("id").schema.add("vec", T.BinaryType()).add("kind", T.IntegerType()).add("n", T.IntegerType()).add("terms", T.ArrayType(T.LongType()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            rows, names, kinds, sizes, found = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, every in enumerate(terms.forms(text)):
                    some = every if sent is None else every[_probe(sent.value, every)]
                    if len(some) and len(some) >= LIMITS[kind] * len(every) - 1e-9:
                        rows.append(i), names.append(xxhash.xxh128_digest(every.tobytes())), kinds.append(kind), sizes.append(len(every)), found.append(some)
            ids = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.binary()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32()), _lists(found)], names=schema.names)

    return texts.select("id", "text").where("text is not null").where(~F.col("text").rlike(_BLANK)).mapInArrow(make, schema)


def bitmaps(terms: DataFrame, size: int) -> list[np.ndarray]:
    """Bit maps of the hashes in ``term`` whose ``df`` is at least 1 and each of OFTEN, for about ``size`` terms; those of OFTEN
    with 8 bits as one, enough for an order, which collisions leave the same on both sides.

    Each task marks its own terms and hands on compressed chunks, whose size follows the terms, not the map; the chunks are
    united in tasks, so the driver gets the maps once.
    """
    bits = min(MOST_BITS, max(15, (16 * size).bit_length()))
    widths = [bits, *[bits - 3] * len(OFTEN)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.zeros(1 << (w - 3), np.uint8) for w in widths]
        for batch in batches:
            place, often = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits), batch.column(1).to_numpy()
            for k, least in enumerate((1, *OFTEN)):
                at = place[often >= least] >> np.uint64(0 if k == 0 else 3)
                np.bitwise_or.at(maps[k], (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        parts = [(k, c, zlib.compress(piece.tobytes(), 1)) for k, m in enumerate(maps) for c, piece in enumerate(np.split(m, CHUNKS)) if piece.any()]
        yield pa.RecordBatch.from_pylist([{"map": k, "chunk": c, "bits": b} for k, c, b in parts], schema=pa.schema([("map", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))

    def unite(key: tuple, parts: pa.Table) -> pa.Table:
        whole = None
        for blob in parts.column("bits"):
            piece = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
            whole = piece.copy() if whole is None else np.bitwise_or(whole, piece, out=whole)
        return pa.table({"map": [key[0].as_py()], "chunk": [key[1].as_py()], "bits": [zlib.compress(whole.tobytes(), 1)]}, schema=parts.schema)

    layout = "map int, chunk int, bits binary"
    out = [np.zeros(1 << (w - 3), np.uint8) for w in widths]
    for k, chunk, blob in terms.select("term", "df").mapInArrow(mark, layout).groupBy("map", "chunk").applyInArrow(unite, layout).collect():
        np.split(out[k], CHUNKS)[chunk][:] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return out


def _probe(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    place = terms.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _level(often: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """How many of OFTEN the number of evaluation texts with the term reaches."""
    level = np.zeros(len(terms), np.int64)
    for bits in often:
        level += _probe(bits, terms)
    return level


def prefixes(found: DataFrame, often: list[np.ndarray], side: str) -> DataFrame:
    """(``term``, vector, its kind and size, ``rest``, ``hot``): the terms of each vector's inverted lists. ``rest`` counts the known
    terms from this one on; at the first common term of a case it makes up the share."""
    sent = found.sparkSession.sparkContext.broadcast(often)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, listed, rests, hot = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
            for kind, n, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                terms = terms.values.to_numpy()
                level = _level(sent.value, terms)
                keep = int(min(len(terms), len(terms) - LIMITS[kind] * n + 1 + 1e-9))  # rest = len - place >= share x n
                first = np.lexsort((terms, level))[:keep]
                rows.append(keep), listed.append(terms[first]), hot.append(level[first] == len(OFTEN))
                rests.append(np.arange(len(terms), len(terms) - keep, -1, dtype=np.int32))
            again = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(again) for k in range(3)), *(pa.array(np.concatenate(x)) for x in (listed, rests, hot))], names=["vec", "kind", "n", "term", "rest", "hot"],
            )

    return found.select("vec", "kind", "n", "terms").mapInArrow(cut, "vec binary, kind int, n int, term long, rest int, hot boolean").toDF(f"{side}_vec", "kind", f"{side}_n", "term", f"{side}_rest", "hot")


def _limit(kind: str = "kind"):
    return F.when(F.col(kind) == 0, LIMITS[0]).otherwise(LIMITS[1])


def measured(candidates: DataFrame, left: DataFrame, right: DataFrame, often: list[np.ndarray], total: int) -> DataFrame:
    """(``left_vec``, ``right_vec``, ``share``, ``cosine``) of the candidates that reach the share, by exact dot products. A term's
    weight is ln(1 + N / df) / ln(1 + N), with df taken as the bound of its class; 1 if one evaluation text has it, or none."""
    weights = np.log1p(total / np.array([1, *OFTEN])) / np.log1p(max(total, 1))
    sent = candidates.sparkSession.sparkContext.broadcast((often, weights**2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shares, cosines = [], [], []
            columns = [batch.column(k).to_pylist() for k in range(2, 5)]
            for i, (kind, n, m) in enumerate(zip(*columns)):
                a, b = (batch.column(k)[i].values.to_numpy() for k in (5, 6))
                both = np.intersect1d(a, b, assume_unique=True)
                if len(both) >= LIMITS[kind] * max(n, m) - 1e-9:
                    # terms that no evaluation text has aren't listed on the right; they weigh 1
                    norm = lambda terms, size: sent.value[1][_level(sent.value[0], terms)].sum() + size - len(terms)
                    rows.append(i), shares.append(len(both) / max(n, m))
                    cosines.append(float(norm(both, len(both)) / np.sqrt(norm(a, n) * norm(b, m))))
            picked = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(shares, pa.float64()), pa.array(cosines, pa.float64())], names=["left_vec", "right_vec", "share", "cosine"])

    def once(found: DataFrame, side: str) -> DataFrame:
        """The vectors of one side that are in a candidate: few, so the others are not shuffled."""
        wanted = small(candidates.select(F.col(f"{side}_vec").alias("vec")).distinct())
        return found.join(wanted, "vec", "left_semi").dropDuplicates(["vec"]).select(F.col("vec").alias(f"{side}_vec"), F.col("n").alias(f"{side}_n"), F.col("terms").alias(f"{side}_terms"))

    both = candidates.join(once(left, "left"), "left_vec").join(once(right, "right"), "right_vec")
    return both.select("left_vec", "right_vec", "kind", "left_n", "right_n", "left_terms", "right_terms").mapInArrow(count, "left_vec binary, right_vec binary, share double, cosine double")


def cosine_join(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of texts of two tables (``id``, ``text``) as classes of equal vectors.

    Result: pairs (``left_vec``, ``right_vec``, ``share``, ``cosine``) whose share of the longer vector reaches LIMITS, and the
    members (``id``, ``vec``) of the left and the right vectors. A pair of short texts may come with its vectors of both kinds.
    Null and blank texts are in no pair. All vectors of both sides are compared; nothing is capped.
    """
    left_all = materialize(vectors(left), "left")
    left_once = materialize(left_all.dropDuplicates(["vec"]).select("vec", "kind", "n", "terms"), "left-once")
    df = materialize(left_once.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.min("n").alias("least")), "df")
    known, *often = bitmaps(df, df.count())
    right_all = materialize(vectors(right, known), "right")

    # what the listed terms not yet passed can contribute, and the terms after them at most
    after = Window.partitionBy("right_vec").orderBy(F.desc("right_rest")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = F.sum(1 / F.greatest("right_n", "least")).over(after) + (F.min("right_rest").over(after) - 1) / F.col("right_n")
    bounded = prefixes(right_all.dropDuplicates(["vec"]), often, "right").join(df.select("term", "least"), "term").withColumn("reach", reach).where(F.col("reach") >= _limit() - 1e-9)
    # the list of a frequent term is split on the right and copied on the left
    right_lists = bounded.select("term", "kind", "right_vec", "right_n", "right_rest", F.when(F.col("hot"), F.pmod(F.xxhash64("right_vec"), F.lit(SPLITS))).otherwise(0).cast("int").alias("part"))
    left_lists = prefixes(left_once, often, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SPLITS - 1).otherwise(0)))).drop("hot")
    met = left_lists.join(right_lists, ["term", "kind", "part"]).where(F.least("left_rest", "right_rest") >= _limit() * F.greatest("left_n", "right_n") - 1e-9)
    candidates = materialize(met.select("left_vec", "right_vec", "kind").distinct(), "candidates")
    pairs = materialize(measured(candidates, left_once, right_all, often, left_once.where("kind = 0").count()), "pairs")
    return pairs, left_all.select("id", "vec"), right_all.select("id", "vec")


def train_keys(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """(rank, key) of every training record, as often as it comes; a row without key has its rank as its own key, which ``own`` tells apart."""
    both = scores.select("rank", F.col("text_key").alias("key")).unionByName(pool.select("rank", F.col("text_hash").alias("key"))).where("rank is not null")
    return both.select("rank", F.coalesce("key", "rank").alias("key"), F.col("key").isNull().alias("own"))


def key_matches(evals: DataFrame) -> DataFrame:
    """(``key``, ``eval_rank``): the key that a training record of the same text has, unless its text carries another hash."""
    filled = evals.where("text is not null").where(~F.col("text").rlike(_BLANK))
    return filled.select(blake2_key("text").alias("key"), F.col("id").alias("eval_rank")).distinct()


def cross_split_pairs(scores: DataFrame, pool: DataFrame, documents: DataFrame, eval_docs: DataFrame) -> DataFrame:
    """(train_rank, eval_rank): every pair of a training record and an evaluation record with the same or nearly the same text.

    The text of a training record is that of any document whose rank has the same key, or the evaluation text of that key.
    Repeated rows make no repeated pairs; null ranks, null and blank texts make none. The records of a key may be a large part
    of all rows: where the matches are few they go to the records, else the records of frequent keys are split.
    """
    evals = eval_docs.where("rank is not null").select(F.col("rank").alias("id"), "text")
    train = documents.where("rank is not null").select(F.col("rank").alias("id"), "text")
    keys = train_keys(scores, pool)
    pairs, left, right = cosine_join(evals, train)
    matched = pairs.join(right.withColumnRenamed("vec", "right_vec"), "right_vec").select("left_vec", F.col("id").alias("rank")).distinct()
    hits = spread_join(keys, matched, ["rank"]).select("left_vec", "key", "own").distinct()
    near = hits.join(left.withColumnRenamed("vec", "left_vec"), "left_vec").select("key", "own", F.col("id").alias("eval_rank"))
    found = near.unionByName(key_matches(evals).withColumn("own", F.lit(False))).distinct()
    return spread_join(keys, found, ["key", "own"]).select(F.col("rank").alias("train_rank"), "eval_rank").distinct()


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_pairs(table(spark, folder, "scores"), table(spark, folder, "pool"), table(spark, folder, "documents", spread=True), table(spark, folder, "eval_docs", spread=True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source of the training record: pairs, evaluation records and training records in them."""
    pairs = materialize(_pairs(spark, folder), "found")
    ranks = pairs.select(F.col("train_rank").alias("rank")).distinct()
    labels = table(spark, folder, "scores").select("rank", "source", "topic").unionByName(table(spark, folder, "pool").select("rank", "source", "topic"))
    # one source per rank; rows of a rank agree but for the way of writing
    sources = canonical(labels.join(small(ranks), "rank", "left_semi"), table(spark, folder, "doc_counts"), vigintile=None).groupBy(F.col("rank").alias("train_rank")).agg(F.min("source").alias("source"))
    splits = {r.split_name: (r.rank_lo, r.rank_hi) for r in table(spark, folder, "splits").collect()}  # three rows
    named = pairs.withColumn("split_name", split_of(F.col("eval_rank"), splits))
    return named.join(sources, "train_rank", "left").groupBy("split_name", "source").agg(F.count("*").alias("pairs"), F.countDistinct("eval_rank").alias("eval_records"), F.countDistinct("train_rank").alias("train_records"))


def p4_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The part of ``p4_found`` that the keys alone give."""
    evals = table(spark, folder, "eval_docs").where("rank is not null").select(F.col("rank").alias("id"), "text")
    keys = train_keys(table(spark, folder, "scores"), table(spark, folder, "pool")).where("not own")
    return spread_join(keys, key_matches(evals), ["key"]).select(F.col("rank").alias("train_rank"), "eval_rank").distinct()
