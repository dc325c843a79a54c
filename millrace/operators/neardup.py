"""Near-duplicate texts: exact set-similarity join on word shingles, MinHash bands, and clusters.

``similar_pairs`` loses no pair: shingles are ordered from rare to frequent, and two sets with a Jaccard similarity of at least t
share one among the first n - ceil(t n) + 1 of each. Texts with equal shingles are one set, so copies are never joined pair by
pair; the result is one row per text with its class, or pairs of classes. ``minhash_bands`` is the probabilistic variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import simplify, word_list
from ..functions.hashing import let
from ..runtime import materialize

SHINGLE = 5
SIMILARITY = 0.8
HOT_TERM, PARTS = 256, 16  # sets from which the list of a term is split, and into how many parts
BUCKETS, ROWS = 20, 12


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of the word n-grams of the simplified text; a shorter text is one shingle, a text without words none."""

    def grams(words: Column) -> Column:
        last = F.greatest(F.size(words) - (n - 1), F.lit(1))
        hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)))
        return F.when(F.size(words) > 0, F.array_distinct(hashed)).otherwise(F.array().cast("array<long>"))

    return let(word_list(simplify(text)), grams)  # words are split once, not once per shingle


def shingle_sets(docs: DataFrame, identifier: str, text: str, shingler=shingles) -> tuple[DataFrame, DataFrame]:
    """members (identifier, ``set_id``) and sets (``set_id``, ``n``, ``terms``); texts without words have a null ``set_id``."""
    hashed = docs.select(F.col(identifier).alias("id"), F.sort_array(shingler(F.col(text))).alias("terms"))
    hashed = hashed.withColumn("set_id", F.when(F.size("terms") > 0, F.md5(F.concat_ws(",", F.col("terms").cast("array<string>")))))
    hashed = materialize(hashed, "shingles")
    sets = hashed.where("set_id is not null").groupBy("set_id").agg(F.first("terms").alias("terms")).withColumn("n", F.size("terms"))
    return hashed.select(F.col("id").alias(identifier), "set_id"), sets


def similar_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of all pairs of different sets with a Jaccard similarity of at least ``similarity``; a < b."""
    once = materialize(sets.select("set_id", "n", "terms"), "sets")
    each = once.select("set_id", "n", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")  # a term of one set joins nothing, and ranks before all others
    shared = each.join(df, "term")
    # position among all terms of the set, from rare to frequent: terms of one set only come first
    ordered = Window.partitionBy("set_id").orderBy("df", "term")
    ranked = shared.withColumn("place", F.row_number().over(ordered)).withColumn("common", F.count("*").over(Window.partitionBy("set_id")))
    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    rest = F.col("common") - F.col("place") + 1  # terms of the set from this one on that others have, too
    listed = ranked.where(F.col("place") + F.col("n") - F.col("common") <= prefix).select("set_id", "n", "term", rest.alias("rest"), (F.col("df") > HOT_TERM).alias("hot"))
    # the list of a frequent term is split on one side and copied on the other
    copied = F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), PARTS - 1).otherwise(0))).alias("part")
    own = F.when(F.col("hot"), F.pmod(F.xxhash64("set_id"), F.lit(PARTS))).otherwise(0).cast("int").alias("part")
    left = listed.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "term", copied)
    right = listed.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), "term", own)
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= F.lit(similarity) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(similarity) * F.col("na") - 1e-9)
    # at the first common term the shorter rest still holds all that two such sets have in common
    enough = F.least("ra", "rb") >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9
    candidates = left.join(right, ["term", "part"]).where(fits & enough).select("a", "b").distinct()
    with_a = candidates.join(once.select(F.col("set_id").alias("a"), F.col("terms").alias("ta")), "a")
    with_b = with_a.join(once.select(F.col("set_id").alias("b"), F.col("terms").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    measured = with_b.select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("similarity"))
    return measured.where(F.col("similarity") >= similarity - 1e-9)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) of an undirected graph: the least node of each connected component.

    Each round every node takes the least label among itself and its neighbours, and then that label's own label
    (pointer jumping), so chains shrink by half; rounds are tables in the shared folder. Stops when nothing changes. Many rows
    may meet in one label or hub, but each time one row of the other side: a skewed partition that the engine splits.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        stepped = materialize(hooked.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = stepped.where("label <> old").limit(1).count()
        labels = stepped.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, identifier: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per text: identifier, ``class_id`` (least identifier of its class), ``links`` (texts of other wording at least
    so similar), ``copies`` (texts of the same shingles, itself included). Texts without words are classes of their own."""
    members, sets = shingle_sets(docs, identifier, text)
    sizes = members.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(identifier).alias("least"))
    pairs = materialize(similar_pairs(sets, similarity), "pairs")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("set_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("links"))
    linked = components(pairs).select(F.col("node").alias("set_id"), "component")
    classes = sizes.join(linked, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    info = classes.join(named, "component").join(links, "set_id", "left").select("set_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(info, "set_id", "left").select(identifier, F.coalesce("class_id", identifier).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one(docs: DataFrame, classes: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """The text of least identifier of each class."""
    return docs.join(classes.where(F.col(identifier) != F.col("class_id")).select(identifier), identifier, "left_anti")


def removed(docs: DataFrame, classes: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """The texts that ``keep_one`` leaves out."""
    return docs.join(classes.where(F.col(identifier) != F.col("class_id")).select(identifier), identifier, "left_semi")


def catch_probability(similarity: float, buckets: int = BUCKETS, rows: int = ROWS) -> float:
    """Chance that two texts of this similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** buckets


def minhash_bands(sets: DataFrame, buckets: int = BUCKETS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(``set_id``, ``bucket``, ``band``): a hash of ``rows`` minima in each of ``buckets`` buckets, on Arrow batches."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, buckets * rows, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 2**63, buckets * rows, dtype=np.uint64)
    schema = T.StructType([T.StructField("set_id", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for terms in batch.column(1):
                values = np.asarray(terms.values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    mixed = values[:, None] * factors[None, :] + shifts[None, :]
                    mixed ^= mixed >> np.uint64(33)
                    least = mixed.min(axis=0).reshape(buckets, rows)
                    band = np.zeros(buckets, dtype=np.uint64)
                    for j in range(rows):
                        band = (band ^ least[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                        band ^= band >> np.uint64(29)
                found.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x) for x in found], pa.list_(pa.int64()))], names=["set_id", "bands"])

    return sets.select("set_id", "terms").mapInArrow(sign, schema).select("set_id", F.posexplode("bands").alias("bucket", "band"))


def minhash_edges(bands: DataFrame) -> DataFrame:
    """A star of edges per bucket: each set to the least one with the same band. Linear in the size of the bucket."""
    star = bands.groupBy("bucket", "band").agg(F.min("set_id").alias("b"))
    return bands.join(star, ["bucket", "band"]).where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()


def minhash_classes(docs: DataFrame, identifier: str = "doc_id", text: str = "text", buckets: int = BUCKETS, rows: int = ROWS) -> DataFrame:
    """identifier, ``class_id``, ``cluster_size`` by band collisions (a pair of similarity s is caught with
    ``catch_probability(s)``); texts without words are classes of their own."""
    members, sets = shingle_sets(docs, identifier, text)
    linked = components(minhash_edges(minhash_bands(sets, buckets, rows))).select(F.col("node").alias("set_id"), "component")
    joined = materialize(members.join(linked, "set_id", "left").select(identifier, F.coalesce("component", "set_id").alias("c")), "classes")
    named = joined.where("c is not null").groupBy("c").agg(F.min(identifier).alias("class_id"), F.count("*").alias("cluster_size"))
    return joined.join(named, "c", "left").select(identifier, F.coalesce("class_id", identifier).alias("class_id"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))
