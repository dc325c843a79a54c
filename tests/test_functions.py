"""Scalar functions against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs, hashing, labels


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("common_crawl-health-0019", ("common_crawl", "health", "19")),
        ("olmocr_science_pdfs-physics", ("olmocr_science_pdfs", "physics", "")),
        ("stack_edu-Python", ("stack_edu", "Python", "")),
        ("wiki", ("wiki", "-", "")),
    ],
)
def test_parse_dir(spark, name, wanted):
    assert tuple(one(spark, labels.parse_dir(F.col("d")), d=("string", name))) == wanted


@pytest.mark.parametrize(("source", "topic", "wanted"), [("common_crawl", "health", "cc:health"), ("stack_edu", "Python", "code:Python"), ("wiki", "-", "wiki")])
def test_group_name(spark, source, topic, wanted):
    assert one(spark, labels.group_name(F.col("s"), F.col("t")), s=("string", source), t=("string", topic)) == wanted


def test_canonical_labels(spark):
    catalog = spark.createDataFrame([(0, "data/common_crawl-Arts-0003/a.zst", 5), (1, "data/wiki/a.zst", 5)], "shard int, file_path string, n_docs long")
    rows = spark.createDataFrame(
        [(" Common-Crawl", " ARTS ", "3", 1), ("common_crawl-arts-0003", None, None, 2), ("WIKI", None, "-", 3), (None, None, None, 4), ("other src", "x", "", 5)],
        "source string, topic string, vigintile string, __source_row int",
    )
    got = {r[3]: tuple(r)[:3] for r in labels.canonical(rows, catalog).collect()}
    assert got == {1: ("common_crawl", "Arts", "03"), 2: ("common_crawl", "Arts", "03"), 3: ("wiki", "-", ""), 4: (None, "-", ""), 5: ("other_src", "x", "")}
    assert labels.canonical(rows.limit(0), catalog).count() == 0


def test_hash64_equals_unsigned_arithmetic(spark):
    x = np.array([0, 1, 2, 3, 123456789, 2**62, -1, -(2**63)], dtype=np.int64)
    with np.errstate(over="ignore"):
        z = x.view(np.uint64) + np.uint64(20261015) * np.uint64(hashing.GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(hashing.MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(hashing.MIX_2)
        z ^= z >> np.uint64(31)
    got = spark.createDataFrame([(int(v),) for v in x], "v long").select(hashing.hash64(20261015, F.col("v")).alias("h")).collect()
    assert [r.h for r in got] == z.view(np.int64).tolist()
    assert z[:2].tolist() == [13937276723524437344, 15680486438959364127]


def test_hash_sample_share(spark):
    n = spark.range(20000).where(hashing.hash_sample(1, F.col("id"), 0.25)).count()
    assert abs(n - 5000) < 300
    assert hashing.pool_fraction(1.9e10, 104_020_922 - 60_000 - 5_198_546, 1511.6) == pytest.approx(0.12726974916897582)


def test_keys(spark):
    assert one(spark, hashing.low64(F.col("a")), a=("string", str(2**100 + 5))) == 5
    assert one(spark, hashing.low64(F.col("a")), a=("string", str(2**127 - 1))) == -1
    assert one(spark, hashing.low64(F.col("a")), a=("string", "x")) is None
    assert one(spark, hashing.dedup_key(F.col("a"), F.col("t")), a=("string", ""), t=("string", "hello")) == 9022087748821825191
    assert one(spark, hashing.dedup_key(F.col("a"), F.col("t")), a=("string", None), t=("string", None)) is None


def test_question_metrics(spark):
    column = exprs.question_metrics(F.col("l"), F.col("c"), F.lit(1))
    m = one(spark, column, l=("array<double>", [-2.0, -1.0, -4.0]), c=("array<string>", ["a", "bb", "cccc"]))
    assert (m.acc, m.acc_norm) == (1.0, 1.0)
    assert m.logp_char == pytest.approx(-0.5) and m.prob_norm == pytest.approx(0.7053845) and m.margin_char == pytest.approx(0.5)
    single = one(spark, exprs.question_metrics(F.col("l"), F.col("c"), F.lit(0), F.lit(True)), l=("array<double>", [-3.0]), c=("array<string>", ["abc"]))
    assert (single.acc, single.logp_char, single.acc_norm) == (1.0, -1.0, None)


@pytest.mark.parametrize(("target", "wanted"), [("2", 2), ("b", 1), ("c", 2), ("zzz", None)])
def test_gold_index(spark, target, wanted):
    assert one(spark, exprs.gold_index(F.col("t"), F.col("c")), t=("string", target), c=("array<string>", ["a", "b", " c"])) == wanted


@pytest.mark.parametrize(("amount", "wanted"), [("300M", 3e8), ("1B", 1e9), ("1e9", 1e9), ("0.5", 5e8), ("abc", None)])
def test_stage_tokens(spark, amount, wanted):
    assert one(spark, exprs.stage_tokens(F.col("a"), F.lit(1e9)), a=("string", amount)) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("1-02:03:04", 93784), ("00:10:00", 600), ("x", None)])
def test_duration(spark, text, wanted):
    assert one(spark, exprs.duration_seconds(F.col("t")), t=("string", text)) == wanted


@pytest.mark.parametrize(
    ("name", "dims", "wanted"),
    [
        ("model.layers.3.self_attn.q_proj.weight", 2, "attn_q"), ("model.embed_tokens.weight", 2, "embed"), ("lm_head.weight", 2, "lm_head"), ("model.layers.0.mlp.down_proj.weight", 2, "mlp_down"),
        ("model.norm.weight", 1, "norm"), ("a.bias", 1, "bias"), ("a.scale", 1, "vector"), ("x.conv.weight", 2, "other_conv"), ("weird", 2, "other_weird"),
    ],
)
def test_block_type(spark, name, dims, wanted):
    assert one(spark, exprs.block_type(F.col("n"), F.lit(dims)), n=("string", name)) == wanted
    assert one(spark, exprs.layer_of(F.col("n")), n=("string", name)) == (int(name.split(".")[2]) if "layers" in name else -1)


@pytest.mark.parametrize(("z", "wanted"), [(-1e-9, "z = 0"), (0.0, "z = 0"), (1e-9, "[+0.0, +0.5)"), (2.5, "[+2.5, +inf)"), (-3.0, "[-inf, -2.5)"), (None, None), (math.nan, None)])
def test_z_bin(spark, z, wanted):
    assert one(spark, exprs.z_bin(F.col("z")), z=("double", z)) == wanted


@pytest.mark.parametrize(("copies", "wanted"), [(1, "1-1"), (2, "2-2"), (4, "3-4"), (16, "5-16"), (100, "17-100"), (1000, "101-1000"), (5000, "1001-inf")])
def test_copy_bucket(spark, copies, wanted):
    assert one(spark, exprs.copy_bucket(F.col("c")), c=("int", copies)) == wanted


@pytest.mark.parametrize(("step", "wanted"), [(228, "warmup"), (229, "stable"), (10300, "stable"), (10301, "decay")])
def test_stage(spark, step, wanted):
    assert one(spark, exprs.stage(F.col("s"), 11444), s=("int", step)) == wanted


def test_last_match(spark):
    column = exprs.last_match(F.col("t"), r"k=(\d+)")
    assert one(spark, column, t=("string", "k=1 k=22")) == "22"
    assert one(spark, column, t=("string", "none")) is None
    assert one(spark, column, t=("string", None)) is None
