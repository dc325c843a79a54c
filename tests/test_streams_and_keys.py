"""Token streams, scorers, keys, joins of hot keys, records: failures that must show, nulls, ties, empty tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import exprs, hashing
from millrace.operators import dynamics, neardup, prefix, quality, records, stats, tokens
from millrace.plans import schedule
from millrace.sources import corpus, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def at(day):
    return datetime(2026, 3, 1) + timedelta(days=day)


def test_keys_next_to_nulls_are_exact(spark):
    rows = [(i, None if i % 3 == 0 else f"text {i}") for i in range(30)]
    got = {r.i: r.k for r in frame(spark, rows, "i int, t string").coalesce(1).select("i", hashing.blake2_key("t").alias("k")).collect()}
    alone = {i: frame(spark, [(t,)], "t string").select(hashing.blake2_key("t").alias("k")).first().k for i, t in rows[:7]}
    assert all(got[i] is None for i in range(0, 30, 3)) and {i: got[i] for i in alone} == alone


@pytest.mark.parametrize("few", [True, False])
def test_spread_join_equals_a_join(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.05 else 1 if rng.random() < 0.5 else rng.randint(2, 30), i) for i in range(600)]
    matches = [(rng.randint(1, 12), f"m{i}") for i in range(25)] + [(None, "none")]
    got = Counter((r.k, r.i, r.m) for r in runtime.spread_join(frame(spark, rows, "k int, i int"), frame(spark, matches, "k int, m string"), ["k"], hot=40).collect())
    assert got == Counter((k, i, m) for k, i in rows for j, m in matches if k is not None and k == j)
    assert runtime.spread_join(frame(spark, rows, "k int, i int"), frame(spark, [], "k int, m string"), ["k"]).count() == 0


def test_tables_of_a_scope_go_with_it(spark):
    outer = runtime.materialize(frame(spark, [(1,)], "x int"))
    with runtime.scope():
        inner = runtime.materialize(frame(spark, [(2,)], "x int"))
        assert inner.first().x == 2
    assert outer.first().x == 1
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(inner.inputFiles()[0])


def test_records_of_the_pool(spark):
    catalog = frame(spark, [(0, "data/wiki/a.zst", 10), (1, "data/wiki/b.zst", 10)], "shard int, file_path string, n_docs long")
    rows = [
        (3, 0, 3, "a", 5, at(2)), (3, 0, 3, "b", 7, at(1)), (None, 0, 3, "z", 9, at(0)),  # the row without id came first
        (None, 1, 2, "c", 1, at(1)), (12, 1, 2, "c", 1, at(1)), (None, None, 4, "x", 1, at(0)), (15, 1, 5, None, None, None),
    ]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = {r.row_id: (r.topic, r.n) for r in records.pool_records(frame(spark, rows, "row_id long, shard int, shard_offset int, topic string, n int, added_at timestamp"), catalog, ["topic", "n"]).collect()}
        assert got == {3: ("z", 9), 12: ("c", 1), 15: (None, None)}


def test_locate_by_files_of_any_size(spark, monkeypatch):
    sizes = [5, 0, 1000, 1, 1, 1, 300]
    catalog = frame(spark, [(i, f"data/wiki/{i}.zst", n) for i, n in enumerate(sizes)], "shard int, file_path string, n_docs long")
    ids = [0, 4, 5, 1004, 1005, 1006, 1007, 1008, 1307, 1308, -1, None, 10**12]
    starts = np.cumsum([0, *sizes])
    wanted = {i: next(((s, i - int(starts[s])) for s in range(len(sizes)) if i is not None and starts[s] <= i < starts[s + 1]), (None, None)) for i in ids}
    rows = frame(spark, [(i, 7) for i in ids], "row_id long, shard int")
    for most in (corpus.MAX_FILES, 3):
        monkeypatch.setattr(corpus, "MAX_FILES", most)
        assert {r.row_id: (r.shard, r.shard_offset) for r in corpus.locate(rows, catalog).collect()} == wanted
    assert corpus.locate(rows, catalog.limit(0)).where("shard is not null").count() == 0 or most == 3


def test_unique_scores_must_be_unique(spark):
    rows = frame(spark, [("a", 1), ("a", 2), (None, 3)], "key string, i int")
    twice = lambda d: d.select("key", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("score"))
    with pytest.raises(Exception, match="scored twice"):
        tokens.score_unique(rows, "key", twice).collect()
    assert {r.i: r.score for r in tokens.score_unique(rows, "key", lambda d: d.select("key", F.lit(1.0).alias("score"))).collect()} == {1: 1.0, 2: 1.0, 3: None}


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_score_stream(spark, batch):
    docs = frame(spark, [(1, [1, 2, 3, 4, 5]), (2, [9]), (3, []), (4, None), (5, [2, 2])], "i int, ids array<int>")
    scorer = lambda: lambda windows: [[float(b - a) for a, b in zip(w, w[1:])] for w in windows]
    got = {r.i: (r.mean_loss, r.n_pred, r.losses) for r in tokens.score_stream(docs, "i", "ids", scorer, window=3, batch_tokens=batch, per_token=True).collect()}
    assert got == {1: (1.0, 3, [1.0, 1.0, 1.0]), 2: (None, 0, []), 3: (None, 0, []), 4: (None, 0, []), 5: (0.0, 1, [0.0])}
    check = tokens.batch_check(docs, "i", "ids", scorer, 3).first()
    assert (check.documents, check.max_difference) == (2, 0.0)
    unsteady = lambda: lambda windows: [[float(len(windows))] * (len(w) - 1) for w in windows]
    assert tokens.batch_check(docs, "i", "ids", unsteady, 3).first().max_difference > 0
    assert tokens.batch_check(docs.limit(0), "i", "ids", scorer).first().documents == 0


def test_unigram_scorer_equals_document_loss(spark):
    rng = random.Random(3)
    docs = frame(spark, [(i, [rng.randint(0, 9) for _ in range(rng.randint(0, 40))]) for i in range(50)], "i int, ids array<int>")
    a = {r.i: (r.mean_loss, r.n_pred) for r in tokens.score_stream(docs, "i", "ids", tokens.unigram_scorer(docs, "ids"), 16).collect()}
    b = {r.i: (r.mean_loss, r.n_pred) for r in tokens.document_loss(docs, "i", "ids", 16).collect()}
    assert a.keys() == b.keys() and all(a[i][1] == b[i][1] and (a[i][0] is None) == (b[i][0] is None) and (a[i][0] is None or a[i][0] == pytest.approx(b[i][0])) for i in a)


def test_ranges_must_be_whole_documents(spark):
    docs = frame(spark, [(1, [tokens.BOS, 5, tokens.EOS]), (2, [tokens.BOS, tokens.EOS]), (3, [tokens.BOS, 5])], "i int, ids array<int>")
    chosen = frame(spark, [(2,), (1,), (1,), (None,)], "i int")
    assert [(r.i, r.start, r.n) for r in tokens.copied_ranges(docs, chosen, "i", ["i"]).orderBy("i").collect()] == [(1, 0, 3), (2, 3, 2)]
    with pytest.raises(Exception, match="no whole document"):
        tokens.copied_ranges(docs, docs, "i", ["i"]).collect()
    assert tokens.alignment(docs).first().aligned and not tokens.alignment(frame(spark, [([1, 2],)], "ids array<int>")).first().aligned
    with pytest.raises(Exception, match="different lengths"):
        docs.select(tokens.aligned(F.col("ids"), F.array(F.lit(1))).alias("z")).collect()


@pytest.mark.parametrize("ids", [[], [tokens.BOS], [7], [7, 8, tokens.BOS, 9, tokens.EOS, tokens.BOS, 4], list(range(9000))])
def test_positions(spark, ids):
    wanted, p = [], -1
    for t in ids:
        p = 0 if t == tokens.BOS else p + 1
        wanted.append(p)
    assert frame(spark, [(ids,)], "ids array<int>").select(tokens.position_ids(F.col("ids")).alias("p")).first().p == wanted


def test_token_table_with_a_broken_tail(spark, tmp_path):
    with pytest.raises(ValueError, match="tail"):
        sinks.write_tokens(frame(spark, [(1, [5, 0])], "i int, ids array<int>"), str(tmp_path / "t"), ["i"])
    sinks.write_tokens(frame(spark, [(i, [i + 1] * (i % 5)) for i in range(200)], "i int, ids array<int>").repartition(7), str(tmp_path / "u"), ["i"])
    n = sinks.export_tokens(spark, str(tmp_path / "u"), str(tmp_path / "u.bin"))
    assert np.fromfile(tmp_path / "u.bin", "<u4").tolist() == [i + 1 for i in range(200) for _ in range(i % 5)] and n == 400
    with pytest.raises(ValueError):
        sinks.local_path("s3://bucket/x")


def naive_shares(text):
    words, out = text.split(), []
    for n in quality.TOP_NGRAM_LIMITS:
        grams = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        most = max(grams.values(), default=0)
        out.append(max((len(g) for g, k in grams.items() if k == most), default=0) * most / max(1, len(text)))
    for n in quality.DUP_NGRAM_LIMITS:
        seen, repeated, i = set(), 0, 0
        while i < len(words) - n + 1:
            gram = tuple(words[i : i + n])
            repeated += sum(map(len, gram)) if gram in seen else 0
            i += n if gram in seen else 1
            seen.add(gram)
        out.append(repeated / max(1, len(text)))
    return out


def test_ngram_shares_equal_a_plain_count(spark):
    rng = random.Random(9)
    texts = ["", "one", "a b", " ".join("x" * 40), "the cat " * 50] + [" ".join(rng.choice(["aa", "b", "ccc", "d"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    for text in texts:
        assert quality.ngram_shares(text) == pytest.approx(naive_shares(text)), text
    docs = frame(spark, [(1, None), (1, "a"), (1, "a")], "doc_id int, text string")
    assert [r.drop_reason for r in quality.filtered(docs).collect()] == ["short"] * 3
    steps = quality.step_counts(quality.filtered(docs)).where("dropped > 0").collect()
    assert [(r.drop_reason, r.texts, r.kept) for r in steps] == [("short", 3, 0)]
    assert quality.step_counts(quality.filtered(docs.limit(0))).agg(F.max("texts")).first()[0] == 0


def test_reached_equals_digitize(spark):
    edges = exprs.logit_thresholds(101)
    values = [*edges, 0.0, 1.0, -5.0, 0.5, float("nan"), None, edges[3] - 1e-18]
    got = frame(spark, [(v,) for v in values], "x double").select(exprs.reached(F.col("x"), edges).alias("a"), exprs.digitize(F.col("x"), edges).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and exprs.logit_thresholds()[1000] == pytest.approx(0.5)


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_medians_of_any_groups(spark, monkeypatch, one_task):
    monkeypatch.setattr(prefix, "IN_ONE_TASK", one_task)
    rows = frame(spark, [(None, "m", "b", s, float(v)) for s in (1, 50, 99) for v in (1, 2, 9)] + [("r", "m", "b", 1, 4.0), ("r", "m", "b", 1, None)], "run string, metric string, block string, step int, value double")
    got = {r.run: (r.warmup, r.stable, r.decay) for r in dynamics.stage_medians(rows, 100, "run").collect()}
    assert got == {None: (2.0, 2.0, 2.0), "r": (4.0, None, None)}
    assert dynamics.stage_medians(rows.limit(0), 100, "run").count() == 0


def test_weighted_percentiles_with_null_groups(spark):
    rows = frame(spark, [(None, 1.0, 1), (None, 2.0, 3), ("a", 5.0, 1), ("a", None, 9)], "g string, x double, w int")
    got = {(r.group, r.weight): r.p50 for r in stats.weighted_percentiles(rows, "g", "x", {"n": F.lit(1), "w": F.col("w")}, [50]).collect()}
    assert got == {(None, "n"): 1.0, (None, "w"): 2.0, ("a", "n"): 5.0, ("a", "w"): 5.0, ("ALL", "n"): 2.0, ("ALL", "w"): 2.0}


def test_breakdown_leaves_out_rare_buckets(spark):
    rows = frame(spark, [(1, "a", 90, 180.0, 90.0), (2, "a", 5, 10.0, 5.0), (2, "b", 4, 8.0, 8.0), (3, "c", 1, 9.0, 9.0), (4, "d", 0, 0.0, 0.0)], "doc int, bucket string, n int, base double, other double")
    got = {r.bucket: (r.predictions, r.share, r.loss, r.delta_other) for r in stats.loss_breakdown(stats.document_buckets(rows, "doc", "bucket", "n", ["base", "other"]), "bucket", "n", "base", ["other"], 0.02).collect()}
    assert got == {"a": (95, 0.95, 2.0, -1.0), "b": (4, 0.04, 2.0, 0.0)}


def test_noise_blocks_need_a_tail(spark):
    got = schedule.noise_blocks(spark.range(80), "id", [(4, 2), (8, 2)], 1, 2, world=2).collect()
    assert Counter((r.measurement, r["rank"], r.pair) for r in got) == {(k, w, p): (2 if k < 2 else 4) for k in range(3) for w in (0, 1) for p in (0, 1)} and len({r.id for r in got}) == len(got)
    trained = {r.id for r in schedule.batches(spark.range(80), "id", [(4, 2), (8, 2)], 1).where("step is not null").collect()}
    assert not trained & {r.id for r in got}
    with pytest.raises(ValueError):
        schedule.noise_blocks(spark.range(40), "id", [(4, 2), (8, 2)], 1, 2, world=2)


def test_split_lists_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(rng.choices(range(40), k=40))] + [(99, None), (98, "")]
    docs = frame(spark, texts, "doc_id long, text string")
    whole = sorted(map(tuple, neardup.near_duplicates(docs, similarity=0.75).collect()))
    monkeypatch.setattr(neardup, "HOT_TERM", 2)
    assert sorted(map(tuple, neardup.near_duplicates(docs, similarity=0.75).collect())) == whole
    assert sum(r[2] for r in whole) > 100
