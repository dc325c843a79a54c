"""Each operator on fixtures: brute force, exact round trips, held-out accuracy; empty tables, nulls, ties, clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime
from millrace.llm import budget, cutoffs, level, mixing, overlap, packing, sample, sketch
from millrace.operators import records
from millrace.runtime import table

FOLDER = "/root/testdata/sf0.01"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SCORES = "rank long, text_key long, source string, topic string, vigintile string, n_tokens long, n_pred long, mean_loss float, scored_at timestamp, loaded_at timestamp"
POOL = "row_id long, shard int, shard_offset int, rank long, text_hash long, topic string, source string, n_tokens_full int, added_at timestamp"
CATALOG = [(0, "data/web-Arts-0003/a.zst", 100), (1, "data/web-Arts-0004/a.zst", 100), (2, "data/wiki/a.zst", 100)]


def catalog(spark):
    return frame(spark, CATALOG, "shard int, file_path string, n_docs long")


def at(day):
    return datetime(2026, 3, 1) + timedelta(days=day)


# --- records


def test_latest_record_wins_whatever_the_order(spark):
    rows = [
        (1, 1, "wiki", "-", "", 5, 4, 2.0, at(2), at(9)), (1, 1, "wiki", "-", "", 7, 6, 3.0, at(3), at(4)), (1, 1, "wiki", "-", "", 7, 6, 3.0, at(3), at(4)),
        (2, 1, "WIKI ", None, None, None, 4, float("nan"), at(1), at(1)), (None, 1, "wiki", "-", "", 5, 4, 2.0, at(2), at(9)), (3, 1, "wiki", "-", "", 5, 4, 2.0, None, None), (3, 1, "wiki", "-", "", 6, 4, 2.5, at(0), None),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = records.labelled_records(frame(spark, rows, SCORES), catalog(spark), ["source", "topic", "n_tokens", "mean_loss", "n_pred"])
        got = {r.rank: (r.source, r.topic, r.n_tokens) for r in found.collect()}
        assert got == {1: ("wiki", "-", 7), 2: ("wiki", "-", None), 3: ("wiki", "-", 6)}
    usable = found.select("rank", records.usable_loss().alias("l"), records.usable_count().alias("c")).collect()
    assert {r.rank: (r.l, r.c) for r in usable} == {1: (3.0, 7), 2: (None, None), 3: (2.5, 6)}


# --- 1


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else f"s{i % 3}", round(rng.random() * 3, 1)) for i in range(3000)]
    targets = [("hot", 40), ("s0", 1), ("s1", 100), ("s2", 0), ("none", 50)]
    found = {r.source: r for r in cutoffs.cutoffs(frame(spark, rows, "rank long, source string, loss double"), frame(spark, targets, "source string, keep_pct int")).collect()}
    for source, pct in targets:
        values = sorted((v, i) for i, s, v in rows if s == source)
        target = -(-len(values) * pct // 100)
        if target == 0:
            assert source not in found
        else:
            assert (found[source].n, found[source].target, found[source].cutoff, found[source].last) == (len(values), target, *values[target - 1])
    kept = cutoffs.kept(frame(spark, rows, "rank long, source string, loss double"), cutoffs.cutoffs(frame(spark, rows, "rank long, source string, loss double"), frame(spark, targets, "source string, keep_pct int")))
    assert kept.where("source = 's1'").count() == sum(s == "s1" for _, s, _ in rows)
    assert cutoffs.cutoffs(frame(spark, [], "rank long, source string, loss double"), frame(spark, targets, "source string, keep_pct int")).count() == 0


# --- 2


def test_text_totals_equal_encoding_every_text(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "source", "lang", "text")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in budget.text_token_totals(docs, ["source", "lang"]).collect()}
    encode = budget.encoding(budget.VOCABULARY).encode_ordinary
    wanted = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        wanted[r.source, r.lang][0] += 1
        wanted[r.source, r.lang][1] += len(encode(r.text)) if r.text else 0
    assert got == {k: tuple(v) for k, v in wanted.items()}


def test_text_totals_of_odd_texts(spark):
    odd = ["", None, " ", "a" * 70_000, "don't stop now\x1c\x85 x", "漢字とかな 123456 ١٢٣", "🙂🙂 é", "  \n\n\t end  ", "ab  12'll"]
    docs = frame(spark, [(i, t) for i, t in enumerate(odd)], "i int, text string")
    got = {r.i: r.n_tokens for r in budget.text_token_totals(docs, ["i"]).collect()}
    encode = budget.encoding(budget.VOCABULARY).encode_ordinary
    wanted = {i: len(encode(t)) if t else 0 for i, t in enumerate(odd)}
    assert got == wanted
    assert {r.i: r.n_tokens for r in budget.token_counts(docs, ["i"]).collect()} == wanted
    assert budget.text_token_totals(docs.limit(0), ["i"]).count() == 0


@pytest.mark.parametrize(("label", "wanted"), [("en", "en"), (" EN ", "en"), ("eng", "en"), ("de-DE", "de"), ("spa", "es"), (None, "und"), ("", "und"), ("??", "und")])
def test_language(spark, label, wanted):
    assert frame(spark, [(label,)], "x string").select(budget.language(F.col("x")).alias("y")).first().y == wanted


def test_record_tokens_take_the_pool_where_missing(spark):
    scores = [(r, 1, "wiki", "-", "", n, 4, 2.0, at(1), at(1)) for r, n in ((1, 10), (2, None), (3, -1), (4, 2_000_000), (5, 0))]
    pool = [(1, 0, 1, r, 1, "wiki", "wiki", n, at(1)) for r, n in ((1, 99), (2, 20), (2, 30), (3, None), (4, -1), (4, 7))]
    got = budget.record_tokens(frame(spark, scores, SCORES), frame(spark, pool, POOL), catalog(spark))
    assert {r.rank: r.tokens for r in got.collect()} == {1: 10, 2: 30, 3: 0, 4: 7, 5: 0}
    assert budget.slice_totals(got.limit(0), ["source"]).count() == 0


# --- 3


def test_codes_keep_order_and_precision():
    rng = np.random.default_rng(0)
    values = np.concatenate((np.exp(rng.normal(0, 4, 5000)), -np.exp(rng.normal(0, 4, 5000)), [0.0, -0.0])).astype(np.float32)
    values = values[np.abs(values) < 2.0**39]
    codes = sketch.encode(np.sort(values))
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 1 << sketch.BITS
    big = np.sort(values[np.abs(values) > 2.0**-20])
    assert (np.abs(sketch.decode(sketch.encode(big)) - big) <= np.abs(big) * 2.0**-9.9).all()


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy"])
def test_percentiles_within_the_stated_error(kind):
    rng = np.random.default_rng(5)
    x = {"spread": rng.lognormal(1, 1, 20000), "ties": np.round(rng.normal(3, 0.5, 20000), 1).clip(0.1), "heavy": np.where(rng.random(20000) < 0.4, 2.75, rng.lognormal(1, 0.3, 20000))}[kind].astype(np.float32)
    parts = np.array_split(x, 7)
    vector = sum(sketch.build(sketch.encode(p), np.ones(len(p), np.int64)) for p in parts)
    assert (vector == sketch.build(sketch.encode(x), np.ones(len(x), np.int64))).all()
    ordered = np.sort(x)
    for q in (1, 10, 50, 90, 99):
        code, exact = sketch.quantile(vector, int(np.ceil(q / 100 * len(x))))
        value = sketch.decode(np.array([code]))[0]
        low, high = np.searchsorted(ordered, value * (1 - 2.0**-9), "left"), np.searchsorted(ordered, value * (1 + 2.0**-9), "right")
        error = min(sketch.rank_error(vector), exact)
        assert low - error <= np.ceil(q / 100 * len(x)) <= high + error
        assert error / len(x) < 0.2


def test_sketches_delete(spark):
    gone = np.random.default_rng(1).lognormal(1, 1, 500).astype(np.float32)
    stay = np.random.default_rng(2).lognormal(2, 1, 700).astype(np.float32)
    both = sketch.build(sketch.encode(np.append(gone, stay)), np.ones(1200, np.int64))
    assert (both + sketch.build(sketch.encode(gone), -np.ones(500, np.int64)) == sketch.build(sketch.encode(stay), np.ones(700, np.int64))).all()
    for size in (10, 700, 9000):  # kept as codes, and as counters
        x = sketch.encode(np.random.default_rng(size).lognormal(0, 3, size).astype(np.float32))
        ones, whole = np.ones(size, np.int64), sketch.build(x, np.ones(size, np.int64))
        halves = [sketch.Sums().add(x[k::2], ones[k::2]) for k in (0, 1)]
        for a, b in (halves, halves[::-1]):
            assert (sketch.Sums().merge(a.pack()).merge(b.pack()).vector() == whole).all()
    rows = [("a", 1, float(v), 1) for v in range(1, 101)] + [("a", 2, float(v), -1) for v in range(51, 101)] + [("a", 3, None, 1), ("a", 3, float("nan"), 1), (None, 1, 5.0, 1)]
    parts = sketch.sketches(frame(spark, rows, "g string, day int, value double, w long"), ["g"], "day", weight="w")
    got = {r.g: (r.n, r.value) for r in sketch.percentiles(sketch.merge(parts, ["g"]), ["g"], [50]).collect()}
    assert got["a"][0] == 50 and got["a"][1] == pytest.approx(25, rel=0.01) and got[None] == (1, pytest.approx(5, rel=0.01))
    empty = sketch.sketches(frame(spark, [], "g string, day int, value double, w long"), ["g"], "day")
    assert sketch.percentiles(sketch.merge(empty, ["g"]), ["g"], [50]).count() == 0


# --- 4


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(["Xa", "yb", "zc"])
    return " ".join(words)


def reappearing(a, b):
    """Share of the longer text's words in common runs: another measure than the operator's."""
    a, b = overlap.words(a), overlap.words(b)
    same = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size > 1)
    return same / max(len(a), len(b), 1)


@pytest.mark.parametrize("few", [True, False])
def test_overlap_equals_brute_force(spark, monkeypatch, few):
    """Also where matches are too many for a broadcast and half of the keys are hot."""
    if not few:
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(overlap, "spread_join", lambda rows, matches, on: runtime.spread_join(rows, matches, on, hot=3))
    rng = random.Random(7)
    vocabulary = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    own_key = lambda text: int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
    evals, docs, scores, pool = [], [], [], []
    rank = 0
    for i in range(40):
        base = draw(80)
        evals.append((1000 + i, " ".join(base)))
        variants = [" ".join(base), near(rng, base, 2), "<p>" + " ".join(base).upper() + "</p>", " ".join(base[: rng.choice([70, 66])]), " ".join(base[:30] + draw(50)), " ".join(draw(80))]
        for text in variants:
            docs.append((rank, rank, text))
            key = None if rank % 11 == 0 else 5 if i == 0 else rank + 10_000
            (scores if rank % 2 else pool).append((rank, key))
            rank += 1
    evals += [(1000, evals[0][1]), (1001, evals[1][1]), (2000, None), (2001, "  "), (2002, "!!!"), (2003, "ABC-1  x"), (None, "x y z")]
    docs += [(9000, None, docs[0][2]), (9001, 9001, None), (9002, 9002, " \n"), (9003, 9003, "!!!")]
    scores += [(9003, 1), (9002, 2), (9001, 3)] + [(5000 + i, 5) for i in range(200)] + [(5000, 5)]
    # training records whose text no document has: their key is the hash of an evaluation text
    keyed = [evals[3][1], evals[4][1], "ABC-1  x", "  ", "another text"]
    scores += [(6000 + i, own_key(t)) for i, t in enumerate(keyed)] + [(6100, own_key(evals[3][1]))]
    pool += [(6000, own_key(evals[3][1])), (None, own_key(evals[3][1])), (6200, own_key(evals[5][1]))]
    frames = (
        frame(spark, [(*r, "s") for r in scores], "rank long, text_key long, source string"), frame(spark, [(*r, "s") for r in pool], "rank long, text_hash long, source string"),
        frame(spark, [(*r, 1) for r in docs], "doc_id long, rank long, text string, terms int"), frame(spark, [(*r, 2) for r in evals], "rank long, text string, vec int"),
    )
    found = [tuple(r) for r in overlap.cross_split_pairs(*frames).collect()]
    got = set(found)
    assert len(found) == len(got)

    keys = {(r, k) for r, k in set(scores) | set(pool) if r is not None}
    of_rank, of_key = defaultdict(set), defaultdict(set)
    for r, k in keys:
        k = ("own", r) if k is None else k
        of_rank[r].add(k)
        of_key[k].add(r)
    wanted = set()
    for e, t in evals:
        if e is None or not (t or "").strip():
            continue
        wanted |= {(x, e) for x in of_key[own_key(t)]}
        for _, r, u in docs:
            if r is not None and (u or "").strip() and (t == u or reappearing(t, u) >= 0.7):
                wanted |= {(x, e) for k in of_rank[r] for x in of_key[k]}
    assert got == wanted and len(wanted) > 200 and {(6000, 1003), (6100, 1003), (6002, 2003), (6200, 1005)} <= got


def test_variants_of_one_text_are_all_found(spark):
    """A third of the evaluation texts share most of one text, so their common terms are frequent."""
    rng = random.Random(11)
    vocabulary = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = draw(80)

    def variant():
        at, n = rng.randrange(70), rng.randrange(4, 14)
        return " ".join(base[:at] + draw(n) + base[at + n :])

    left = [(i, variant() if i % 3 == 0 else " ".join(draw(80))) for i in range(90)]
    right = [(i, variant() if i % 3 == 0 else left[i][1] if i % 3 == 1 else " ".join(draw(60))) for i in range(60)]
    pairs, a, b = overlap.cosine_join(*[frame(spark, rows, "id long, text string") for rows in (left, right)])
    got = {(r.l, r.r) for r in pairs.join(a.toDF("l", "left_vec"), "left_vec").join(b.toDF("r", "right_vec"), "right_vec").collect()}
    terms = overlap.Terms()
    found = lambda rows: [(i, set(terms.of(t).tolist())) for i, t in rows]
    wanted = {(i, j) for i, x in found(left) for j, y in found(right) if len(x & y) >= overlap.LIMITS[0] * max(len(x), len(y))}
    assert got == wanted and len(wanted) > 500
    shares = pairs.agg(F.min("share"), F.max("share"), F.max("cosine")).first()
    assert shares[0] >= overlap.LIMITS[0] and shares[1] <= 1 and shares[2] <= 1 + 1e-9


def test_short_and_changed_texts_are_found(spark):
    """Pairs that share half of their three-word shingles, but few of five words; longer texts with every eighth word changed."""
    rng = random.Random(5)
    left, right, wanted = [], [], set()
    for i, (n, changed) in enumerate([(23, [5, 11, 17]), (10, [5]), (60, list(range(5, 60, 6))), (3, []), (2, []), (60, list(range(4, 60, 5))), (90, list(range(7, 90, 12))), (90, list(range(2, 90, 4)))]):
        words = [f"w{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
        left.append((i, " ".join(words)))
        right.append((i, " ".join(f"x{w}" if k in changed else w for k, w in enumerate(words))))
        size, limit = (3, overlap.LIMITS[1]) if n <= overlap.SHORT else (5, overlap.LIMITS[0])
        kept = sum(not set(changed) & set(range(k, k + size)) for k in range(max(1, n - size + 1)))
        wanted |= {i} if kept >= limit * max(1, n - size + 1) else set()
    rng.shuffle(right)
    evals, docs = (frame(spark, rows, "rank long, text string") for rows in (left, right))
    keys = [(i, i) for i in range(len(right))]
    got = overlap.cross_split_pairs(frame(spark, keys, "rank long, text_key long"), frame(spark, [], "rank long, text_hash long"), docs, evals).collect()
    assert {tuple(r) for r in got} == {(i, i) for i in wanted} and wanted == {0, 1, 2, 3, 4, 6}


@pytest.mark.parametrize("size", [1, 30_000])
def test_bit_maps_have_every_term(spark, size):
    terms = np.random.default_rng(size).integers(-(2**63), 2**63 - 1, size)
    rows = [(int(t), 1 + 300 * (i % 2)) for i, t in enumerate(terms)]
    known, *often = overlap.bitmaps(frame(spark, rows, "term long, df long"), size)
    assert overlap._probe(known, terms).all() and (overlap._level(often, terms)[1::2] == len(overlap.OFTEN)).all()
    other = np.random.default_rng(99).integers(-(2**63), 2**63 - 1, 30_000)
    assert overlap._probe(known, other).mean() < 0.1


def test_overlap_of_empty_tables(spark):
    empty = [frame(spark, [], s) for s in ("rank long, text_key long", "rank long, text_hash long", "doc_id long, rank long, text string", "rank long, text string")]
    assert overlap.cross_split_pairs(*empty).count() == 0


def test_normalised_words():
    assert overlap.words("The ﬁne poly-\nontology, <b>ins0far</b> as THIS") == ["the", "fine", "polyontology", "insofar", "as", "this"]


# --- 5


def test_permutation_is_a_bijection_of_the_domain():
    """The network in plain numbers inverts, so no two identifiers share a place."""
    keys = sample.round_keys()

    def forward(x):
        left, right = x >> 31, x & sample.MASK
        for key, factor in keys:
            left, right = right, left ^ ((((right ^ key) * factor) >> 17) & sample.MASK)
        return left << 31 | right

    def backward(y):
        left, right = y >> 31, y & sample.MASK
        for key, factor in reversed(keys):
            left, right = right ^ ((((left ^ key) * factor) >> 17) & sample.MASK), left
        return left << 31 | right

    rng = random.Random(0)
    for x in [0, 1, 2, (1 << 62) - 1, *[rng.randrange(1 << 62) for _ in range(2000)]]:
        assert backward(forward(x)) == x and 0 <= forward(x) < 1 << 62


def test_sample_is_uniform_stable_and_nested(spark):
    ids = spark.range(100_000)
    places = np.array([r.p for r in ids.select(sample.permuted(F.col("id")).alias("p")).collect()], dtype=float) / 2.0**62
    counts = np.histogram(places, bins=50, range=(0, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() < 100  # chi-square of 49 degrees of freedom
    pick = lambda df, rate: {r.id for r in df.where(sample.in_sample(F.col("id"), rate)).collect()}
    small, large = pick(ids, 0.01), pick(ids, 0.05)
    assert small < large and pick(ids.repartition(17), 0.01) == small and pick(spark.range(50_000), 0.01) == {i for i in small if i < 50_000}
    odd = frame(spark, [(None,), (-1,), (1 << 62,)], "id long")
    assert pick(odd, 1.0) == set() and len(pick(ids, 1.0)) == 100_000 and pick(ids, 0.0) == set()


def test_later_batches_remove_nothing(spark):
    pool = table(spark, FOLDER, "pool")
    files = table(spark, FOLDER, "doc_counts")
    days = sorted(r[0] for r in pool.select(F.to_date("added_at")).distinct().collect())
    sampled = lambda rows: {tuple(r) for r in sample.stable_sample(sample.with_row_id(rows, files).select("row_id", "rank", "added_at"), 0.2).select("row_id", "rank").collect()}
    early, all_ = sampled(pool.where(F.to_date("added_at") <= days[len(days) // 2])), sampled(pool)
    assert early < all_ and len({i for i, _ in all_}) == len(all_)


def test_row_ids_are_recovered(spark):
    rows = [(None, 1, 5, 1, 1, "t", "s", 1, at(1)), (7, 0, 7, 2, 1, "t", "s", 1, at(1)), (None, 99, 5, 3, 1, "t", "s", 1, at(1)), (None, None, None, 4, 1, "t", "s", 1, at(1))]
    got = {r.rank: r.row_id for r in sample.with_row_id(frame(spark, rows, POOL), catalog(spark)).collect()}
    assert got == {1: 105, 2: 7, 3: None, 4: None}


# --- 6


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_exact_and_tight(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(v) for v in {0: rng.integers(1, 400, 3000), 1: np.append(rng.geometric(0.004, 2000), [2048, 2049, 5000, 0]), 2: np.full(700, 1500), 3: rng.integers(1, 3000, 40)}[seed]]
    rows = [(i % 50 if seed == 3 else i, s, "x") for i, s in enumerate(sizes)] + [(9999, None, "x")]
    got = packing.pack(frame(spark, rows, "doc_id long, n_tokens long, container string")).collect()
    assert Counter((r.doc_id, r.tokens, r.n_parts) for r in got if r.n_parts == 1) == Counter((i, s, 1) for i, s, _ in rows if s and s <= 2048)
    assert sum(r.tokens for r in got) == sum(sizes)
    assert all(r.tokens == 2048 or r.part == r.n_parts - 1 for r in got)
    fill = Counter()
    for r in got:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= {0: 1.02, 1: 1.03, 2: 1.4, 3: 1.35}[seed] * sum(sizes) / 2048 + 2


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, [], "doc_id long, n_tokens long")).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    matrix = rng.random((20, 12))
    wanted = matrix @ np.maximum(rng.normal(size=12), 0)
    x, settled = packing.nnls(matrix, wanted)
    assert settled and not packing.nnls(matrix, wanted, rounds=0)[1]
    assert x.min() >= 0 and np.abs(matrix @ x - wanted).max() < 1e-6
    assert packing.combinations(4, np.array([0, 1, 1, 1, 1])) == [(4,), (1, 3), (1, 1, 2), (2, 2)]


# --- 7


def test_weights():
    s = np.array([0.7, 0.2, 0.1])
    for wanted in (0.4, 0.8, 1.0):
        assert mixing.entropy(mixing.tempered(s, mixing.entropy_exponent(s, wanted))) == pytest.approx(wanted, abs=1e-6)
    tokens, targets, repeats = np.array([700.0, 200, 100]), np.array([0.3, 0.3, 0.4]), np.array([1.0, 5, 2])
    weights, _ = mixing.target_weights(tokens, targets, repeats, 1000)
    assert weights.sum() == pytest.approx(1) and (weights <= repeats * tokens / 1000 + 1e-9).all() and weights[2] == pytest.approx(0.2)
    free, exponent = mixing.target_weights(tokens, np.array([0.5, 0.3, 0.2]), np.array([9.0, 9, 9]), 1000)
    assert free == pytest.approx([0.5, 0.3, 0.2]) and exponent == 1.0


def test_mix_meets_the_shares(spark):
    rng = random.Random(1)
    rows = [(i, f"s{i % 3}", rng.randint(5, 20)) for i in range(3000)]
    texts = frame(spark, [(s, i, n) for i, s, n in rows], "source string, doc_id long, n_tokens long")
    plan = mixing.shares(texts, frame(spark, [("s0", 50, 2), ("s1", 30, 1), ("s2", 20, 3), ("s9", 0, 1)], "source string, mix_pct int, max_repeats int"))
    got = mixing.mix(texts, plan).collect()
    used, total = Counter(), sum(r.n_tokens * r.copies for r in got)
    for r in got:
        used[r.source] += r.n_tokens * r.copies
    assert {s: used[s] / total for s in ("s0", "s1", "s2")} == pytest.approx({"s0": 0.5, "s1": 0.3, "s2": 0.2}, abs=0.002)
    assert max(r.copies for r in got if r.source == "s0") <= 2 and all(p["reachable"] for p in plan if p["source"] != "s9")
    assert {r.doc_id for r in got} == {r.doc_id for r in mixing.mix(texts.repartition(5), plan).collect()}


def test_every_block_is_a_permutation_of_its_own(spark):
    texts = frame(spark, [("a", i, 10) for i in range(100)] + [("b", 1000 + i, 10) for i in range(300)], "source string, doc_id long, n_tokens long")
    plan = mixing.shares(texts, frame(spark, [("a", 65, 3), ("b", 35, 1)], "source string, mix_pct int, max_repeats int"))
    mixed = mixing.mix(texts, plan)
    got = mixing.placed_blocks(mixed).collect()
    orders = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.place, r.doc_id)):
        orders[r.source, r.block].append(r.doc_id)
    assert sorted((k, len(v)) for k, v in orders.items()) == [(("a", 0), 100), (("a", 1), 100), (("a", 2), 60), (("b", 0), 140)]
    assert set(orders["a", 0]) == set(orders["a", 1]) == set(range(100)) and orders["a", 0] != orders["a", 1]
    # the partial block is the prefix of the permutation that its number gives
    places = {r.doc_id: r.place for r in texts.where("source = 'a'").select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED), F.lit(2)).alias("place")).collect()}
    assert orders["a", 2] == sorted(places, key=lambda d: (places[d], d))[:60]


def test_distinct_texts(spark):
    rows = [(1, "same", " WIKI"), (2, "same", "wiki"), (3, "same", "web-arts-0003"), (4, None, "wiki"), (5, " \n ", "wiki"), (6, "other", None)]
    docs = frame(spark, [(*r, "-", 1) for r in rows], "doc_id long, text string, source string, topic string, hash int")
    got = sorted((r.source, r.doc_id) for r in mixing.distinct_texts(docs, catalog(spark)).collect())
    assert got == [("-", 6), ("web", 3), ("wiki", 1)]
    empty = mixing.distinct_texts(docs.limit(0), catalog(spark))
    plan = mixing.shares(empty, frame(spark, [("wiki", 50, 2)], "source string, mix_pct int, max_repeats int"))
    assert mixing.mix(empty, plan).count() == 0


# --- 8


def test_levels_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs = level.running_text(table(spark, folder, "documents"), table(spark, folder, "doc_counts"))
    labels = table(spark, folder, "level_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = level.fit(level.graded_texts(docs, labels.where(~held)))
    found = level.graded(docs, model, ["doc_id"]).join(labels.where(held), "doc_id").collect()
    assert len(found) > 150
    assert np.mean([r.level == r.reading_level for r in found]) > 0.85  # raters err, too
    assert np.mean([abs(r.score - r.reading_level) for r in found]) < 0.3


def test_levels_of_odd_input(spark):
    docs = frame(spark, [(1, None, "en", "wiki", "-"), (2, "", "en", "wiki", "-"), (3, "zzz qqq", None, "wiki", "-"), (4, "int x", "en", "stack_edu", "C"), (5, "the cat " * 30_000, "de", None, None)], "doc_id long, text string, lang string, source string, topic string")
    running = level.running_text(docs, catalog(spark))
    assert sorted(r.doc_id for r in running.collect()) == [3, 5]
    labels = frame(spark, [(3, 1, "r"), (3, None, "r"), (5, 9, "r"), (77, 2, "r")], "doc_id long, reading_level int, rater string")
    texts = level.graded_texts(running, labels)
    assert [(t[0], t[1]) for t in texts] == [("und", [1.0, 0.0, 0.0, 0.0])]
    assert {r.doc_id: (r.language, r.level) for r in level.graded(running, level.fit(texts), ["doc_id"]).collect()} == {3: ("und", None), 5: ("de", None)}  # nothing is known of any language
    assert level.graded(running.limit(0), level.fit([]), ["doc_id"]).count() == 0


def test_languages_are_learned_from_labels_of_which_some_are_wrong():
    rng = random.Random(2)
    own = {"en": "the of and a with", "de": "der und mit ein nicht", "fr": "le la et un avec"}
    topics = [f"topic{i}" for i in range(40)]
    texts = []
    for i in range(600):
        name = rng.choice(["en", "en", "de", "fr"])
        counts = Counter(rng.choices(own[name].split(), k=8) + rng.choices(topics, k=12))
        texts.append((name, rng.choice(["en", "de", "xx", None]) if i % 10 == 0 else name, counts))
    model = level.fit_languages([(written, counts) for _, written, counts in texts])
    assert {"en", "de", "fr"} <= set(model.names)
    assert all(model.of(counts, written) == name for name, written, counts in texts)
    assert model.of(Counter(["nothing"]), "it") == "it" and model.of(Counter(), None) == "und"
    assert level.fit_languages([("en", Counter("ab"))] * 3).of(Counter("a"), None) == "und" and level.fit_languages([]).of(Counter("a"), "en") == "en"


def test_schema_of_strings_is_kept(spark):
    docs = table(spark, FOLDER, "documents")
    assert budget.token_counts(docs, ["doc_id", "rank"]).schema["n_tokens"].dataType == T.LongType()
