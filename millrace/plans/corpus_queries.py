"""Queries over the corpus tables: splits, dedup, selection, statistics, text quality, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, labels
from ..functions.hashing import blake2_key, hash_sample, sql_hash64
from ..operators import dedup, neardup, prefix, quality, records, select, stats, tokens
from ..runtime import table
from ..sources import corpus
from . import sql

SEED = 20_261_015
Q: dict = {}
SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- shared inputs, and the same as SQL


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and evaluation documents with a rank and a text: rank, key (64 bits of the text's hash), chars."""
    docs, evals = table(spark, folder, "documents"), table(spark, folder, "eval_docs")
    both = docs.select("rank", "text").unionByName(evals.select("rank", "text")).where("rank is not null and text is not null")
    return both.select("rank", blake2_key("text").alias("key"), F.length("text").cast("long").alias("chars"))


TEXTS = """texts as (select rank, md5(text) as key, length(text)::bigint as chars from (select rank, text from documents union all select rank, text from eval_docs)
 where rank is not null and text is not null)"""


def clean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The pool's records with a positive count and a z: row_id, topic (``-`` where it is empty or null), n_tokens_full, z, mean_loss."""
    rows = records.pool_records(table(spark, folder, "pool"), table(spark, folder, "doc_counts"), ["topic", "n_tokens_full", "z", "mean_loss"]).where("n_tokens_full > 0 and z is not null")
    return rows.select("row_id", F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("-")).alias("topic"), F.col("n_tokens_full").cast("long").alias("n_tokens_full"), F.col("z").cast("double").alias("z"), F.col("mean_loss").cast("double").alias("mean_loss"))


POOL = f"""{sql.KNOWN}, firsts as (select * from known where row_id is not null qualify row_number() over (partition by row_id order by added_at nulls last, topic nulls last, n_tokens_full nulls last, z nulls last, mean_loss nulls last) = 1),
clean as (select row_id, coalesce(nullif(trim(topic), ''), '-') as topic, n_tokens_full::bigint as n_tokens_full, z::double as z, mean_loss::double as mean_loss from firsts where n_tokens_full > 0 and z is not null)"""


def clean_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The records of ``scores`` with a usable loss and a usable count: rank, topic (canonical), n_tokens, mean_loss."""
    return records.usable_scores(table(spark, folder, "scores"), table(spark, folder, "doc_counts")).drop("source")


SCORES = f"""{sql.CATALOG}, {sql.RECORDS},
clean_scores as (select rank, topic, count as n_tokens, loss::double as mean_loss from records where loss is not null and count is not null)"""

EVAL_FROM = "(select rank_hi from splits where split_name = 'train')"


def eval_from(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "splits").where("split_name = 'train'").first().rank_hi


def signed_hash(view: str, seed: int, value: str) -> str:
    return f"(select * exclude (h), (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as h from {sql_hash64(seed, view, value)})"


# --- splits, labels, hashing


@query(f"with {TEXTS} select split_name, count(*) as n, min(rank) as least, max(rank) as most from texts left join splits on rank >= rank_lo and rank < rank_hi group by split_name")
def split_ranges(spark, folder):
    ranges = {x.split_name: (x.rank_lo, x.rank_hi) for x in table(spark, folder, "splits").collect()}  # three rows
    named = texts(spark, folder).withColumn("split_name", select.split_of(F.col("rank"), ranges))
    return named.groupBy("split_name").agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"))


@query(f"select row_id, rank from {sql_hash64(SEED, '(select distinct row_id, rank from pool where row_id is not null)', 'row_id')} where h < {int(0.1273 * 2.0**64)}::uhugeint")
def hash_sampled(spark, folder):
    rows = table(spark, folder, "pool").where("row_id is not null").select("row_id", "rank")
    return rows.where(hash_sample(SEED, F.col("row_id"), 0.1273)).distinct()


@query("""with d as (select regexp_extract(file_path, '([^/]+)/[^/]+$', 1) as d, n_docs from doc_counts),
p as (select n_docs, case when regexp_matches(d, '-[0-9]+$') then split_part(d, '-', 1) when regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1) <> '' then regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1) else d end as source,
 case when regexp_matches(d, '-[0-9]+$') then regexp_replace(regexp_replace(d, '-[0-9]+$', ''), '^[^-]*-', '') when regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1) <> '' then regexp_replace(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', '') else '-' end as topic,
 case when regexp_matches(d, '-[0-9]+$') then right(regexp_extract(d, '-([0-9]+)$', 1), 2) else '' end as vigintile from d)
select source, topic, vigintile, case source when 'common_crawl' then 'cc:' || topic when 'olmocr_science_pdfs' then 'pdf:' || topic when 'stack_edu' then 'code:' || topic else source end as "group", count(*) as files, sum(n_docs)::bigint as docs from p group by all""")  # fmt: skip
def directory_cells(spark, folder):
    parsed = table(spark, folder, "doc_counts").select(labels.parse_dir(labels.directory(F.col("file_path"))).alias("d"), "n_docs")
    cells = parsed.groupBy("d.source", "d.topic", "d.vigintile").agg(F.count("*").alias("files"), F.sum("n_docs").alias("docs"))
    return cells.withColumn("group", labels.group_name(F.col("source"), F.col("topic")))


@query("""with c as (select shard as s, (sum(n_docs) over (order by shard))::bigint as hi, n_docs from doc_counts)
select row_id, s as shard, row_id - (hi - n_docs) as shard_offset from (select distinct row_id from pool where row_id is not null) left join c on row_id >= hi - n_docs and row_id < hi""")
def located_rows(spark, folder):
    return corpus.locate(table(spark, folder, "pool").where("row_id is not null").select("row_id").distinct(), table(spark, folder, "doc_counts"))


@query("select event_type, sum(regexp_extract_all(props, '\"k\": *(-?[0-9]+)', 1)[-1]::bigint)::bigint as k, count(*) as n from events group by event_type")
def regex_json_field(spark, folder):
    field = exprs.last_match(F.col("props"), r'"k": *(-?[0-9]+)').cast("long")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(field).alias("k"), F.count("*").alias("n"))


@query("select source as dir, file_path from (select *, split_part(regexp_extract(file_path, '([^/]+)/[^/]+$', 1), '-', 1) as source, row_number() over (partition by split_part(regexp_extract(file_path, '([^/]+)/[^/]+$', 1), '-', 1) order by file_path) as rn from doc_counts) where (rn - 1) % 10 = 0")
def sampled_files(spark, folder):
    catalog = table(spark, folder, "doc_counts").withColumn("dir", F.regexp_extract(labels.directory(F.col("file_path")), "^[^-]*", 0))
    return stats.every_nth_file(catalog, "dir", "file_path", 10).select("dir", "file_path")


@query("""with f as (select *, split_part(regexp_extract(file_path, '([^/]+)/[^/]+$', 1), '-', 1) as dir from doc_counts), s as (select *, row_number() over (partition by dir order by file_path) as rn from f)
select dir, sum(n_docs) filter ((rn - 1) % 10 = 0)::bigint as sampled_docs, sum(n_docs)::bigint as all_docs, round(sum(n_docs) / sum(n_docs) filter ((rn - 1) % 10 = 0), 6) as weight from s group by dir""")
def shard_sample_scaled(spark, folder):
    catalog = table(spark, folder, "doc_counts").withColumn("dir", F.regexp_extract(labels.directory(F.col("file_path")), "^[^-]*", 0))
    scaled = stats.scaled_totals(stats.every_nth_file(catalog, "dir", "file_path", 10), catalog, "dir", "n_docs", "n_docs")
    return scaled.select("dir", "sampled_docs", "all_docs", r("weight").alias("weight"))


# --- dedup and decontamination

_KEPT = f"""with {TEXTS}, kept as (select key, min(rank) as rank, arg_min(chars, rank) as chars from texts group by key having max(rank) < {EVAL_FROM})"""


@query(f"{_KEPT} select rank, chars from kept")
def exact_dedup(spark, folder):
    return dedup.deduplicated(texts(spark, folder), "key", "rank", eval_from(spark, folder)).select("rank", "chars")


@query(f"{_KEPT} select coalesce(lang, '-') as lang, count(*) as n, sum(chars)::bigint as chars from kept join documents using (rank) group by 1")
def dedup_by_language(spark, folder):
    """Flagship: exact dedup and decontamination, then sizes by language."""
    kept = dedup.deduplicated(texts(spark, folder), "key", "rank", eval_from(spark, folder))
    named = kept.join(table(spark, folder, "documents").select("rank", F.coalesce("lang", F.lit("-")).alias("lang")), "rank")
    return named.groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("select doc_id from documents where text is null or text not in (select text from eval_docs where text is not null)")
def decontam_anti(spark, folder):
    docs, evals = table(spark, folder, "documents").select("doc_id", blake2_key("text").alias("key")), table(spark, folder, "eval_docs").select(blake2_key("text").alias("key"))
    return dedup.without_keys(docs, evals, "key").select("doc_id")


@query("select doc_id from documents where text in (select text from eval_docs where text is not null)")
def decontam_semi(spark, folder):
    docs, evals = table(spark, folder, "documents").select("doc_id", blake2_key("text").alias("key")), table(spark, folder, "eval_docs").select(blake2_key("text").alias("key"))
    return dedup.with_keys(docs, evals, "key").select("doc_id")


@query("""with e as (select distinct text from eval_docs where text is not null)
select count(*)::bigint as train_docs_hit, coalesce(sum(length(text)), 0)::bigint as train_size_hit, count(distinct text) as held_out_hit, (select count(*) from e) as held_out_keys from documents where text in (select text from e)""")
def val_overlap(spark, folder):
    key = [blake2_key("text").alias("key"), F.length("text").cast("long").alias("size")]
    return dedup.overlap_counts(table(spark, folder, "documents").select(*key), table(spark, folder, "eval_docs").select(*key), "key", "size")


_REPEATS = "k as (select text_hash, count(*) as n, sum(n_tokens_full)::bigint as s, arg_min(n_tokens_full, (added_at, shard, shard_offset)) as f from pool where n_tokens_full > 0 group by text_hash)"


@query(f"""with {_REPEATS}, b as (select case when n = 1 then '1-1' when n = 2 then '2-2' when n <= 4 then '3-4' when n <= 16 then '5-16' when n <= 100 then '17-100' when n <= 1000 then '101-1000' else '1001-inf' end as copies, * from k)
select copies, sum(n)::bigint as docs, sum(s)::bigint as size, round(100 * sum(s) / sum(sum(s)) over (), 4) as size_pct from b group by copies""")
def repetition_histogram(spark, folder):
    return dedup.copy_histogram(table(spark, folder, "pool").where("n_tokens_full > 0").select("text_hash", "n_tokens_full"), "text_hash", "n_tokens_full")


@query("""with k as (select text_key, count(*) as n, sum(1) as s from scores group by text_key)
select sum(n)::bigint as docs, count(*) as texts, sum(n - 1)::bigint as repeated_docs, sum(s - 1)::bigint as repeated_size, round(sum(n * s) / sum(s), 6) as mean_copies, max(n) as max_copies from k""")
def repetition_summary(spark, folder):
    rows = table(spark, folder, "scores").select("text_key", "rank", F.lit(1).cast("long").alias("one"))
    return dedup.repetition_summary(rows, "text_key", "one", "rank")


@query("select text_hash, count(*) as copies, sum(n_tokens_full)::bigint as size from pool where n_tokens_full > 0 group by text_hash order by size desc, text_hash limit 15")
def top_repeats(spark, folder):
    return dedup.top_repeats(table(spark, folder, "pool").where("n_tokens_full > 0"), "text_hash", "n_tokens_full")


@query("select text_key, min(rank) as rank from scores where text_key is not null group by text_key")
def first_per_key(spark, folder):
    return dedup.first_per_key(table(spark, folder, "scores").select("text_key", "rank").where("text_key is not null"), "text_key", "rank")


_WITH_HASH = signed_hash("kept", 43, "rank")


@query(f"""{_KEPT}, o as (select *, row_number() over (order by h, rank) as n from {_WITH_HASH}), picked as (select * from o where n <= floor(0.25 * (select count(*) from kept))),
k as (select key, count(*) as n, count(*) filter (rank < {EVAL_FROM}) as nt, sum(chars) filter (rank < {EVAL_FROM}) as tc, arg_min(chars, rank) as fc, max(rank) >= {EVAL_FROM} as ev from texts group by key)
select sum(n)::bigint as docs, count(*) as unique_texts, sum(nt)::bigint as train_docs, count(*) filter (not ev) as train_docs_kept, coalesce(sum(nt) filter (ev), 0)::bigint as train_docs_in_eval,
 (select count(*) from picked) as train_docs_selected, (select sum(chars) from picked)::bigint as train_chars_selected, sum(tc)::bigint as train_chars, sum(fc) filter (not ev)::bigint as train_chars_kept,
 floor(sum(fc) filter (not ev) / 4.5)::bigint as est_unique_train_tokens, 4.5 as chars_per_token, max(n) as max_copies from k""")  # fmt: skip
def dedup_stats(spark, folder):
    rows, start = texts(spark, folder), eval_from(spark, folder)
    kept = dedup.deduplicated(rows, "key", "rank", start).select("rank", "chars")
    selected = dedup.uniform_selection(kept, 43, "rank", F.col("chars"), fraction=0.25)
    return dedup.dedup_stats(rows, "key", "rank", "chars", start, selected, 4.5)


@query(f"{_KEPT}, o as (select *, sum(chars) over (order by h, rank) as cum from {_WITH_HASH}) select rank, chars from o where cum - chars < 1000000")
def uniform_unique_budget(spark, folder):
    rows = dedup.deduplicated(texts(spark, folder), "key", "rank", eval_from(spark, folder)).select("rank", "chars")
    return dedup.uniform_selection(rows, 43, "rank", F.col("chars"), target=1_000_000)


@query(f"{_KEPT}, o as (select *, row_number() over (order by h, rank) as n from {_WITH_HASH}) select rank, chars from o where n <= floor(0.25 * (select count(*) from kept))")
def uniform_unique_fraction(spark, folder):
    rows = dedup.deduplicated(texts(spark, folder), "key", "rank", eval_from(spark, folder)).select("rank", "chars")
    return dedup.uniform_selection(rows, 43, "rank", F.col("chars"), fraction=0.25)


# --- scores and selection


@query("""with u as (select text_key, max(case when isfinite(mean_loss) then mean_loss end)::double as loss from scores where n_pred > 0 group by text_key), p as (select rank, text_hash, topic from pool)
select topic, count(*) as rows, count(loss) as scored, round(avg(loss), 6) as mean_loss from p left join u on text_hash = text_key group by topic""")
def pool_with_scores(spark, folder):
    """Each text's score joined to all pool rows of the text: scored once, used by all copies."""
    loss = F.col("mean_loss").cast("double")
    unique = table(spark, folder, "scores").where("n_pred > 0").groupBy(F.col("text_key").alias("text_hash")).agg(F.max(F.when(~F.isnan(loss) & (F.abs(loss) < float("inf")), loss)).alias("loss"))
    rows = table(spark, folder, "pool").select("rank", "text_hash", "topic")
    return rows.join(unique, "text_hash", "left").groupBy("topic").agg(F.count("*").alias("rows"), F.count("loss").alias("scored"), r(F.avg("loss")).alias("mean_loss"))


@query("""with t as (select *, n_scored >= 32 and mean_loss is not null and not isnan(mean_loss) as ok from pool), g as (select topic, avg(mean_loss::double) as mu, stddev_samp(mean_loss::double) as sd from t where ok group by topic)
select row_id, rank, round(case when ok and sd > 0 then greatest(least((mean_loss::double - mu) / sd, 3.0), -3.0) else 0.0 end, 4) as z from t left join g on t.topic is not distinct from g.topic""")
def zscore_topic(spark, folder):
    scored = select.z_scores(table(spark, folder, "pool").drop("z"), "topic", "mean_loss", F.coalesce(F.col("n_scored") >= 32, F.lit(False)))
    return scored.select("row_id", "rank", r("z", 4).alias("z"))


_DRAW = f"""with {POOL}, keyed as (select *, -(ln(((case when h < 0 then h::hugeint + 18446744073709551616::hugeint else h::hugeint end >> 11)::double + 0.5) * {2.0**-53!r}) / exp(0.5 * z)) as key from {signed_hash('clean', 0, 'row_id')}),
drawn as (select *, sum(n_tokens_full) over (order by key, row_id rows unbounded preceding) as cum from keyed)"""
BUDGET = 1_500_000


@query(f"{_DRAW} select row_id, n_tokens_full from drawn where cum <= {BUDGET}")
def weighted_draw(spark, folder):
    return select.weighted_draw(clean_pool(spark, folder), 0.5, BUDGET, 0).select("row_id", "n_tokens_full")


@query(f"""{_DRAW}, b as (select *, cum <= {BUDGET} as chosen, case when z < -2.5 then '[-inf, -2.5)' when z < -2 then '[-2.5, -2.0)' when z < -1.5 then '[-2.0, -1.5)' when z < -1 then '[-1.5, -1.0)' when z < -0.5 then '[-1.0, -0.5)' when z < -1e-9 then '[-0.5, +0.0)'
 when z < 1e-9 then 'z = 0' when z < 0.5 then '[+0.0, +0.5)' when z < 1 then '[+0.5, +1.0)' when z < 1.5 then '[+1.0, +1.5)' when z < 2 then '[+1.5, +2.0)' when z < 2.5 then '[+2.0, +2.5)' else '[+2.5, +inf)' end as bin from drawn)
select bin, count(*) as rows, round(avg(chosen::int), 6) as share_rows, round(coalesce(sum(n_tokens_full) filter (chosen), 0) / sum(n_tokens_full), 6) as share_size, avg(chosen::int) > 0.9 as saturating from b group by bin""")  # fmt: skip
def selection_by_bin(spark, folder):
    rows = clean_pool(spark, folder)
    drawn = select.weighted_draw(rows, 0.5, BUDGET, 0).select("row_id", F.lit(True).alias("chosen"))
    marked = rows.join(drawn, "row_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return select.selected_by_bin(marked, F.col("chosen"), "n_tokens_full")


@query(f"""{_DRAW}, p as (select topic, sum(n_tokens_full) / (select sum(n_tokens_full) from clean) as ps from clean group by topic), s as (select topic, sum(n_tokens_full) / (select sum(n_tokens_full) from drawn where cum <= {BUDGET}) as ss from drawn where cum <= {BUDGET} group by topic)
select topic, round(ps, 6) as pool_share, round(coalesce(ss, 0), 6) as chosen_share, round(coalesce(ss, 0) - ps, 6) as difference from p left join s using (topic)""")
def share_difference(spark, folder):
    rows = clean_pool(spark, folder)
    diff = select.share_difference(rows, select.weighted_draw(rows, 0.5, BUDGET, 0), "topic", "n_tokens_full")
    return diff.select("topic", *[r(c).alias(c) for c in ("pool_share", "chosen_share", "difference")])


@query(f"""with {POOL}, keyed as (select *, -ln(((case when h < 0 then h::hugeint + 18446744073709551616::hugeint else h::hugeint end >> 11)::double + 0.5) * {2.0**-53!r}) as key from {signed_hash('clean', 5, 'row_id')}),
drawn as (select *, sum(n_tokens_full) over (order by key, row_id rows unbounded preceding) as cum from keyed) select row_id from drawn where cum <= {2 * BUDGET}""")
def subpool(spark, folder):
    return select.subpool(clean_pool(spark, folder), 2 * BUDGET, 5).select("row_id")


@query(f"with {POOL} select row_id, (row_number() over (order by h, row_id) - 1)::bigint as rank from {signed_hash('clean', 42, 'row_id')}")
def seeded_order(spark, folder):
    return select.seeded_order(clean_pool(spark, folder).select("row_id"), 42, "row_id")


def _band_sql(group: str) -> str:
    return f"""with {SCORES}, g as (select *, {group} as "group" from clean_scores), c as (select "group", quantile_cont(mean_loss, 0.05) as low_cut, quantile_cont(mean_loss, 0.9) as high_cut from g group by 1),
 j as (select *, mean_loss between low_cut and high_cut as kept from g join c using ("group"))
 select "group", count(*) as docs, sum(n_tokens)::bigint as tokens, round(any_value(low_cut), 6) as low_cut, round(any_value(high_cut), 6) as high_cut, round(avg(kept::int), 6) as docs_kept, round(sum(n_tokens) filter (kept) / sum(n_tokens), 6) as tokens_kept from j group by 1"""


def _bands(spark, folder, group):
    cuts = select.band_cuts(clean_scores(spark, folder), group, "mean_loss", "n_tokens", 5, 10)
    return cuts.select("group", "docs", "tokens", *[r(c).alias(c) for c in ("low_cut", "high_cut", "docs_kept", "tokens_kept")])


@query(_band_sql("topic"))
def bands_per_group(spark, folder):
    return _bands(spark, folder, "topic")


@query(_band_sql("'ALL'"))
def bands_global(spark, folder):
    return _bands(spark, folder, None)


@query(f"with {SCORES}, c as (select topic, quantile_cont(mean_loss, 0.05) as lo, quantile_cont(mean_loss, 0.9) as hi from clean_scores group by topic) select rank, mean_loss from clean_scores join c using (topic) where mean_loss between lo and hi")
def rows_in_band(spark, folder):
    rows = clean_scores(spark, folder)
    return select.in_band(rows, select.band_cuts(rows, "topic", "mean_loss", "n_tokens", 5, 10), "topic", "mean_loss").select("rank", "mean_loss")


_POINTS = ", ".join(f"round(min(x) filter (share >= {q / 100!r} - 1e-12), 6) as p{q}" for q in exprs.PERCENTILES)


@query(f"""with {SCORES}, e as (select topic as "group", mean_loss as x, n_tokens from clean_scores union all select 'ALL', mean_loss, n_tokens from clean_scores),
s as (select "group", 'docs' as weight, x, count(*)::double as w from e group by all union all select "group", 'tokens', x, sum(n_tokens)::double from e group by all),
c as (select *, sum(w) over (partition by "group", weight order by x) / sum(w) over (partition by "group", weight) as share from s)
select "group", weight, {_POINTS} from c group by all""")
def weighted_percentiles(spark, folder):
    found = stats.weighted_percentiles(clean_scores(spark, folder), "topic", "mean_loss", {"docs": F.lit(1), "tokens": F.col("n_tokens")})
    return found.select("group", "weight", *[r(f"p{q}").alias(f"p{q}") for q in exprs.PERCENTILES])


@query("with k as (select doc_id, doc_id - row_number() over (order by doc_id) as i from documents where length(text) > 800) select min(doc_id) as first, max(doc_id) + 1 as \"end\", count(*) as rows from k group by i")
def kept_runs(spark, folder):
    return select.kept_runs(table(spark, folder, "documents"), "doc_id", F.length("text") > 800)


@query("""with f as (select rank, topic, mean_loss::double as mean_loss from pool where mean_loss is not null and n_scored >= 32 group by all),
o as (select *, row_number() over (partition by topic order by mean_loss, rank) as lo, row_number() over (partition by topic order by mean_loss desc, rank desc) as hi from f)
select topic, rank, 'lowest' as "end", lo as place from o where lo <= 10 union all select topic, rank, 'highest', hi from o where hi <= 10""")
def extremes(spark, folder):
    rows = table(spark, folder, "pool").where("mean_loss is not null and n_scored >= 32").select("rank", "topic", F.col("mean_loss").cast("double").alias("mean_loss")).distinct()
    return select.extremes(rows, "topic", "mean_loss", "rank").select("topic", "rank", "end", F.col("place").cast("long").alias("place"))


@query(f"with {POOL} select topic, count(*) as docs, sum(n_tokens_full)::bigint as size, round(count(*) / sum(count(*)) over (), 6) as docs_share, round(sum(n_tokens_full) / sum(sum(n_tokens_full)) over (), 6) as size_share from clean group by topic")
def group_shares(spark, folder):
    found = stats.shares(clean_pool(spark, folder), "topic", "n_tokens_full")
    return found.select("topic", "docs", "size", r("docs_share").alias("docs_share"), r("size_share").alias("size_share"))


@query(f"with {POOL} select topic, least(floor((mean_loss - 0.0) * 70 / 7.0), 69)::int as bin, count(*) as n from clean where mean_loss between 0 and 7 group by all")
def loss_histogram(spark, folder):
    return stats.histogram(clean_pool(spark, folder), "mean_loss", 0.0, 7.0, 70, "topic")


@query(f"""with {sql.CATALOG}, named as (select * exclude (topic), '' as topic, '' as vigintile from pool), c as (select * from {sql.canonical('named')})
select coalesce(case when grouping(source) = 1 then 'ALL' else source end, '-') as source, count(*) as docs, sum(n_tokens_full)::bigint as size, count(*) filter (mean_loss is not null and not isnan(mean_loss)) as scored,
 count(*) filter (mean_loss is null or isnan(mean_loss) or mean_loss < 3) as kept, coalesce(sum(n_tokens_full) filter (mean_loss is null or isnan(mean_loss) or mean_loss < 3), 0)::bigint as kept_size from c group by rollup (source)""")
def qc_stats(spark, folder):
    rows = labels.canonical(table(spark, folder, "pool").select("source", "topic", "n_tokens_full", "mean_loss"), table(spark, folder, "doc_counts"), vigintile=None)
    return quality.scan_stats(rows, "source", "n_tokens_full", "mean_loss", 3.0).withColumn("source", F.coalesce("source", F.lit("-")))


@query("select event_id from events where value < 20 or value is null or isnan(value)")
def qc_filter(spark, folder):
    return table(spark, folder, "events").where(exprs.qc_passes(F.col("value"), 20.0)).select("event_id")


THRESHOLDS = exprs.logit_thresholds()
_GRID = f"grid as (select unnest([{', '.join(map(repr, THRESHOLDS))}]) as threshold), scored as (select (mean_loss::double) / 10 as score, n_tokens_full as weight from pool where mean_loss is not null and not isnan(mean_loss))"
_SURVIVAL = f"""{_GRID}, sums as (select threshold, (select count(*) from scored where score >= threshold) as n, (select coalesce(sum(weight), 0) from scored where score >= threshold) as w from grid)"""


def _curve(spark, folder):
    rows = table(spark, folder, "pool").select((F.col("mean_loss").cast("double") / 10).alias("score"), "n_tokens_full")
    return quality.survival(rows, "score", F.col("n_tokens_full"), THRESHOLDS)


@query(f"with {_SURVIVAL} select round(threshold, 9) as threshold, round(n / (select count(*) from scored), 6) as share_docs, round(w / (select sum(weight) from scored), 6) as share_weight from sums")
def qc_survival(spark, folder):
    """The share of scores (losses as tenths) at or above each of 2,001 thresholds with equal steps of their log odds."""
    return _curve(spark, folder).withColumn("threshold", r("threshold", 9))


@query(f"""with {_SURVIVAL}, s as (select threshold, round(w / (select sum(weight) from scored), 6) as a from sums)
select round(threshold, 9) as threshold, round(a * 1000.0 + 500.0, 4) as keep_above, round(1000.0 - a * 1000.0 + 500.0, 4) as keep_below from s""")
def tokens_left(spark, folder):
    left = quality.tokens_left(_curve(spark, folder), 1000.0, 500.0)
    return left.select(r("threshold", 9).alias("threshold"), r("keep_above", 4).alias("keep_above"), r("keep_below", 4).alias("keep_below"))


@query("""select event_type, round(median(value), 6) as median, round(sum(event_id % 7) filter (value >= 20) / sum(event_id % 7), 6) as high_share, sum(event_id % 7)::bigint as weight,
 round(sum(event_id % 7) / sum(sum(event_id % 7)) over (), 6) as weight_share from events group by event_type""")
def group_quality(spark, folder):
    return quality.group_quality(table(spark, folder, "events").withColumn("w", F.col("event_id") % 7), "event_type", "value", "w", 20.0)


# --- representativeness

_CELLS = f"""with {POOL}, c as (select *, case when n_tokens_full >= 2048 then 3 when n_tokens_full >= 1024 then 2 when n_tokens_full >= 512 then 1 else 0 end as bin from clean), s as (select * from {sql_hash64(7, 'c', 'row_id')}),
cells as (select topic, bin, count(*) as population_docs, count(*) filter (h < {int(0.3 * 2.0**64)}::uhugeint) as selection_docs, sum(n_tokens_full)::bigint as population_size, coalesce(sum(n_tokens_full) filter (h < {int(0.3 * 2.0**64)}::uhugeint), 0)::bigint as selection_size from s group by all),
pq as (select *, population_size / sum(population_size) over () as p, selection_size / sum(selection_size) over () as q from cells)"""


def _cells(spark, folder):
    rows = clean_pool(spark, folder).withColumn("bin", stats.length_bin(F.col("n_tokens_full"), [512, 1024, 2048]))
    return stats.compare_cells(rows, rows.where(hash_sample(7, F.col("row_id"), 0.3)), ["topic", "bin"], "n_tokens_full")


@query(f"{_CELLS} select topic, bin, population_docs, selection_docs, round(p, 6) as p, round(q, 6) as q from pq")
def cell_distribution(spark, folder):
    return _cells(spark, folder).select("topic", "bin", "population_docs", "selection_docs", r("p").alias("p"), r("q").alias("q"))


@query(f"{_CELLS} select round(0.5 * sum(abs(q - p)), 6) as distance from pq")
def variation_distance(spark, folder):
    return stats.variation_distance(_cells(spark, folder)).select(r("distance").alias("distance"))


@query(f"{_CELLS}, f as (select topic, sum(p) as p, sum(q) as q from pq group by topic) select round(0.5 * sum(abs(q - p)), 6) as distance from f")
def variation_by_topic(spark, folder):
    return stats.variation_distance(_cells(spark, folder), "topic").select(r("distance").alias("distance"))


@query(f"""{_CELLS}, z as (select (selection_docs - population_docs * 0.3) / sqrt(greatest(population_docs * 0.3 * 0.7, 1e-9)) as z from pq where population_docs >= 20)
select count(*) as cells, count(*) filter (abs(z) > 3) as beyond_3, round(max(abs(z)), 6) as max_z, round(sum(z * z) / count(*), 6) as chi2_dof from z""")
def cell_chi2(spark, folder):
    return stats.cell_fit(_cells(spark, folder), 0.3, 20).select("cells", "beyond_3", r("max_z").alias("max_z"), r("chi2_dof").alias("chi2_dof"))


@query()
def distance_by_chance(spark, folder):
    return stats.distance_by_chance(_cells(spark, folder), 0.3, ["topic", "bin"])


@query("select source, round(coalesce(sum(n_tokens_full) / nullif(sum(original_word_count), 0), sum(sum(n_tokens_full)) over () / sum(sum(original_word_count)) over ()), 6) as tokens_per_char from pool where n_tokens_full > 0 and original_word_count > 0 group by source")
def calibration(spark, folder):
    rows = table(spark, folder, "pool").where("n_tokens_full > 0 and original_word_count > 0")
    return stats.ratio_calibration(rows, "source", "n_tokens_full", "original_word_count").select("source", r("tokens_per_char").alias("tokens_per_char"))


# --- texts


_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pN\s]', '', 'g'), '\s+'), lambda x: x <> '')"


@query(rf"""with w as (select doc_id, {_WORDS} as w from documents where text is not null),
s as (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0),
sets as (select min(doc_id) as id, s, len(s) as n from s group by s), each as (select id, n, unnest(s) as term from sets),
pairs as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from each a join each b on a.term = b.term and a.id < b.id group by 1, 2)
select a, b, round(c / (na + nb - c), 6) as similarity from pairs where c / (na + nb - c) >= 0.8 - 1e-9""")
def near_duplicate_pairs(spark, folder):
    """Pairs of different wording with a similarity of at least 0.8, as the least ids of their classes of equal shingles."""
    members, sets = neardup.shingle_sets(table(spark, folder, "documents", spread=True), "doc_id", "text")
    least = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    pairs = neardup.similar_pairs(sets)
    named = pairs.join(least.select(F.col("set_id").alias("a"), F.col("id").alias("ia")), "a").join(least.select(F.col("set_id").alias("b"), F.col("id").alias("ib")), "b")
    return named.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), r("similarity").alias("similarity"))


@query()
def minhash_classes(spark, folder):
    return neardup.minhash_classes(table(spark, folder, "documents", spread=True))


_PLAIN = r"list_filter(string_split(text, E'\n'), lambda x: trim(x) <> '')"


@query(rf"""with f as (select doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w, {_PLAIN} as l, string_split_regex(text, '\n+') as d from documents where text is not null),
g as (select *, list_filter(list_transform(w, lambda x: regexp_replace(regexp_replace(x, '^\pP+', ''), '\pP+$', '')), lambda x: x <> '') as p from f)
select doc_id, len(w) as n_words, round(case when len(p) > 0 then list_sum(list_transform(p, lambda x: length(x))) / len(p) else 0 end, 6) as mean_word_length,
 len(list_intersect(list_transform(p, lambda x: lower(x)), ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'])) as stop_words,
 round(case when len(l) > 0 then len(list_filter(l, lambda x: starts_with(ltrim(x), '•') or starts_with(ltrim(x), '-'))) / len(l) else 0 end, 6) as bullet_ratio,
 round(case when len(d) > 0 then (len(d) - len(list_distinct(d))) / len(d) else 0 end, 6) as dup_line_frac from g""")  # fmt: skip
def quality_features(spark, folder):
    docs = table(spark, folder, "documents", spread=True).where("text is not null")
    made = docs.select("doc_id", *[c.alias(n) for n, c in quality.text_features(F.col("text")).items()])
    return made.select("doc_id", "n_words", "stop_words", *[r(c).alias(c) for c in ("mean_word_length", "bullet_ratio", "dup_line_frac")])


@query()
def quality_reasons(spark, folder):
    return quality.filtered(table(spark, folder, "documents", spread=True))


_LIST = r"regexp_extract_all(regexp_replace(lower(text), '[^\pL\pN\s]', '', 'g'), '[\pL\pN]+')"


def _word_docs(spark, folder):
    words = F.regexp_extract_all(exprs.simplify(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", words.alias("ids"))


@query(f"select token, count(*) as n from (select unnest({_LIST}) as token from documents) group by token")
def unigram_counts(spark, folder):
    return tokens.token_counts(_word_docs(spark, folder), "ids")


_LOSS = f"""with e as (select doc_id, unnest({_LIST}) as token, generate_subscripts({_LIST}, 1) - 1 as pos from documents where text is not null), c as (select token, count(*) as n from e group by token),
l as (select token, n, -ln(n / (select sum(n) from c)) as loss from c)"""


@query(f"""{_LOSS}, s as (select doc_id, sum(loss) / count(*) as mean_loss, count(*) as n_pred from e join l using (token) where pos % 512 <> 0 group by doc_id)
select doc_id, round(mean_loss, 6) as mean_loss, coalesce(n_pred, 0) as n_pred from documents left join s using (doc_id) where text is not null""")
def document_loss(spark, folder):
    return tokens.document_loss(_word_docs(spark, folder), "doc_id", "ids", 512).select("doc_id", r("mean_loss").alias("mean_loss"), "n_pred")


@query(f"{_LOSS} select case when n >= 10000 then 2 when n >= 1000 then 1 else 0 end as bucket, sum(n)::bigint as predictions, round(sum(n * loss) / sum(n), 6) as mean_loss from l group by 1")
def loss_by_frequency(spark, folder):
    counts = tokens.token_counts(_word_docs(spark, folder), "ids")
    total = counts.agg(F.sum("n")).scalar()
    scored = counts.withColumn("loss", -F.log(F.col("n") / total))
    return scored.groupBy(exprs.digitize(F.col("n"), [1e3, 1e4]).alias("bucket")).agg(F.sum("n").alias("predictions"), r(F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias("mean_loss"))


def _length_docs(spark, folder):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", F.transform(words, lambda w: F.length(w)).alias("ids"))


_STREAM = "s as (select doc_id, unnest(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x))) as v, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) as i from documents where text is not null)"


@query(f"with {_STREAM}, g as (select v, (row_number() over (order by doc_id, i) - 1) as p from s) select p // 512 as block_id, count(*) as n, sum(v)::bigint as total, sum(v * (p % 512))::bigint as checksum from g group by 1 having count(*) = 512")
def token_blocks(spark, folder):
    made = tokens.blocks(_length_docs(spark, folder), ["doc_id"], "ids", 512)
    each = made.select("block_id", F.posexplode("ids").alias("i", "v"))
    return each.groupBy("block_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("i")).alias("checksum"))


@query("select doc_id, (sum(n) over (order by doc_id) - n)::bigint as start, n from (select doc_id, length(text)::bigint as n from documents where text is not null)")
def stream_offsets(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    return tokens.starts_of(docs, ["doc_id"], "n")


@query("select doc_id, md5(text) as hash, length(text) as chars, n_chars from documents")
def json_round_trip(spark, folder):
    """Documents to JSON lines and back through the corpus source's parser."""
    raw = table(spark, folder, "documents").select("n_chars", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("value"))
    parsed = raw.select("n_chars", F.from_json("value", corpus.DOCUMENT).alias("d"))
    return parsed.select(F.col("d.id").cast("long").alias("doc_id"), F.md5("d.text").alias("hash"), F.length("d.text").alias("chars"), "n_chars")


@query("select rank, text from eval_docs where rank is not null and text is not null group by all order by rank limit 100")
def eval_in_order(spark, folder):
    return table(spark, folder, "eval_docs").where("rank is not null and text is not null").distinct().orderBy("rank", "text").limit(100)


@query(f"with {SCORES} select topic, quantile_cont(mean_loss, 0.25) as p25, quantile_cont(mean_loss, 0.5) as p50, quantile_cont(mean_loss, 0.99) as p99 from clean_scores group by topic".replace("quantile_cont(mean_loss, 0.25)", "round(quantile_cont(mean_loss, 0.25), 6)").replace("quantile_cont(mean_loss, 0.5)", "round(quantile_cont(mean_loss, 0.5), 6)").replace("quantile_cont(mean_loss, 0.99)", "round(quantile_cont(mean_loss, 0.99), 6)"))
def exact_percentiles(spark, folder):
    found = prefix.exact_quantiles(clean_scores(spark, folder), "mean_loss", [0.25, 0.5, 0.99], "topic")
    at = lambda q, n: r(F.max(F.when(F.col("q") == q, F.col("quantile")))).alias(n)
    return found.groupBy("topic").agg(at(0.25, "p25"), at(0.5, "p50"), at(0.99, "p99"))


_DIR_GROUPS = """dirs as (select regexp_extract(file_path, '([^/]+)/[^/]+$', 1) as d, n_docs from doc_counts),
mixes as (select case when d like 'common_crawl-%' then 'cc:' || regexp_replace(regexp_replace(d, '-[0-9]+$', ''), '^[^-]*-', '') when d like 'olmocr_science_pdfs-%' then 'pdf:' || substr(d, 21) when d like 'stack_edu-%' then 'code:' || substr(d, 11) else d end as topic, sum(n_docs) as n from dirs group by 1)"""


@query(f"""with {POOL}, {_DIR_GROUPS}, m as (select topic, n / sum(n) over () as mix_share from mixes), p as (select topic, count(*) / (select count(*) from clean) as pool_share, sum(n_tokens_full) / (select sum(n_tokens_full) from clean) as token_share, avg(mean_loss) as mean_loss, stddev_samp(mean_loss) as std from clean group by topic)
select topic, round(mix_share, 6) as mix_share, round(coalesce(pool_share, 0), 6) as pool_share, round(100 * (coalesce(pool_share, 0) - mix_share), 4) as diff_pp, round(coalesce(token_share, 0), 6) as token_share, round(mean_loss, 6) as mean_loss, round(std, 6) as std, abs(coalesce(pool_share, 0) - mix_share) <= 0.001 as ok from m left join p using (topic)""")
def pool_report(spark, folder):
    """Per topic: share in the whole mix, share of the pool's rows and tokens, loss, and whether the shares agree within 0.1 points."""
    rows = clean_pool(spark, folder)
    cells = table(spark, folder, "doc_counts").select(labels.parse_dir(labels.directory(F.col("file_path"))).alias("d"), "n_docs")
    mix = stats.shares(cells.select(labels.group_name(F.col("d.source"), F.col("d.topic")).alias("topic"), "n_docs"), "topic", "n_docs").select("topic", F.col("size_share").alias("mix_share"))
    pool = stats.shares(rows, "topic", "n_tokens_full").select("topic", F.col("docs_share").alias("pool_share"), F.col("size_share").alias("token_share"))
    joined = mix.join(pool, "topic", "left").join(select.group_stats(rows, "topic", "mean_loss"), "topic", "left").fillna(0.0, ["pool_share", "token_share"])
    diff = F.col("pool_share") - F.col("mix_share")
    return joined.select("topic", r("mix_share").alias("mix_share"), r("pool_share").alias("pool_share"), r(100 * diff, 4).alias("diff_pp"), r("token_share").alias("token_share"), r("mean").alias("mean_loss"), r("std").alias("std"), (F.abs(diff) <= 0.001).alias("ok"))


@query(f"""with {POOL} select count(*) as rows, sum(n_tokens_full)::bigint as tokens, round(avg(n_tokens_full), 4) as tokens_per_row, round(avg((abs(z) >= 3)::int), 6) as clipped_share, round(median(z), 6) as median_z, round(sum(z * n_tokens_full) / sum(n_tokens_full), 6) as weighted_z from clean""")
def pool_summary(spark, folder):
    rows = clean_pool(spark, folder)
    out = rows.agg(
        F.count("*").alias("rows"), F.sum("n_tokens_full").alias("tokens"), r(F.avg("n_tokens_full"), 4).alias("tokens_per_row"), r(F.avg((F.abs("z") >= 3).cast("double"))).alias("clipped_share"),
        r(stats.weighted_average(F.col("z"), F.col("n_tokens_full"))).alias("weighted_z"),
    )
    middle = prefix.exact_quantiles(rows.withColumn("all", F.lit(0)), "z", [0.5], "all").select(r("quantile").alias("q"))
    return out.withColumn("median_z", middle.scalar())


@query("select source, doc_id, substr(text, 1, 600) as snippet from (select *, row_number() over (partition by source order by doc_id) as rn from documents where doc_id % 97 = 0 and source is not null) where rn <= 4")
def snippets(spark, folder):
    docs = table(spark, folder, "documents").where("source is not null")
    return quality.snippets(docs, "source", "doc_id", "text", 97)


@query("with c as (select source, sum(n_chars)::bigint as chars, sum(len(regexp_extract_all(text, '[a-z]+')))::bigint as words from documents where doc_id % 10 = 0 and text is not null group by source) select source, round(words / nullif(chars, 0), 6) as words_per_char from c")
def calibration_rows(spark, folder):
    rows = quality.calibration_rows(table(spark, folder, "documents").where("text is not null"), 10, "doc_id")
    totals = rows.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.sum(F.size(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("words"))
    return totals.select("source", r(F.try_divide("words", "chars")).alias("words_per_char"))
