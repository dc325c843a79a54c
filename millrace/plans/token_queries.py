"""Queries over keys, token streams, scorers and filters of the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, labels
from ..functions.hashing import dedup_key, low64
from ..operators import neardup, quality, records, select, stats, tokens
from ..runtime import spread_join, table
from . import corpus_queries as base
from . import sql

Q: dict = {}
SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


r = base.r

# --- keys


@query("""select distinct rank, (case when k >= 9223372036854775808 then k - 18446744073709551616 else k end)::bigint as key
 from (select rank, (trim(text_hash)::uhugeint % 18446744073709551616::uhugeint)::hugeint as k from scores where regexp_full_match(trim(text_hash), '[0-9]+'))""")
def keys_of_hashes(spark, folder):
    """128-bit hashes cut to 64 bits."""
    rows = table(spark, folder, "scores").where(F.trim("text_hash").rlike(r"^\d+$"))
    return rows.select("rank", low64(F.col("text_hash")).alias("key")).distinct()


@query(f"""with {sql.RECORDS_LATEST} select d.rank, l.text_key as key from documents d join latest l using (rank) where d.text is not null and (l.text_hash <> '' or l.source not ilike '%crawl%')""")
def keys_of_records(spark, folder):
    """The dedup keys of the records whose text is there: of their hash, or of their text where they have none. A web record that
    lost its hash has the key of the hash, which its text can't tell, so it is left out."""
    latest = records.latest_records(table(spark, folder, "scores"), ["n_tokens", "mean_loss", "text_hash", "source"])
    both = table(spark, folder, "documents").select("rank", "text").where("text is not null").join(latest, "rank").where("text_hash <> '' or not source ilike '%crawl%'")
    return both.select("rank", dedup_key(F.col("text_hash"), F.col("text")).alias("key"))


@query()
def pool_in_held_out(spark, folder):
    """Per split: pool rows, records and keys whose key an evaluation text has; the rows that decontamination drops."""
    splits = {x.split_name: (x.rank_lo, x.rank_hi) for x in table(spark, folder, "splits").collect()}  # three rows
    held = table(spark, folder, "eval_docs").where("text is not null and rank is not null").select(dedup_key(F.lit(None).cast("string"), F.col("text")).alias("text_hash"), select.split_of(F.col("rank"), splits).alias("split_name")).distinct()
    hit = spread_join(table(spark, folder, "pool").select("text_hash", "row_id"), held, ["text_hash"])
    return hit.groupBy("split_name").agg(F.count("*").alias("rows"), F.countDistinct("row_id").alias("records"), F.countDistinct("text_hash").alias("keys"))


_TRUST = f"""{sql.KNOWN}, firsts as (select * from known where row_id is not null qualify row_number() over (partition by row_id order by added_at nulls last, text_hash nulls last, n_scored nulls last, n_tokens_full nulls last, z nulls last) = 1)"""


@query(f"""with {_TRUST}, f as (select *, coalesce(n_scored >= 32, false) as trusted from firsts where n_tokens_full > 0)
select count(*) as rows, count(distinct text_hash) as texts, sum(n_tokens_full)::bigint as tokens, round(avg((not trusted)::int), 6) as untrusted_rows, round(sum(n_tokens_full) filter (not trusted) / sum(n_tokens_full), 6) as untrusted_tokens, round(avg((abs(z) >= 3)::int), 6) as clipped from f""")
def pool_trust(spark, folder):
    """One row: records, texts and tokens of the pool, shares of records and tokens whose score is not trusted, share of clipped z."""
    rows = records.pool_records(table(spark, folder, "pool"), table(spark, folder, "doc_counts"), ["text_hash", "n_scored", "n_tokens_full", "z"]).where("n_tokens_full > 0")
    known = rows.withColumn("trusted", F.coalesce(F.col("n_scored") >= 32, F.lit(False)))
    return known.agg(
        F.count("*").alias("rows"), F.countDistinct("text_hash").alias("texts"), F.sum("n_tokens_full").alias("tokens"), r(F.avg((~F.col("trusted")).cast("double"))).alias("untrusted_rows"),
        r(F.try_divide(F.sum(F.when(~F.col("trusted"), F.col("n_tokens_full"))), F.sum("n_tokens_full"))).alias("untrusted_tokens"), r(F.avg((F.abs("z") >= 3).cast("double"))).alias("clipped"),
    )


@query("select topic, count(*) as rows, sum(((text_hash % 100) + 100) % 100)::bigint as total from pool group by topic")
def unique_scores(spark, folder):
    """Each text scored once (here by a number from its key), the score given to all its rows."""
    scored = tokens.score_unique(table(spark, folder, "pool").select("topic", "text_hash"), "text_hash", lambda d: d.select("text_hash", F.pmod("text_hash", F.lit(100)).alias("score")))
    return scored.groupBy("topic").agg(F.count("*").alias("rows"), F.sum("score").alias("total"))


@query(f"with {base.POOL} select topic, count(*) as docs, sum(n_tokens_full)::bigint as size from clean group by topic order by size desc, topic limit 25")
def largest_groups(spark, folder):
    """The 25 largest topics of the pool."""
    return stats.largest(stats.shares(base.clean_pool(spark, folder), "topic", "n_tokens_full"), "topic", "size").select("topic", "docs", "size")


@query("select lang, count(*) as docs, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes from documents group by lang")
def text_sizes(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select row_id, rank, round(greatest(least(mean_loss::double / 4, 1 - 1e-6), 1e-6), 6) as score from pool where mean_loss is not null and not isnan(mean_loss)")
def clipped_scores(spark, folder):
    rows = table(spark, folder, "pool").select("row_id", "rank", quality.clipped(F.col("mean_loss").cast("double") / 4).alias("score"))
    return rows.where("score is not null").withColumn("score", r("score"))


# --- token streams: the lengths of words stand for tokens, so that another engine can follow


def _framed(spark, folder):
    return base._length_docs(spark, folder).withColumn("ids", tokens.framed(F.col("ids")))


_WORDS = "list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x))"
_FRAMED = f"""framed as (select doc_id, list_concat([128000], {_WORDS}, [128001]) as ids from documents where text is not null),
stream as (select v, (row_number() over (order by doc_id, i) - 1) as p from (select doc_id, unnest(ids) as v, generate_subscripts(ids, 1) as i from framed)),
blocked as (select p // 2048 as block_id, p % 2048 as i, v from stream qualify count(*) over (partition by p // 2048) = 2048)"""


@query(f"with {_FRAMED} select block_id, (1 + count(*) filter (v = 128000 and i > 0))::int as segments, count(*) filter (v = 128000)::int as documents from blocked group by block_id")
def document_segments(spark, folder):
    """Blocks of framed documents: segments per block, and how many begin a document."""
    made = tokens.blocks(_framed(spark, folder), ["doc_id"], "ids", 2048)
    return made.select("block_id", (F.size(tokens.segment_starts(F.col("ids"))) - 1).alias("segments"), F.size(tokens.boundaries(F.col("ids"))).alias("documents"))


@query(f"""with {_FRAMED}, s as (select block_id, i, max(case when v = 128000 or i = 0 then i end) over (partition by block_id order by i rows unbounded preceding) as start from blocked)
select block_id, sum(i - start)::bigint as total, max(i - start)::int as longest from s group by block_id""")
def segment_positions(spark, folder):
    """Position of each token in its segment: their sum and the greatest, per block."""
    made = tokens.blocks(_framed(spark, folder), ["doc_id"], "ids", 2048).select("block_id", tokens.position_ids(F.col("ids")).alias("positions"))
    return made.select("block_id", F.aggregate("positions", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.array_max("positions").alias("longest"))


@query(f"""with {_FRAMED}, pairs as (select v as a, lead(v) over (partition by block_id order by i) as b from blocked qualify b is not null), joint as (select a, b, count(*) as n from pairs group by all),
given as (select a, sum(n) as na from joint group by a), scored as (select b, n, -ln((n + 1) / (na + (select count(distinct b) from joint))) as loss from joint join given using (a))
select round(sum(n * loss) / sum(n), 6) as concat_loss, round(sum(n * loss) filter (b <> 128000) / sum(n) filter (b <> 128000), 6) as doc_loss, sum(n)::bigint as predictions from scored""")
def packing_protocols(spark, folder):
    found = tokens.protocol_losses(tokens.blocks(_framed(spark, folder), ["doc_id"], "ids", 2048))
    return found.select(r("concat_loss").alias("concat_loss"), r("doc_loss").alias("doc_loss"), "predictions")


@query(f"with {_FRAMED} select doc_id, (sum(len(ids)) over (order by doc_id) - len(ids))::bigint as start, len(ids)::int as n from framed where doc_id % 3 = 0")
def range_copies(spark, folder):
    """The ranges of a third of the documents copied to a new stream; every one is checked to be a whole document."""
    docs = _framed(spark, folder)
    return tokens.copied_ranges(docs, docs.where("doc_id % 3 = 0"), "doc_id", ["doc_id"]).select("doc_id", "start", "n")


@query("select count(*) as documents, count(*)::bigint as boundaries, true as aligned from documents where text is not null")
def stream_alignment(spark, folder):
    return tokens.alignment(_framed(spark, folder))


@query(f"with {_FRAMED} select doc_id, 2 as documents, len(ids)::int as longest from framed")
def boundary_lengths(spark, folder):
    """Lengths of documents from their boundaries in a stream of each document twice."""
    twice = _framed(spark, folder).select("doc_id", F.concat("ids", "ids").alias("ids"))
    lengths = twice.select("doc_id", tokens.document_lengths(tokens.boundaries(F.col("ids")), F.size("ids")).alias("n"))
    return lengths.select("doc_id", F.size("n").alias("documents"), F.array_max("n").alias("longest"))


_LENGTHS = f"{base._STREAM}, c as (select v, count(*) as n from s group by v), l as (select v, n, -ln(n / (select sum(n) from c)) as loss from c)"


@query(f"""with {_LENGTHS}, o as (select *, sum(n) over (order by doc_id) - n as start from (select doc_id, count(*) as n from s group by doc_id)) select v as token, count(*) as n from s join o using (doc_id) where start < 20000 group by v""")
def prefix_counts(spark, folder):
    """Unigram counts of the documents that begin in the first 20,000 tokens of the stream."""
    docs = base._length_docs(spark, folder).withColumn("n", F.size("ids"))
    return tokens.token_counts(tokens.starts_of(docs, ["doc_id"], "n"), "ids", 20_000, "start")


@query(f"""with {_LENGTHS}, e as (select doc_id, avg(loss) as mean_loss, count(*) as n_pred from s join l using (v) where i <= 512 and (i - 1) % 128 <> 0 group by doc_id)
select doc_id, round(mean_loss, 6) as mean_loss, coalesce(n_pred, 0)::int as n_pred from documents left join e using (doc_id) where text is not null""")
def scored_stream(spark, folder):
    """The first 512 tokens of every document, scored in windows of 128 by a model that goes to the tasks."""
    docs = base._length_docs(spark, folder)
    scored = tokens.score_stream(docs.withColumn("ids", tokens.truncated(F.col("ids"))), "doc_id", "ids", tokens.unigram_scorer(docs, "ids"), window=128, batch_tokens=4096)
    return scored.withColumn("mean_loss", r("mean_loss"))


@query("select least(20, count(*)) as documents, true as same from documents where len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 2")
def scorer_check(spark, folder):
    """Whether the first 20 documents have the same losses in batches and one by one."""
    docs = base._length_docs(spark, folder)
    return tokens.batch_check(docs, "doc_id", "ids", tokens.unigram_scorer(docs, "ids"), window=128).select("documents", (F.col("max_difference") < 1e-3).alias("same"))


@query("select doc_id, len(string_split(text, ' '))::int as n, list_sum(list_transform(string_split(text, ' '), lambda x: length(x)))::bigint as total from documents where text is not null")
def zipped_words(spark, folder):
    """Words and their lengths, zipped by position."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    zipped = docs.select("doc_id", tokens.aligned(F.col("w"), F.transform("w", lambda w: F.length(w)), ("word", "length")).alias("z"))
    return zipped.select("doc_id", F.size("z").alias("n"), F.aggregate("z", F.lit(0).cast("long"), lambda a, z: a + z["length"]).alias("total"))


@query(f"""{base._LOSS}, x as (select doc_id, case when n >= 1000 then 2 when n >= 100 then 1 else 0 end as bucket, loss from e join l using (token) where pos % 512 <> 0)
select doc_id, bucket, count(*) as predictions, round(sum(loss), 4) as loss from x group by all""")
def frequency_buckets(spark, folder):
    """Document x frequency bucket of the target: predictions and summed loss."""
    docs = base._word_docs(spark, folder)
    counts = tokens.token_counts(docs, "ids")
    total = counts.agg(F.sum("n")).scalar()
    logs = counts.select("token", exprs.digitize(F.col("n"), [1e2, 1e3]).alias("bucket"), (-F.log(F.col("n") / total)).alias("one"))
    each = docs.select("doc_id", F.posexplode("ids").alias("pos", "token")).where(F.col("pos") % 512 != 0).groupBy("doc_id", "token").agg(F.count("*").alias("predictions"))
    rows = each.join(logs, "token").withColumn("loss", F.col("predictions") * F.col("one"))
    return stats.document_buckets(rows, "doc_id", "bucket", "predictions", ["loss"]).withColumn("loss", r("loss", 4))


def _breakdown(label: str) -> str:
    return f"""{base._LOSS}, {sql.CATALOG}, s as (select doc_id, count(*) as k, sum(loss) as x from e join l using (token) where pos % 512 <> 0 group by doc_id), named as (select doc_id, {label} as bucket from {sql.canonical('documents')}),
b as (select bucket, sum(k) as predictions, sum(x) as x from s join named using (doc_id) group by bucket)
select bucket, predictions::bigint as predictions, round(predictions / (select sum(predictions) from b), 6) as share, round(x / predictions, 6) as loss from b where predictions >= 0.02 * (select sum(predictions) from b)"""


def _loss_by(spark, folder, bucket):
    named = labels.canonical(table(spark, folder, "documents").select("doc_id", "source", "topic"), table(spark, folder, "doc_counts"), vigintile=None)
    scored = tokens.document_loss(base._word_docs(spark, folder), "doc_id", "ids", 512).where("n_pred > 0").withColumn("loss", F.col("mean_loss") * F.col("n_pred"))
    rows = stats.document_buckets(scored.join(named.select("doc_id", bucket.alias("bucket")), "doc_id"), "doc_id", "bucket", "n_pred", ["loss"])
    found = stats.loss_breakdown(rows, "bucket", "n_pred", "loss", min_share=0.02)
    return found.select("bucket", "predictions", r("share").alias("share"), r("loss").alias("loss"))


@query(f"{_breakdown('source')}")
def loss_by_source(spark, folder):
    return _loss_by(spark, folder, F.col("source"))


@query(f"{_breakdown(chr(39).join(['source || ', ':', ' || topic']))}")
def loss_by_domain(spark, folder):
    """Domains with at least a fiftieth of the predictions."""
    return _loss_by(spark, folder, F.concat("source", F.lit(":"), "topic"))


# --- filters and near-duplicates


@query(r"""with w as (select doc_id, greatest(length(text), 1) as size, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents where text is not null),
x as (select doc_id, size, unnest(w) as a, generate_subscripts(w, 1) as i from w), y as (select *, lead(a, 1) over o as b, lead(a, 2) over o as c, lead(a, 3) over o as d from x window o as (partition by doc_id order by i)),
g as (select doc_id, size, 2 as k, a || ' ' || b as gram from y union all select doc_id, size, 3, a || ' ' || b || ' ' || c from y union all select doc_id, size, 4, a || ' ' || b || ' ' || c || ' ' || d from y),
c as (select doc_id, size, k, gram, count(*) as n from g where gram is not null group by all), t as (select doc_id, k, max(n) as n from c group by all),
z as (select doc_id, k, max(length(gram)) * any_value(c.n) / any_value(c.size) as share from c join t using (doc_id, k, n) group by doc_id, k)
select doc_id, round(coalesce(max(share) filter (k = 2), 0), 6) as top_2gram, round(coalesce(max(share) filter (k = 3), 0), 6) as top_3gram, round(coalesce(max(share) filter (k = 4), 0), 6) as top_4gram from w left join z using (doc_id) group by doc_id""")
def top_ngrams(spark, folder):
    docs = table(spark, folder, "documents", spread=True).where("text is not null")
    found = quality.ngram_features(docs, ["doc_id"], "text")
    return found.select("doc_id", *[r(f"top_{n}gram").alias(f"top_{n}gram") for n in (2, 3, 4)])


@query()
def filter_steps(spark, folder):
    return quality.step_counts(quality.filtered(table(spark, folder, "documents", spread=True)))


_CLASSES = rf"""with recursive w as (select doc_id, {base._WORDS} as w from documents),
x as (select doc_id, len(w) as size, unnest(w) as a, generate_subscripts(w, 1) as i from w),
y as (select doc_id, a || ' ' || lead(a, 1) over o || ' ' || lead(a, 2) over o || ' ' || lead(a, 3) over o || ' ' || lead(a, 4) over o as gram from x window o as (partition by doc_id order by i)),
g as (select doc_id, gram from y where gram is not null union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
s as (select doc_id, list_sort(list(distinct gram)) as s from g group by doc_id),
sets as (select min(doc_id) as id, s, len(s) as n, count(*) as copies from s group by s), each as (select id, n, unnest(s) as term from sets),
pairs as (select a.id as a, b.id as b from each a join each b on a.term = b.term and a.id <> b.id group by 1, 2 having count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8 - 1e-9),
reach(a, b) as (select id, id from sets union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
classes as (select a as id, min(b) as class_id from reach group by a), linked as (select a as id, sum(copies) as links from pairs join sets on sets.id = b group by a),
found as (select s.doc_id, class_id, coalesce(links, 0)::bigint as links, copies from s join sets on sets.s = s.s join classes using (id) left join linked using (id))"""


@query(f"{_CLASSES} select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(links, 0) as links, coalesce(copies, 1) as copies from documents d left join found using (doc_id)")
def near_duplicate_classes(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents", spread=True))


@query(f"{_CLASSES} select d.doc_id, d.source from documents d left join found using (doc_id) where coalesce(class_id, d.doc_id) = d.doc_id")
def near_dedup(spark, folder):
    docs = table(spark, folder, "documents", spread=True)
    return neardup.keep_one(docs, neardup.near_duplicates(docs)).select("doc_id", "source")
