"""SQL that queries share: canonical labels and records, for the comparison with another engine."""

CATALOG = """
cat as (select distinct
    case when regexp_matches(d, '-[0-9]+$') then split_part(d, '-', 1)
         when regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1) <> '' then regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1)
         else d end as source,
    case when regexp_matches(d, '-[0-9]+$') then regexp_replace(regexp_replace(d, '-[0-9]+$', ''), '^[^-]*-', '')
         when regexp_extract(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', 1) <> '' then regexp_replace(d, '^(common_crawl|olmocr_science_pdfs|stack_edu)-', '')
         else '-' end as topic
  from (select regexp_extract(file_path, '([^/]+)/[^/]+$', 1) as d from doc_counts)),
cat_source as (select distinct source, trim(regexp_replace(lower(source), '[\\s_-]+', '_', 'g'), '_') as folded from cat),
cat_topic as (select distinct source, topic, trim(regexp_replace(lower(topic), '[\\s_-]+', '_', 'g'), '_') as folded from cat)
"""


def canonical(view: str) -> str:
    """A subquery: ``view`` with source, topic and vigintile replaced by their canonical form."""
    return f"""(
select x.* exclude (source, topic, vigintile, f, t, rest), coalesce(s.source, x.f) as source,
  coalesce(c.topic, nullif(nullif(trim(x.topic), '-'), ''), '-') as topic,
  case when v <> '' then lpad(right(v, 2), 2, '0') else '' end as vigintile
from (select *, coalesce(nullif(regexp_extract(vigintile, '([0-9]+)\\s*$', 1), ''), nullif(regexp_extract(f, '_([0-9]+)$', 1), ''), '') as v,
        trim(regexp_replace(lower(topic), '[\\s_-]+', '_', 'g'), '_') as t, '' as rest
      from (select *, trim(regexp_replace(lower(source), '[\\s_-]+', '_', 'g'), '_') as f from {view})) x
left join cat_source s on x.f = s.folded or starts_with(x.f, s.folded || '_')
left join cat_topic c on c.source = s.source and c.folded = coalesce(nullif(x.t, ''), nullif(regexp_replace(substr(x.f, length(s.folded) + 2), '_?[0-9]+$', ''), '')))"""


RECORDS_LATEST = "latest as (select * from scores where rank is not null qualify row_number() over (partition by rank order by scored_at desc nulls last, loaded_at desc nulls last, n_tokens desc nulls last, mean_loss desc nulls last) = 1)"
RECORDS = f"""
{RECORDS_LATEST},
records as (select * exclude (v), case when mean_loss > 0 and isfinite(mean_loss) and n_pred > 0 then mean_loss end as loss,
    case when n_tokens between 1 and 1000000 then n_tokens end as count from {canonical('latest')})
"""
WITH = f"with {CATALOG}, {RECORDS}"

STARTS = "starts as (select shard, coalesce(sum(n_docs) over (order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as start from doc_counts)"
KNOWN = f"{STARTS}, known as (select p.* exclude (row_id), coalesce(row_id, start + shard_offset)::bigint as row_id from pool p left join starts using (shard))"
