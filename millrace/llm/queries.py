"""The queries of this subpackage and, where SQL can express them, the SQL to compare them with."""

from ..plans.sql import CATALOG, KNOWN, WITH, canonical
from . import budget, cutoffs, level, mixing, overlap, packing, sample, sketch

QUERIES = {
    "p1_found": cutoffs.p1_found,
    "p1_cutoffs": cutoffs.p1_cutoffs,
    "p1_by_topic": cutoffs.p1_by_topic,
    "p2_found": budget.p2_found,
    "p2_budget": budget.p2_budget,
    "p2_texts": budget.p2_texts,
    "p2_bytes": budget.p2_bytes,
    "p3_found": sketch.p3_found,
    "p3_percentiles": sketch.p3_percentiles,
    "p3_daily": sketch.p3_daily,
    "p3_checked": sketch.p3_checked,
    "p4_found": overlap.p4_found,
    "p4_report": overlap.p4_report,
    "p4_exact": overlap.p4_exact,
    "p5_sample": sample.p5_sample,
    "p5_report": sample.p5_report,
    "p6_found": packing.p6_found,
    "p6_assignments": packing.p6_assignments,
    "p6_containers": packing.p6_containers,
    "p6_report": packing.p6_report,
    "p6_bytes": packing.p6_bytes,
    "p7_found": mixing.p7_found,
    "p7_mix": mixing.p7_mix,
    "p7_texts": mixing.p7_texts,
    "p7_tempered": mixing.p7_tempered,
    "p7_blocks": mixing.p7_blocks,
    "p8_found": level.p8_found,
    "p8_levels": level.p8_levels,
    "p8_profile": level.p8_profile,
}

_CUTS = f"""{WITH},
usable as (select * from records where loss is not null),
sized as (select u.*, t.keep_pct, count(*) over (partition by u.source) as n, row_number() over (partition by u.source order by loss, rank) as pos from usable u join source_targets t using (source)),
cuts as (select source, any_value(keep_pct) as keep_pct, any_value(n) as n, max((n * keep_pct + 99) // 100) as target, max(loss) filter (pos = (n * keep_pct + 99) // 100) as cutoff from sized group by source)
"""

_SLICES = f"""{WITH},
filled as (select rank, max(n_tokens_full) as pool_tokens from pool where n_tokens_full > 0 group by rank),
slices as (select source, topic, vigintile, count(*) as n_docs, sum(coalesce(count, pool_tokens, 0))::bigint as n_tokens from records left join filled using (rank) group by all),
shared as (select *, (sum(n_tokens) over ())::bigint as all_tokens from slices)
"""

_MEASURES = f"""{WITH},
usable as (select source, topic, 'mean_loss' as measure, loss::double as value from records where loss is not null
  union all select source, topic, 'n_tokens', count::double from records where count is not null),
ranked as (select *, count(*) over (partition by source, topic, measure) as n, row_number() over (partition by source, topic, measure order by value) as pos from usable)
"""

ORACLES = {
    "p1_found": f"{_CUTS} select rank from sized join cuts using (source) where loss <= cutoff",
    "p1_cutoffs": f"""{_CUTS} select source, cuts.keep_pct, cuts.n as n_usable, target, cutoff::double as cutoff, count(*) filter (loss <= cutoff) as n_kept,
        round(count(*) filter (loss <= cutoff) / any_value(cuts.n), 6) as kept_share from sized join cuts using (source) group by all""",
    "p1_by_topic": f"{_CUTS} select source, topic, count(*) as n_usable, count(*) filter (loss <= cutoff) as n_kept from sized join cuts using (source) group by all",
    "p2_found": f"{_SLICES} select source, topic, vigintile from shared where n_tokens * 300 >= all_tokens",
    "p2_budget": f"{_SLICES} select source, topic, vigintile, n_docs, n_tokens, round(n_tokens / all_tokens, 6) as share from shared",
    "p2_bytes": f"""with {CATALOG}, d as (select * exclude (lang), case regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})([-_].*)?$', 1) when 'eng' then 'en' when 'spa' then 'es' when 'fra' then 'fr' when 'fre' then 'fr' when 'deu' then 'de' when 'ger' then 'de'
        else coalesce(nullif(left(regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})([-_].*)?$', 1), 2), ''), 'und') end as lang from documents)
        select source, lang, topic, count(*) as n_docs, coalesce(sum(strlen(text)), 0)::bigint as n_tokens from {canonical('d')} group by all""",
    "p3_checked": f"{_MEASURES} select source, topic, measure, count(*) as n, true as within from ranked group by all",
    "p3_found": f"""{_MEASURES}, points as (select source, topic, measure, min(value) filter (pos * 100 >= n * 50) as p50, min(value) filter (pos * 100 >= n * 90) as p90,
        min(value) filter (pos * 100 >= n * 95) as p95 from ranked where n >= 50 group by all)
        select source, topic, measure from points where (measure = 'mean_loss' and p90 >= 1.5 * p50) or (measure = 'n_tokens' and p95 >= 6 * p50)""",
    "p5_sample": sample.SQL_SAMPLE,
    "p5_report": f"""with {CATALOG}, {KNOWN},
        firsts as (select row_id, source, topic, '' as vigintile from known where row_id >= 0 qualify row_number() over (partition by row_id order by added_at, shard, shard_offset, rank, source nulls last, topic nulls last) = 1)
        select source, count(*) as n_docs, count(*) filter ({sample.SQL_IN}) as n_sampled, round(count(*) filter ({sample.SQL_IN}) / count(*), 6) as rate from {canonical('firsts')} group by source""",
    # no text lies near the limit by any tokenizer, so words and marks can be counted instead
    "p6_found": r"select doc_id from documents where len(regexp_extract_all(text, '[\pL]+|[\pN]+|[^\s\pL\pN]')) > 2048",
    "p6_bytes": """select sum((b + 65535) // 65536)::bigint as items, count(*) filter (b > 65536) as divided_texts, sum(b)::bigint as bytes, 0::bigint as overfull, 0::bigint as misplaced, true as tight
        from (select strlen(text) as b from documents where text <> '')""",
    "p7_blocks": mixing.SQL_BLOCKS.replace("{catalog}", CATALOG).replace("{documents}", canonical("documents")),
    "p7_found": mixing.SQL_FOUND.replace("{catalog}", CATALOG).replace("{documents}", canonical("documents")),
}
