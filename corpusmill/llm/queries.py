"""Registered queries of this subpackage and the SQL that DuckDB can check them with.

Exact set operators have SQL over whole tables. Packing and mixing, whose sizes come from a tokenizer, have queries of what
must hold of their results. Trained models and sentence rules have no SQL; they are tested on held-out texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import furniture, markup, mixing, nearcopies, packing, personal, quality, repetition, splits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of a session and a folder of tables."""
    return {
        "p1_found": repetition.p1_found,
        "p1_bands": repetition.p1_bands,
        "p1_shares": repetition.p1_shares,
        "p2_found": nearcopies.p2_found,
        "p2_groups": nearcopies.p2_groups,
        "p3_found": quality.p3_found,
        "p3_statistics": quality.p3_statistics,
        "p4_found": furniture.p4_found,
        "p4_body": furniture.p4_body,
        "p5_found": markup.p5_found,
        "p5_clean": markup.p5_clean,
        "p6_found": splits.p6_found,
        "p6_report": splits.p6_report,
        "p7_pack": packing.p7_pack,
        "p7_fill": packing.p7_fill,
        "p7_invariants": packing.p7_invariants,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p8_invariants": mixing.p8_invariants,
        "p9_found": personal.p9_found,
        "p9_redacted": personal.p9_redacted,
    }


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_T = "(select dedup_threshold from filter_config where config_name = 'base' and updated_at is not null order by updated_at desc, config_id desc limit 1)"
_TEXTS = "(select distinct example_id, text from example where example_id is not null and text is not null)"
_SET = "list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))))"
_PHASES = "(select run_id, min(phase) as phase from (select run_id, case when said like 'val%' then 'val' when said like 'train%' then 'train' end as phase from (select run_id, lower(regexp_replace(phase, '[^A-Za-z]', '', 'g')) as said from checkpoints)) where run_id is not null and phase is not null group by 1)"
_REPEATED = f"""w as (select example_id, {_WORDS} as w from {_TEXTS}),
r as (select example_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) > 5),
g as (select example_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as h from r),
b as (select example_id, i, row_number() over (partition by example_id, h order by i) > 1 as again from g),
m as (select example_id, sum(least(5, i - coalesce(prev, i - 5))) as repeated from (select *, lag(i) over (partition by example_id order by i) as prev from b where again) group by 1),
share as (select distinct example_id, len(w) as n_words, coalesce(repeated, 0) as repeated from w left join m using (example_id))"""
_CLASSES = f"""w as (select example_id, {_WORDS} as w from {_TEXTS}),
s as (select distinct example_id, {_SET} as s from w where len(w) >= 3),
c as (select min(example_id) as c, s, len(s) as n, list(example_id) as ids from s group by s),
x as (select c, n, unnest(s) as t from c),
e as (select a.c as a, b.c as b, a.n as na, b.n as nb, count(*) as shared from x a join x b on a.t = b.t and a.c < b.c and least(a.n, b.n) >= {_T} * greatest(a.n, b.n) - 1e-9 group by all),
links as (select a, b from e where shared::double / (na + nb - shared) >= {_T}),
members as (select c, unnest(ids) as id from c)"""
_HITS = f"""w as (select example_id, phase, {_WORDS} as w from (select distinct example_id, phase, text from example join {_PHASES} using (run_id) where example_id is not null and text is not null)),
s as (select distinct example_id, phase, {_SET} as s from w where len(w) >= 3),
x as (select example_id, phase, unnest(s) as t, len(s) as n from s),
p as (select v.example_id as v, r.example_id as r, v.n as n, count(*) as shared from x v join x r on v.t = r.t and v.phase = 'val' and r.phase = 'train' and r.n >= {_T} * v.n - 1e-9 group by all),
hits as (select v, r from p where shared::double / n >= {_T})"""


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express over whole tables."""
    return {
        "p1_found": f"with {_REPEATED} select example_id from share where repeated > 0.30 * n_words",
        "p1_shares": f"with {_REPEATED} select example_id, n_words::int as n_words, repeated::int as repeated_words, round(repeated::double / greatest(n_words, 1), 8) as share from share",
        "p2_found": f"with {_CLASSES}, pairs as (select m.id as x, o.id as y from links join members m on m.c = a join members o on o.c = b union all select m.id, o.id from members m join members o on m.c = o.c and m.id < o.id) select least(x, y) as example_id_a, greatest(x, y) as example_id_b from pairs",
        "p2_groups": f"""with recursive {_CLASSES}, both_ways as (select a, b from links union all select b, a from links),
reach(c, r) as (select a, a from both_ways union select reach.c, b from reach join both_ways on a = r),
roots as (select c, min(r) as root from reach group by c), degree as (select a as c, count(*) as links from both_ways group by 1), sizes as (select c, len(ids) as copies from c)
select id as example_id, coalesce(root, c) as group_id, coalesce(links, 0) as links, copies from members left join roots using (c) left join degree using (c) join sizes using (c) where root is not null or copies > 1""",
        "p6_found": f"with {_HITS} select distinct least(v, r) as example_id_a, greatest(v, r) as example_id_b from hits where v <> r",
        "p6_report": f"""with {_HITS}, told as (select example_id, max(source) as source, max(run_id) as run_id from example where example_id is not null group by 1), hit as (select v as id from hits union select r from hits)
select phase as split, source, count(*) as records, count(id) as overlapping, round(count(id)::double / count(*), 6) as share from told join {_PHASES} using (run_id) left join hit on id = example_id group by 1, 2""",
        "p7_invariants": "select p.profile, count(*) as documents, 0::bigint as lost, 0::bigint as repeated, 0::bigint as overfull, 0::bigint as badly_cut from documents, (values ('three_way'), ('short_blocks')) p(profile) where text is not null and text <> '' group by 1",
        "p8_invariants": "select p.profile, source, count(*) as documents, 0::bigint as over_cap, 0::bigint as uneven, 0::bigint as off_budget from documents, (select distinct meta_name as profile from data_meta) p where source in ('c4', 'wiki', 'gutenberg') and text is not null and text <> '' group by 1, 2",
    }
