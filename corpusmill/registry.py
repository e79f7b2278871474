"""Registered queries of the core and the SQL that DuckDB can check them with.

Every query runs over its whole tables. Token queries use code points as ids, so that SQL can reproduce them; the
``subword_`` queries use the SentencePiece model and have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import cut, remove, shared_folder
from .functions import sql as S
from .functions import text as T
from .operators import clean, control, dedup, filters, order, stats, tokens
from .operators.chunk import explode_chunks
from .plans import pipeline
from .sources import readers, writers
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SEED = 42
BLOCK = 2048
VOCAB = 256
WEIGHTS = {"c4": 0.3, "wiki": 0.45, "gutenberg": 0.25}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    """Query name -> function of a session and a folder of tables."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL with the same result in DuckDB."""
    return dict(_SQL)


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return readers.spread(readers.table(spark, sf_dir, "documents").select("doc_id", *columns))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").filter("text is not null")


DOCS = "(select * from documents where text is not null)"

# Features.
_FEATURES = {
    "alpha_ratio": (T.alpha_ratio, S.alpha_ratio), "weird_ratio": (T.weird_ratio, S.weird_ratio), "punct_ratio": (T.punct_ratio, S.punct_ratio), "char_entropy": (T.entropy, S.entropy),
}
for _name, (_col, _sql) in _FEATURES.items():
    _add(_name, lambda s, d, n=_name, c=_col: _text(s, d).select("doc_id", F.round(c(F.col("text")), 8).alias(n)), f"select doc_id, round({_sql('text')}, 8) as {_name} from {DOCS}")
_add("sentence_count", lambda s, d: _text(s, d).select("doc_id", T.sentence_count(F.col("text")).cast("bigint").alias("sentences")), f"select doc_id, {S.sentence_count('text')}::bigint as sentences from {DOCS}")
_add("full_lines", lambda s, d: _text(s, d).select("doc_id", F.size(T.full_lines(F.col("text"))).cast("bigint").alias("n_lines")), f"select doc_id, len({S.full_lines('text')})::bigint as n_lines from {DOCS}")
_add("dedup_key", lambda s, d: _text(s, d).select("doc_id", T.dedup_key(F.col("text")).alias("key")), f"select doc_id, {S.dedup_key('text')} as key from {DOCS}")
_add("char_histogram", lambda s, d: stats.char_histogram(_text(s, d), "doc_id", "text"), f"select doc_id, ch, count(*) as n from (select doc_id, unnest({S.chars('text')}) as ch from {DOCS}) group by all")

# Single rules and verdicts.
for _rule in filters.RULES:
    _add(_rule.lower(), lambda s, d, r=_rule: _text(s, d).select("doc_id", filters.passes(r, F.col("text")).alias("passed")), f"select doc_id, ({filters.passes_sql(_rule, 'text')}) as passed from {DOCS}")
_add("global_verdict", lambda s, d: _docs(s, d, "text").select("doc_id", filters.reason(F.col("text"), filters.GLOBAL).alias("reason")), f"select doc_id, {filters.reason_sql('text', filters.GLOBAL)} as reason from documents")
_add("web_verdict", lambda s, d: _docs(s, d, "text").select("doc_id", filters.reason(F.col("text"), filters.WEB + filters.GLOBAL).alias("reason")), f"select doc_id, {filters.reason_sql('text', filters.WEB + filters.GLOBAL)} as reason from documents")


def _global(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d, "source", "text").select("source", filters.reason(F.col("text"), filters.GLOBAL).alias("reason"))


_GLOBAL_SQL = f"(select source, {filters.reason_sql('text', filters.GLOBAL)} as reason from documents)"
_add("filter_stats", lambda s, d: stats.filter_stats(_global(s, d)), f"select source, count(*) as total, count_if(reason = '') as passed, count(*) - count_if(reason = '') as rejected, round(count_if(reason = '')::double / count(*), 6) as pass_rate from {_GLOBAL_SQL} group by source")
_add(
    "filter_report", lambda s, d: stats.filter_report(_global(s, d)),
    f"select source, reason, n, percent, row_number() over (partition by source order by n desc, reason)::int as place from (select source, reason, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by source), 4) as percent from {_GLOBAL_SQL} group by source, reason) where reason <> ''",
)
_add("stream_stats", incremental.run_stats, f"select source, reason, count(*) as n from {_GLOBAL_SQL} group by all")
_add("stream_first_seen", incremental.run_first_seen, f"select distinct md5({S.dedup_key('text')}) as key from {DOCS}")

# Clean-up.
_LINES = f"(select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {DOCS})"
_LOW = f"lower({S.strip('x')})"
_NAME = r"regexp_replace(low, '^[= ]+|[= ]+$', '', 'g')"
_W0 = f"""with l as (select *, {_LOW} as low from {_LINES}),
h as (select *, (starts_with(low, '==') or ends_with(low, '==')) as head, ({' or '.join(f"contains({_NAME}, '{n}')" for n in clean.WIKI_SECTIONS)}) as hit from l),
k as (select *, coalesce(last_value(case when head then hit end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row), false) as skip from h)
select doc_id, coalesce(string_agg(x, chr(10) order by i) filter (where not skip), '') as cleaned from k group by doc_id"""
_W3_STEPS = (r"\{\{[^}]*\}\}", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"), (r"\[|\]", ""), (r"\n{3,}", "\n\n")


def _w3(t: str) -> str:
    for pattern, to in _W3_STEPS:
        to = "chr(10) || chr(10)" if to == "\n\n" else S.q(to)
        t = f"regexp_replace({t}, {S.q(pattern)}, {to}, 'g')"
    return S.strip(t)


def _first_sql(patterns: list[str], whole: bool) -> str:
    out = "null"
    for p in reversed(patterns):
        p = p.replace("WS", S.WS)
        group = f"length(regexp_extract(text, {S.q(f'(?is)^.*?(?:{p})')}, 0))" if whole else f"length(regexp_extract(text, {S.q(f'(?is)^(.*?)(?:{p})')}, 1))"
        out = f"case when regexp_matches(text, {S.q(f'(?i){p}')}) then {group} else {out} end"
    return out


_CHAPTER = clean.CHAPTER.replace("WS", S.WS)
_GUT0 = f"""with a as (select doc_id, text, {_first_sql(clean.START_MARKS, True)} as after, {_first_sql(clean.END_MARKS, False)} as stop, case when regexp_matches(text, {S.q(_CHAPTER)}) then length(regexp_extract(text, {S.q(f'(?s)^(.*?){_CHAPTER}')}, 1)) else -1 end as chapter from {DOCS}),
b as (select *, case when after is null then 0 when strpos(substr(text, after + 1), chr(10)) > 0 then after + strpos(substr(text, after + 1), chr(10)) else after end as b0,
case when stop is null then length(text) when strpos(reverse(substr(text, 1, stop)), chr(10)) > 0 then stop - strpos(reverse(substr(text, 1, stop)), chr(10)) else stop end as e0 from a),
c as (select *, case when b0 = 0 and chapter >= 0 then chapter else b0 end as b1 from b)
select doc_id, case when e0 > b1 then {S.strip('substr(text, b1 + 1, e0 - b1)')} else '' end as cleaned from c"""
_TOC_HEAD, _TOC_LINE = (p.replace("WS", S.WS).replace(r"\z", "$") for p in (clean.TOC_HEAD, clean.TOC_LINE))
_GUT1 = f"""with l as (select *, upper({S.strip('x')}) as u from {_LINES}),
h as (select *, regexp_matches(u, {S.q(_TOC_HEAD)}) as head, (length(u) < 80 and regexp_matches(u, {S.q(_TOC_LINE)})) as toc from l),
g as (select *, sum(head::int) over (partition by doc_id order by i) as grp from h),
k as (select *, row_number() over (partition by doc_id, grp order by i) - 1 as n, max((not toc and not head)::int) over (partition by doc_id, grp order by i) as over from g)
select doc_id, coalesce(string_agg(x, chr(10) order by i) filter (where not (grp > 0 and over = 0 and n <= 51)), '') as cleaned from k group by doc_id"""
_GUT3 = f"""with t as (select doc_id, regexp_replace(regexp_replace(text, {S.q('-' + chr(92) + 'n' + S.WS + '*')}, '', 'g'), '[ \\t]+', ' ', 'g') as text from {DOCS}),
l as (select doc_id, unnest(string_split(text, chr(10))) as r, generate_subscripts(string_split(text, chr(10)), 1) as i from t),
s as (select doc_id, i, {S.strip('r')} as x from l),
p as (select *, lag(x) over (partition by doc_id order by i) as prev from s),
f as (select *, (i > 1 and x <> '' and prev <> '' and not regexp_matches(prev, '[.!?:;"'']$') and not regexp_matches(x, '^\\p{{Lu}}')) as goes_on from p)
select doc_id, string_agg(case when i = 1 then x when goes_on then ' ' || x else chr(10) || x end, '' order by i) as cleaned from f group by doc_id"""
for _name, _fn, _sql in (
    ("wiki_strip_sections", clean.strip_wiki_sections, _W0), ("wiki_strip_markup", clean.strip_wiki_markup, f"select doc_id, {_w3('text')} as cleaned from {DOCS}"),
    ("gut_boilerplate", clean.strip_book_marks, _GUT0), ("gut_toc", clean.strip_toc, _GUT1), ("gut_normalize", clean.merge_wrapped, _GUT3),
):
    _add(_name, lambda s, d, f=_fn: _text(s, d).select("doc_id", f(F.col("text")).alias("cleaned")), _sql)


def _wiki_rows(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d).select("doc_id", clean.strip_wiki_markup(clean.strip_wiki_sections(F.col("text"))).alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n_chars"), filters.reason(F.col("c"), filters.WIKI + filters.GLOBAL).alias("reason"))


_add("wiki_verdict", _wiki_rows, f"select doc_id, length(c)::bigint as n_chars, {filters.reason_sql('c', filters.WIKI + filters.GLOBAL)} as reason from (select doc_id, {_w3('cleaned')} as c from ({_W0}))")


def _book_rows(s: SparkSession, d: str) -> DataFrame:
    c = clean.merge_wrapped(clean.strip_toc(clean.strip_book_marks(F.col("text"))))
    return _text(s, d).select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n_chars"), filters.reason(F.col("c"), ["GUT2_poetry_heavy", *filters.GLOBAL]).alias("reason"))


_BOOK_SQL = _GUT3.replace(DOCS, f"(select doc_id, cleaned as text from ({_GUT1.replace(DOCS, f'(select doc_id, cleaned as text from ({_GUT0}))')}))")
_add("book_verdict", _book_rows, f"select doc_id, length(cleaned)::bigint as n_chars, {filters.reason_sql('cleaned', ['GUT2_poetry_heavy', *filters.GLOBAL])} as reason from ({_BOOK_SQL})")


# Chunks, duplicates.
def _chunk_sql(texts: str, most: int = 8000, least: int = 500) -> str:
    """(doc_id, chunk_idx, chunk) of the relation ``texts`` (doc_id, text): a walk over the parts of each long text."""
    ends = S.q(rf"([.!?]){S.WS}+")
    return f"""with recursive src as materialized ({texts}),
parts as (select doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {S.strip('p')}), lambda p: p <> '')) as p, generate_subscripts(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {S.strip('p')}), lambda p: p <> ''), 1) as k from src where length(text) > {most}),
cells as (select doc_id, k, length(p) > {most} as s, case when length(p) > {most} then string_split(regexp_replace(p, {ends}, '\\1' || chr(1), 'g'), chr(1)) else [p] end as xs from parts),
flat as (select doc_id, k, s, unnest(xs) as x, generate_subscripts(xs, 1) as j from cells),
atoms as materialized (select doc_id, row_number() over (partition by doc_id order by k, j) as i, s and j = 1 as first, s and j > 1 as inner_s, x, length(x) + case when s then 0 else 2 end as size from flat),
walk(doc_id, i, n, grp) as (select doc_id, i, size, 0 from atoms where i = 1 union all
select a.doc_id, a.i, case when a.first or w.n + a.size > {most} then a.size else w.n + a.size end, w.grp + (a.first or w.n + a.size > {most})::int from walk w join atoms a on a.doc_id = w.doc_id and a.i = w.i + 1),
grouped as (select w.doc_id, w.grp, list(a.x order by a.i) as xs, arg_min(a.inner_s, a.i) as begins_inner from walk w join atoms a on a.doc_id = w.doc_id and a.i = w.i group by 1, 2),
joined as (select doc_id, grp, case when coalesce(lead(begins_inner) over (partition by doc_id order by grp), false) then array_to_string(xs, ' ') else array_to_string(xs, chr(10) || chr(10)) end as chunk from grouped),
every as (select doc_id, grp, chunk from joined where length(chunk) >= {least} union all select doc_id, 0, text from src where length(text) between {least} and {most})
select doc_id, (row_number() over (partition by doc_id order by grp) - 1)::int as chunk_idx, chunk from every"""


_add("chunk_text", lambda s, d: explode_chunks(_text(s, d)), _chunk_sql(f"select doc_id, text from {DOCS}"))
_add("short_chunks", lambda s, d: explode_chunks(_text(s, d).filter(F.length("text") <= 8000)), f"select doc_id, 0 as chunk_idx, text as chunk from {DOCS} where length(text) between 500 and 8000")


def _kept(s: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_docs(s, d, "pos", "text"), "text", "pos").select("doc_id")


_KEY = S.dedup_key("text")
_add("dedup_prefix", _kept, f"select arg_min(doc_id, pos) as doc_id from {DOCS} group by {_KEY}")
_add(
    "dedup_rejects",
    lambda s, d: _docs(s, d, "text").filter("text is not null").groupBy(F.md5(T.dedup_key(F.col("text"))).alias("k")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("documents"), F.count("*").alias("stored"), (F.sum("n") - F.count("*")).alias("rejects")),
    f"select count(*)::bigint as documents, count(distinct {_KEY}) as stored, count(*) - count(distinct {_KEY}) as rejects from {DOCS}",
)


def _incremental(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d, "source", "text").filter("text is not null")
    seen = docs.filter("source = 'wiki'").select(T.dedup_key(F.col("text")).alias("key"))
    return dedup.not_seen(docs.filter("source = 'c4'"), seen, "text").select("doc_id")


_add("dedup_against_seen", _incremental, f"select doc_id from {DOCS} where source = 'c4' and {_KEY} not in (select {_KEY} from {DOCS} where source = 'wiki')")


def _overlap(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d, "source", "text").filter("text is not null")
    return pipeline.overlap_report(docs.filter("source = 'c4'"), docs.filter("source <> 'c4'"))


_add("overlap_report", _overlap, f"with k as (select source = 'c4' as c, {_KEY} as key from {DOCS} where source is not null), u as (select key, bool_or(c) as a, bool_or(not c) as b from k group by key) select count_if(a) as keys_a, count_if(b) as keys_b, count_if(a and b) as shared from u")


def _split(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d).select("doc_id", pipeline.split_of(F.col("text"), 0.1).alias("split"))


_add("split_by_key", _split, f"select doc_id, case when ('0x' || substr(md5({_KEY}), 1, 8))::bigint::double / {float(1 << 32)} < 0.1 then 'val' else 'train' end as split from {DOCS}")

_GOOD_DOCS = f"(select doc_id, text from {DOCS} where {filters.reason_sql('text', filters.GLOBAL)} = '')"
_add("stream_chunks", incremental.run_chunks, f"select doc_id, chunk_idx, length(chunk)::bigint as n_chars, coalesce(sum(length(chunk)) over (order by pos, chunk_idx rows between unbounded preceding and 1 preceding), 0)::bigint as start from ({_chunk_sql(_GOOD_DOCS)}) join (select doc_id, pos from documents) using (doc_id)")

# Mixing, order, budgets.
_RATE = "case source " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + " end"
_DRAW = f"select doc_id, source, sum(-ln({order.uniform_sql(SEED, 'source', 'pos')}) / ({_RATE})) over (partition by source order by pos) as draw from documents where source in ('c4', 'wiki', 'gutenberg')"


def _drawn(s: SparkSession, d: str) -> DataFrame:
    return order.interleave(_docs(s, d, "pos", "source"), WEIGHTS, SEED)


_add("interleave", lambda s, d: order.running(_drawn(s, d), ["draw"], {"place": F.lit(1).cast("bigint")}).select("doc_id", "source", "place"), f"select doc_id, source, row_number() over (order by draw) - 1 as place from ({_DRAW})")


def _interleave_filter(s: SparkSession, d: str) -> DataFrame:
    rows = order.interleave(_docs(s, d, "pos", "source", "n_chars"), WEIGHTS, SEED)
    return order.running(rows, ["draw"], {"place": F.lit(1).cast("bigint")}).filter("n_chars >= 200").select("doc_id", "place")


_add("interleave_and_filter", _interleave_filter, f"select doc_id, place from (select doc_id, row_number() over (order by draw) - 1 as place from ({_DRAW})) join documents using (doc_id) where n_chars >= 200")
TOKENIZER_CHARS = 50_000_000
TARGET_TOKENS = 1_000_000_000
_LINE = S.strip("replace(text, chr(10), ' ')")
_add(
    "tokenizer_text", lambda s, d: writers.tokenizer_text(_docs(s, d, "pos", "text").filter("text is not null").drop("doc_id"), "pos", TOKENIZER_CHARS).select("pos", "line"),
    f"select pos, line from (select pos, line, coalesce(sum(length(line)) over (order by pos rows between unbounded preceding and 1 preceding), 0) as b from (select pos, {_LINE} as line from {DOCS}) where line <> '') where b < {TOKENIZER_CHARS}",
)
_add("token_budget", lambda s, d: order.within_budget(_docs(s, d, "pos", "n_chars"), "pos", F.col("n_chars") + 1, TARGET_TOKENS).select("doc_id", F.col("taken_before").cast("bigint").alias("taken_before")), f"select doc_id, b::bigint as taken_before from (select doc_id, coalesce(sum(n_chars + 1) over (order by pos rows between unbounded preceding and 1 preceding), 0) as b from documents) where b < {TARGET_TOKENS}")
_add("shuffle_order", lambda s, d: order.running(_docs(s, d).withColumn("k", order.shuffle_key(SEED)), ["k"], {"place": F.lit(1).cast("bigint")}).select("doc_id", "place"), f"select doc_id, row_number() over (order by md5(concat_ws('|', '{SEED}', doc_id::varchar))) - 1 as place from documents")
_add("shuffle_bounded", lambda s, d: order.running(_docs(s, d, "pos").withColumn("k", order.displaced_key(SEED, 1000)), ["k", "pos"], {"place": F.lit(1).cast("bigint")}).select("doc_id", "place"), f"select doc_id, row_number() over (order by pos + {order.uniform_sql(SEED, 'pos')} * 1000, pos) - 1 as place from documents")


def _basic(s: SparkSession, d: str) -> DataFrame:
    t = F.substring("text", 1, 100_000)
    rows = _docs(s, d, "source", "text").filter(F.length("text") >= 200).withColumn("text", t)
    out = rows.withColumn("cleaned", F.when(F.col("source") == "gutenberg", pipeline.cleaned(F.lit("gutenberg"), F.col("text"))).when(F.col("source") == "wiki", pipeline.cleaned(F.lit("wiki"), F.col("text"))).otherwise(F.col("text")))
    return out.filter(F.length("cleaned") >= 200).select("doc_id", F.length("cleaned").cast("bigint").alias("n_chars"))


_CUT = "(select doc_id, source, substr(text, 1, 100000) as text from documents where length(text) >= 200)"


def _of(sql: str, source: str) -> str:
    return sql.replace(DOCS, f"(select * from {_CUT} where source = '{source}')")


_add(
    "tokenizer_filter", _basic,
    f"select doc_id, length(cleaned)::bigint as n_chars from (select doc_id, text as cleaned from {_CUT} where source is null or source not in ('wiki', 'gutenberg') union all select doc_id, {_w3('cleaned')} from ({_of(_W0, 'wiki')}) union all select doc_id, cleaned from ({_of(_BOOK_SQL, 'gutenberg')})) where length(cleaned) >= 200",
)

# Token stream, code points as ids.
def _chars(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return _docs(s, d, *columns, "text").filter("text is not null and text <> ''")


def _ids(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return tokens.code_points(_chars(s, d, *columns), "text")


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return _chars(s, d, "pos").select("doc_id", "pos", (F.length("text") + 1).cast("bigint").alias("n_tokens"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    """Texts with their places, ordered by sizes alone; ids are made after the join, which so moves texts and not arrays."""
    placed = order.running(_sizes(s, d), ["pos"], {"start": "n_tokens"})
    rows = order.joined_back(_chars(s, d, "pos").select("pos", "text"), placed, ["pos"])
    return tokens.code_points(rows, "text").withColumn("packed", F.concat("ids", F.array(F.lit(2)))).drop("ids")


def _stream(s: SparkSession, d: str) -> DataFrame:
    return tokens.stream(_packed(s, d))


def _plain(s: SparkSession, d: str) -> DataFrame:
    """Tokens without their places, where the order doesn't matter."""
    return _ids(s, d).select(F.explode(F.concat("ids", F.array(F.lit(2)))).alias("token"))


_CH = "(select * from documents where text is not null and text <> '')"
_TOK = f"(select unnest(list_transform(list_append({S.chars('text')}, chr(2)), lambda c: unicode(c))) as token from {_CH})"
_POS = f"(select row_number() over (order by p, i) - 1 as pos, token from (select pos as p, unnest(list_transform(list_append({S.chars('text')}, chr(2)), lambda c: unicode(c))) as token, generate_subscripts(list_append({S.chars('text')}, chr(2)), 1) as i from {_CH}))"
_add("pack_offsets", lambda s, d: order.running(_sizes(s, d), ["pos"], {"start": "n_tokens"}).select("doc_id", "n_tokens", "start"), f"select doc_id, length(text) + 1 as n_tokens, coalesce(sum(length(text) + 1) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from {_CH}")
_add("token_histogram", lambda s, d: stats.token_histogram(_plain(s, d)), f"select token, count(*) as n from {_TOK} group by token")
_add("token_range", lambda s, d: stats.token_range(_plain(s, d), VOCAB), f"select min(token) as min_id, max(token) as max_id, count(*) as total, count_if(token >= {VOCAB}) as out_of_range, count_if(token < {VOCAB}) as in_range, round(count_if(token >= {VOCAB})::double / count(*), 8) as out_share, true as consistent from {_TOK}")
_add("special_shares", lambda s, d: stats.special_shares(_plain(s, d)), f"select s.token, count(t.token) as n, round(count(t.token)::double / (select count(*) from {_TOK}), 8) as share from (select unnest([0, 1, 2, 3]) as token) s left join {_TOK} t on s.token = t.token group by s.token")
_add("top_tokens", lambda s, d: stats.top_tokens(_plain(s, d), 20), f"select token, count(*) as n from {_TOK} group by token order by n desc, token limit 20")
_joined = lambda c: F.md5(F.concat_ws(",", c.cast("array<string>")))
_add(
    "sequential_blocks", lambda s, d: tokens.blocks(_packed(s, d), BLOCK).select("block", _joined(F.col("x")).alias("x"), _joined(F.col("y")).alias("y")),
    f"with t as (select * from {_POS}), b as (select pos // {BLOCK} as block, string_agg(token::varchar, ',' order by pos) as x, count(*) as n from t group by 1), y as (select (pos - 1) // {BLOCK} as block, string_agg(token::varchar, ',' order by pos) as y, count(*) as n from t where pos > 0 group by 1) select block::bigint as block, md5(x) as x, md5(y) as y from b join y using (block) where b.n = {BLOCK} and y.n = {BLOCK}",
)
SAMPLES = 64


def _random(s: SparkSession, d: str) -> DataFrame:
    packed = cut(_packed(s, d))
    end = packed.agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))  # one row
    starts = end.select(F.explode(tokens.random_starts(F.col("n"), BLOCK, SAMPLES, SEED)).alias("start")).distinct()
    return tokens.slices(packed, F.broadcast(starts), BLOCK).select("start", _joined(F.col("x")).alias("x"))  # 64 rows


_add(
    "random_blocks", _random,
    f"with t as (select * from {_POS}), s as (select distinct floor({order.uniform_sql(SEED, 'i')} * ((select count(*) from t) - {BLOCK} - 1))::bigint as start from (select unnest(range({SAMPLES})) as i)) select start, md5(string_agg(token::varchar, ',' order by pos)) as x from s join t on pos >= start and pos < start + {BLOCK} group by start",
)
MICROSET = 5_000_000
_add("microset", lambda s, d: tokens.head(_packed(s, d), MICROSET), f"select pos, token from {_POS} where pos < {MICROSET}")


def _eos(s: SparkSession, d: str) -> DataFrame:
    ends = tokens.eos_places(_packed(s, d))
    return order.running(ends, ["end"], {"doc": F.lit(1).cast("bigint")})


_add("eos_documents", _eos, f"select row_number() over (order by pos) - 1 as doc, pos as \"end\" from {_POS} where token = 2")


def _repl(s: SparkSession, d: str) -> DataFrame:
    packed = cut(_packed(s, d))
    end = packed.agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))  # one row
    starts = end.select(F.explode(tokens.random_starts(F.col("n"), 40, SAMPLES, SEED + 1, inclusive=True)).alias("start")).distinct()
    return tokens.slices(packed, F.broadcast(starts), 40).select("start", F.md5(F.array_join("x", ",")).alias("x"), tokens.listed(F.col("x"), 8).alias("shown"))  # 64 rows


_add(
    "repl_samples", _repl,
    f"with t as (select * from {_POS}), s as (select distinct floor({order.uniform_sql(SEED + 1, 'i')} * ((select count(*) from t) - 40))::bigint as start from (select unnest(range({SAMPLES})) as i)) select start, md5(string_agg(token::varchar, ',' order by pos)) as x, string_agg(token::varchar, ', ' order by pos) filter (where pos < start + 8) || ', ...' as shown from s join t on pos >= start and pos < start + 40 group by start",
)


def _until(s: SparkSession, d: str) -> DataFrame:
    rows = _ids(s, d).select("doc_id", tokens.until_eos(F.col("ids"), 10, (0, 1, 10, 32)).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n"), _joined(F.col("ids")).alias("ids"))


_KEPT = "list_filter(list_transform(regexp_extract_all(string_split(text, chr(10))[1], '(?s).'), lambda c: unicode(c)), lambda t: t not in (0, 1, 10, 32))"
_add("decode_until_eos", _until, f"select doc_id, len({_KEPT})::bigint as n, md5(coalesce(array_to_string({_KEPT}, ','), '')) as ids from {_CH}")
def _parse(s: SparkSession, d: str) -> DataFrame:
    """Lists of ids in any text: what stands between commas and white space, null where it is no number of up to nine digits."""
    pieces = F.filter(F.split("text", f"(?:,|{T.WS})+"), lambda x: x != "")
    ids = F.transform(pieces, lambda x: F.when(F.rlike(x, F.lit(r"\A[+-]?[0-9]{1,9}\z")), x.try_cast("int")))
    rows = _text(s, d).select("doc_id", ids.alias("ids"))
    known = F.filter("ids", lambda i: i.isNotNull())
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.size(known).cast("bigint").alias("n_ids"), F.md5(F.array_join(known, ",")).alias("ids"))


_PIECES = rf"list_filter(string_split(regexp_replace(text, '(,|{S.WS})+', ',', 'g'), ','), lambda x: x <> '')"
_IDS = f"list_transform(list_filter({_PIECES}, lambda x: regexp_full_match(x, '[+-]?[0-9]{{1,9}}')), lambda x: x::int)"
_add("parse_ids", _parse, f"select doc_id, len({_PIECES})::bigint as n_pieces, len({_IDS})::bigint as n_ids, md5(coalesce(array_to_string({_IDS}, ','), '')) as ids from {DOCS}")


# Subword tokens: no SQL.
def _subwords(s: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_docs(s, d, "pos", "text").filter("text is not null"), "text")


_add("subword_pack", lambda s, d: tokens.pack(cut(_subwords(s, d)), "pos").select("doc_id", "start", F.col("n_tokens").cast("int").alias("n_tokens")))
_add("subword_histogram", lambda s, d: stats.token_histogram(_subwords(s, d).select(F.explode("ids").alias("token")), 32000))
_add("subword_marked", lambda s, d: tokens.marked(tokens.blocks(tokens.pack(cut(_subwords(s, d)), "pos"), BLOCK).select("block", F.col("x").alias("ids"))))
_add("subword_decode", lambda s, d: tokens.decode(_subwords(s, d).select("doc_id", "ids")))

def _pieces(s: SparkSession, d: str) -> DataFrame:
    top = stats.top_tokens(_subwords(s, d).select(F.explode("ids").alias("token")), 50)
    return top.join(F.broadcast(tokens.vocabulary(s)), "token")  # a fixed vocabulary


_add("subword_pieces", _pieces)


def _binary(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "tokens")
    n = tokens.write_binary(_packed(s, d), path, 0x110000)
    try:
        return cut(stats.token_range(tokens.read_binary(s, path, 4, n), VOCAB))
    finally:
        remove(s, path)


_add("binary_scan", _binary, _SQL["token_range"])


def _headers(s: SparkSession, d: str) -> DataFrame:
    end = _text(s, d).filter("text <> ''").agg(F.sum(F.length("text") + 1).alias("total"))  # one row
    b = tokens.blocks(_packed(s, d), BLOCK).crossJoin(F.broadcast(end))
    total, start = F.col("total"), F.col("block") * BLOCK
    return b.select(
        "block", tokens.step_start(start, BLOCK, total, True).alias("next"), tokens.step_start(start, BLOCK, total, False).alias("previous"), tokens.sample_header(start, F.col("x"), total, 5).alias("header")
    )


_add("sample_headers", _headers, f"""with p as (select * from {_POS}), n as (select count(*) as total from p), t as (select pos // {BLOCK} as block, list(token order by pos) as x from p group by 1), b as (select block::bigint as block, x, total, list_filter(list_transform(range(len(x)), lambda i: case when x[i + 1] = 2 then i end), lambda i: i is not null) as e from t, n where len(x) = {BLOCK} and (block + 1) * {BLOCK} < total)
select block, least(block * {BLOCK} + {BLOCK}, greatest(total - {BLOCK} - 1, 0)) as next, greatest(block * {BLOCK} - {BLOCK}, 0) as previous, printf('offset %d (%.2f%%), eos at [%s], %d documents, ids %s', block * {BLOCK}, 100.0::double * (block * {BLOCK}) / total, coalesce(array_to_string(e, ', '), ''), len(e) + 1, array_to_string(x[1:5], ', ') || ', ...') as header from b""")


def _metadata(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d, "source", "text").filter("text is not null").withColumn("split", pipeline.split_of(F.col("text"), 0.1))
    sizes = docs.groupBy("split").agg(F.sum(F.length("text")).alias("n_tokens"))
    report = _global(s, d).filter("source is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))
    return writers.metadata(sizes, report, {"vocab_size": VOCAB, "dtype": tokens.dtype_of(VOCAB), "eos_token_id": 2}).select("train_tokens", "val_tokens", "vocab_size", "dtype", F.size("train_stats").alias("n_stats"))


_add("data_metadata", _metadata, f"select coalesce(sum(length(text)) filter (where split = 'train'), 0)::bigint as train_tokens, coalesce(sum(length(text)) filter (where split = 'val'), 0)::bigint as val_tokens, {VOCAB} as vocab_size, 'uint16' as dtype, (select count(*) from (select distinct source, reason from {_GLOBAL_SQL} where source is not null))::int as n_stats from (select text, case when ('0x' || substr(md5({_KEY}), 1, 8))::bigint::double / {float(1 << 32)} < 0.1 then 'val' else 'train' end as split from {DOCS})")

# Runs: checkpoints, budgets, retention.
_LAST = "(select * from (select *, row_number() over (partition by run_id order by saved_at desc, checkpoint_id desc, ingested_at desc) as rn from checkpoints where run_id is not null) where rn = 1)"


def _last_states(s: SparkSession, d: str) -> DataFrame:
    rows = readers.table(s, d, "checkpoints").filter("run_id is not null")
    newest = F.max_by(F.struct("checkpoint_id", "tokens_written", "docs_processed", "elapsed_seconds"), F.struct("saved_at", "checkpoint_id", "ingested_at"))
    return rows.groupBy("run_id").agg(newest.alias("r")).select("run_id", "r.*")


_add("last_checkpoint", lambda s, d: _last_states(s, d), f"select run_id, checkpoint_id, tokens_written, docs_processed, elapsed_seconds from {_LAST}")


def _times(s: SparkSession, d: str) -> DataFrame:
    """When each state was saved, as its file says it."""
    rows = readers.table(s, d, "checkpoints").select("checkpoint_id", "saved_at").filter("saved_at is not null").distinct()
    return rows.select("checkpoint_id", F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


_add("state_times", _times, "select distinct checkpoint_id, strftime(saved_at, '%Y-%m-%dT%H:%M:%SZ') as timestamp from checkpoints where saved_at is not null")


def _budget(s: SparkSession, d: str) -> DataFrame:
    speed = F.try_divide(F.col("tokens_written").cast("double"), F.col("elapsed_seconds"))
    cost, fits, steps = stats.steps_within_budget(F.lit(2e9), F.col("tps"), F.lit(0.35), F.lit(100.0), F.lit(262144.0))
    return _last_states(s, d).withColumn("tps", speed).select("run_id", F.round(cost, 6).alias("cost"), fits.alias("fits"), steps.cast("bigint").alias("steps"))


_GOOD = "tokens_written > 0 and elapsed_seconds > 0"
_COST = "2e9::double / (tokens_written::double / elapsed_seconds) / 3600.0::double * 0.35::double"
_add("budget_guard", _budget, f"select run_id, case when {_GOOD} then round({_COST}, 6) end as cost, case when {_GOOD} then {_COST} <= 100 end as fits, case when {_GOOD} and {_COST} <= 100 then ceil(2e9::double / 262144)::bigint end as steps from {_LAST}")
_add(
    "best_checkpoints", lambda s, d: stats.best(readers.table(s, d, "checkpoints").select("run_id", "checkpoint_id", "elapsed_seconds").filter("run_id is not null").distinct(), "run_id", "elapsed_seconds", "checkpoint_id", 2),
    "select run_id, checkpoint_id, elapsed_seconds, place::int as place from (select *, row_number() over (partition by run_id order by elapsed_seconds asc nulls last, checkpoint_id) as place from (select distinct run_id, checkpoint_id, elapsed_seconds from checkpoints where run_id is not null)) where place <= 2",
)


def _settings(s: SparkSession, d: str) -> DataFrame:
    """Every event as a command that sets its type's value for a user: what each user's settings are in the end."""
    sent = readers.table(s, d, "events").select("user_id", "event_id", F.lit("set").alias("cmd"), F.concat(F.lit("checks."), "event_type").alias("path"), "value")
    return control.updates(sent, ["user_id"], "event_id").select("user_id", "path", F.round("value", 6).alias("value"))


_add("runtime_updates", _settings, "select user_id, 'checks.' || event_type as path, round(arg_max(value, event_id), 6) as value from events where event_type is not null group by all")


def _retention(s: SparkSession, d: str) -> DataFrame:
    files = readers.table(s, d, "data_meta").select(F.col("meta_name").alias("name"), F.col("block_size").alias("size"))
    return stats.to_delete(files, files.filter("name = 'even'"), 5000)


_add("retention", _retention, "select name from (select name, total, coalesce(sum(size) over (order by name rows between unbounded preceding and 1 preceding), 0) as b from (select meta_name as name, block_size as size, (select sum(block_size) from data_meta) as total from data_meta) where name <> 'even') where total - b > 5000")
_add("perplexity", lambda s, d: stats.perplexity(_losses(s, d), "run_id", "loss"), "select run_id, round(avg(loss), 6) as loss, round(exp(least(avg(loss), 20)), 6) as perplexity from (select run_id, tokens_written::double / greatest(docs_processed, 1) / 100 as loss from checkpoints where run_id is not null) group by run_id")


def _losses(s: SparkSession, d: str) -> DataFrame:
    return readers.table(s, d, "checkpoints").filter("run_id is not null").select("run_id", (F.col("tokens_written").cast("double") / F.greatest("docs_processed", F.lit(1)) / 100).alias("loss"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    """Documents written as samples (lines of JSON) and read back."""
    path = shared_folder(s, "samples")
    try:
        writers.write_samples(_text(s, d), path, "jsonl")
        return cut(s.read.schema("doc_id bigint, text string").json(path).select("doc_id", F.md5("text").alias("text")))
    finally:
        remove(s, path)


_add("sample_sink", _samples, f"select doc_id, md5(text) as text from {DOCS}")
_add("record_source", lambda s, d: readers.shuffled(readers.records(s, f"{d}/example.parquet").withColumn("k", F.md5("text")), SEED, "k").groupBy("k").agg(F.count("*").alias("n")), "select md5(text) as k, count(*) as n from example group by 1")

# Whole pipelines.
_CLEANED = f"""select doc_id, source, text as clean from documents where source = 'c4' and text is not null
union all select doc_id, 'wiki', c from (select doc_id, {_w3('cleaned')} as c from ({_W0.replace(DOCS, "(select * from documents where source = 'wiki' and text is not null)")}))
union all select doc_id, 'gutenberg', cleaned from ({_BOOK_SQL.replace(DOCS, "(select * from documents where source = 'gutenberg' and text is not null)")})"""
_JUDGED = f"""select doc_id, source, clean, case source when 'c4' then {filters.reason_sql('clean', filters.WEB + filters.GLOBAL)} when 'wiki' then {filters.reason_sql('clean', filters.WIKI + filters.GLOBAL)} else {filters.reason_sql('clean', filters.GLOBAL)} end as reason from ({_CLEANED})
union all select doc_id, source, null, 'null_text' from documents where source in ('c4', 'wiki', 'gutenberg') and text is null"""
_add("pipeline_verdicts", lambda s, d: pipeline.verdicts(_docs(s, d, "source", "text")).select("doc_id", "reason"), f"select doc_id, reason from ({_JUDGED})")
_PASSING = f"(select doc_id, clean as text from ({_JUDGED}) where reason = '')"
_add(
    "pipeline_mixed", lambda s, d: pipeline.outcomes(_docs(s, d, "source", "text")),
    f"select source, outcome, count(*) as n from (select source, case when reason <> '' then reason when doc_id in (select doc_id from ({_chunk_sql(_PASSING)})) then 'pass' else 'empty' end as outcome from ({_JUDGED})) group by all",
)
_add(
    "pipeline_corpus", lambda s, d: pipeline.corpus(_docs(s, d, "pos", "source", "text"), weights=WEIGHTS).select("doc_id", "source", "chunk_idx", F.length("chunk").alias("n_chars")),
    f"with c as (select * from ({_chunk_sql(_PASSING)}) join (select doc_id, source, draw from ({_DRAW})) using (doc_id)), k as (select *, row_number() over (partition by {S.dedup_key('chunk')} order by draw, doc_id, chunk_idx) as rn from c) select doc_id, source, chunk_idx, length(chunk)::int as n_chars from k where rn = 1",
)


def _pipeline_packed(s: SparkSession, d: str) -> DataFrame:
    """From records to the packed stream of all chunks."""
    pieces = pipeline.corpus(_docs(s, d, "pos", "source", "text"), weights=WEIGHTS)
    packed = pipeline.packed_corpus(pieces, None, lambda df: tokens.encode(df, "chunk"))
    return packed.select("doc_id", "chunk_idx", "start", F.size("packed").cast("bigint").alias("n_tokens"), F.md5(F.array_join("packed", ",")).alias("ids"))


_add("pipeline_packed", _pipeline_packed)
