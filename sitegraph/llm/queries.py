"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, mixing, neardup, secrets, tokenbin, tokencount, topk, toxicity
from ._shared import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five candidates of the highest integer inner product for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written, indexed and read back by key."""
    return tokenbin.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from labelled rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations with its recovered role, rendered."""
    return chat.format_turns(table(spark, sf_dir, "conversations"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document under a mixture in which no source is read more than twice."""
    return mixing.mix(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and number of links of every document."""
    return neardup.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_top_k, op2_token_binary, op3_toxicity, op4_chat_formatting, op5_source_mixing, op6_language_id, op7_secret_scan, op8_ngram_jaccard_join, op9_benchmark_decontamination, op10_token_counts)}

_WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
_SHINGLES = """
  select {id} as id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
  from (select {id}, {words} as w from {table})"""

_OP9 = f"""
with d as ({_SHINGLES.format(id='doc_id', words=_WORDS, table='documents')}),
     b as ({_SHINGLES.format(id='item_id', words=_WORDS, table='benchmark')}),
     n as (select id, count(*) as n from b group by id)
select d.id as doc_id, b.id as item_id, any_value(n.n) as n_shingles, count(*) as n_shared, count(*) / any_value(n.n) as containment
from d join b on d.s = b.s join n on n.id = b.id
group by d.id, b.id having count(*) + 1e-9 >= 0.8 * any_value(n.n)"""

_OP8 = f"""
with recursive d as ({_SHINGLES.format(id='doc_id', words=_WORDS, table='documents')}),
  n as (select id, count(*) as n from d group by id),
  links as (select x.id as a, y.id as b from d x join d y on x.s = y.s and x.id <> y.id join n nx on nx.id = x.id join n ny on ny.id = y.id
    group by x.id, y.id, nx.n, ny.n having count(*) * 1.8 + 1e-6 >= 0.8 * (nx.n + ny.n)),
  reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select t.doc_id, least(t.doc_id, coalesce(r.m, t.doc_id)) as class_id, coalesce(l.c, 0) as n_links
from documents t left join (select a, min(b) as m from reach group by a) r on r.a = t.doc_id
left join (select a, count(*) as c from links group by a) l on l.a = t.doc_id"""

_OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
qualify rank <= 5"""



def _op7() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = (("assign", secrets.ASSIGN, 2, 6), ("access", secrets.ACCESS, 0, 20), ("hex", secrets.HEX, 0, 24), ("ident", secrets.IDENTITY, 2, 2), ("endpoint", secrets.ENDPOINT, 0, 8))
    found = " union all ".join(
        f"select rid, doc_id, '{k}' as kind, regexp_extract_all(text, {quoted(p)}, 0) as h, string_split_regex(text, {quoted(p)}) as g, {quoted(p)} as p, {n} as grp, {least} as least from t where regexp_matches(text, {quoted(p)})" for k, p, n, least in kinds
    )
    near = lambda c: f"(coalesce(max(case when {c} then e end) over behind >= s - {secrets.SCOPE}, false) or coalesce(min(case when {c} then s end) over ahead <= e + {secrets.SCOPE}, false))"
    number = " ".join(f"when '{k}' then {i}" for i, k in enumerate(secrets.KINDS))
    group = "length(case grp when 2 then case kind when 'assign' then regexp_extract(h[i], {a}, 2) else regexp_extract(h[i], {b}, 2) end else h[i] end)".format(a=quoted(secrets.ASSIGN), b=quoted(secrets.IDENTITY))
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
f as ({found}),
c as (select rid, doc_id, kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::bigint as s, length(h[i]) as n, {group} >= least as ok
  from (select *, unnest(range(1, len(h) + 1)) as i from f)),
e as (select rid, s, s + n as e, case when kind = 'assign' and not ok then 'weak' else kind end as kind from c where ok or kind = 'assign'),
w as (select *, kind in ('assign', 'access', 'hex') as base, {near("kind in ('assign', 'hex', 'weak')")} as secret, {near("kind in ('access', 'ident')")} as ident, {near("kind = 'endpoint'")} as endpoint,
    coalesce(max(case when kind in ('assign', 'access', 'hex') then e end) over behind > s, false) or coalesce(min(case when kind in ('assign', 'access', 'hex') then s end) over ahead < e, false) as covered
  from e window behind as (partition by rid order by s range between unbounded preceding and current row), ahead as (partition by rid order by s range between current row and unbounded following)),
k as (select rid, s, e, kind, base, case kind {number} end as number from w where base or (not covered and case kind when 'weak' then ident or endpoint when 'ident' then secret else secret and ident end)),
r as (select rid, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex, string_agg(concat_ws(':', kind, s, e), ',' order by s, number, e) filter (where base) as b,
    string_agg(concat_ws(':', kind, s, e), ',' order by s, number, e) as spans, count_if(not base) as n_linked from k group by rid)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from t left join r using (rid)"""


ORACLES: dict[str, str] = {"op7_secret_scan": _op7(), "op1_exact_top_k": _OP1, "op8_ngram_jaccard_join": _OP8, "op9_benchmark_decontamination": _OP9}
