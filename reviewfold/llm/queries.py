"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewfold.llm.alignment import align_tokens
from reviewfold.llm.common import crc_mod, read_table
from reviewfold.llm.content_sort import content_groups
from reviewfold.llm.divergence import source_divergence
from reviewfold.llm.language_id import fit_language_id
from reviewfold.llm.near_dup import near_duplicates
from reviewfold.llm.ngram_model import score_texts
from reviewfold.llm.packing import pack
from reviewfold.llm.shards import shard_documents
from reviewfold.llm.spans import drop_repeated_spans
from reviewfold.llm.token_counts import token_counts
from reviewfold.llm.topk import top_k
from reviewfold.llm.toxicity import fit_toxicity
from reviewfold.llm.word_table import encode_round_trip

N_SHARDS = 8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def op1_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, is_query=F.col("id") % 50 == 0, k=5)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as query_id, b.vec_id,
         cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""


def op2_bloom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir), train=crc_mod("doc", 5) != 1)


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(_documents(spark, sf_dir)).select("doc_id", "n_sentences", "n_removed", "text")


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(_documents(spark, sf_dir)).drop("points")


OP4_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from t window w as (partition by norm order by points desc, doc_id)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), limit=2048)


def op6_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_round_trip(_documents(spark, sf_dir))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = fit_toxicity(docs, labels, train=crc_mod("doc", 5) != 0)
    scored = model.score(docs)
    return scored.withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(_documents(spark, sf_dir), N_SHARDS)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.col("grown_shard"))


def op10_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=4, threshold=80)


OP10_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reach as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
group by d.doc_id, s.n
"""


def op11_translate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents", "text", "lang", "source"))


OP11_SQL = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), w as (
  select row, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select row, lang, source, unnest(words) as word from d)
), kept as (
  select lang, term, count(*) as total from w group by lang, term having count(distinct row) >= 3
), langs as (
  select d.lang, (select count(*) from kept k where k.lang = d.lang) as v,
         (select coalesce(sum(total), 0) from kept k where k.lang = d.lang) as n
  from (select distinct lang from d) d
), counts as (
  select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all
), groups as (
  select g.lang, g.source, l.v, coalesce(sum(c.n), 0) as n
  from (select distinct lang, source from d) g join langs l using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source group by g.lang, g.source, l.v
), probs as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + cast(1000000000 * (coalesce(c.n, 0) + 1) as hugeint) // cast(g.n + g.v as hugeint) as p,
         1 + cast(1000000000 * (k.total + 1) as hugeint) // cast(l.n + l.v as hugeint) as q
  from groups g join kept k using (lang) join langs l using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value
  from probs where n > 0 and p > q
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from probs a join probs b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 200
"""


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit_language_id(docs, train=crc_mod("doc", 5) != 0)
    return model.predict(docs).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op13_merge_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_threshold_search, op2_bloom_model, op3_sentence_spans, op4_content_sort, op5_token_counts, op6_word_table, op7_best_fit, op8_string_kernel, op9_jump_shards, op10_hamming_join, op11_translate_audit, op12_kneser_ney, op13_merge_asof)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_threshold_search": OP1_SQL, "op4_content_sort": OP4_SQL, "op10_hamming_join": OP10_SQL, "op11_translate_audit": OP11_SQL}
