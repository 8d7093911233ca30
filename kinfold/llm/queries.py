"""The operators over the whole tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import (ann, bpe, divergence, lines, minhash, negatives, packing, quality, sharding, spotsigs, substrings,
                         suffix_tree, text, token_files)
from kinfold.llm.text import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(text.id_text(documents(spark, sf_dir)))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op5_line_dedup"] = r"""
with numbered as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
split as (
  select row, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
  from numbered),
keyed as (
  select row, doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from split),
often as (
  select key, max(doc_id) as last_doc from keyed where length(key) >= 20 and doc_id is not null
  group by key having count(distinct row) >= 3),
marked as (
  select k.row, k.doc_id, place, line, o.key is not null and k.doc_id < o.last_doc as gone
  from keyed k left join often o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by row, doc_id"""


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir)).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def packing_encoder() -> Callable:
    """Ids of the vocabulary that ``byte_bpe_50k.json`` holds, from the same vocabulary as ranks."""
    import public_tokenizers
    return packing.vocabulary_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                      (("<|endoftext|>", 50256),))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), packing_encoder)


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(text.id_text(documents(spark, sf_dir)))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op2_substring_dedup"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w
  from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 48)) as place, w from words where len(w) >= 50),
hashed as (select doc_id, place, md5(array_to_string(w[place:place + 49], ' ')) as h from windows),
least as (select h, min(doc_id) as first_doc from hashed group by h),
lost as (select distinct doc_id, unnest(range(place, place + 50)) as gone
         from hashed join least using (h) where doc_id > first_doc),
lists as (select doc_id, list(gone) as gone from lost group by doc_id),
placed as (select words.doc_id, w, gone from words left join lists using (doc_id)),
cut as (select doc_id, len(w) as n_words, len(coalesce(gone, [])) as n_removed,
               list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)) as kept from placed)
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from cut"""


@query
def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(documents(spark, sf_dir))


@query
def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(documents(spark, sf_dir))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the corpus as one: bad is what is of no quality or toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (
        (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))


@query
def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(text.id_text(documents(spark, sf_dir)), labels_of(spark, sf_dir)).drop("text")


@query
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = text.importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def token_encoder() -> token_files.Encoder:
    import public_tokenizers
    return token_files.piece_encoder(public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = token_files.new_folder(spark)
    token_files.written_files(documents(spark, sf_dir), token_encoder, end=1, vocabulary=49408, root=root)
    return token_files.read_back(spark, root)


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(documents(spark, sf_dir))


ORACLE["op12_source_divergence"] = r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents),
occurring as (
  select row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as (select lang, term from occurring group by lang, term having count(distinct row) >= 3),
groups as (select distinct lang, source from docs),
counts as (
  select lang, source, term, count(*) as n from occurring join kept using (lang, term) group by lang, source, term),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over g + count(*) over g)::hugeint as p
  from dense window g as (partition by lang, source)),
whole as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n)::hugeint + 1))
    // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang))::hugeint as q
  from dense group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
both_parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // q from shares join whole using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
where part = 'pair' or rank <= 200"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = text.importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from rows a, rows b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (
         partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5"""
