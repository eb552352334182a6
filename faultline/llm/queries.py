"""The driver's queries over the operators of this subpackage, and DuckDB equivalents where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from faultline.llm import bpe_codec, conversation_repair, exact_dedup, html_text, jaccard, language_id, license_scan, packing, quality, simhash, spelling, token_counts, topk_search
from faultline.llm.shared import table


def vocabulary(name: str) -> str:
    """The file of a public tokenizer: in the folder that PUBLIC_TOKENIZERS names, else where the package has it."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_bpe_codec(spark, sf_dir):
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.language_id(docs, language_id.learn(docs))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_topk_search(spark, sf_dir):
    return topk_search.top_k_neighbours(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark, sf_dir):
    harmed = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_summary(harmed, F.col("dropped"))


def op12_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with digests as (
    select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as digest
    from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by digest) as group_size,
       row_number() over best = 1 as kept, digest as text_sha256
from digests
window best as (partition by digest order by n_chars desc, doc_id)
"""

OP9_SQL = """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as parts
    from embeddings
    where embedding is not null and vec_id is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.parts, v.parts) as bigint) as score
    from vectors q join vectors v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from scores)
select * from ranked where rank <= 5
"""

OP12_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as grams
    from words),
items as (select doc_id, len(grams) as n, unnest(grams) as gram from sets),
pairs as (
    select x.doc_id as a, y.doc_id as b
    from items x join items y on x.gram = y.gram and x.doc_id < y.doc_id
    group by x.doc_id, y.doc_id, x.n, y.n
    having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
from sets s left join reach r on r.a = s.doc_id
group by s.doc_id, s.grams
"""


def llm_queries() -> dict:
    found = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_bpe_codec, op4_simhash_near_dedup, op5_html_extraction,
                                     op6_best_fit_packing, op7_language_id, op8_exact_dedup, op9_topk_search, op10_quality_classifier, op11_conversation_repair, op12_ngram_jaccard_join,
                                     op13_spelling_variants)}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def llm_oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op8_exact_dedup": OP8_SQL, "op9_topk_search": OP9_SQL, "op12_ngram_jaccard_join": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
