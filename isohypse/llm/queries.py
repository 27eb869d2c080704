"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bins, codes, divergence, licenses, lines, ngram_join, packing, quality, tokens, toxicity, vectors
from .common import read


def vocabulary() -> str:
    """The public tokenizer's file; it is read where it lies, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.self_search(read(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(read(spark, sf_dir, "documents"), vocabulary())


def op6_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.first_lines(read(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.rate(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op12_vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_hnsw_nearest, op3_best_fit_packing, op4_toxicity_grammar, op5_bpe_encode_decode, op6_token_ids_orc, op7_fuzzy_line_dedup, op8_ngram_jaccard_join, op9_embedding_near_dedup, op10_quality_ordinal, op11_vector_codes, op12_vector_bins, op13_source_divergence)}


def _codes_sql(rounds: int = 4) -> str:
    """Product quantization in whole numbers: each round's assignment and means as relations of their own.

    Sums stay far under 2^53, so that products of doubles are exact.
    """
    nearest = """
near{k} as materialized (
    select r, p, any_value(x) x, arg_min(e, (d, e)) e, cast(min(d) as bigint) d
    from (select r, parts.p, parts.x, e, list_inner_product(parts.x, parts.x) - 2 * list_inner_product(parts.x, b.x) + list_inner_product(b.x, b.x) d
          from parts join book{k} b on parts.p = b.p)
    group by r, p)"""
    refined = """
sums{k} as (
    select p, e, i, cast(sum(cast(x[i] as bigint)) as bigint) s, count(*) n
    from near{k}, (select unnest(range(1, (select any_value(len(x)) + 1 from parts))) i) group by p, e, i),
means{k} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as double) order by i) x from sums{k} group by p, e),
book{next} as materialized (select b.p, b.e, coalesce(m.x, b.x) x from book{k} b left join means{k} m on b.p = m.p and b.e = m.e)"""
    steps = [nearest.format(k=k) + ("," + refined.format(k=k, next=k + 1) if k < rounds else "") for k in range(rounds + 1)]
    return f"""
with kept as materialized (
    select vec_id, label, row_number() over (order by vec_id nulls last, embedding) r, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) v
    from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] x from kept, (select unnest(range(4)) p)),
book0 as materialized (select p, r - 1 e, x from parts where r <= 256),
{",".join(steps)},
digest as (
    select sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by p, e, i)) h
    from (select p, e, unnest(x) c, unnest(range(1, len(x) + 1)) i from book{rounds})),
coded as (select r, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from near{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256
from coded join kept using (r), digest"""


#: Nearest vectors and cosines are left out: their sums' last bits differ between engines. The tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op13_source_divergence": r"""
with docs as (
    select row_number() over () d, coalesce(lang, '') lang, coalesce(source, '') source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
    from documents),
found as (select d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as materialized (select lang, term from found group by lang, term having count(distinct d) >= 3),
counts as materialized (select lang, source, term, count(*) n from found join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from docs),
sizes as (select lang, count(*) v from kept group by lang),
totals as (select lang, source, sum(n) total from counts group by lang, source),
p as materialized (
    select g.lang, g.source, k.term, coalesce(c.n, 0) n,
        cast(1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + s.v) as bigint) p
    from groups g join kept k on g.lang = k.lang join sizes s on g.lang = s.lang
    left join totals t on g.lang = t.lang and g.source = t.source
    left join counts c on g.lang = c.lang and g.source = c.source and k.term = c.term),
whole as (
    select lang, term, cast(1 + (cast(1000000000 as hugeint) * (sum(n) + 1)) // (any_value(total) + any_value(v)) as bigint) q
    from counts join (select lang, sum(n) total from counts group by lang) using (lang) join sizes using (lang)
    group by lang, term),
sums as (
    select a.lang, a.source, b.source item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) s
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (
    select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
leading_terms as (
    select lang, source, 'term' part, term item, (p - q) * (p - q) // q as value
    from p join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) rank
from (select * from pairs union all select * from leading_terms)
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 200
""",
    "op8_ngram_jaccard_join": r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
    from documents),
sets as (
    select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end s
    from words),
elements as (select doc_id, len(s) n, unnest(s) e from sets),
links as (
    select a.doc_id a, b.doc_id b from elements a join elements b on a.e = b.e and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(id, r) as (
    select a, b from links
    union
    select reach.id, links.b from reach join links on reach.r = links.a)
select sets.doc_id, cast(len(any_value(s)) as bigint) n_shingles, least(sets.doc_id, coalesce(min(r), sets.doc_id)) component_id
from sets left join reach on sets.doc_id = reach.id group by sets.doc_id
""",
}
