"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import bpe, decontamination, divergence, forest, html, negatives, ngram_join, quality, suffixes, topk, toxicity, urls, warc
from ledgerflow.llm.urls import Rule
from ledgerflow.llm.tables import table


# The stated URL rules.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_ngram_join": op5_ngram_join,
    "op6_decontamination": op6_decontamination,
    "op7_top_k": op7_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_minhash_forest": op11_minhash_forest,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": """
        with recursive cut as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
        ), part as (
            select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut
        ), rules(rh, rp, rv) as (
            values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fit as (
            select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as stated
            from part join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
        ), known as (
            select p.page_id, host, path, rule, stated,
                   list_distinct(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x)
                     || case when host <> '' then ['top=' || list_filter(string_split(host, '.'), lambda x: x <> '')[-1]] else [] end
                     || list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' and not regexp_matches(x, '^[0-9]+$')), lambda x: 'path=' || x)) as tokens
            from part p left join fit f on p.page_id = f.page_id
        ), taught as (select page_id, stated, unnest(tokens) as t from known where stated is not null),
        total as (select count(*) as n, ceil(0.01 * count(*)) as least from known where stated is not null),
        ante as (
            select page_id, stated, [t] as items from taught
            union all select a.page_id, a.stated, list_append(a.items, b.t) from ante a join taught b on a.page_id = b.page_id and a.items[-1] < b.t
        ), freq as (select items, count(*) as f from ante group by items),
        raw as (
            select a.items, a.stated as verdict, count(*) / any_value(f)::double as confidence, count(*) as support
            from ante a join freq q on a.items = q.items group by a.items, a.stated
            having count(*) >= (select least from total) and count(*) / any_value(f)::double >= 0.9
        ), mined as (
            select * from raw r where not exists (
                select 1 from raw o where len(o.items) < len(r.items) and len(list_intersect(o.items, r.items)) = len(o.items) and o.verdict = r.verdict and o.confidence >= r.confidence)
        ), guess as (
            select page_id, arg_max(verdict, (confidence, support, len(items), case verdict when 'block' then 1 else 0 end)) as verdict
            from known join mined on len(list_intersect(tokens, items)) = len(items) where stated is null group by page_id
        )
        select k.page_id, host, path, rule, coalesce(stated, g.verdict, 'allow') as verdict from known k left join guess g on k.page_id = g.page_id
    """,
    "op3_suffix_dedup": """
        with body as (select doc_id, hex(encode(coalesce(text, ''))) as x, (length(hex(encode(coalesce(text, '')))) // 2)::bigint as n from documents),
        string as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as g from (select doc_id, x, unnest(range(n - 99)) as i from body where n >= 100)),
        again as (
            select doc_id, i from (select doc_id, i, min(doc_id * 16777216 + i) over (partition by g) as first from string) where doc_id * 16777216 + i > first
        ), run as (
            select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run
            from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from again)
        ), span as (select doc_id, min(i) as b, max(i) + 100 as e from run group by doc_id, run),
        piece as (
            select doc_id, coalesce(lag(e) over (partition by doc_id order by b), 0) as a, b from span
            union all select doc_id, coalesce(max(e), 0), any_value(n) from body left join span using (doc_id) group by doc_id
        ), kept as (
            select p.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (p.b - a)), '' order by a) as x from piece p join body using (doc_id) group by p.doc_id
        ), gone as (select doc_id, sum(e - b) as n_removed, count(*) as n_spans from span group by doc_id)
        select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept.x)) as kept_sha256
        from body join kept using (doc_id) left join gone using (doc_id)
    """,
    "op5_ngram_join": """
        with recursive word as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), gram as (
            select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from word
        ), size as (select doc_id, count(*) as n from gram group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as c from gram a join gram b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
        ), link as (
            select a, b from shared join size x on a = x.doc_id join size y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)
        ), both_ways as (select a, b from link union all select b, a from link),
        reach(a, b) as (
            select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a
        ), least as (select a, min(b) as b from reach group by a)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(b, d.doc_id))::bigint as component_id
        from documents d left join size s on d.doc_id = s.doc_id left join least l on d.doc_id = l.a
    """,
    "op7_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), product as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from product)
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (
            select page_id, strlen(html)::bigint as payload_bytes, list_aggregate(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::integer) & 31)::integer, 1)), 'string_agg', '') as payload_digest
            from p
        ), f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
        select page_id, payload_bytes, payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
               case when first_id <> page_id then first_id end as refers_to from f
    """,
    "op11_minhash_forest": """
        with recursive word as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), gram as (
            select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from word
        ), size as (select doc_id, count(*) as n from gram group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as c from gram a join gram b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
        ), link as (
            select a, b from shared join size x on a = x.doc_id join size y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)
        ), both_ways as (select a, b from link union all select b, a from link),
        reach(a, b) as (
            select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a
        ), least as (select a, min(b) as b from reach group by a)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(b, d.doc_id))::bigint as component_id,
               d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) as kept
        from documents d left join size s on d.doc_id = s.doc_id left join least l on d.doc_id = l.a
    """,
    "op12_source_divergence": """
        with doc as (
            select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
            from documents
        ), occurs as (select d, lang, source, unnest(terms) as term from doc),
        kept as (select lang, term from occurs group by lang, term having count(distinct d) >= 30),
        grp as (select distinct lang, source from doc),
        cnt as (select lang, source, term, count(*) as n from occurs join kept using (lang, term) group by lang, source, term),
        width as (select g.lang, count(k.term) as v from (select distinct lang from grp) g left join kept k on g.lang = k.lang group by g.lang),
        held as (
            select g.lang, g.source, v, coalesce(total, 0) as total from grp g join width using (lang)
            left join (select lang, source, sum(n) as total from cnt group by lang, source) using (lang, source)
        ), p as (
            select h.lang, h.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
            from held h join kept k on h.lang = k.lang left join cnt c on h.lang = c.lang and h.source = c.source and k.term = c.term
        ), q as (
            select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) as q
            from p join (select lang, sum(total) as total, any_value(v) as v from held group by lang) using (lang) group by lang, term
        ), pair as (
            select a.lang, a.source, b.source as item, coalesce(value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
            left join (
                select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by x.lang, x.source, y.source
            ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
        ), term as (select lang, source, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q)
        select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pair
        union all select * from (
            select lang, source, 'term' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from term
        ) where rank <= 50
    """,
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
                   coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
        ), positive as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::integer as rank,
               vec_id as negative_id, positive_score, score as negative_score
        from positive p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3
    """,
}
