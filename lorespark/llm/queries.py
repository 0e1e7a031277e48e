"""The queries of the training-data operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import ann, decontaminate, divergence, infill, jaccard, langid, licenses, lm, mixing, quality_model, substring
from lorespark.llm.bpe import bpe_decode, bpe_encode
from lorespark.llm.common import held_out, table
from lorespark.llm.quality_rules import quality_rules


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("hash")


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.train(docs, learn=~held_out("doc_id", 4))
    return langid.predict(docs, network).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), learn=~held_out("doc_id", 7))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), learn=~held_out("doc_id", 4))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


#: Targets: the hot source shrinks and small ones grow, languages have given weights, topics move little.
MIX: dict[str, mixing.Targets] = {"source": 0.9, "lang": {"en": 0.58, "de": 0.155, "fr": 0.145, "es": 0.12}, "topic": 0.95}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), MIX).withColumn("rate", F.round("rate", 4))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
with docs as materialized (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
),
occurrences as materialized (select r, lang, source, unnest(w) as term from docs),
kept as materialized (select lang, term from occurrences group by lang, term having count(distinct r) >= 3),
groups as (select distinct lang, source from docs),
sizes as (select lang, count(*) as v from kept group by lang),
counts as materialized (select o.lang, o.source, o.term, count(*) as n from occurrences o semi join kept k on o.lang = k.lang and o.term = k.term group by all),
group_totals as (select lang, source, sum(n) as total from counts group by all),
lang_counts as (select lang, term, sum(n) as n from counts group by all),
lang_totals as (select lang, sum(n) as total from lang_counts group by all),
p as materialized (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + s.v) as p
    from groups g join kept k using (lang) join sizes s using (lang)
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term left join group_totals t on t.lang = g.lang and t.source = g.source
),
q as (select c.lang, c.term, 1 + (1000000000::hugeint * (c.n + 1)) // (t.total + s.v) as q from lang_counts c join lang_totals t using (lang) join sizes s using (lang)),
sums as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (((p - q) * (p - q)) // q)::bigint as value from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms qualify rank <= 200
"""


DECONTAMINATE_SQL = r"""
with docs as materialized (
    select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
),
items as materialized (
    select item_id::varchar as item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
),
widths as (select item_id, w, least(len(w), 10) as k from items where len(w) > 0),
asked as (select distinct item_id, k, w[i:i + k - 1] as x from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from widths)),
places as (select r, k, i, w[i:i + k - 1] as x from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct k from widths) where len(w) >= k)),
found as materialized (select p.r, p.i, p.k, a.item_id from places p join asked a on a.k = p.k and a.x = p.x),
hit as (select r, count(*) as n from (select distinct r, unnest(range(i, i + k)) as at from (select distinct r, i, k from found)) group by r),
named as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) as names from (select distinct r, item_id from found where item_id is not null) group by r)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256"),
    )


INFILL_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
units as (
    select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u,
        ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
    from texts
),
cuts as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from units),
parts as (
    select doc_id, t, n, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from cuts
)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then length(p) end as prefix_chars,
    case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_bpe": op2_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_langid": op5_langid,
        "op6_ann": op6_ann,
        "op7_quality_rules": op7_quality_rules,
        "op8_lm_score": op8_lm_score,
        "op9_quality_model": op9_quality_model,
        "op10_mixing": op10_mixing,
        "op11_divergence": op11_divergence,
        "op12_infill": op12_infill,
        "op13_decontaminate": op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.oracle(), "op10_mixing": mixing.oracle(MIX), "op11_divergence": DIVERGENCE_SQL, "op12_infill": INFILL_SQL, "op13_decontaminate": DECONTAMINATE_SQL}
