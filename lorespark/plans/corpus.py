"""Queries over documents, pages and conversations: text functions, chunks, ids, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import catalog, chunks
from lorespark.plans.registry import query, table

TOKEN_SQL = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|[^\s]"


@query(r"""select doc_id, length(t) n_chars, sha256(t) digest from (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '(?m)^[ ]+|[ ]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') t from documents)""")
def normalize_text_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("digest"))


@query("""select doc_id, substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), 1, 80) summary from documents""")
def summaries_80(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(r"""select doc_id, substring(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 240) quote from documents""")
def evidence_quote_240(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.evidence_quote(F.col("text")).alias("quote"))


@query(f"""select doc_id, len(regexp_extract_all(lower(text), '{TOKEN_SQL}'))::bigint n_tokens from documents""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""select term, count(*) df from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) term from documents) group by 1 order by df desc, term limit 100""")
def term_df_topk(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").select("doc_id", F.explode(T.lexical_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(100)


@query(f"""with t as (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}') a from documents), s as (select doc_id, a, unnest(range(0, greatest(len(a) - 64 - 1, 0) + 1, 448)) st from t where len(a) > 0)
  select doc_id, (st / 448)::int chunk_idx, st::int start, len(list_slice(a, st + 1, st + 512))::int n_tokens, sha256(array_to_string(list_slice(a, st + 1, st + 512), ' ')) digest from s""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    out = chunks.chunk_windows(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_idx", F.col("start").cast("int").alias("start"), F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


@query("""select doc_id, sha256(text) content, substring(sha256(text), 1, 8) || '-' || substring(sha1('txt:v1:'), 1, 8) || '-0' chunk_id, substring(sha1('doc' || doc_id || '|references|a|b'), 1, 16) edge_id from documents""")
def content_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2("text", 256)
    rel = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", sha.alias("content"), T.chunk_id(sha, F.lit("txt:v1:"), F.lit(0)).alias("chunk_id"), T.edge_id(rel, F.lit("references"), F.lit("a"), F.lit("b")).alias("edge_id"))


@query("""select sha256(text) content, count(*) n, min(doc_id) first_id, max(doc_id) last_id from documents group by 1 having count(*) > 1""")
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("""select source, lang, count(*) n, sum(n_chars)::bigint chars, grouping(source)::int g_source, grouping(lang)::int g_lang from documents group by cube (source, lang)""")
def format_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").cube("source", "lang")
    return c.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping("source").cast("int").alias("g_source"), F.grouping("lang").cast("int").alias("g_lang"))


@query("""select lang, count(*) n, round(avg(n_chars), 4) mean_chars, min(n_chars) least, max(n_chars) most, round(stddev_samp(n_chars), 4) spread from documents group by lang""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("lang")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.stddev_samp("n_chars"), 4).alias("spread"))


@query(r"""select base, slug from (select doc_id, b base, case when rn = 1 then b else b || '-' || rn end slug from (select *, row_number() over (partition by b order by doc_id) rn from
  (select doc_id, case when length(s) <= 96 then s else regexp_replace(substring(s, 1, 87), '-+$', '') || '-' || substring(sha1(x), 1, 8) end b from
  (select doc_id, x, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s from (select doc_id, source || ' ' || lang x from documents)))))""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", T.slug(F.concat_ws(" ", "source", "lang")).alias("base"))
    at = F.row_number().over(Window.partitionBy("base").orderBy("doc_id"))
    return base.select("base", T.unique_slug(F.col("base"), at).alias("slug"))


@query("""select doc_id, case when contains(t, 'dependency') then 'dependency' when contains(t, 'risk') then 'risk' when contains(t, 'project') then 'project' else 'general' end as label,
  case when contains(t, 'atlas') then 'Project Atlas' when contains(t, 'borealis') then 'Project Borealis' when contains(t, 'risk') then 'Risk' else 'Knowledge Item' end as concept from (select doc_id, lower(text) t from documents)""")
def llm_classify_labels(spark: SparkSession, d: str) -> DataFrame:
    return catalog.extract(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "label", "concept")


@query("""select l.quality, l.toxic, count(*) n, round(avg(d.n_chars), 4) mean_chars from labels l join documents d using (doc_id) group by 1, 2""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""select conv_id, turn, role, length(text) n from (select *, row_number() over (partition by conv_id order by turn desc) rn from conversations) where rn = 1""")
def conversation_last_turn(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("l"))
    return last.select("conv_id", "l.turn", "l.role", F.length("l.text").cast("long").alias("n"))


@query("""select conv_id, turn, sha256(prev) asked, sha256(text) answered from (select *, lag(text) over w prev, lag(role) over w prole from conversations window w as (partition by conv_id order by turn)) where prole = 'user' and role = 'assistant'""")
def conversation_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"prev": F.lag("text").over(w), "prole": F.lag("role").over(w)})
    return rows.filter("prole = 'user' and role = 'assistant'").select("conv_id", "turn", F.sha2("prev", 256).alias("asked"), F.sha2("text", 256).alias("answered"))


@query(r"""select page_id, length(t)::bigint n_chars, sha256(t) digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') t from pages)""")
def html_strip_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("digest"))


@query(r"""select regexp_extract(url, '^[a-z]+://([^/:]+)', 1) host, count(*) n, count(distinct url) urls from pages group by 1""")
def url_host_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


@query("""select 'doc' || lpad(doc_id::varchar, 10, '0') relpath, lang format from documents where lang = 'en' order by 1 limit 50 offset 100""")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("relpath"), F.col("lang").alias("format"))
    return catalog.page(entries, 100, 50, format_="en")


@query("""select label, mode_size from (select label, b mode_size, row_number() over (partition by label order by count(*) desc, b) rn from (select label, vec_id % 7 b from embeddings) group by 1, 2) where rn = 1""")
def mode_smallest_tie(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("mode_size"))
    return catalog.mode_smallest(rows, ["label"], "mode_size")


@query("""with s as (select p_brand relpath, p_partkey k, case p_partkey % 5 when 0 then 'heading' when 1 then 'table_row' when 2 then 'table_row' else 'paragraph' end kind, p_name x from part),
  l as (select *, lag(kind) over (partition by relpath order by k) pk from s), g as (select *, case when pk is null then '' when kind = 'table_row' and pk = kind then chr(10) else chr(10) || chr(10) end || x part from l)
  select relpath, sha256(string_agg(part, '' order by k)) digest from g group by 1""")
def segment_bodies(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    kind = F.when(m == 0, "heading").when(m.isin(1, 2), "table_row").otherwise("paragraph")
    segments = table(spark, d, "part").select(F.col("p_brand").alias("relpath"), F.col("p_partkey").alias("seg_idx"), kind.alias("kind"), F.col("p_name").alias("text"))
    return chunks.segments_to_body(segments).select("relpath", F.sha2("body", 256).alias("digest"))


@query()
def segment_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    kind = F.when(m == 0, "heading").when(m == 1, "table_row").otherwise("paragraph")
    segments = table(spark, d, "part").select(F.col("p_brand").alias("relpath"), F.col("p_partkey").alias("seg_idx"), kind.alias("kind"), F.col("p_name").alias("text"))
    return chunks.segment_chunks(segments, 32)


@query(r"""select doc_id, case when length(text) = 0 then 'empty' when text like '%PDF-%' then 'pdf' else 'txt' end kind, case when length(text) > 20000 then 'oversized' when not regexp_matches(text, '\S') then 'empty' else 'ok' end guard from documents""")
def size_guards(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    kind = F.when(F.length(t) == 0, "empty").when(t.contains("PDF-"), "pdf").otherwise("txt")
    guard = F.when(F.length(t) > 20000, "oversized").when(~t.rlike("\\S"), "empty").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), guard.alias("guard"))


@query("""select type, sum(n)::bigint n from (select case l_linenumber % 3 when 0 then 'image' when 1 then 'chart' else 'macro' end type, l_quantity n from lineitem) group by 1""")
def skipped_segment_sums(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_linenumber") % 3
    kind = F.when(m == 0, "image").when(m == 1, "chart").otherwise("macro")
    return table(spark, d, "lineitem").groupBy(kind.alias("type")).agg(F.sum("l_quantity").cast("long").alias("n"))


@query("""select l_orderkey page, string_agg(p_name, ' ' order by l_linenumber, p_name) line, min(l_linenumber)::int first, max(l_linenumber)::int last, round(avg(l_quantity * 4) / 100, 4) confidence from lineitem join part on l_partkey = p_partkey group by 1""")
def ocr_line_fold(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    zero = F.lit(0)
    words = j.select(F.col("l_orderkey").alias("image"), zero.alias("block"), zero.alias("par"), zero.alias("line"), F.col("l_linenumber").alias("left"), F.col("l_linenumber").alias("top"), zero.alias("width"), zero.alias("height"), (F.col("l_quantity") * 4).alias("conf"), F.col("p_name").alias("text"))
    return catalog.ocr_lines(words).select(F.col("image").alias("page"), F.col("text").alias("line"), F.col("top").alias("first"), F.col("bottom").alias("last"), "confidence")
