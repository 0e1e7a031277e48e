"""Queries that answer batches of questions over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions import vectors as V
from lorespark.operators import postings as P
from lorespark.operators import retrieval as R
from lorespark.operators.tables import union_all, written
from lorespark.plans.registry import query, table

TOKEN_SQL = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|[^\s]"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every passage is a question; each third one asks for a summary, so that routes differ."""
    b = table(spark, d, "benchmark")
    lead = F.when(F.col("item_id") % 3 == 0, "summary of ").when(F.col("item_id") % 3 == 1, "why ").otherwise("")
    return b.select(F.col("item_id").alias("query_id"), F.concat(lead, F.col("text")).alias("question"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("slug"), F.concat("source", F.lit(" "), "lang").alias("title"), T.summary(t).alias("summary"), t.alias("body"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_relpath"),
    )


PAGES_SQL = """(select 'doc' || lpad(doc_id::varchar, 10, '0') slug, lower(source || ' ' || lang) title, lower(substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), 1, 80)) summary, lower(text) body from documents)"""
QUESTIONS_SQL = """(select item_id query_id, case item_id % 3 when 0 then 'summary of ' when 1 then 'why ' else '' end || text question from benchmark)"""


WIKI_SQL = rf"""with q as (select query_id, lower(trim(question, ' ')) q, regexp_extract_all(lower(question), '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]{{2,}}') terms from {QUESTIONS_SQL}),
  s as (select query_id, slug, (case when contains(title, q) then 8 else 0 end + case when contains(summary, q) then 6 else 0 end + case when contains(body, q) then 4 else 0 end
   + coalesce(list_sum(list_transform(terms, lambda t: case when contains(title, t) then 4 else 0 end + case when contains(summary, t) then 3 else 0 end + case when contains(body, t) then 1 else 0 end)), 0))::int score from q cross join {PAGES_SQL} p)
  select query_id, slug, score from (select *, row_number() over (partition by query_id order by score desc, slug) rn from s where score > 0) where rn = 1"""


@query(WIKI_SQL)
def wiki_search_best(spark: SparkSession, d: str) -> DataFrame:
    return R.wiki_search(questions(spark, d), pages(spark, d))


def page_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The pages, and their posting lists."""
    wiki = pages(spark, d)
    return wiki, written(P.build(P.page_entries(wiki), wiki.count()).withColumn("batch", F.lit("")))


@query(WIKI_SQL)
def wiki_search_postings(spark: SparkSession, d: str) -> DataFrame:
    wiki, lists = page_lists(spark, d)
    return P.page_search(questions(spark, d), lists, wiki, lambda rows: rows)[0]


@query(f"""select string_agg('- ' || title || ': ' || summary, chr(10) order by slug) overview from (select slug, source || ' ' || lang title, substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), 1, 80) summary from (select *, 'doc' || lpad(doc_id::varchar, 10, '0') slug from documents) order by slug limit 5)""")
def wiki_overview(spark: SparkSession, d: str) -> DataFrame:
    return R.wiki_overview(pages(spark, d))


EMBED_SQL = f"""(select id, b, n / sqrt(sum(n * n) over (partition by id)) w from (select id, b, count(*)::double n from (select id, ('0x' || substr(md5(t), 1, 8))::bigint % 128 b from (select id, unnest(regexp_extract_all(lower(x), '{TOKEN_SQL}')) t from SOURCE)) group by 1, 2))"""


@query(f"""select id doc_id, count(*) n_buckets, round(max(w), 4) top, round(sum(w * w), 4) norm from {EMBED_SQL.replace('SOURCE', '(select doc_id id, text x from documents)')} group by 1""")
def hash_embed_norms(spark: SparkSession, d: str) -> DataFrame:
    e = V.embedded(table(spark, d, "documents"), "doc_id", "text").withColumn("norm", F.round(V.dot(F.col("vector"), F.col("vector")), 4)).filter("norm > 0")
    return e.select("doc_id", F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_buckets"), F.round(F.array_max("vector"), 4).alias("top"), "norm")


@query(f"""with e as {EMBED_SQL.replace('SOURCE', '(select doc_id id, text x from documents)')}, q as {EMBED_SQL.replace('SOURCE', f'(select query_id id, question x from {QUESTIONS_SQL})')},
  s as (select q.id query_id, e.id doc_id, round(sum(q.w * e.w), 4) similarity from q join e using (b) group by 1, 2)
  select query_id, doc_id, similarity, rank::int rank from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) rank from s) where rank <= 5""")
def hash_embed_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), questions(spark, d)
    base = V.embedded(docs, "doc_id", "text")
    q = V.embedded(asked, "query_id", "question").withColumnRenamed("vector", "v")
    return V.nearest(base, "doc_id", "vector", q, "query_id", "v", 5)


KNN_SQL = """(select q.vec_id query_id, e.vec_id, e.label, greatest(round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 4), 0) similarity from embeddings q, embeddings e where q.vec_id % 50 = 0)"""


def knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))  # every fiftieth vector asks
    return V.nearest(e, "vec_id", "embedding", asked, "query_id", "v", 10)


@query(f"""select query_id, vec_id, similarity, rank::int rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) rank from {KNN_SQL}) where rank <= 10""")
def knn_exact_top10(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d)


@query(f"""select query_id, label, votes from (select query_id, label, count(*) votes, row_number() over (partition by query_id order by count(*) desc, label) rn from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) rank from {KNN_SQL}) where rank <= 10 group by 1, 2) where rn = 1""")
def knn_label_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = knn(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


@query(f"""with q as (select query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{{2,}}'))) term from {QUESTIONS_SQL}), t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) term from documents)
  select query_id, count(distinct doc_id) passed, max(c) most_shared from (select query_id, doc_id, count(*) c from q join t using (term) group by 1, 2) group by 1""")
def lexical_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = R.small(questions(spark, d)).select("query_id", F.explode(T.lexical_terms(F.col("question"))).alias("term"))
    have = table(spark, d, "documents").select("doc_id", F.explode(T.lexical_terms(F.col("text"))).alias("term"))
    shared = have.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return shared.groupBy("query_id").agg(F.count("*").alias("passed"), F.max("c").alias("most_shared"))


@query(f"""select query_id, case when s > 0 then 'summary' when r > 0 then 'relation' when x > 0 then 'detail' end rule_id, case when s > 0 then 'wiki' when r > 0 then 'graph' when x > 0 then 'vector' end route from
  (select query_id, len(list_filter(['summary', 'summarize', 'overview', 'tl;dr'], lambda k: contains(lower(question), k))) s, len(list_filter(['impact', 'relation', 'depends', 'dependency', 'why', 'because'], lambda k: contains(lower(question), k))) r,
  len(list_filter(['excerpt', 'detail', 'clause', 'passage', 'verbatim'], lambda k: contains(lower(question), k))) x from {QUESTIONS_SQL}) where s + r + x > 0""")
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    routed = R.route(questions(spark, d), R.rule_table(spark))
    return routed.filter("hits > 0").select("query_id", "rule_id", "route")


@query()
def route_all_questions(spark: SparkSession, d: str) -> DataFrame:
    return R.route(questions(spark, d), R.rule_table(spark))


CANDIDATES_SQL = """(select o_custkey query_id, o_orderkey idx, case o_orderkey % 4 when 0 then 'wiki' when 1 then 'graph' when 2 then 'vector' else 'page_tree' end route, round(o_totalprice / 500000, 2) score from orders)"""


@query(f"""with r as (select *, row_number() over (partition by query_id, route order by score desc, idx) rk, list_position(['wiki', 'graph', 'vector', 'page_tree'], route) ro from {CANDIDATES_SQL})
  select query_id, idx, route, score, rk::int route_rank, round(1.0 / (60 + rk), 9) rrf, row_number() over (partition by query_id order by 1.0 / (60 + rk) desc, score desc, ro, idx)::int position from r""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 4
    route = F.when(m == 0, "wiki").when(m == 1, "graph").when(m == 2, "vector").otherwise("page_tree")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("idx"), route.alias("route"), F.round(F.col("o_totalprice") / 500000, 2).alias("score"))
    return R.fuse(c).select("query_id", "idx", "route", "score", "route_rank", F.round("rrf", 9).alias("rrf"), "position")


@query("""select o_custkey query_id, max(o_orderkey) best, case when round(max(o_totalprice) / 500000, 2) >= 0.75 then 'commit' else 'skip' end as action, case when round(max(o_totalprice) / 500000, 2) >= 0.75 then 'confident' else 'below_threshold' end status from orders group by 1""")
def writeback_gate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderkey").alias("best"), F.round(F.max("o_totalprice") / 500000, 2).alias("confidence"))
    return R.writeback(g).join(g.select("query_id", "best"), "query_id")


@query("""select l_suppkey query_id, list_sort(list_distinct(list('p' || l_partkey))) slugs from (select distinct l_suppkey, l_partkey from lineitem) group by 1""")
def related_pages(spark: SparkSession, d: str) -> DataFrame:
    touched = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").cast("string").alias("relpath"))
    wiki = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_partkey").cast("string").alias("source_relpath"))
    return R.related_pages(touched, wiki)


@query(rf"""with q as (select query_id, lower(trim(question, ' ')) q, regexp_extract_all(lower(question), '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]{{2,}}') terms from {QUESTIONS_SQL}),
  s as (select query_id, slug, (case when contains(title, q) then 8 else 0 end + case when contains(summary, q) then 6 else 0 end + case when contains(body, q) then 4 else 0 end
   + coalesce(list_sum(list_transform(terms, lambda t: case when contains(title, t) then 4 else 0 end + case when contains(summary, t) then 3 else 0 end + case when contains(body, t) then 1 else 0 end)), 0))::int own,
   (case when contains(summary, q) then 8 else 0 end + coalesce(list_sum(list_transform(terms, lambda t: case when contains(summary, t) then 4 else 0 end)), 0))::int b from q cross join {PAGES_SQL} p),
  t as (select *, b boost from s), u as (select *, max(boost) over (partition by query_id) > 0 any_boost from t)
  select query_id, slug, own + boost score from (select *, row_number() over (partition by query_id order by own + boost desc, slug) rn from u where own + boost > 0 and (not any_boost or boost > 0)) where rn = 1""")
def tree_boosted_search(spark: SparkSession, d: str) -> DataFrame:
    wiki = pages(spark, d)
    nodes = wiki.select(F.col("source_relpath").alias("relpath"), F.lit("t").alias("tree_slug"), F.col("summary").alias("title"), F.lit("").alias("summary"))
    return R.tree_boosted_search(questions(spark, d), wiki, nodes)


def fused(spark: SparkSession, d: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = questions(spark, d) if asked is None else asked
    wiki = pages(spark, d)
    routed = R.route(asked, R.rule_table(spark))
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("relpath"), "text")
    vectors = V.embedded(docs.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "text")
    nodes = wiki.select(F.col("source_relpath").alias("relpath"), F.lit(1).alias("preorder"), "title", "summary")
    found = R.wiki_candidates(asked, wiki, routed)
    found = union_all([found, R.vector_candidates(asked, chunks, vectors), R.tree_candidates(asked, nodes)])
    return asked, R.fuse(found), routed


@query()
def q_fused_retrieval(spark: SparkSession, d: str) -> DataFrame:
    asked, ranked, routed = fused(spark, d)
    return R.answers(asked, ranked, routed)
