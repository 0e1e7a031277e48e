"""Queries over the entity graph and section trees; both are made from the star schema's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import graph as G
from lorespark.operators import retrieval as R
from lorespark.operators import trees as P
from lorespark.operators.components import TOGETHER, connected_components, numbered
from lorespark.operators.tables import partitions
from lorespark.plans.registry import query, table


def text(*parts: object):
    return F.concat(*(p if not isinstance(p, str) or p in COLUMNS else F.lit(p) for p in parts))


COLUMNS = {"s_name", "n_name", "c_name", "r_name", "p_name", "p_type"}


def statements(spark: SparkSession, d: str) -> DataFrame:
    """relpath, pos-free body: suppliers depend on nations, customers belong to nations, nations impact regions."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(text("supplier/", F.col("s_suppkey").cast("string")).alias("relpath"), text("s_name", " depends on ", "n_name", ". Later news.").alias("body"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(text("customer/", F.col("c_custkey").cast("string")).alias("relpath"), text("- ", "c_name", " belongs to ", "n_name", " and Market").alias("body"))
    r = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(text("nation/", F.col("n_nationkey").cast("string")).alias("relpath"), text("n_name", " impacts ", "r_name", "\nNothing else here").alias("body"))
    return s.union(c).union(r)


TRIPLES_SQL = """(select 'supplier/' || s_suppkey relpath, 'depends_on' relation, s_name source, n_name target from supplier join nation on s_nationkey = n_nationkey
  union all select 'customer/' || c_custkey, 'belongs_to', c_name, t from customer join nation on c_nationkey = n_nationkey, unnest([n_name, 'Market']) x(t)
  union all select 'nation/' || n_nationkey, 'impacts', n_name, r_name from nation join region on n_regionkey = r_regionkey)"""


@query(f"select relpath, relation, source, target from {TRIPLES_SQL}")
def relation_extract(spark: SparkSession, d: str) -> DataFrame:
    # small files, much work a row: rows are dealt to all tasks
    return G.relations(G.sentences(statements(spark, d).repartition(partitions(spark)), "relpath", "body"), "relpath").select("relpath", "relation", "source", "target")


@query("""select p_partkey, list_transform(list_filter([p_name, p_brand, p_type], lambda x: x <> ''), lambda x: trim(x, ' ')) targets, 3::bigint n from part""")
def relation_targets_split(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "part").withColumn("raw", F.concat("p_name", F.lit(", "), "p_brand", F.lit(" and "), "p_type"))
    t = T.split_targets(F.col("raw"))
    return both.select("p_partkey", t.alias("targets"), F.size(t).cast("long").alias("n"))


@query("""select p_partkey, case when l like '%project %' and l not like '%service%' then 'Project' when regexp_matches(l, 'delay|risk|milestone|incident|event|window') then 'Event'
  when regexp_full_match(x, '[A-Z][a-z]+( [A-Z][a-z]+)+') then 'Person' when regexp_matches(l, 'spec|document|analysis|summary|report') then 'Document' else 'Concept' end as type
  from (select p_partkey, x, lower(x) l from (select p_partkey, case p_partkey % 5 when 0 then 'Project ' || p_name when 1 then 'Delay of ' || p_name when 2 then 'Anna Bell' when 3 then p_name || ' report' else p_name end x from part))""")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    label = F.when(m == 0, text("Project ", "p_name")).when(m == 1, text("Delay of ", "p_name")).when(m == 2, "Anna Bell").when(m == 3, text("p_name", " report")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.entity_type(label).alias("type"))


def star_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of customers, suppliers, nations and regions."""
    parts = []
    for name, kind in (("region", "Concept"), ("nation", "Concept"), ("customer", "Person"), ("supplier", "Project")):
        k, label = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name")}[name]
        parts.append(table(spark, d, name).select(F.concat(F.lit(f"{name}:"), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), F.array(F.lower(label)).alias("aliases"), F.array(F.lit(name)).alias("source_relpaths")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.union(p)
    edges = None
    for name, a, b, to, relation in (("nation", "n_nationkey", "n_regionkey", "region", "belongs_to"), ("customer", "c_custkey", "c_nationkey", "nation", "depends_on"), ("supplier", "s_suppkey", "s_nationkey", "nation", "impacts")):
        t = table(spark, d, name).withColumns({"src": F.concat(F.lit(f"{name}:"), F.col(a).cast("string")), "dst": F.concat(F.lit(f"{to}:"), F.col(b).cast("string"))})
        label = {"nation": "n_name", "customer": "c_name", "supplier": "s_name"}[name]
        t = t.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit(relation).alias("relation"), "src", "dst", F.lit(name).alias("source_relpath"), F.concat(F.col(label), F.lit(f" {relation} it")).alias("evidence"))
        edges = t if edges is None else edges.union(t)
    return nodes, edges


NODES_SQL = """(select 'region:' || r_regionkey id, r_name label, 'Concept' as type from region union all select 'nation:' || n_nationkey, n_name, 'Concept' from nation union all select 'customer:' || c_custkey, c_name, 'Person' from customer union all select 'supplier:' || s_suppkey, s_name, 'Project' from supplier)"""
EDGES_SQL = """(select 'nation:' || n_nationkey src, 'region:' || n_regionkey dst, 'belongs_to' relation, n_name || ' belongs_to it' evidence from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'depends_on', c_name || ' depends_on it' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'impacts', s_name || ' impacts it' from supplier)"""


def graph_questions(spark: SparkSession, d: str) -> DataFrame:
    """What each nation's question is about depends on its key."""
    m = F.col("n_nationkey") % 3
    ask = F.when(m == 0, text("why does ", "n_name", " impact sales")).when(m == 1, text("what depends on ", "n_name")).otherwise(text("n_name", " overview"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), ask.alias("question"))


GQ_SQL = "(select n_nationkey::bigint query_id, case n_nationkey % 3 when 0 then 'why does ' || n_name || ' impact sales' when 1 then 'what depends on ' || n_name else n_name || ' overview' end question from nation)"


@query(f"""select query_id, relation from (select query_id, unnest(list_filter([case when regexp_matches(q, 'impact|affect') then 'impacts' end, case when regexp_matches(q, 'cause|because|reason') then 'causes' end, case when regexp_matches(q, 'contradict|conflict') then 'contradicts' end,
  case when regexp_matches(q, 'follow|succeed') then 'succeeds' end, case when regexp_matches(q, 'depend') then 'depends_on' end, case when regexp_matches(q, 'reference') then 'references' end, case when regexp_matches(q, 'belong') then 'belongs_to' end, case when contains(q, 'own') then 'owns' end], lambda x: x is not null)) relation
  from (select query_id, lower(question) q from {GQ_SQL}))""")
def desired_relations(spark: SparkSession, d: str) -> DataFrame:
    return R.desired_relations(graph_questions(spark, d), R.keyword_table(spark))


TERMS = "list_distinct(regexp_extract_all(lower(X), '[a-z0-9]{2,}'))"
SCORED_SQL = f"""with q as (select query_id, lower(question) q, {TERMS.replace('X', 'question')} t from {GQ_SQL}),
  n as (select query_id, id, (len(list_intersect(t, {TERMS.replace('X', 'label')})) + 3.0 * (case when contains(q, lower(label)) then case when label = lower(label) then 1 else 2 end else 0 end))::double s, len(list_intersect(t, {TERMS.replace('X', 'label')})) c from q cross join {NODES_SQL}),
  ns as (select query_id, id, s from n where c > 0),
  w as (select query_id, unnest(list_filter([case when contains(q, 'impact') then 'impacts' end, case when contains(q, 'depend') then 'depends_on' end, case when contains(q, 'own') then 'owns' end], lambda x: x is not null)) relation from q),
  e as (select q.query_id, x.src || '>' || x.dst id, round(coalesce(1.5 * greatest(coalesce(a.s, 0), coalesce(b.s, 0)), 0) + len(list_intersect(t, {TERMS.replace('X', 'evidence')})) + case when w.relation is not null then 4.0 else 0 end, 4)::double score, w.relation is not null wanted
   from q cross join {EDGES_SQL} x left join ns a on a.query_id = q.query_id and a.id = x.src left join ns b on b.query_id = q.query_id and b.id = x.dst left join w on w.query_id = q.query_id and w.relation = x.relation)"""


@query(f"{SCORED_SQL} select query_id, id, score from e where score > 0")
def graph_edge_scores(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star_graph(spark, d)
    return R.graph_scores(graph_questions(spark, d), nodes, edges, R.keyword_table(spark)).select("query_id", "id", F.round("score", 4).alias("score"))


@query(f"""{SCORED_SQL}, p as (select *, row_number() over (partition by query_id order by score desc, id) rn from (select *, max(wanted) over (partition by query_id) m from e where score > 0) where wanted = m)
  select query_id, round(least(0.99, 0.55 + least(max(score), 6) * 0.06 + (count(*) - 1) * 0.05), 4)::double confidence, count(*) n_edges from p where rn <= 3 group by 1""")
def graph_answer(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star_graph(spark, d)
    return R.graph_answers(graph_questions(spark, d), nodes, edges, R.keyword_table(spark)).select("query_id", "confidence", "n_edges")


@query()
def graph_answer_texts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star_graph(spark, d)
    return R.graph_answers(graph_questions(spark, d), nodes, edges, R.keyword_table(spark))


MERGE_SQL = "(select p_brand id, case p_partkey % 3 when 0 then 'Concept' else 'Project' end as type, p_name label, p_partkey o, p_type src from part)"


@query(f"""select id, coalesce(first(type order by o) filter (where type <> 'Concept'), 'Concept') as type, first(label order by length(label) desc, o) as label, list_sort(list_distinct(list(label))) aliases, list_sort(list_distinct(list(src))) source_relpaths from {MERGE_SQL} group by 1""")
def graph_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "Concept").otherwise("Project").alias("type"), F.col("p_name").alias("label"), F.col("p_type").alias("source_relpath"), F.col("p_partkey").alias("o"))
    return G.merge_nodes(rows, "o")


@query("""select 'all' source_relpath, l_suppkey dst, count(distinct l_partkey) n from lineitem group by 2 having count(distinct l_partkey) > 1""")
def depends_on_fanin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.lit("all").alias("source_relpath"), F.lit("depends_on").alias("relation"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.shared_targets(e)


@query("""select id, type from (select 'customer:' || c_custkey id, case c_custkey % 10 when 0 then 'Document' else 'Person' end as type, c_custkey k from customer) where type = 'Document' or k in (select o_custkey from orders)""")
def dangling_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(F.concat(F.lit("customer:"), k.cast("string")).alias("id"), F.when(k % 10 == 0, "Document").otherwise("Person").alias("type"))
    edges = table(spark, d, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst"))
    return G.without_dangling(nodes, edges)


@query("""select o_custkey id, o_orderkey first_order, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) where rn = 1""")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), "o_orderpriority", "o_orderdate")
    return G.first_wins(rows, "id", F.col("o_orderdate"), F.col("first_order")).drop("o_orderdate")


def chains(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order is linked to the line before it, the first to the customer: a component a customer, of chains that meet in it."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    # dealt by order once, for the distinct lines, the join and the window
    e = table(spark, d, "lineitem").select("l_orderkey", line.alias("src")).repartition("l_orderkey").distinct().join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    before = F.lag("src").over(Window.partitionBy("l_orderkey").orderBy("src"))
    return e.select("src", F.coalesce(before, -F.col("o_custkey")).alias("dst"))


NODES_OF_CHAINS_SQL = "(select distinct l_orderkey * 8 + l_linenumber node, -o_custkey component from lineitem join orders on l_orderkey = o_orderkey union select -o_custkey, -o_custkey from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select node, component from {NODES_OF_CHAINS_SQL}")
def components_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(chains(spark, d), together=TOGETHER)


@query(f"select component, count(*) n_nodes, dense_rank() over (order by component)::int number from {NODES_OF_CHAINS_SQL} group by 1")
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = connected_components(chains(spark, d), together=TOGETHER).groupBy("component").agg(F.count("*").alias("n_nodes"))
    return numbered(sizes, "component").select("component", "n_nodes", F.col("number").cast("int").alias("number"))


def graph_layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = star_graph(spark, d)
    sources = table(spark, d, "region").select(F.concat(F.lit("region/"), F.col("r_name")).alias("relpath"))
    pages = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 4 == 0, "gone").otherwise(F.concat(F.lit("region/"), F.col("r_name"))).alias("source_relpath"))
    return G.unified(sources, pages, nodes.filter("id != 'nation:3'"), edges)


@query(f"""select kind, count(*) n from (select 'source' kind, r_name x from region union all select 'wiki_page', n_name from nation union all select lower(type), label from {NODES_SQL} where id <> 'nation:3') group by 1""")
def unified_graph_kinds(spark: SparkSession, d: str) -> DataFrame:
    return graph_layers(spark, d)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""select src, dst, relation from {EDGES_SQL} where src = 'nation:3' or dst = 'nation:3'""")
def unified_graph_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph_layers(spark, d)[2].select("src", "dst", "relation")


@query()
def community_report(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _ = graph_layers(spark, d)
    return G.community_summary(nodes, edges, G.communities(nodes, edges))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = text("# ", "r_name", "\n\nintro\n\n## ", "n_name", "\n\nbody of it\n\n### Detail\nx\n## End\ny")
    return j.select(F.col("n_nationkey").cast("string").alias("relpath"), body.alias("body"), "n_name", "r_name")


MD_SQL = "(select n_nationkey::varchar relpath, n_name, r_name, length(r_name) r, length(n_name) n from nation join region on n_regionkey = r_regionkey)"

@query(f"""with b as (select relpath, '# ' || r_name || chr(10) || chr(10) || 'intro' || chr(10) || chr(10) || '## ' || n_name || chr(10) || chr(10) || 'body of it' || chr(10) || chr(10) || '### Detail' || chr(10) || 'x' || chr(10) || '## End' || chr(10) || 'y' t, n_name, r_name from {MD_SQL}),
  h as (select relpath, t, unnest([{{'i': 'n1', 'l': 1, 'w': r_name, 'p': r_name, 'at': strpos(t, '# ') - 1, 'u': length(t)}}, {{'i': 'n1.1', 'l': 2, 'w': n_name, 'p': r_name || ' > ' || n_name, 'at': strpos(t, '## ' || n_name) - 1, 'u': strpos(t, '## End') - 1}},
  {{'i': 'n1.1.1', 'l': 3, 'w': 'Detail', 'p': r_name || ' > ' || n_name || ' > Detail', 'at': strpos(t, '### D') - 1, 'u': strpos(t, '## End') - 1}}, {{'i': 'n1.2', 'l': 2, 'w': 'End', 'p': r_name || ' > End', 'at': strpos(t, '## End') - 1, 'u': length(t)}}]) x from b)
  select relpath, x.i node_id, x.l as level, x.w title, x.p section_path, x.at::int start_offset, x.u::int end_offset from h""")
def heading_tree(spark: SparkSession, d: str) -> DataFrame:
    return P.nest(P.markdown_headings(markdown(spark, d), "relpath", "body")).select("relpath", "node_id", "level", "title", "section_path", "start_offset", "end_offset")


@query("""with b as (select n_nationkey::varchar relpath, '# ' || r_name || chr(10) || chr(10) || 'intro' || chr(10) || chr(10) || '## ' || n_name || chr(10) || chr(10) || 'body of it' || chr(10) || chr(10) || '### Detail' || chr(10) || 'x' || chr(10) || '## End' || chr(10) || 'y' t, n_name, r_name from nation join region on n_regionkey = r_regionkey),
  o as (select relpath, t, n_name, unnest(range(0, length(t), 5)) o from b)
  select relpath, o::int as "offset", case when o >= strpos(t, '## End') - 1 then 'n1.2' when o >= strpos(t, '### D') - 1 then 'n1.1.1' when o >= strpos(t, '## ' || n_name) - 1 then 'n1.1' else 'n1' end node_id from o""")
def offset_to_section(spark: SparkSession, d: str) -> DataFrame:
    md = markdown(spark, d)
    offsets = md.select("relpath", F.explode(F.sequence(F.lit(0), F.length("body") - 1, F.lit(5))).alias("offset"))
    return P.sections_at(offsets, P.nest(P.markdown_headings(md, "relpath", "body"))).select("relpath", "offset", "node_id")


@query("""with s as (select o_custkey id, unnest([{'a': 0, 'b': 40}, {'a': case when o_orderkey % 3 = 0 then 45 else 30 end, 'b': 100}]) x from orders) select id, bool_or(x.b = 100 and x.a <= 40) covered from s group by 1""")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    two = F.array(F.struct(F.lit(0).alias("start"), F.lit(40).alias("end")), F.struct(F.when(k % 3 == 0, 45).otherwise(30).alias("start"), F.lit(100).alias("end")))
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.explode(two).alias("x")).select("id", "x.*")
    return P.coverage(spans, "id", F.lit(100))


@query(f"""with t as (select relpath, length('# ' || r_name || '..intro..## ' || n_name || '..body of it..### Detail.x.## End.y') n from {MD_SQL}) select relpath, k node_id, (n * (i - 1) // 3)::int start_offset, (n * i // 3)::int end_offset, 'Summary of: ' || 'doc (' || i || ')' summary from t, unnest([1, 2, 3]) u(i), lateral (select 'n' || i k)""")
def tree_enrich_thirds(spark: SparkSession, d: str) -> DataFrame:
    roots = P.single_root(markdown(spark, d).withColumn("title", F.lit("doc")), "relpath", "title", "body")
    return P.enrich(roots).select("relpath", "node_id", "start_offset", "end_offset", "summary")


@query(f"""with b as (select relpath, r, n, r + n + length('# ..intro..## ..body of it..') d0 from {MD_SQL}) select relpath, unnest(['n1', 'n1.1', 'n1.1.1', 'n1.2']) node_id, unnest([0, r + 11, d0, d0 + 13])::int start, unnest([r + 11, d0, d0 + 13, d0 + 21])::int as "end" from b""")
def tree_own_ranges(spark: SparkSession, d: str) -> DataFrame:
    nodes = P.nest(P.markdown_headings(markdown(spark, d), "relpath", "body"))
    return P.own_ranges(nodes)
