"""The entity and relation graph: extraction, merging, pruning, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import clean_label, contextual_entity_type, edge_id, node_id, slug, split_targets
from lorespark.operators.components import TOGETHER, connected_components
from lorespark.operators.trees import own_ranges

# Relation, pattern with the left and the right label, and whether the right label is the source; in the order they are tried.
PATTERNS = (
    ("causes", "(.+?)(?:導致|造成|引發|使得?)(.+)", False),
    ("causes", "(.+?)\\s+causes?\\s+(.+)", False),
    ("contradicts", "([^，,。；;!?！？]+?)(?:與|和)([^，,。；;!?！？]+?)(?:矛盾|衝突)", False),
    ("contradicts", "(?:.*\\b(?:however|but)\\s+)?([^.，,;；]+?)\\s+(?:contradicts?|conflicts with)\\s+([^.，,;；]+)", False),
    ("succeeds", "(.+?)\\s+succeeds\\s+(.+)", False),
    ("succeeds", "(.+?)(?:之後)?(?:接續|接著|後續是)(.+)", True),
    ("succeeds", "(.+?)\\s+(?:followed by|is followed by)\\s+(.+)", True),
    ("succeeds", "(.+?)\\s+precedes\\s+(.+)", True),
    ("impacts", "(.+?)(?:會|將|直接)?影響(.+)", False),
    ("impacts", "(.+?)\\s+(?:affects?|impacts?)\\s+(.+)", False),
    ("depends_on", "(.+?)依賴(.+)", False),
    ("depends_on", "(.+?)\\s+depends on\\s+(.+)", False),
    ("references", "(.+?)(?:引用|參考)(.+)", False),
    ("references", "(.+?)\\s+references\\s+(.+)", False),
    ("belongs_to", "(.+?)(?:屬於|隸屬於)(.+)", False),
    ("belongs_to", "(.+?)\\s+belongs to\\s+(.+)", False),
    ("owns", "(.+?)(?:擁有|負責)(.+)", False),
    ("owns", "(.+?)\\s+owns\\s+(.+)", False),
)
# The words of each pattern, without its labels; where none of them is, the pattern does not fit.
TRIGGERS = (
    "導致|造成|引發|使", "\\scauses?\\s", "矛盾|衝突", "\\s(?:contradicts?|conflicts with)\\s", "\\ssucceeds\\s", "接續|接著|後續是", "\\s(?:is )?followed by\\s", "\\sprecedes\\s", "影響",
    "\\s(?:affects?|impacts?)\\s", "依賴", "\\sdepends on\\s", "引用|參考", "\\sreferences\\s", "屬於", "\\sbelongs to\\s", "擁有|負責", "\\sowns\\s",
)
# A label that may begin anywhere begins as far left as it can: behind the start, or behind a character that it cannot hold.
STARTS = (("(.+?)", "(?:^|(?<=[\\n\\r\\x{85}\\x{2028}\\x{2029}]))"), ("([^，,。；;!?！？]+?)(?:與", "(?:^|(?<=[，,。；;!?！？]))"))
# What ends no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Ms.", "Mrs.", "Prof.", "Sr.", "Jr.", "St.", "U.S.", "U.K.")
# Words that make a sentence one of several relations.
MANY = ("依賴", "depends on", "影響", "affects", "導致", "causes", "矛盾", "contradicts", "接續", "followed by", "precedes", "succeeds")


def sentences(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id_col, further columns, pos and sentence. A sentence with two relation words or more is cut at commas too."""
    guard = "".join("(?<!" + a.replace(".", "\\.") + ")" for a in ABBREVIATIONS)
    cut = f"[\\n。！？!?;；]|(?<=[A-Za-z0-9]\\.){guard}\\s+(?=[A-Z\\x{{4e00}}-\\x{{9fff}}])"
    parts = F.filter(F.transform(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), cut), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda x: sum(((F.length(x) - F.length(F.replace(x, F.lit(k), F.lit("")))) / len(k) for k in MANY), F.lit(0.0))
    pieces = F.flatten(F.transform(parts, lambda x: F.when(count(x) > 1, F.filter(F.transform(F.split(x, "[，,]"), lambda z: F.trim(z)), lambda y: y != "")).otherwise(F.array(x))))
    return docs.select(id_col, *more, F.posexplode(pieces).alias("pos", "sentence"))


def relations(found: DataFrame, id_col: str) -> DataFrame:
    """id_col, pos, relation, source, target, evidence, and further columns of found. The first pattern with a label on its left decides; each target of a list is a row.

    One search for the words of all patterns leaves out most sentences, in time that grows with their length. Of the others, only
    patterns whose words are there are tried, each from the places where its label can begin.
    """
    more = [c for c in found.columns if c not in (id_col, "pos", "sentence")]
    s = F.col("sentence")
    start = lambda p: next((at for head, at in STARTS if p.startswith(head)), "")
    patterns = [f"(?i){start(p)}{p}" for _, p, _ in PATTERNS]
    # lambdas keep the generated code small: a pattern is one call in it
    lefts = F.array(*(F.when(s.rlike(f"(?i){t}"), F.regexp_extract(s, p, 1)).otherwise("") for p, t in zip(patterns, TRIGGERS, strict=True)))
    # only the pattern that decides is searched for its right label
    right = F.coalesce(*(F.when(F.col("nth") == k, F.regexp_extract(s, p, 2)) for k, p in enumerate(patterns, 1)))
    by_nth = lambda values: F.element_at(values, F.col("nth").cast("int"))
    literal = lambda values: F.array(*map(F.lit, values))
    rows = found.filter(s.rlike("(?i)" + "|".join(TRIGGERS))).withColumn("lefts", F.transform(lefts, lambda x: F.when(x == "", x).otherwise(clean_label(x))))
    rows = rows.withColumn("nth", F.array_position(F.transform("lefts", lambda x: x != ""), True)).filter("nth > 0")
    rows = rows.select(id_col, "pos", "sentence", *more, by_nth(literal([r for r, _, _ in PATTERNS])).alias("relation"), by_nth(literal([r for _, _, r in PATTERNS])).alias("reverse"), by_nth(F.col("lefts")).alias("left"), right.alias("right"))
    rows = rows.withColumn("other", F.explode(F.transform(split_targets(F.col("right")), clean_label))).filter("other != ''")
    return rows.select(
        id_col, "pos", "relation",
        F.when(F.col("reverse"), F.col("other")).otherwise(F.col("left")).alias("source"),
        F.when(F.col("reverse"), F.col("left")).otherwise(F.col("other")).alias("target"),
        F.col("sentence").alias("evidence"), *more,
    )


def section_id(relpath: Column, node: Column, title: Column) -> Column:
    return F.concat(F.lit("document:section-"), F.substring(F.sha1(F.concat_ws("|", relpath, node).cast("binary")), 1, 12), F.lit("-"), slug(title))


def document_graph(docs: DataFrame, relpath: str, title: str, text: str, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, source_relpath) and edges (id, relation, src, dst, source_relpath, evidence) of all documents.

    tree: section nodes (relpath, node_id, parent_id, title, start_offset, end_offset, section_path). A section is a node that
    belongs to its document, unless their labels are equal, and relations are looked for in each section's own ranges. The
    document refers to each end of a relation. A target that several sources of a document depend on is a concept.
    """
    r = F.col(relpath)
    docs = docs.select(r.alias("relpath"), F.col(title).alias("title"), F.col(text).alias("text"))
    documents = docs.select("relpath", node_id(F.lit("Document"), F.col("title")).alias("document"), F.col("title").alias("document_title"))
    nodes = documents.select(F.col("document").alias("id"), F.lit("Document").alias("type"), F.col("document_title").alias("label"), F.col("relpath").alias("source_relpath"))
    edge = lambda relation, src, dst, evidence, pos: F.struct(F.lit(relation).alias("relation") if isinstance(relation, str) else relation.alias("relation"), src.alias("src"), dst.alias("dst"), evidence.alias("evidence"), pos.alias("pos"))
    if tree is None:
        pieces = docs.select("relpath", F.lit(None).cast("string").alias("section"), F.lit("").alias("prefix"), F.lit(0).alias("begin"), "text")
        parts = None
    else:
        sections = tree.select("relpath", "node_id", F.col("title").alias("section"), F.concat(F.lit("Section: "), "section_path").alias("path"))
        sections = sections.withColumn("id", section_id(F.col("relpath"), F.col("node_id"), F.col("section")))
        own = own_ranges(tree).join(sections, ["relpath", "node_id"]).join(docs.select("relpath", "text"), "relpath")
        pieces = own.select("relpath", "section", F.concat("path", F.lit(" | ")).alias("prefix"), F.col("start").alias("begin"), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
        nodes = nodes.union(sections.select("id", F.lit("Document"), "section", "relpath"))
        inside = sections.join(documents, "relpath").filter("section != document_title and id != document")
        parts = inside.select("relpath", edge("belongs_to", F.col("id"), F.col("document"), F.col("path"), F.lit(-1).cast("long")).alias("e"))
    found = relations(sentences(pieces, "relpath", "text", "section", "prefix", "begin"), "relpath").withColumn("at", F.col("begin").cast("long") * (1 << 24) + F.col("pos"))
    kind = {end: contextual_entity_type(F.col(end), F.col("relation"), end, F.col("section")) for end in ("source", "target")}
    found = found.withColumns({f"{end}_type": k for end, k in kind.items()}).join(documents, "relpath").withColumn("evidence", F.concat("prefix", "evidence"))
    ends = found.select("relpath", "document", "evidence", "at", F.explode(F.array(*(F.struct(node_id(F.col(f"{e}_type"), F.col(e)).alias("id"), F.col(f"{e}_type").alias("type"), F.col(e).alias("label")) for e in ("source", "target")))).alias("e")).select("relpath", "document", "evidence", "at", "e.*")
    nodes = nodes.union(ends.select("id", "type", "label", "relpath"))
    named = found.select("relpath", edge(F.col("relation"), node_id(F.col("source_type"), F.col("source")), node_id(F.col("target_type"), F.col("target")), F.col("evidence"), F.col("at")).alias("e"))
    # the first reference counts, but the last of the other relations
    refs = ends.select("relpath", edge("references", F.col("document"), F.col("id"), F.col("evidence"), -F.col("at") - 2).alias("e"))
    every = named.union(refs) if parts is None else named.union(refs).union(parts)
    edges = _last(every.select(F.col("relpath").alias("source_relpath"), "e.*"))
    return retag(nodes, edges)


def _last(edges: DataFrame) -> DataFrame:
    """One row of each edge: that of the largest pos."""
    rows = edges.withColumn("id", edge_id(F.col("source_relpath"), F.col("relation"), F.col("src"), F.col("dst")))
    return rows.groupBy("id").agg(F.max_by(F.struct("relation", "src", "dst", "source_relpath", "evidence"), F.struct("pos", "evidence")).alias("e")).select("id", "e.*")


def shared_targets(edges: DataFrame) -> DataFrame:
    """source_relpath, dst and n of targets that more than one source depends on: they become concepts."""
    wanted = edges.filter("relation = 'depends_on'")
    return wanted.groupBy("source_relpath", "dst").agg(F.countDistinct("src").alias("n")).filter("n > 1")


def retag(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in which each document's shared targets are concepts, under the ids that concepts have."""
    shared = shared_targets(edges).select("source_relpath", F.col("dst").alias("id"))
    label = nodes.filter("type != 'Concept'").groupBy("source_relpath", "id").agg(F.min("label").alias("label"))
    new = shared.join(label, ["source_relpath", "id"]).select("source_relpath", F.col("id").alias("old"), node_id(F.lit("Concept"), F.col("label")).alias("new"))
    renamed = nodes.join(new.withColumnRenamed("old", "id"), ["source_relpath", "id"], "left")
    nodes = renamed.select(F.coalesce("new", "id").alias("id"), F.when(F.col("new").isNotNull(), "Concept").otherwise(F.col("type")).alias("type"), "label", "source_relpath")
    for end in ("src", "dst"):
        edges = edges.join(new.withColumnRenamed("old", end), ["source_relpath", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return nodes, _last(edges.withColumn("pos", F.lit(0)).drop("id"))


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row an id: type (the first that is no Concept), label (the longest, the first of equal ones), and the union of aliases and sources. order: the column that says who comes first."""
    kind = F.coalesce(F.min_by(F.when(F.col("type") != "Concept", F.col("type")), F.when(F.col("type") != "Concept", F.col(order))), F.min("type"))
    label = F.max_by("label", F.struct(F.length("label"), -F.col(order)))
    return nodes.groupBy("id").agg(kind.alias("type"), label.alias("label"), F.array_sort(F.collect_set("label")).alias("aliases"), F.array_sort(F.collect_set("source_relpath")).alias("source_relpaths"))


def remove_documents(nodes: DataFrame, edges: DataFrame, relpaths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some documents: their edges, and nodes that no other document has."""
    left = edges.join(relpaths.select(F.col("relpath").alias("source_relpath")), "source_relpath", "left_anti")
    kept = nodes.withColumn("r", F.explode("source_relpaths")).join(relpaths.select(F.col("relpath").alias("r")), "r", "left_anti")
    kept = kept.groupBy("id").agg(F.min("type").alias("type"), F.min("label").alias("label"), F.min("aliases").alias("aliases"), F.array_sort(F.collect_set("r")).alias("source_relpaths"))
    return without_dangling(kept, left), left


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are documents or have an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends.withColumn("has", F.lit(True)), "id", "left").filter("has or type = 'Document'").drop("has")


def prune(nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame, gone_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.join(gone_nodes.select("id"), "id", "left_anti")
    e = edges.join(gone_edges.select("id"), "id", "left_anti")
    for end in ("src", "dst"):
        e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
    return n, e


def first_wins(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def unified(sources: DataFrame, pages: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The derived graph of sources, pages and entities: nodes (id, label, kind), edges (id, src, dst, relation, evidence) and the edges left out as an end is missing."""
    s = sources.select(F.concat(F.lit("source:"), "relpath").alias("id"), F.col("relpath").alias("label"), F.lit("source").alias("kind"), F.lit(0).alias("o"))
    w = pages.select(F.concat(F.lit("wiki:"), "slug").alias("id"), F.col("title").alias("label"), F.lit("wiki_page").alias("kind"), F.lit(1).alias("o"))
    e = nodes.select("id", "label", F.lower("type").alias("kind"), F.lit(2).alias("o"))
    every = first_wins(s.union(w).union(e), "id", F.col("o"), F.col("label")).drop("o")
    of = pages.join(sources.select(F.col("relpath").alias("source_relpath")), "source_relpath", "left_semi")
    links = of.select(F.concat(F.lit("wiki:"), "slug").alias("src"), F.concat(F.lit("source:"), "source_relpath").alias("dst"), F.lit("references").alias("relation"))
    links = links.select(edge_id(F.lit("unified"), F.col("relation"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", "relation", F.lit("EXTRACTED").alias("evidence"))
    copied = edges.select("id", "src", "dst", "relation", F.lit("EXTRACTED").alias("evidence"))
    joined = first_wins(links.union(copied), "id", F.col("src"), F.col("dst"))
    ids = every.select("id", F.lit(True).alias("__has"))
    for end in ("src", "dst"):
        joined = joined.join(ids.select(F.col("id").alias(end), F.col("__has").alias(f"__{end}")), end, "left")
    whole = F.coalesce("__src", F.lit(False)) & F.coalesce("__dst", F.lit(False))
    return every, joined.filter(whole).drop("__src", "__dst"), joined.filter(~whole).drop("__src", "__dst")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and community of each node: connected components, numbered by their smallest node. A node without edges is its own."""
    parts = connected_components(edges, together=TOGETHER).select(F.col("node").alias("id"), "component")
    return nodes.select("id").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))


def community_summary(nodes: DataFrame, edges: DataFrame, member: DataFrame, first_edges: int = 10) -> DataFrame:
    """component, n_nodes, n_edges, label (the first page by id, else entity, else node) and the first edges by id."""
    kind = F.when(F.col("kind") == "wiki_page", 0).when(F.col("kind") != "source", 1).otherwise(2)
    n = nodes.join(member, "id").groupBy("component").agg(F.count("*").alias("n_nodes"), F.min_by("label", F.struct(kind, "id")).alias("label"))
    e = edges.join(member.select(F.col("id").alias("src"), "component"), "src").select("component", "id")
    ranked = e.withColumn("at", F.row_number().over(Window.partitionBy("component").orderBy("id")))
    e = ranked.groupBy("component").agg(F.count("*").alias("n_edges"), F.array_sort(F.collect_list(F.when(F.col("at") <= first_edges, F.col("id")))).alias("first_edges"))
    return n.join(e, "component", "left").withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "first_edges": F.coalesce("first_edges", F.array().cast("array<string>"))})
