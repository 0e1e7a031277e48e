"""The library as one object: ingest, query, lint, refresh, catalogue and graph analytics over the tables of a store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark import audit
from lorespark.audit import PARTS
from lorespark.functions import text as T
from lorespark.functions import vectors as V
from lorespark.operators import catalog, chunks, graph, ledger, lint, postings, refresh, retrieval, trees
from lorespark.operators.tables import union_all, written
from lorespark.sources import files, sinks
from lorespark.streaming import ledger as ledger_stream

FINGERPRINT = {"txt": "txt:v1:", "md": "md:v1:", "docx": "docx:v1:", "xlsx": "xlsx:v1:", "pptx": "pptx:v1:"}
#: Tables, and the column that names a row's document.
TABLES = {"sources": "relpath", "wiki_pages": "source_relpath", "chunks": "relpath", "vectors": "relpath", "tree_nodes": "relpath", "graph_nodes": "source_relpath", "graph_edges": "source_relpath", "wiki_index": "source_relpath"}


def _summed(nodes: DataFrame) -> DataFrame:
    """Tree nodes with the summary that searches see."""
    return nodes.withColumn("summary", F.concat(F.lit("Summary of: "), "title"))


#: Lists by term that every commit, and every range of the store's base, has of its pages and tree nodes.
LISTS = {
    "page_lists": lambda tables, docs, by: postings.build(postings.page_entries(tables["wiki_pages"], *by), docs, *by),
    "node_lists": lambda tables, docs, by: postings.build(postings.node_entries(_summed(tables["tree_nodes"]), *by), docs, *by),
}


class Engine:
    """A knowledge base under one folder. An ingest writes the rows of the documents it changes, in one commit for all tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.store = sinks.Store(spark, f"{self.root}/store", TABLES, derived=LISTS)
        self.candidates = sinks.VersionedTable(spark, f"{self.root}/candidates")
        #: Blocks of page lists that the last query found and read.
        self.blocks: dict[str, int] = {}
        self.graph_runs = sinks.VersionedTable(spark, f"{self.root}/graphify/runs")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.store.read(name)
        raise AttributeError(name)

    def scan(self, path: str, whole: bool = False) -> DataFrame:
        """The files of a folder with format, digest, parser and issue. Files of the length and time they had when they were ingested are not read, but with whole."""
        if whole or not self.store.exists():
            return self._named(files.checked(files.discover(self.spark, path)))
        current = F.create_map(*(F.lit(x) for kv in FINGERPRINT.items() for x in kv))
        known = self._manifest().filter((F.col("root") == path.rstrip("/")) & (F.col("parser_fingerprint") == F.try_element_at(current, "format")))
        return self._named(files.rescan(self.spark, path, known.select("relpath", F.col("size_bytes").alias("length"), F.col("modified").alias("modificationTime"), "sha256")))

    @staticmethod
    def _named(found: DataFrame) -> DataFrame:
        f = F.lit(None).cast("string")
        for k, v in FINGERPRINT.items():
            f = F.when(F.col("format") == k, v).otherwise(f)
        known = F.when(F.col("issue").isNotNull(), F.col("issue")).when(f.isNull(), "unsupported")
        return found.withColumns({"parser_fingerprint": f, "issue": known})

    def _manifest(self) -> DataFrame:
        """Sources that came from files; pages written back have none."""
        if self.store.exists():
            return self.sources.filter("format != 'writeback'")
        return self.spark.createDataFrame([], "relpath string, format string, sha256 string, parser_fingerprint string, size_bytes long, wiki_pages array<string>, vector_ids array<string>, graph_nodes array<string>, graph_edges array<string>, page_tree long, body_length int, root string, modified timestamp")

    def ingest(self, path: str, prune: bool = False, found: DataFrame | None = None, stream: tuple[str, int] | None = None) -> DataFrame:
        """Ingests new and changed files; relpath and status of every file. Files that did not change are not parsed again; one that can't be parsed is failed and keeps the document it had, and an empty one is skipped and has none. found: files of scan() in place of a new scan; stream: see Store.commit."""
        after = self.store.latest()
        found, old = self.scan(path) if found is None else found, self._manifest()
        status = written(refresh.ingest_status(found, old, prune))
        todo = found.join(status.filter("status in ('created', 'updated')").select("relpath"), "relpath", "left_semi")
        # texts as they stand in the body, so that sections and chunks have their offsets
        segments = written(files.read_office(todo).withColumn("text", F.when(F.col("kind") == "error", F.col("text")).otherwise(T.normalize_text(F.col("text")))))
        broken = segments.filter("kind = 'error'").select("relpath").distinct()
        office = segments.join(broken, "relpath", "left_anti")
        plain = files.read_text(todo).select("relpath", "format", "title", T.normalize_text(F.col("body")).alias("body"))
        bodies = chunks.segments_to_body(office).join(todo.select("relpath", "format"), "relpath")
        bodies = bodies.select("relpath", "format", files.title_of(F.col("relpath")).alias("title"), T.normalize_text(F.col("body")).alias("body"))
        parsed = written(plain.union(bodies).filter("body != ''").withColumn("summary", T.summary(F.col("body"))))
        pages = written(sinks.wiki_pages(parsed, self.wiki_pages.select("slug", "source_relpath", "origin") if after else None))
        if after:
            # pages that were made of a document stay when it changes
            own = self.wiki_pages.filter("origin = 'llm_wiki'").join(parsed.select(F.col("relpath").alias("source_relpath")), "source_relpath", "left_semi")
            pages = written(pages.unionByName(own.select(pages.columns)))
        tree = written(self._tree(parsed, office))
        sha = todo.select("relpath", "sha256", "parser_fingerprint", F.col("length").alias("size_bytes"), "format", F.col("modificationTime").alias("modified"))
        pieces = written(self._chunks(parsed, office, tree, sha))
        nodes, edges = (written(x) for x in graph.document_graph(parsed, "relpath", "title", "body", tree))
        entries = sha.join(parsed.select("relpath", F.length("body").alias("body_length")), "relpath").withColumn("root", F.lit(path.rstrip("/")))
        entries = self._entries(entries, {"wiki_pages": pages, "chunks": pieces, "graph_nodes": nodes, "graph_edges": edges, "tree_nodes": tree})
        rows = {"sources": entries, "wiki_pages": pages, "wiki_index": self._index(pages), "chunks": pieces, "vectors": self._vectors(pieces), "tree_nodes": tree, "graph_nodes": nodes, "graph_edges": edges}
        # a file whose new content cannot be parsed keeps its old document; one that is empty now has none
        gone = status.filter("status in ('updated', 'pruned')").select("relpath").join(broken, "relpath", "left_anti")
        if not (parsed.isEmpty() and gone.isEmpty()):
            self.store.commit(rows, gone, after, stream)
        empty = todo.select("relpath").join(broken, "relpath", "left_anti").join(parsed.select("relpath"), "relpath", "left_anti").select("relpath", F.lit("skipped").alias("now"))
        now = broken.select("relpath", F.lit("failed").alias("now")).union(empty)
        out = status.join(now, "relpath", "left").select("relpath", F.coalesce("now", "status").alias("status"))
        self._log(out.filter("status != 'skipped'").select(F.lit("ingest").alias("event"), "status", F.col("relpath").alias("target"), F.lit("ingest").alias("action"), F.when(F.col("status") == "failed", "failed").otherwise("success").alias("outcome")))
        return out

    @staticmethod
    def _entries(base: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        """Manifest entries with what the tables hold of each document."""
        for table, key, name in (("wiki_pages", "slug", "wiki_pages"), ("chunks", "chunk_id", "vector_ids"), ("graph_nodes", "id", "graph_nodes"), ("graph_edges", "id", "graph_edges")):
            ids = tables[table].groupBy(F.col(TABLES[table]).alias("relpath")).agg(F.array_sort(F.collect_set(key)).alias(name))  # of one document
            base = base.join(ids, "relpath", "left")
        return base.join(tables["tree_nodes"].groupBy("relpath").agg(F.count("*").alias("page_tree")), "relpath", "left")

    def rebuild_manifest(self) -> DataFrame:
        """Makes entries whose lists are not what the tables hold anew, from the tables; relpath of each."""
        after, old = self.store.latest(), self.sources.filter("format != 'writeback'")
        made = ("wiki_pages", "vector_ids", "graph_nodes", "graph_edges", "page_tree")
        new = self._entries(old.drop(*made), {t: self.store.read(t) for t in TABLES if t != "sources"}).select(old.columns)
        listed = lambda c: F.array_sort(F.col(c)) if c != "page_tree" else F.col(c)
        as_rows = lambda rows: rows.select("relpath", *(listed(c).alias(c) for c in made))
        wrong = written(as_rows(new).exceptAll(as_rows(old)).select("relpath").distinct())
        if not wrong.isEmpty():
            rows = {t: self.store.read(t).join(wrong.withColumnRenamed("relpath", doc), doc, "left_semi") for t, doc in TABLES.items()}
            self.store.commit(rows | {"sources": new.join(wrong, "relpath", "left_semi")}, wrong, after)
        return wrong

    def _log(self, events: DataFrame) -> None:
        """event, status, target, action and outcome of what was done."""
        sinks.append_log(events.withColumn("at", F.current_timestamp()), f"{self.root}/log")

    def log(self) -> DataFrame:
        """What ingests and fixes did, and when: event, status, target, action, outcome, at."""
        return self.spark.read.parquet(f"{self.root}/log")

    def follow(self, path: str, checkpoint: str, prune: bool = False) -> DataFrame:
        """Ingests the files that came since the last call, in micro-batches, and gives the number of the last one. A batch carries its number into the commit, so that one that is run again after a stop changes nothing. Files that changed or went are those that differ from a listing of the folder: they are looked for after the new ones."""
        name = f"follow:{path.rstrip('/')}"

        def apply(new: DataFrame, number: int) -> None:
            self.ingest(path, found=written(self._named(files.checked(files.relative(new, path)))), stream=(name, number))

        query = ledger_stream.refresh_stream(self.spark, path, apply, checkpoint)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        self.ingest(path, prune)
        return self.spark.createDataFrame([(self.store.applied(name),)], "batch long")

    def _tree(self, parsed: DataFrame, office: DataFrame) -> DataFrame:
        """Sections by format: headings of markdown and Word files, slides with their headings, sheets; one section for plain text and where there is none."""
        spans = chunks.segment_spans(office).join(parsed.select("relpath", "format"), "relpath")
        heads = trees.markdown_headings(parsed.filter("format = 'md'"), "relpath", "body").unionByName(trees.segment_headings(spans.filter("format = 'docx'")))
        sections = trees.nest(heads).unionByName(trees.header_tree(spans.filter("format in ('pptx', 'xlsx')")))
        flat = trees.single_root(parsed.join(sections.select("relpath").distinct(), "relpath", "left_anti"), "relpath", "title", "body")
        return sections.unionByName(flat)

    def _chunks(self, parsed: DataFrame, office: DataFrame, tree: DataFrame, sha: DataFrame) -> DataFrame:
        """chunk_id, relpath, chunk_idx, text, offset, tree_node_id, section_path, section_type and header of each chunk."""
        text = parsed.filter("format in ('txt', 'md')")
        cut = chunks.chunk_windows(text, "relpath", "body").withColumn("text", chunks.joined(F.col("tokens"))).drop("tokens")
        placed = cut.join(trees.chunk_offsets(cut, text), ["relpath", "chunk_idx"])
        at = trees.sections_at(placed.select("relpath", "offset").distinct(), tree)
        none = F.lit(None).cast("string")
        one = placed.join(at, ["relpath", "offset"], "left").select("relpath", "chunk_idx", "text", "offset", F.col("node_id").alias("tree_node_id"), "section_path", none.alias("section_type"), none.alias("header"))
        # chunks of segments know their heading, slide or sheet: the first section of that title
        named = tree.groupBy("relpath", F.col("title").alias("named")).agg(F.min_by(F.struct("node_id", "section_path", "start_offset"), "preorder").alias("n"))
        packed = chunks.segment_chunks(office).withColumn("named", F.regexp_replace(F.coalesce("header", "heading"), "^#+\\s*", ""))
        root = tree.filter("preorder = 1").select("relpath", F.struct("node_id", "section_path", "start_offset").alias("first"))
        two = packed.join(named, ["relpath", "named"], "left").join(root, "relpath").withColumn("n", F.coalesce("n", "first"))
        two = two.select("relpath", "chunk_idx", "text", F.col("n.start_offset").alias("offset"), F.col("n.node_id").alias("tree_node_id"), F.col("n.section_path").alias("section_path"), "section_type", "header")
        both = one.unionByName(two).join(sha.select("relpath", "sha256", "parser_fingerprint"), "relpath")
        return both.withColumn("chunk_id", T.chunk_id(F.col("sha256"), F.concat_ws("|", "parser_fingerprint", "relpath"), F.col("chunk_idx"))).drop("sha256", "parser_fingerprint")

    @staticmethod
    def _vectors(pieces: DataFrame) -> DataFrame:
        return V.embedded(pieces, "chunk_id", "text", "relpath")

    @staticmethod
    def _index(pages: DataFrame) -> DataFrame:
        """The index's rows of pages; they change with the pages, in one commit."""
        return pages.select("slug", "title", "summary", "source_relpath")

    def rebuild_index(self) -> None:
        """Documents whose index is not that of their pages are written again with it."""
        after, pages = self.store.latest(), self._index(self.wiki_pages)
        wrong = written(pages.exceptAll(self.wiki_index).union(self.wiki_index.exceptAll(pages)).select(F.col("source_relpath").alias("relpath")).distinct())
        if wrong.isEmpty():
            return
        rows = {t: self.store.read(t).join(wrong.withColumnRenamed("relpath", doc), doc, "left_semi") for t, doc in TABLES.items()}
        self.store.commit(rows | {"wiki_index": self._index(rows["wiki_pages"])}, wrong, after)

    def index_lines(self) -> DataFrame:
        return sinks.index_lines(self.wiki_index)

    def query(self, questions: DataFrame | str, writeback: str = "no", threshold: float = 0.75, reranker: Callable[[DataFrame], DataFrame] | None = None, most: int = 10) -> DataFrame:
        """reranker: gets the first `most` candidates of each question (query_id, question, index, route, text, score) and gives a ranking (query_id, indices); a question that it leaves out, or ranks with indices that are not there, keeps its order. answer, route, confidence, source, quote and section_path for each question (query_id, question), or for one. writeback: yes, auto (at the threshold) or no; then answers become pages, and `writeback` says which."""
        if isinstance(questions, str):
            questions = self.spark.createDataFrame([(0, questions)], "query_id long, question string")
        out = written(retrieval.in_blocks(questions, lambda block: self._answers(block, reranker, most)))
        if writeback == "no":
            return out
        gate = retrieval.writeback(out, writeback, threshold)
        asked = out.join(questions, "query_id").filter("confidence > 0")
        related = retrieval.related_pages(out.filter("source != ''").select("query_id", F.col("source").alias("relpath")), self.wiki_pages)
        self._write_back(sinks.writeback_pages(asked, gate, related))
        return out.join(gate.select("query_id", F.col("status").alias("writeback")), "query_id")

    def _answers(self, questions: DataFrame, reranker: Callable[[DataFrame], DataFrame] | None = None, most: int = 10) -> DataFrame:
        pages = self.wiki_pages
        routed = written(retrieval.route(questions, retrieval.rule_table(self.spark)))
        nodes = graph.merge_nodes(self.graph_nodes.withColumn("o", F.xxhash64("source_relpath", "label")), "o")
        at = self.store.latest()
        current = lambda rows: self.store.current(rows, at)
        best, self.blocks = postings.page_search(questions, self.store.segments("page_lists", at), pages, current)
        sections = postings.node_search(questions, self.store.segments("node_lists", at), current).join(_summed(self.tree_nodes), ["relpath", "preorder"])
        found = [
            retrieval.wiki_candidates(questions, pages, routed, best),
            retrieval.graph_candidates(questions, nodes, self.graph_edges, retrieval.keyword_table(self.spark)),
            retrieval.vector_candidates(questions, self.chunks, self.vectors),
            retrieval.node_candidates(sections),
        ]
        fused = retrieval.fuse(union_all(found))
        if reranker is not None:
            fused = written(fused)
            first = fused.filter(F.col("position") <= most).select("query_id", (F.col("position") - 1).alias("index"), "route", "text", "score")
            fused = retrieval.rerank(fused, retrieval.valid_ranking(reranker(first.join(questions.select("query_id", "question"), "query_id")), first), most)
        return retrieval.answers(questions, fused, routed)

    def _write_back(self, answers: DataFrame) -> None:
        """Pages without a file: each is a document of its own, whose chunk can be found."""
        after, old = self.store.latest(), self.wiki_pages.select("slug", "source_relpath")
        rows = answers.withColumn("relpath", F.concat(F.lit("writeback/"), T.slug(F.col("title")))).dropDuplicates(["relpath"])
        pages = written(sinks.wiki_pages(rows, old).withColumn("origin", F.lit("writeback")))
        if pages.isEmpty():
            return
        source = pages.select(F.col("source_relpath").alias("relpath"), F.lit("writeback").alias("format"), F.sha2("body", 256).alias("sha256"), F.lit("*").alias("parser_fingerprint"), F.length("body").cast("long").alias("size_bytes"), F.array("slug").alias("wiki_pages"), F.length("body").alias("body_length"))
        empty = {t: self.store.read(t).limit(0) for t in TABLES}
        rows = empty | {"sources": empty["sources"].unionByName(source, allowMissingColumns=True), "wiki_pages": pages.select(empty["wiki_pages"].columns), "wiki_index": self._index(pages)}
        self.store.commit(rows, after=after)

    def lint(self, path: str | None = None) -> DataFrame:
        """Findings of all checks over the store. path: the raw files' folder, else those that were ingested."""
        pages, sources = self.wiki_pages, self._manifest()
        roots = [path] if path else [r["root"] for r in sources.select("root").distinct().collect()]  # as many as folders were ingested
        raw = reduce(DataFrame.union, [self.scan(r).select("relpath") for r in roots]) if roots else sources.select("relpath")
        current = F.lit(None).cast("string")
        for k, v in FINGERPRINT.items():
            current = F.when(F.col("format") == k, v).otherwise(current)
        ingested = pages.filter("origin != 'writeback'")
        tree, bodies = self.tree_nodes, sources.select("relpath", F.col("body_length").alias("length"))
        nodes = graph.merge_nodes(self.graph_nodes.withColumn("o", F.xxhash64("source_relpath", "label")), "o")
        parts = [
            lint.check_wiki(pages, self.wiki_index),
            lint.check_sources(sources, raw.join(self._unreadable(roots), "relpath", "left_anti"), ingested),
            lint.check_vectors(sources.filter("vector_ids is not null"), self.chunks),
            lint.check_graph(sources.filter("graph_nodes is not null"), nodes, self.graph_edges),
            lint.check_fingerprints(sources, current),
            lint.check_trees(sources, tree.select("relpath").distinct().withColumn("corrupt", F.lit(None).cast("string")), tree, bodies),
            lint.check_chunk_sections(self.chunks, tree, bodies),
            audit.artifact_findings(self.spark, self.root),
            audit.synthesis_findings(self.spark, self.candidates, pages),
            audit.graph_run_findings(self.spark, self.root, self.graph_runs),
            audit.watch_findings(self.spark, self.root),
        ]
        return union_all(parts)

    def _unreadable(self, roots: list[str]) -> DataFrame:
        """relpath of files that no ingest takes."""
        parts = [self.scan(r).filter("issue is not null").select("relpath") for r in roots]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "relpath string")

    def fix(self, path: str | None = None, apply: bool = False) -> DataFrame:
        """What lint's findings allow to mend: action, target, reason (why it is skipped) and outcome (planned, skipped, success or apply_failed). With apply, the index is built anew and rows that no manifest entry has go, and what was done is logged."""
        steps = written(lint.fix_plan(self.lint(path), reasons=True).distinct())
        became = F.when(F.col("action") == "skip", "skipped").otherwise("planned")
        if apply:
            todo = {r["action"] for r in steps.select("action").distinct().collect()}  # a handful of kinds
            pruned = todo & {"prune_vectors", "prune_graph_nodes", "prune_graph_edges"}
            for kinds, mend in ((todo & {"rebuild_index"}, self.rebuild_index), (pruned, lambda: self._prune(steps))):
                if kinds:
                    try:
                        mend()
                        outcome = "success"
                    except Exception:  # noqa: BLE001  the state is the report
                        outcome = "apply_failed"
                    became = F.when(F.col("action").isin(*kinds), outcome).otherwise(became)
        steps = steps.withColumn("outcome", became)
        if apply:
            self._log(steps.filter("action != 'skip'").select(F.lit("lint").alias("event"), F.lit("lint_fix_applied").alias("status"), "target", "action", "outcome"))
        return steps

    def _prune(self, steps: DataFrame) -> None:
        """Documents with rows to prune are written again without them."""
        after, dropped = self.store.latest(), {}
        for action, table, key in (("prune_vectors", "chunks", "chunk_id"), ("prune_vectors", "vectors", "chunk_id"), ("prune_graph_nodes", "graph_nodes", "id"), ("prune_graph_edges", "graph_edges", "id")):
            dropped[table] = key, steps.filter(F.col("action") == action).select(F.col("target").alias(key))
        touched = reduce(DataFrame.union, [self.store.read(t).join(gone, key, "left_semi").select(F.col(TABLES[t]).alias("relpath")) for t, (key, gone) in dropped.items()]).distinct()
        touched = written(touched)
        rows = {}
        for table, doc in TABLES.items():
            part = self.store.read(table).join(touched.select(F.col("relpath").alias(doc)), doc, "left_semi")
            rows[table] = part.join(dropped[table][1], dropped[table][0], "left_anti") if table in dropped else part
        self.store.commit(rows, touched, after)

    def refresh(self, path: str, prune: bool = False, mode: str = "plan") -> DataFrame:
        """The actions that bring the store up to date. mode: plan, or execute, which runs them and adds each one's kind of outcome; plans and runs are kept under the root."""
        steps = refresh.plan(refresh.states(self.scan(path), self._manifest()), prune)
        if mode != "execute":
            return steps
        steps, run = written(steps), uuid.uuid4().hex
        steps.withColumn("run_id", F.lit(run)).write.mode("append").parquet(f"{self.root}/watch/plans")

        def ingested(_: DataFrame) -> DataFrame:
            """One ingest takes all new, changed and pruned files; what became of each is what it says."""
            became = F.when(F.col("status") == "failed", "failed").when(F.col("status").isin("created", "updated", "pruned"), "completed").otherwise("skipped")
            verb = F.when(F.col("status") == "pruned", "prune:").otherwise("ingest:")
            return written(self.ingest(path, prune).select(F.concat(verb, "relpath").alias("action_id"), became.alias("outcome")))

        out = written(refresh.execute(steps, {("prune", "ingest"): ingested, ("graphify_build",): lambda _: self._kept_graph()}, "execute"))
        out.withColumns({"run_id": F.lit(run), "at": F.current_timestamp()}).write.mode("append").parquet(f"{self.root}/watch/runs")
        return out

    def _kept_graph(self) -> None:
        self.graph_analytics(keep=True)

    def catalog(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return catalog.page(self.sources, offset, limit)

    def show(self, relpath: str) -> DataFrame:
        """The manifest entry of one document."""
        return self.store.read("sources", relpath)

    def extract(self, again: bool = False) -> DataFrame:
        """What the extractor finds in each page (slug, label, confidence, summary, concept), made once for each text of a page; again: made anew."""
        from lorespark.services import Artifacts

        pages = self.wiki_pages.select("slug", "body", "source_relpath")
        asked = pages.withColumn("idempotency_key", F.concat_ws(":", F.lit("extract:v1"), "slug", F.sha2("body", 256)))
        made = lambda todo: catalog.extract(todo, "idempotency_key", "body").join(todo.select("idempotency_key", "slug", "source_relpath"), "idempotency_key")
        return Artifacts(self.spark, self.root).store_or_reuse(asked, made, F.lit(True) if again else None)

    def synthesize(self) -> DataFrame:
        """A page candidate for each document, from its extraction, its entities and what its graph says; kept under candidate_id, with the digest of the source it is made of."""
        found = self.extract().groupBy(F.col("source_relpath").alias("relpath")).agg(F.min_by("artifact_id", "slug").alias("artifact_id"), F.min_by("summary", "slug").alias("summary"))
        entities = self.graph_nodes.groupBy(F.col("source_relpath").alias("relpath")).agg(F.slice(F.array_sort(F.collect_set("label")), 1, 8).alias("entities"))
        facts = self.graph_edges.filter("relation != 'belongs_to'").groupBy(F.col("source_relpath").alias("relpath")).agg(F.slice(F.array_sort(F.collect_set("evidence")), 1, 8).alias("facts"))
        none = F.array().cast("array<string>")
        rows = found.join(entities, "relpath", "left").join(facts, "relpath", "left").withColumns({"entities": F.coalesce("entities", none), "facts": F.coalesce("facts", none)})
        made = catalog.synthesize(rows).join(self.sources.select("relpath", "sha256", "parser_fingerprint"), "relpath")
        made = written(made.dropDuplicates(["target_slug"]))
        self.candidates.upsert(made, "candidate_id")
        return made

    def apply(self, candidate_ids: DataFrame | None = None) -> DataFrame:
        """candidate_id, target_slug and operation of stored candidates, all or some. Those that create or update become pages of their source, in one commit; stale: the source is another than the candidate was made of, or gone; conflict: the slug is a page of other origin or source."""
        after = self.store.latest()
        asked = self.candidates.read() if candidate_ids is None else self.candidates.read().join(candidate_ids.select("candidate_id"), "candidate_id", "left_semi")
        now = self.sources.select("relpath", F.col("sha256").alias("is_sha"), F.col("parser_fingerprint").alias("is_parser"))
        fresh = (F.col("sha256") == F.col("is_sha")) & (F.col("parser_fingerprint") == F.col("is_parser"))
        asked = asked.join(now, "relpath", "left").withColumn("fresh", F.coalesce(fresh, F.lit(False))).drop("is_sha", "is_parser")
        what = catalog.apply_operation(asked, self.wiki_pages).join(asked.select("candidate_id", "fresh"), "candidate_id")
        what = written(what.select("candidate_id", "target_slug", F.when(F.col("fresh"), F.col("operation")).otherwise("stale").alias("operation")))
        todo = written(asked.join(what.filter("operation in ('create', 'update')").select("candidate_id"), "candidate_id", "left_semi").dropDuplicates(["target_slug"]))
        if not todo.isEmpty():
            rows = {t: self.store.read(t).join(todo.select(F.col("relpath").alias(doc)).distinct(), doc, "left_semi") for t, doc in TABLES.items()}
            told = {"generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "extraction_artifact_id": F.col("artifact_id"), "wiki_candidate_artifact_id": F.col("candidate_id"), "source_fingerprint": F.col("sha256"), "parser_fingerprint": F.col("parser_fingerprint"), "prompt_version": F.lit("v1"), "provider_id": F.lit("built-in"), "model_id": F.lit("rules")}
            metadata = F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v)))
            new = sinks.page_text(todo.select(F.col("target_slug").alias("slug"), "title", "summary", "body", "relpath", F.lit("llm_wiki").alias("origin"), metadata.alias("metadata")))
            pages = rows["wiki_pages"].join(new.select("slug"), "slug", "left_anti").unionByName(new.select(rows["wiki_pages"].columns))
            slugs = pages.groupBy(F.col("source_relpath").alias("relpath")).agg(F.array_sort(F.collect_set("slug")).alias("s"))
            sources = rows["sources"].join(slugs, "relpath").withColumn("wiki_pages", F.col("s")).select(rows["sources"].columns)
            self.store.commit(rows | {"wiki_pages": pages, "wiki_index": self._index(pages), "sources": sources}, None, after)
        return what

    def graph_analytics(self, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes and edges of the unified graph, and its communities. keep: as the newest run under the root."""
        nodes = graph.merge_nodes(self.graph_nodes.withColumn("o", F.xxhash64("source_relpath", "label")), "o")
        n, e, _ = graph.unified(self.sources, self.wiki_pages, nodes, self.graph_edges)
        n, e = written(n), written(e)
        out = n, e, written(graph.community_summary(n, e, graph.communities(n, e)))
        if keep:
            run = uuid.uuid4().hex
            for name, rows in zip(PARTS, out, strict=True):
                rows.write.parquet(f"{self.root}/graphify/{run}/{name}")
            # the run is there once its row is, with all of its parts
            row = self.spark.createDataFrame([(run, self.store.latest(), *(rows.count() for rows in out))], "run_id string, store_commit long, nodes long, edges long, communities long")
            self.graph_runs.upsert(row.withColumns({"status": F.lit("complete"), "at": F.current_timestamp()}), "run_id")
        return out

    def graph_run(self, run_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and communities of a kept run, the latest else."""
        run = run_id or self.graph_runs.read().orderBy(F.desc("at"), "run_id").first()["run_id"]
        return tuple(self.spark.read.parquet(f"{self.root}/graphify/{run}/{name}") for name in PARTS)

    def watch_runs(self) -> DataFrame:
        """The actions of all runs of refresh, with their outcomes; see watch_status."""
        return self.spark.read.parquet(f"{self.root}/watch/runs")

    def watch_status(self) -> DataFrame:
        """run_id, at, and how many actions had each outcome; the latest run first."""
        sums = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in refresh.OUTCOMES]
        status = F.when(F.col("failed") > 0, "partial").otherwise("complete").alias("status")
        return self.watch_runs().groupBy("run_id").agg(F.max("at").alias("at"), *sums).select("*", status).orderBy(F.desc("at"), "run_id")

    def leases(self, events: DataFrame) -> DataFrame:
        return ledger.fold_leases(events)
