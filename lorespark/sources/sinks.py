"""Tables and files that are written: versions with a pointer, wiki pages, index, logs, reports."""

from __future__ import annotations

import html
import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import slug, unique_slug
from lorespark.operators.tables import ages, create_once, delete, names, read_small, written


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit is visible."""


class VersionedTable:
    """A Parquet table of versions. A version is a folder of its own, and becomes visible by one numbered file that only one writer can create: readers follow the newest number, a failed write changes nothing they see, and of two writers from the same version one gets Conflict."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The newest version's number; 0 before the first."""
        return max([0, *map(int, names(self.spark, f"{self.path}/versions"))])

    def exists(self) -> bool:
        return self.version() > 0

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def folder(self, version: int | None = None) -> str:
        version = self.version() if version is None else version
        return f"{self.path}/data/{read_small(self.spark, f'{self.path}/versions/{version:08d}')}"

    def write(self, df: DataFrame, after: int | None = None) -> None:
        """after: the version that df was made from, else the newest."""
        after, batch = self.version() if after is None else after, uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{batch}")
        if not create_once(self.spark, f"{self.path}/versions/{after + 1:08d}", batch):
            raise Conflict(f"version {after + 1} is taken")

    def _changed(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> None:
        """Writes what change makes of the newest version, anew if another writer was faster."""
        for k in range(tries):
            after = self.version()
            try:
                return self.write(change(self.read(after) if after else None), after)
            except Conflict:
                if k == tries - 1:
                    raise

    def upsert(self, new: DataFrame, key: str) -> None:
        """Rows of new in place of those with the same key."""
        self._changed(lambda old: new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame, key: str) -> None:
        self._changed(lambda old: old.join(keys.select(key), key, "left_anti"))


#: Makes a derived table of tables, for so many documents at most in a part, keeping columns that parts are told by.
Derive = Callable[[dict[str, DataFrame], int, tuple[str, ...]], DataFrame]


def _range_of(lows: list[str]):
    """Rows of relpath with the number of the range that each is in; -1 where there are no ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [max(bisect_right(lows, p) - 1, 0 if lows else -1) for p in b.column("relpath").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("relpath"), pa.array(at, pa.int32())], ["relpath", "old"])

    return run


class Store:
    """Tables of documents that change together. A commit holds the rows of the documents it replaces, in a folder of its own
    for each table, and becomes visible in all tables at once by one small numbered file. Rows of other documents are not rewritten.

    tables: name, and the column that says which document a row is of. A commit's number follows the one its rows were made
    from, and its file can only be created once, so of two writers one gets Conflict. A document's rows are those of its
    latest commit.

    After `most_deltas` commits compact() merges them into a base: documents in ranges of relpath, about `range_docs` in each,
    with one folder a table and range. Only ranges with changed documents are written; a base's file lists all ranges with
    their folder, number of documents and digest. So a read looks at the last base and the few commits after it, a read
    of one document at one range of it and the commits whose documents may include it. The file has a line for each range.

    derived: tables that are made of the tables' rows of one commit, or of one range of a base, such as lists by term: their
    rows are of many documents. segments() has all parts of one, and current() leaves out what it has of replaced documents.

    Every number is a snapshot that can be read until expire() drops it; pinned() keeps one while it is read.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], most_deltas: int = 20, range_docs: int = 50_000, derived: dict[str, Derive] | None = None) -> None:
        self.spark, self.root, self.most_deltas, self.range_docs = spark, root.rstrip("/"), most_deltas, range_docs
        self.tables, self.keys, self.derived = tables, tables | {"documents": "relpath"}, derived or {}
        self._known: dict[int, dict] = {}

    def commits(self) -> list[tuple[int, dict]]:
        """Number and content of each commit there is. Their files never change, so each is read once."""
        numbers = sorted(int(n) for n in names(self.spark, f"{self.root}/commits"))
        for n in numbers:
            if n not in self._known:
                self._known[n] = json.loads(read_small(self.spark, f"{self.root}/commits/{n:08d}"))
        return [(n, self._known[n]) for n in numbers]

    def latest(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max([0, *map(int, names(self.spark, f"{self.root}/commits"))])

    def exists(self) -> bool:
        return self.latest() > 0

    def state(self, at: int | None = None, relpath: str | None = None) -> tuple[list[dict], list[dict]]:
        """The base's ranges and the commits after it, as of a number; with relpath, only those that may have that document."""
        seen = [(n, c) for n, c in self.commits() if at is None or n <= at]
        base = max([n for n, c in seen if c["kind"] == "base"], default=0)
        if at and (not seen or not base and seen[0][0] > 1):
            raise ValueError(f"snapshot {at} is expired")
        ranges = next((c["ranges"] for n, c in seen if n == base), [])
        deltas = [c for n, c in seen if n > base]
        if relpath is not None:
            ranges = ranges[max(0, bisect_right([r["low"] for r in ranges], relpath) - 1) :][:1]
            deltas = [c for c in deltas if c["docs"] and c["low"] <= relpath <= c["high"]]
        return ranges, deltas

    def folders(self, name: str, at: int | None = None, relpath: str | None = None) -> list[str]:
        """The folders that a read of a table looks at."""
        ranges, deltas = self.state(at, relpath)
        return self._base_folders(name, ranges) + [f"{self.root}/{name}/{c['batch']}" for c in deltas]

    def _base_folders(self, name: str, ranges: list[dict]) -> list[str]:
        return [f"{self.root}/{name}/{r['folder']}/range={r['part']}" for r in ranges if name in r["tables"]]

    def _touched(self, deltas: list[dict]) -> DataFrame:
        """Of documents in commits: relpath, the batch of the last, and whether they went with it."""
        entries = self.spark.read.parquet(*(f"{self.root}/entries/{c['batch']}" for c in deltas))
        return entries.groupBy("relpath").agg(F.max_by(F.struct("batch", "gone"), "number").alias("e")).select("relpath", "e.*")

    def _schema(self, name: str) -> T.StructType:
        """A table's columns. Commits keep them, so that no file is opened for it."""
        return T.StructType.fromJson(json.loads(self.commits()[-1][1]["schemas"][name]))

    def _rows(self, name: str, ranges: list[dict], deltas: list[dict]) -> DataFrame:
        schema, key, parts = self._schema(name), self.keys[name], []
        touched = self._touched(deltas) if deltas else None
        if folders := self._base_folders(name, ranges):
            base = self.spark.read.schema(schema).parquet(*folders)
            parts.append(base if touched is None else base.join(touched.select(F.col("relpath").alias(key)), key, "left_anti").select(schema.names))
        if touched is not None:
            new = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(*(f"{self.root}/{name}/{c['batch']}" for c in deltas))
            here = touched.filter("not gone").select(F.col("relpath").alias(key), "batch")
            parts.append(new.join(here, [key, "batch"], "left_semi").select(schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, name: str, relpath: str | None = None, at: int | None = None) -> DataFrame:
        """A table's rows; of one document, or as of a number."""
        out = self._rows(name, *self.state(at, relpath))
        return out if relpath is None else out.filter(F.col(self.keys[name]) == relpath)

    def segments(self, name: str, at: int | None = None) -> DataFrame:
        """The rows of a derived table in all parts, with the batch of each; empty for the base."""
        ranges, deltas = self.state(at)
        parts = [self.spark.read.parquet(*folders).withColumn("batch", F.lit(""))] if (folders := self._base_folders(name, ranges)) else []
        if deltas:
            parts.append(self.spark.read.parquet(*(f"{self.root}/{name}/{c['batch']}" for c in deltas)))
        return reduce(DataFrame.unionByName, parts)

    def current(self, rows: DataFrame, at: int | None = None) -> DataFrame:
        """The rows (relpath, batch, ...) from segments() that are of documents as they are at a number."""
        _, deltas = self.state(at)
        if not deltas:
            return rows
        last = self._touched(deltas).select("relpath", F.col("batch").alias("last"), "gone")
        fits = F.when(F.col("last").isNull(), True).otherwise((F.col("batch") == F.col("last")) & ~F.col("gone"))
        return rows.join(last, "relpath", "left").filter(fits).drop("last", "gone")

    def live(self, at: int | None = None) -> DataFrame:
        """relpath of the documents there are."""
        return self.read("documents", at=at)

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the store; -1: none."""
        return max([c["streams"].get(stream, -1) for _, c in self.commits()], default=-1)

    def commit(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, after: int | None = None, stream: tuple[str, int] | None = None) -> bool:
        """rows: of every table, all rows of the documents that this commit replaces or adds; gone: relpath of those that go; after: the commit that rows were made from. stream: a stream's name and the number of its batch; a batch that is in the store already changes nothing, and False says so."""
        after = self.latest() if after is None else after
        if stream and self.applied(stream[0]) >= stream[1]:
            return False
        batch = uuid.uuid4().hex
        for name in self.tables:
            rows[name].withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/{name}/{batch}")
        own = [self.spark.read.parquet(f"{self.root}/{name}/{batch}").select(F.col(key).alias("relpath")) for name, key in self.tables.items()]
        reduce(DataFrame.union, own).distinct().withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/documents/{batch}")
        there = self.spark.read.parquet(f"{self.root}/documents/{batch}").select("relpath", F.lit(False).alias("gone"))
        entries = there if gone is None else there.union(gone.select("relpath").distinct().join(there, "relpath", "left_anti").withColumn("gone", F.lit(True)))
        entries.withColumns({"batch": F.lit(batch), "number": F.lit(after + 1)}).write.parquet(f"{self.root}/entries/{batch}")
        docs, low, high = self.spark.read.parquet(f"{self.root}/entries/{batch}").agg(F.count(F.lit(1)), F.min("relpath"), F.max("relpath")).first()
        for name, make in self.derived.items():
            made = make({t: self.spark.read.parquet(f"{self.root}/{t}/{batch}") for t in self.tables}, docs, ())
            made.withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/{name}/{batch}")
        schemas = {name: rows[name].schema.json() for name in self.tables} | {"documents": there.select("relpath").schema.json()}
        self._publish(after, {"kind": "delta", "batch": batch, "docs": docs, "low": low, "high": high, "schemas": schemas, "streams": dict([stream]) if stream else {}})
        if len(self.state()[1]) >= self.most_deltas:
            try:
                self.compact()
            except Conflict:
                pass  # another commit came; the next one tries again
        return True

    def _publish(self, after: int, content: dict) -> None:
        if self.latest() > after or not create_once(self.spark, f"{self.root}/commits/{after + 1:08d}", json.dumps(content)):
            raise Conflict(f"commit {self.latest()} came after {after}")

    def compact(self) -> None:
        """Merges the commits since the last base into a new base. Ranges with changed documents are cut anew, by number of documents; the others stay as they are."""
        after = self.latest()
        ranges, deltas = self.state(after)
        if not deltas:
            return
        lows = [r["low"] for r in ranges]
        numbered = lambda docs: docs.select("relpath").mapInArrow(_range_of(lows), "relpath string, old int")
        changed = {r["old"] for r in numbered(self._touched(deltas)).select("old").distinct().collect()}  # a row a range
        kept, old = [r for k, r in enumerate(ranges) if k not in changed], [r for k, r in enumerate(ranges) if k in changed]
        docs = written(numbered(self._rows("documents", old, deltas)))
        cut = written(docs.repartitionByRange(max(1, -(-docs.count() // self.range_docs)), "old", "relpath").withColumn("piece", F.spark_partition_id()))
        digest = F.sum(F.xxhash64("relpath").cast("decimal(38,0)")).cast("string")
        pieces = cut.groupBy("old", "piece").agg(F.min("relpath").alias("low"), F.count(F.lit(1)).alias("docs"), digest.alias("digest")).orderBy("low").collect()  # a row a range
        parts = self.spark.createDataFrame([(p["old"], p["piece"], k) for k, p in enumerate(pieces)], "old int, piece int, range int")
        part_of = written(cut.join(F.broadcast(parts), ["old", "piece"]).select("relpath", "range"))
        batch = uuid.uuid4().hex
        for name, key in self.keys.items():
            rows = self._rows(name, old, deltas).join(part_of.withColumnRenamed("relpath", key), key)
            rows.repartition(max(1, len(pieces)), "range").sortWithinPartitions("range", key).write.partitionBy("range").parquet(f"{self.root}/{name}/{batch}")
        for name, make in self.derived.items():
            own = {t: self.spark.read.schema(T.StructType([*self._schema(t).fields, T.StructField("range", T.IntegerType())])).parquet(f"{self.root}/{t}/{batch}") for t in self.tables}
            made = make(own, max([p["docs"] for p in pieces], default=0), ("range",))
            made.repartition(max(1, len(pieces)), "range").sortWithinPartitions("range", *made.columns[1:2]).write.partitionBy("range").parquet(f"{self.root}/{name}/{batch}")
        held = {name: set(names(self.spark, f"{self.root}/{name}/{batch}")) for name in (*self.keys, *self.derived)}
        new = [{"low": p["low"], "folder": batch, "part": k, "docs": p["docs"], "digest": p["digest"], "tables": [name for name in held if f"range={k}" in held[name]]} for k, p in enumerate(pieces)]
        streams = {s: self.applied(s) for s in {s for _, c in self.commits() for s in c["streams"]}}
        self._publish(after, {"kind": "base", "batch": batch, "ranges": sorted(kept + new, key=lambda r: r["low"]), "schemas": {name: self._schema(name).json() for name in self.keys}, "streams": streams})

    def verify(self) -> list[int]:
        """Numbers of the base's ranges whose documents are not those that its file tells the number and digest of."""
        ranges, _ = self.state()
        found = {}
        if folders := self._base_folders("documents", ranges):
            # rows know their range by their file: ranges of one batch and of others may have the same part
            rows = self.spark.read.parquet(*folders).withColumn("folder", F.regexp_extract(F.input_file_name(), "([0-9a-f]{32}/range=[0-9]+)/[^/]*$", 1))
            told = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("relpath").cast("decimal(38,0)")).cast("string").alias("digest"))
            found = {r["folder"]: (r["n"], r["digest"]) for r in told.collect()}  # a row a range
        return [k for k, r in enumerate(ranges) if found.get(f"{r['folder']}/range={r['part']}") != (r["docs"], r["digest"])]

    @contextmanager
    def pinned(self, seconds: float = 3600.0) -> Iterator[int]:
        """The number of a snapshot that stays readable in the block, for so many seconds at most if its reader is lost."""
        number, name = self.latest(), f"{self.root}/pins/{uuid.uuid4().hex}"
        create_once(self.spark, name, json.dumps({"number": number, "until": time.time() + seconds}))
        try:
            yield number
        finally:
            delete(self.spark, name)

    def expire(self) -> int:
        """Drops snapshots before the last base, but for what pins need; how many commits. Their folders go with vacuum()."""
        pins = [json.loads(read_small(self.spark, f"{self.root}/pins/{n}")) for n in names(self.spark, f"{self.root}/pins")]
        oldest = min([p["number"] for p in pins if p["until"] > time.time()], default=self.latest())
        base = max([n for n, c in self.commits() if c["kind"] == "base" and n <= oldest], default=0)
        gone = [n for n, _ in self.commits() if n < base]
        for n in gone:  # the oldest first, so that what is left is always whole
            delete(self.spark, f"{self.root}/commits/{n:08d}")
        return len(gone)

    def vacuum(self, min_age: float = 86_400.0) -> int:
        """Deletes folders that no commit names: of commits that never became visible, and of expired ones; how many. min_age: seconds that a folder is left alone, as its writer may still be at work."""
        commits = [c for _, c in self.commits()]
        kept = {c["batch"] for c in commits if c["kind"] == "delta"} | {r["folder"] for c in commits if c["kind"] == "base" for r in c["ranges"]}
        n = 0
        for name in (*self.keys, *self.derived, "entries"):
            for batch, changed in ages(self.spark, f"{self.root}/{name}"):
                if batch not in kept and time.time() - changed >= min_age:
                    n += delete(self.spark, f"{self.root}/{name}/{batch}")
        return n


def numbered_slugs(pages: DataFrame, old: DataFrame | None) -> DataFrame:
    """pages (relpath, title) with a slug. A page keeps the slug it had under the same title; others of an equal slug get the next numbers after those there are, by relpath. old: slug, source_relpath and, if it is there, origin: pages made of a document are not its own."""
    rows = pages.withColumn("base", slug(F.col("title")))
    place = F.row_number().over(Window.partitionBy("base").orderBy("relpath"))
    if old is None:
        return rows.withColumn("slug", unique_slug(F.col("base"), place)).drop("base")
    number = lambda s: F.when(s.rlike("-[0-9]+$"), F.regexp_extract(s, "-([0-9]{1,9})$", 1).cast("int"))
    stem = F.regexp_replace("slug", "-[0-9]+$", "")
    used = old.select(F.explode(F.array(F.struct(F.col("slug").alias("base"), F.lit(1).alias("n")), F.struct(stem.alias("base"), F.coalesce(number(F.col("slug")), F.lit(1)).alias("n")))).alias("u")).select("u.*")
    used = used.groupBy("base").agg(F.max("n").alias("used"))
    own = old.filter("origin = 'ingest'") if "origin" in old.columns else old
    own = own.groupBy(F.col("source_relpath").alias("relpath")).agg(F.min("slug").alias("had"))
    rows = rows.join(own, "relpath", "left")
    keeps = F.coalesce((F.col("had") == F.col("base")) | ((F.regexp_replace("had", "-[0-9]+$", "") == F.col("base")) & F.col("had").rlike("-[0-9]+$")), F.lit(False))
    rows = rows.withColumn("keeps", keeps).join(used, "base", "left")
    place = F.sum((~F.col("keeps")).cast("int")).over(Window.partitionBy("base").orderBy("relpath")) + F.coalesce("used", F.lit(0))
    return rows.withColumn("slug", F.when(F.col("keeps"), F.col("had")).otherwise(unique_slug(F.col("base"), place))).drop("base", "had", "keeps", "used")


def wiki_pages(extracted: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """slug, title, summary, body, source_relpath, origin and text (markdown with front matter) of extracted documents (relpath, title, summary, body). old: pages there are (slug, source_relpath)."""
    return page_text(numbered_slugs(extracted, old).withColumn("origin", F.lit("ingest")))


def page_text(rows: DataFrame) -> DataFrame:
    """slug, title, summary, body, source_relpath, origin and text of rows (slug, title, summary, body, relpath, origin, and a map metadata if there is more to say in the front matter)."""
    quoted = lambda c: F.to_json(F.array(F.regexp_replace(c, "\\s+", " "))).substr(F.lit(2), F.length(F.to_json(F.array(F.regexp_replace(c, "\\s+", " ")))) - 2)
    lines = [F.concat(F.lit(f"{k}: "), quoted(F.col(c))) for k, c in (("slug", "slug"), ("title", "title"), ("summary", "summary"), ("source", "relpath"), ("origin", "origin"))]
    if "metadata" in rows.columns:
        lines.append(F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e.getField("key"), F.lit(": "), quoted(e.getField("value")))), "\n"))
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), "body")
    return rows.select("slug", "title", "summary", "body", F.col("relpath").alias("source_relpath"), "origin", text.alias("text"))


def index_lines(pages: DataFrame) -> DataFrame:
    """The lines of the wiki's index, by slug."""
    title = F.regexp_replace("title", "([\\[\\]])", "\\\\$1")
    return pages.orderBy("slug").select(F.concat(F.lit("- ["), title, F.lit("](pages/"), "slug", F.lit(".md) — "), "summary").alias("value"))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def graph_html(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 1000) -> str:
    """A page with the first nodes and edges by id; the limits are the feature."""
    n = [r.asDict() for r in nodes.select("id", "label", "kind").orderBy("id").limit(most_nodes).collect()]
    e = [r.asDict() for r in edges.select("id", "src", "dst", "relation").orderBy("id").limit(most_edges).collect()]
    rows = "".join(f"<li>{html.escape(x['label'] or '')} <small>{html.escape(x['kind'])}</small></li>" for x in n)
    data = json.dumps({"nodes": n, "edges": e}, ensure_ascii=False).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>Graph</title><ul>{rows}</ul><script type='application/json' id='graph'>{data}</script>"


def graph_report(edges: DataFrame, communities: DataFrame, findings: DataFrame) -> str:
    """Counts of edges by evidence, communities by size (the ten largest) and findings by severity, as markdown."""
    out = ["# Graph report", "", "## Evidence"]
    out += [f"- {r['evidence']}: {r['count']}" for r in edges.groupBy("evidence").count().orderBy("evidence").collect()]
    out += ["", "## Communities"]
    out += [f"- {r['label']}: {r['n_nodes']} nodes" for r in communities.orderBy(F.desc("n_nodes"), "label").limit(10).collect()]
    out += ["", "## Findings"]
    out += [f"- {r['severity']}: {r['count']}" for r in findings.groupBy("severity").count().orderBy("severity").collect()]
    return "\n".join(out)


def writeback_pages(answered: DataFrame, gate: DataFrame, related: DataFrame) -> DataFrame:
    """Pages for answers that go back: title is the question, summary the answer's first 80 characters, and links to related pages."""
    rows = answered.join(gate.filter("action = 'commit'").select("query_id"), "query_id").join(related, "query_id", "left")
    links = F.concat(F.lit("\n\n## Related\n"), F.array_join(F.transform("slugs", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n"))
    return rows.select(slug(F.col("question")).alias("slug"), F.col("question").alias("title"), F.substring("answer", 1, 80).alias("summary"), F.concat("answer", F.coalesce(links, F.lit(""))).alias("body"), F.lit("writeback").alias("origin"))
