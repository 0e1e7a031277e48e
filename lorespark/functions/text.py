"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|[^\s]"
TERM = r"[a-z0-9]{2,}"
HAN_RUN = r"[\x{4e00}-\x{9fff}]{2,}"
GRAPH_TERM = r"[a-z0-9]{2,}|[\x{4e00}-\x{9fff}]{1,2}"
QUERY_TERM = r"[A-Za-z0-9\x{4e00}-\x{9fff}]{2,}"


def lit(x: str) -> Column:
    return F.lit(x)


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, lit(pattern), F.lit(0))


def normalize_text(text: Column) -> Column:
    """LF line ends, single blanks, stripped lines, at most one empty line in a row."""
    out = F.replace(text, lit("\r\n"), lit("\n"))
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, "(?m)^[ ]+|[ ]+$", "")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def tokens(text: Column, lower: bool = True) -> Column:
    return all_matches(F.lower(text) if lower else text, TOKEN)


def summary(text: Column, length: int = 80) -> Column:
    """Non-blank lines, stripped, joined by a space, cut."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(lines, " "), 1, length)


def evidence_quote(text: Column, length: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, length)


def lexical_terms(text: Column) -> Column:
    """The set of alphanumeric terms and overlapping pairs of Han characters."""
    low = F.lower(text)
    pairs = F.transform(all_matches(low, HAN_RUN), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.array_distinct(F.concat(all_matches(low, TERM), F.flatten(pairs)))


def graph_terms(text: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(text), GRAPH_TERM))


def query_terms(text: Column) -> Column:
    """Terms of a question, repeats kept: a repeated term counts twice."""
    return all_matches(F.lower(text), QUERY_TERM)


def slug(text: Column, most: int = 96) -> Column:
    """ASCII slug; a long one is cut and ends in a digest; an empty one is a digest."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(base, 1, most - 9), "-+$", "")
    fit = F.when(F.length(base) <= most, base).otherwise(F.concat(cut, lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 8)))
    return F.when(base == "", F.substring(F.sha1(text.cast("binary")), 1, 12)).otherwise(fit)


def unique_slug(base: Column, position: Column) -> Column:
    """base for the first of its kind, base-2, base-3, ... for the others."""
    return F.when(position == 1, base).otherwise(F.concat(base, lit("-"), position.cast("string")))


def node_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lower(kind), lit(":"), slug(label))


def edge_id(relpath: Column, relation: Column, src: Column, dst: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", relpath, relation, src, dst).cast("binary")), 1, 16)


def chunk_id(sha256: Column, fingerprint: Column, index: Column) -> Column:
    return F.concat_ws("-", F.substring(sha256, 1, 8), F.substring(F.sha1(fingerprint.cast("binary")), 1, 8), index.cast("string"))


def fingerprint_compatible(stored: Column, current: Column) -> Column:
    """A stored `*` (or none) fits every parser."""
    return (F.coalesce(stored, lit("*")) == "*") | (stored == current)


def clean_label(raw: Column) -> Column:
    """A label without bullets, numbers, a `Prefix: `, leading conjunctions, and punctuation at its ends."""
    out = F.regexp_replace(F.trim(raw), "^[#*\\-\\d.\\s]+", "")
    out = F.regexp_replace(out, "^[A-Za-z][A-Za-z ]{0,30}:\\s*", "")
    out = F.regexp_replace(out, "(?i)^(?:因為|由於|because)\\s+", "")
    out = F.regexp_replace(out, "^(?:但是|但|然而)\\s*", "")
    out = F.regexp_replace(out, "\\s+", " ")
    return F.regexp_replace(out, "^[ ,:：()\\[\\]{}\"'。；;.]+|[ ,:：()\\[\\]{}\"'。；;.]+$", "")


def split_targets(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, "(?i)\\s*(?:與|和|及|、| and |,)\\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, "(?i)^(?:and|or)\\s+", ""))


# Words that decide an entity's type.
EVENT_WORDS_HAN = ("延遲", "風險", "里程碑", "事故", "事件")
EVENT_WORDS = ("delay", "risk", "milestone", "incident", "event", "window")
DOCUMENT_WORDS = ("spec", "document", "analysis", "summary", "report", "文件", "報告")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def entity_type(label: Column, default: str = "Concept") -> Column:
    low = F.lower(label)
    return (
        F.when(label.contains("專案") | low.contains("project ") & ~low.contains("service"), "Project")
        .when(has_any(label, EVENT_WORDS_HAN) | has_any(low, EVENT_WORDS), "Event")
        .when(label.rlike("^[A-Z][a-z]+(?: [A-Z][a-z]+)+$"), "Person")
        .when(has_any(low, DOCUMENT_WORDS), "Document")
        .otherwise(default)
    )


def contextual_entity_type(label: Column, relation: Column, role: str, title: Column | None = None, default: str = "Concept") -> Column:
    """entity_type, biased by the section's title; a cause is an event."""
    out = entity_type(label, default)
    if role == "source":
        out = F.when(relation.isin("causes", "impacts") & (out == "Concept"), "Event").otherwise(out)
    if title is None:
        return out
    low, top = F.lower(label), F.lower(title)
    same = F.coalesce(top.contains(low) | low.contains(top), F.lit(False))
    document = has_any(low, DOCUMENT_WORDS) | has_any(top, DOCUMENT_WORDS)
    return F.when(same & document, "Document").when(same, "Project").otherwise(out)


def classify(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("dependency"), "dependency").when(low.contains("risk"), "risk").when(low.contains("project"), "project").otherwise("general")


def concept(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("atlas"), "Project Atlas").when(low.contains("borealis"), "Project Borealis").when(low.contains("risk"), "Risk").otherwise("Knowledge Item")


def first_line(text: Column, most: int = 240) -> Column:
    """The first line with something in it, stripped and cut; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), lit("")), 1, most)


def table_row(cells: Column) -> Column:
    """Cells as a markdown table row."""
    return F.concat(lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c, lit("")), lit("|"), lit("\\|")), lit("\n"), lit(" "))), " | "), lit(" |"))


def shell_export(value: Column, name: str = "KS_ROOT") -> Column:
    """An export command with the value quoted for a shell."""
    return F.concat(lit(f"export {name}='"), F.replace(value, lit("'"), lit("'\"'\"'")), lit("'"))


def stable_hash(row: Column) -> Column:
    """sha256 of a struct's JSON; name its fields in alphabetical order."""
    return F.sha2(F.to_json(row), 256)


def valid_agent_id(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Za-z0-9][A-Za-z0-9._:-]{0,79}$"), F.lit(False))


def valid_resource_key(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x)).between(1, 240) & ~x.startswith("/") & ~x.contains("..") & ~x.contains("\\"), F.lit(False))


def valid_relpath(x: Column) -> Column:
    return F.coalesce((x != "") & ~x.startswith("/") & ~x.rlike("(^|/)\\.\\.(/|$)"), F.lit(False))


def front_matter(page: Column) -> Column:
    """The names and values between a page's first two lines of `---`, as a map. Quoted values are JSON strings; of equal names the first counts."""
    head = F.regexp_extract(page, "^---\\n([\\s\\S]*?)\\n---(?:\\n|$)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(": "))
    name = lambda x: F.trim(F.substring_index(x, ": ", 1))
    raw = lambda x: F.regexp_replace(x, "^.*?: ", "")
    plain = lambda v: F.when(v.startswith('"'), F.coalesce(F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)), v)).otherwise(v)
    pairs = F.transform(lines, lambda x: F.struct(name(x).alias("k"), plain(raw(x)).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q.getField("k")), p.getField("k")) == i + 1)
    return F.map_from_entries(first)


def without_front_matter(page: Column) -> Column:
    return F.regexp_replace(page, "^---\\n[\\s\\S]*?\\n---(?:\\n\\s*|$)", "")
