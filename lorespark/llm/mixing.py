"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic. Their token masses are raked until the shares by source, by
language and by topic all are the targets; a document's sampling rate is its cell's raked mass over its own mass, scaled
so that the largest rate is 1, and a hash of its id decides.

Targets: for each dimension given, weights of its groups (a dictionary, or a table with the columns <dimension> and
`target`), or a power, which tempers the dimension's own shares (under 1 it lifts small groups). A topic is a column of
the caller's, or else the form of the text (TOPICS).

The cell table has one row for each (source, language, topic) that occurs. It is aggregated on the map side first, so
a source with a third of all rows costs one row a task. Raking only touches the cell table: each step adds up its masses
by one dimension (partial sums first) and multiplies. Sweeps go on until all shares are within `tolerance` of their
targets, relative to them. Where the targets contradict the cells that occur, no such masses exist: raking ends when five
sweeps don't halve the largest error any more, and a warning tells it.

Defined cases: a null source, language, topic or text is a group of its own ('' as its name) or an empty text; a document
without words counts as one token; a target for a group that does not occur is left out and the others are scaled up; a
group without a target keeps its own share; negative or null targets count as none, a target of 0 leaves no document;
rows with equal ids are kept or dropped together; an empty table gives no rows. Further input columns, whatever their
names, are ignored by mixing_rates and kept by sample.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import WORD, unused, written
from lorespark.operators.tables import drop

DIMENSIONS = ("source", "lang", "topic")
#: Topics by form, the first that holds: a pattern in the text, and the topic's name.
TOPICS = ((r"[{};]\s*\n", "code"), (r" \| ", "table"), (r"https?://|@[A-Za-z0-9]", "contact"), (r"(?i)licen[cs]e|copyright|all rights reserved", "legal"))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for pattern, name in reversed(TOPICS):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


#: Targets of a dimension: weights by group, a table (<dimension>, target), or the power of its own shares.
Targets = dict[str, float] | DataFrame | float


def grouped(text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> list[Column]:
    """source, lang and topic of a row."""
    named = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(d)
    return [named(source_col, "source"), named(lang_col, "lang"), named(topic_col, "topic") if topic_col else topic(F.col(text_col).cast("string")).alias("topic")]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each row's whole text."""
    tokens = F.greatest(F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), *grouped(text_col, source_col, lang_col, topic_col), tokens.alias("tokens"))


def scalar(df: DataFrame, what: Column) -> float:
    """One number of a table."""
    return float(df.agg(what).first()[0] or 0)


def goals(cells: DataFrame, dimension: str, targets: Targets) -> DataFrame:
    """dimension and goal: the share that each of its groups shall have."""
    shares = cells.groupBy(dimension).agg(F.sum("own").alias("share"))
    if isinstance(targets, DataFrame):
        given = targets.groupBy(F.coalesce(F.col(dimension).cast("string"), F.lit("")).alias(dimension)).agg(F.max("target").alias("given"))
        shares = shares.join(given, dimension, "left")
    elif isinstance(targets, dict):
        given = F.lit(None).cast("double")
        for name, weight in targets.items():
            given = F.when(F.col(dimension) == name, F.lit(float(weight))).otherwise(given)
        shares = shares.withColumn("given", given)
    else:
        shares = shares.withColumn("given", F.pow("share", F.lit(float(targets))))
    # what has no target keeps its own share; the given ones share out the rest in proportion
    shares = written(shares.select(dimension, "share", F.when(F.col("given") >= 0, F.col("given")).alias("given")))
    sums = shares.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("share")))).first()
    weight, kept = (float(x or 0) for x in sums)
    return shares.select(dimension, F.when(F.col("given").isNull() | F.lit(weight <= 0), F.col("share")).otherwise(F.col("given") / (weight or 1.0) * (1 - kept)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, Targets], tolerance: float = 1e-6) -> DataFrame:
    """The cells (DIMENSIONS, tokens) with `own` and `raked`: masses, whose shares follow the targets to the tolerance.

    A raked mass is the own one times a factor of each dimension's group; a step makes one dimension's factors anew, from the
    cells and the others' factors, which are small tables.
    """
    total = scalar(cells, F.sum("tokens")) or 1.0
    out = cells.withColumn("own", F.col("tokens") / total)
    wanted = {d: goals(out, d, t) for d, t in targets.items()}
    factors: dict[str, DataFrame] = {}

    def raked(but: str | None = None) -> DataFrame:
        rows, mass = out, F.col("own")
        for d, f in factors.items():
            if d != but:
                rows, mass = rows.join(f.select(d, F.col("factor").alias(f"factor_{d}")), d), mass * F.col(f"factor_{d}")
        return rows.withColumn("raked", mass)

    errors: list[float] = []
    while wanted:
        for d, goal in wanted.items():
            mass = raked(d).groupBy(d).agg(F.sum("raked").alias("mass")).join(goal, d)
            before = mass.join(factors[d].select(d, F.col("factor").alias("old")), d) if d in factors else mass.withColumn("old", F.lit(1.0))
            off = F.abs(F.col("mass") * F.col("old") - F.col("goal")) / F.greatest("goal", F.lit(1e-12))
            new = written(before.select(d, F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).otherwise(0.0).alias("factor"), off.alias("off")))
            if d in factors:
                drop(factors[d])
            factors[d] = new
        errors.append(max(scalar(reduce(DataFrame.union, [f.select("off") for f in factors.values()]), F.max("off")), 0.0))
        if errors[-1] <= tolerance:
            break
        if len(errors) > 5 and errors[-1] > errors[-6] / 2:
            warnings.warn(f"raking ended at a relative error of {errors[-1]:.3g}: the targets don't fit the cells that occur", stacklevel=2)
            break
    return raked().select(*cells.columns, "own", "raked")


def cell_rates(rows: DataFrame, targets: dict[str, Targets], tolerance: float = 1e-6) -> DataFrame:
    """source, lang, topic and the rate of each cell, from the rows of described()."""
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    rates = written(rake(cells, targets, tolerance).select(*DIMENSIONS, (F.col("raked") / F.col("own")).alias("rate")))
    return rates.withColumn("rate", F.col("rate") / (scalar(rates, F.max("rate")) or 1.0))


def mixing_rates(docs: DataFrame, targets: dict[str, Targets], tolerance: float = 1e-6, seed: str = "mix", **columns: str) -> DataFrame:
    """doc_id, source, lang, topic, tokens, rate and kept for each row. columns: as described() names them."""
    rows = described(docs, **columns)
    # one row for each cell that occurs; Spark broadcasts it only while it is under the session's broadcast threshold
    out = rows.join(cell_rates(rows, targets, tolerance), [*DIMENSIONS], "left")
    return out.withColumn("kept", chance(F.col("doc_id"), seed) < F.col("rate")).select("doc_id", *DIMENSIONS, "tokens", "rate", "kept")


def sample(docs: DataFrame, targets: dict[str, Targets], tolerance: float = 1e-6, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    cell, rate = unused(docs, "cell", "rate")
    rates = cell_rates(described(docs, id_col, text_col, source_col, lang_col, topic_col), targets, tolerance)
    rates = rates.select(F.struct(*DIMENSIONS).alias(cell), F.col("rate").alias(rate))
    placed = docs.withColumn(cell, F.struct(*grouped(text_col, source_col, lang_col, topic_col)))
    return placed.join(rates, cell, "left").filter(chance(F.col(id_col), seed) < F.col(rate)).select(*(placed[c] for c in docs.columns))


def chance(id_: Column, seed: str) -> Column:
    """A number in [0, 1) that only depends on the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48)


def oracle(targets: dict[str, dict[str, float] | float], sweeps: int = 12, seed: str = "mix", digits: int = 4) -> str:
    """The same rows in DuckDB, from a fixed number of sweeps: enough for rates to the digits given."""
    topics = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for p, n in TOPICS)
    out = [
        f"""with r as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, case {topics} else 'prose' end topic,
        greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::bigint tokens from documents),
        c as (select source, lang, topic, sum(tokens)::bigint tokens from r group by all),"""
    ]
    for d, t in targets.items():
        given = "case " + " ".join(f"when {d} = '{k}' then {v}::double" for k, v in t.items()) + " end" if isinstance(t, dict) else f"pow(share, {t})"
        out.append(f"s_{d} as (select *, {given} given from (select {d}, sum(tokens)::double / (select sum(tokens) from c) share from c group by 1)),")
        out.append(f"g_{d} as (select {d}, case when given is null then share else given / sum(given) over () * (1 - coalesce(sum(case when given is null then share end) over (), 0)) end goal from s_{d}),")
    out.append("w0 as (select *, tokens::double / sum(tokens) over () own, tokens::double / sum(tokens) over () raked from c),")
    k = 0
    for _ in range(sweeps):
        for d in targets:
            k += 1
            out.append(f"w{k} as (select w.* replace (raked * g.goal / sum(raked) over (partition by w.{d}) as raked) from w{k - 1} w join g_{d} g on w.{d} = g.{d}),")
    out.append(f"z as (select source, lang, topic, (raked / own) / max(raked / own) over () rate from w{k})")
    out.append(
        f"""select doc_id, source, lang, topic, tokens, round(rate, {digits}) rate,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / {float(1 << 48)} < rate kept from r join z using (source, lang, topic)"""
    )
    return "\n".join(out)
