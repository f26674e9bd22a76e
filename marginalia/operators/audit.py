"""Validation, link and graph checks, health, and status of a collection of notes.

Notes are rows as ``parse_notes`` gives them: name, content, raw (frontmatter text), fields, type, status, area, gist,
tags, modified. Checks are one row each: check, status, total, found, message.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NotesConfig
from ..functions import text as tx

WARNINGS = ("folded_scalar",)
SHARE = 0.3


def _v(code: str, arg: Column | str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(arg) if isinstance(arg, str) else arg).cast("string").alias("arg")))


def message(code: Column, arg: Column, config: NotesConfig) -> Column:
    """The text of a violation."""
    one_of = lambda values: F.concat(F.lit("'"), arg, F.lit(f"' is none of {', '.join(values)}"))
    texts = {
        "missing_frontmatter": F.lit("the note has no frontmatter"), "missing_field": F.concat(arg, F.lit(" is required and absent")),
        "invalid_type": F.concat(F.lit("type "), one_of(config.types)), "invalid_status": F.concat(F.lit("status "), one_of(config.statuses)), "invalid_area": F.concat(F.lit("area "), one_of(config.areas)),
        "too_many_tags": F.concat(arg, F.lit(f" tags where {config.max_tags} are allowed")), "hierarchical_tag": F.concat(F.lit("no levels in tags: "), arg),
        "non_lowercase_tag": F.concat(F.lit("capitals in tag "), arg), "duplicate_frontmatter": F.concat(arg, F.lit(" frontmatter blocks where one is expected")),
        "yaml_syntax": F.concat(F.lit("the frontmatter is no YAML"), arg), "folded_scalar": F.concat(arg, F.lit(" is folded over lines, which not every reader shows")),
    }
    out = F.lit(None).cast("string")
    for name, value in texts.items():
        out = F.when(code == name, value).otherwise(out)
    return out


def _found(notes: DataFrame, c: NotesConfig, yaml: bool) -> tuple[DataFrame, Column]:
    """(notes, the array of their violations: code and arg)."""
    notes = notes.withColumn("_yaml", yaml_error(F.col("raw"))) if yaml else notes.withColumn("_yaml", F.lit(None).cast("string"))
    blocks, has, parses = tx.block_count(F.col("content")), F.col("raw").isNotNull(), F.col("raw").isNotNull() & F.col("_yaml").isNull()
    single = [_v("duplicate_frontmatter", blocks, blocks > 1), _v("missing_frontmatter", "", ~has), _v("yaml_syntax", F.col("_yaml"), has & F.col("_yaml").isNotNull())]
    for field, allowed in (("type", c.types), ("status", c.statuses), ("area", c.areas)):
        if c.requires(field):
            single.append(_v("missing_field", c.field_prefix + field, parses & F.col(field).isNull()))
            single.append(_v(f"invalid_{field}", F.col(field), parses & F.col(field).isNotNull() & ~F.col(field).isin(*allowed)))
    if c.requires("gist"):
        single.append(_v("missing_field", c.field_prefix + "gist", parses & F.col("gist").isNull()))
    single.append(_v("too_many_tags", F.size("tags"), parses & (F.size("tags") > c.max_tags)))
    item = lambda code, arg: F.struct(F.lit(code).alias("code"), arg.cast("string").alias("arg"))
    none = F.array().cast("array<struct<code:string,arg:string>>")
    listed = lambda on, code, values, test: F.when(parses & F.lit(on), F.transform(F.filter(values, test), lambda t: item(code, t))).otherwise(none)
    parts = [
        F.array_compact(F.array(*single)), listed(True, "folded_scalar", tx.folded_fields(F.col("raw"), c.field_prefix), lambda t: t != ""),
        listed(not c.hierarchical_tags, "hierarchical_tag", F.col("tags"), lambda t: F.contains(t, F.lit("/"))),
        listed(c.lowercase_tags, "non_lowercase_tag", F.col("tags"), lambda t: t != F.lower(t)),
    ]
    return notes, F.concat(*[F.coalesce(p, none) for p in parts])


def violations(notes: DataFrame, config: NotesConfig | None = None, yaml: bool = False) -> DataFrame:
    """(name, code, severity, arg, message) of all schema violations; a note may have several.

    Type, status and area are checked only if they are required. With ``yaml`` the frontmatter's syntax is checked too,
    and a note that fails has no further violations but a duplicate block.
    """
    c = config or NotesConfig()
    notes, found = _found(notes, c, yaml)
    rows = notes.select("name", F.explode(found).alias("v")).select("name", "v.code", "v.arg")
    severity = F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error")
    return rows.select("name", "code", severity.alias("severity"), "arg", message(F.col("code"), F.col("arg"), c).alias("message"))


def _yaml(raw: pd.Series) -> pd.Series:
    import yaml

    def check(text: str | None) -> str | None:
        try:
            yaml.safe_load(text or "")
        except yaml.MarkedYAMLError as e:
            at = e.problem_mark or e.context_mark
            return (f" at line {at.line + 1}, column {at.column + 1}" if at else "") + f": {e.problem or e.context}"
        except (yaml.YAMLError, ValueError) as e:
            return f": {e}"
        except (RecursionError, MemoryError):
            return ": nested too deeply"
        return None

    return raw.map(check)


def yaml_error(raw: Column) -> Column:
    """Null for frontmatter that is YAML, else where and why it isn't, in Arrow batches."""
    return F.pandas_udf(_yaml, T.StringType())(raw)


def broken_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """The links (src, dst, pos) to names that no note has."""
    return links.join(names.select("name").distinct(), F.col("dst") == F.col("name"), "left_anti")


def orphans(links: DataFrame, names: DataFrame) -> DataFrame:
    """The names that no link leads to; a note's link to itself counts."""
    linked = links.select(F.col("dst").alias("name")).distinct()
    return names.select("name").distinct().join(linked, "name", "left_anti")


def link_report(links: DataFrame, names: DataFrame) -> DataFrame:
    """(total, valid, broken, files_with_broken, orphans), one row."""
    known = names.select("name").distinct()
    marked = links.join(known.withColumnRenamed("name", "dst").withColumn("ok", F.lit(True)), "dst", "left")
    counts = marked.agg(F.count("*").alias("total"), F.count("ok").alias("valid"), F.count_if(F.col("ok").isNull()).alias("broken"), F.count_distinct(F.when(F.col("ok").isNull(), F.col("src"))).alias("files_with_broken"))
    return counts.crossJoin(orphans(links, names).agg(F.count("*").alias("orphans")))  # one row by one row


def broken_by_file(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, n, targets): the files with broken links, how many they have, and to what, each target once and in order."""
    return broken_links(links, names).groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("src").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("dst")).alias("targets"))


def incoming(links: DataFrame, names: DataFrame) -> DataFrame:
    """(name, incoming): how many links lead to each note."""
    counts = links.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("incoming"))
    return names.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("incoming", F.lit(0).cast("long")).alias("incoming"))


def _gist_date(prefix: str) -> Column:
    return F.try_to_date(F.regexp_extract("raw", rf"(?m)^{prefix}gist_date:\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1))


def stale(notes: DataFrame, prefix: str = "note_") -> DataFrame:
    """(name, gist_date, modified_date) of the notes changed after their gist was written."""
    rows = notes.select("name", _gist_date(prefix).alias("gist_date"), F.to_date("modified").alias("modified_date"))
    return rows.filter("gist_date < modified_date")


def audit(notes: DataFrame, links: DataFrame, config: NotesConfig | None = None, quick: bool = False, yaml: bool = False) -> DataFrame:
    """(check, status, found, total), a row a check; quick: schema and links alone.

    Schema, gists, tags and stale gists are counted in one pass over the notes, links and orphans by one join of the link
    targets, counted first, with the names.
    """
    c = config or NotesConfig()
    rows, found = _found(notes, c, yaml)
    rows = rows.select(found.alias("v"), F.col("gist").isNull().alias("no_gist"), (F.size("tags") <= 0).alias("no_tags"), (_gist_date(c.field_prefix) < F.to_date("modified")).alias("stale"))
    errors = F.size(F.filter("v", lambda x: ~x["code"].isin(*WARNINGS)))
    counted = rows.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("violations"), F.coalesce(F.sum(errors), F.lit(0)).alias("errors"), *[F.count_if(x).alias(x) for x in ("no_gist", "no_tags", "stale")])
    targets = links.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("links"))
    both = notes.select("name").distinct().withColumn("known", F.lit(True)).join(targets, "name", "full_outer")
    linked = both.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("links"))), F.lit(0)).alias("broken"), F.count_if(F.col("links").isNull()).alias("orphans"))
    few = lambda n: F.when((F.col("notes") == 0) | (F.col(n) / F.greatest("notes", F.lit(1)) < SHARE), "pass").otherwise("fail")
    none = lambda n, bad: F.when(F.col(n) > 0, bad).otherwise("pass")
    checks = [("schema", F.when(F.col("errors") > 0, "fail").otherwise(none("violations", "warn")), "violations", "notes"), ("wikilinks", none("broken", "fail"), "broken", "links")]
    if not quick:
        checks += [("gist", none("no_gist", "fail"), "no_gist", "notes"), ("tags", few("no_tags"), "no_tags", "notes"), ("orphans", few("orphans"), "orphans", "notes"), ("stale_gists", none("stale", "warn"), "stale", "notes")]
    each = F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status"), F.col(n).cast("long").alias("found"), F.col(of).cast("long").alias("total")) for name, status, n, of in checks])
    return counted.crossJoin(linked).select(F.inline(each))  # one row by one row


def audit_totals(checks: DataFrame) -> DataFrame:
    """(passed, failed); a warning counts in neither."""
    return checks.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))


def status(notes: DataFrame) -> DataFrame:
    """(total, with_gist, with_type, with_area, health), one row. Health weighs the shares 40, 30 and 30."""
    r = notes.agg(F.count("*").alias("total"), F.count("gist").alias("with_gist"), F.count("type").alias("with_type"), F.count("area").alias("with_area"))
    total = F.greatest("total", F.lit(1))
    health = F.round((40 * F.col("with_gist") + 30 * F.col("with_type") + 30 * F.col("with_area")) / total).cast("int")
    return r.withColumn("health", F.when(F.col("total") > 0, health).otherwise(0))


def counts_by(notes: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for each of the columns, nulls left out: one pass and one exchange for all."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")
    return notes.select(each).select("x.*").filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
