"""Profiles of unknown frontmatter, schema recommendations, and migrations.

``fields`` tables have a row for each field of a note: (path, field, kind, values), with the values of a list or the one
value; kind is string, array, number or boolean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import FENCED, once, unquote

# What fields may be called, what they should hold, and limits.
ALIASES = {
    "type": ["type", "category", "kind", "note_type", "doctype", "content_type"],
    "area": ["area", "domain", "topic", "subject", "field", "scope"],
    "gist": ["gist", "summary", "description", "abstract", "tldr", "desc", "excerpt", "overview"],
    "tags": ["tags", "keywords", "labels", "categories", "topics"],
}
RECOMMENDED = {"type": ["note", "term", "project", "log"], "area": ["work", "tech", "life", "career", "learning", "reference"]}
MOST_CLEAN = {"type": 10, "area": 15}
HIGH, DOMINANT, LONG = 15, 10, 100
#: The line end before a line that doesn't continue the one before it.
CONTINUED = r"\n(?!  )"


def scan_fields(notes: DataFrame) -> DataFrame:
    """The fields of notes (path, content): ``key: value`` lines of the frontmatter with inline lists, and block values."""
    lines = F.split(F.regexp_extract("content", FENCED, 1), CONTINUED)
    line = r"(?s)^([A-Za-z_][A-Za-z0-9_]*):[ \t]*(.*)"
    rows = notes.select("path", F.posexplode(F.filter(lines, lambda x: F.regexp_like(x, F.lit(line)))).alias("place", "x"))
    rows = rows.select("path", "place", F.regexp_extract("x", line, 1).alias("field"), F.regexp_extract("x", line, 2).alias("value"))
    parts = F.split("value", r"\r?\n")
    head = F.trim(F.get(parts, 0))
    block = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.trim(x)), " ")
    value = F.when(head.isin(">", "|"), block).otherwise(F.regexp_replace(head, "[\"']", ""))
    items = F.filter(F.transform(F.split(F.regexp_extract(head, r"^\[([^\]]*)\]", 1), ","), unquote), lambda v: v != "")
    kind = F.when(F.startswith(head, F.lit("[")), "array").when(head.isin("true", "false"), "boolean").when(F.regexp_like(head, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), "number").otherwise("string")
    rows = rows.select("path", "place", "field", kind.alias("kind"), F.when(kind == "array", items).otherwise(F.array(value)).alias("values"))
    return rows.groupBy("path", "field").agg(F.max_by("kind", "place").alias("kind"), F.max_by("values", "place").alias("values"))


def valued(fields: DataFrame) -> DataFrame:
    """(field, value): short values of strings, and items of lists, a row each."""
    kept = fields.filter("kind in ('string', 'array')").select("field", "kind", F.explode("values").alias("value"))
    return kept.filter((F.col("kind") == "array") | (F.char_length("value") < LONG)).select("field", "value")


def value_counts(fields: DataFrame) -> DataFrame:
    """(field, value, n): how often each value occurs."""
    return valued(fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def field_profile(fields: DataFrame) -> DataFrame:
    """(field, n, coverage, data_type, distinct, high_cardinality); coverage is of the notes that have any field."""
    with_any = fields.agg(F.count_distinct("path").alias("notes"))
    kinds = fields.groupBy("field").agg(F.count("*").alias("n"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    distinct = value_counts(fields).groupBy("field").agg(F.count("*").alias("distinct"))
    rows = kinds.join(distinct, "field", "left").crossJoin(F.broadcast(with_any))  # one row
    count = F.coalesce("distinct", F.lit(0).cast("long"))
    kind = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed")
    return rows.select("field", "n", (F.col("n") / F.col("notes")).alias("coverage"), kind.alias("data_type"), count.alias("distinct"), (count > HIGH).alias("high_cardinality"))


def top_values(fields: DataFrame, k: int = DOMINANT) -> DataFrame:
    """(field, value, n, percentage, rank) of the ``k`` most frequent values of each field."""
    totals = fields.groupBy("field").agg(F.count("*").alias("total"))
    rows = value_counts(fields).withColumn("rank", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)
    return rows.join(totals, "field").select("field", "value", "n", (100 * F.col("n") / F.col("total")).alias("percentage"), "rank")


def folders(notes: DataFrame) -> DataFrame:
    """(folder, n): notes by parent folder, / for the top."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return notes.groupBy(F.when(folder != "", folder).otherwise("/").alias("folder")).agg(F.count("*").alias("n"))


def candidates(profile: DataFrame, role: str) -> DataFrame:
    """The fields that may play a role, by name: one contains the other. Tags must be lists (or mixed); type, area and
    tags need values. Best coverage first."""
    return profile.filter(_may_be(role)).select(F.lit(role).alias("role"), "*").orderBy(F.desc("coverage"), "field")


def _may_be(role: str) -> Column:
    low = F.lower("field")
    named = [F.contains(low, F.lit(a)) | F.contains(F.lit(a), low) for a in ALIASES[role]]
    out = sum((x.cast("int") for x in named), F.lit(0)) > 0
    out = out & F.col("data_type").isin("array", "mixed") if role == "tags" else out
    return out if role == "gist" else out & (F.col("distinct") > 0)


def map_value(value: Column, recommended: list[str]) -> Column:
    """What a value becomes: the recommended one that equals it but for case, or else contains it or is contained in it,
    or else the first."""
    low = F.lower(value)
    out = F.lit(recommended[0])
    for r in reversed(recommended):
        out = F.when(F.contains(low, F.lit(r.lower())) | F.contains(F.lit(r.lower()), low), F.lit(r)).otherwise(out)
    for r in reversed(recommended):
        out = F.when(low == r.lower(), F.lit(r)).otherwise(out)
    return out


def value_mapping(fields: DataFrame, field: str, recommended: list[str]) -> DataFrame:
    """(value, n, mapped) for the values of a field."""
    return value_counts(fields).filter(F.col("field") == field).select("value", "n", map_value(F.col("value"), recommended).alias("mapped"))


def estimate(mapping: DataFrame) -> DataFrame:
    """(n): how many values a mapping changes."""
    return mapping.agg(F.coalesce(F.sum(F.when(F.col("mapped") != F.col("value"), F.col("n"))), F.lit(0)).alias("n"))


def profile_health(notes: DataFrame, fields: DataFrame) -> DataFrame:
    """(coverage, score, band, issue), one row: 30 for frontmatter, 20 and 10 for type and few values of it, 15 and 5 for
    area, 20 for gist."""
    first = lambda role: F.min(F.when(_may_be(role), F.struct((-F.col("coverage")).alias("c"), "field", F.col("high_cardinality").alias("high")))).alias(role)
    roles = field_profile(fields).agg(first("type"), first("area"), first("gist"))
    counts = notes.agg(F.count("*").alias("total")).crossJoin(fields.agg(F.count_distinct("path").alias("having")))
    rows = counts.crossJoin(roles)  # one row each
    coverage = F.when(F.col("total") > 0, F.col("having") / F.col("total")).otherwise(0.0)
    part = lambda role, points: F.coalesce(-points * F.col(f"{role}.c"), F.lit(0.0))
    few = lambda role, points: F.when(F.col(f"{role}.high") == F.lit(False), points).otherwise(0)
    score = 30 * coverage + part("type", 20) + few("type", 10) + part("area", 15) + few("area", 5) + part("gist", 20)
    rows = rows.select(coverage.alias("coverage"), F.round(F.least(F.lit(100.0), score)).cast("int").alias("score"))
    return rows.select("coverage", "score", band(F.col("score")).alias("band"), F.when(F.col("coverage") < 0.3, "low frontmatter coverage").alias("issue"))


def band(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "fair").otherwise("poor")


@dataclass(frozen=True)
class Recommendation:
    """What a role's field becomes. A value goes by ``mapping``, which may be overridden before planning, and else, if a
    migration is needed, by ``map_value``: so a field of many values needs no list of them."""

    existing: str | None
    values: tuple[str, ...]
    mapping: dict[str, str]
    needs_migration: bool

    def override(self, **changes: str) -> Recommendation:
        return Recommendation(self.existing, self.values, self.mapping | changes, self.needs_migration)

    def target(self, value: Column) -> Column:
        """What a value becomes; null if it isn't mapped."""
        named = F.create_map(*[F.lit(x) for pair in self.mapping.items() for x in pair])[value] if self.mapping else F.lit(None).cast("string")
        return F.coalesce(named, F.when(F.char_length(value) < LONG, map_value(value, list(self.values)))) if self.needs_migration else named


def recommend(fields: DataFrame, role: str, prefix: str = "note_", profile: DataFrame | None = None) -> Recommendation:
    """For type or area: keep a clean field that has the right name already, else map its values to the recommended ones.
    Only the values of a field of few values (HIGH at most) reach the driver. ``profile``: that of the fields, if it is there."""
    first = candidates(field_profile(fields) if profile is None else profile, role).first()
    wanted = RECOMMENDED[role]
    if first is None:
        return Recommendation(None, tuple(wanted), {}, False)
    field = first["field"]
    rows = [] if first["high_cardinality"] else value_mapping(fields, field, wanted).orderBy(F.desc("n"), "value").collect()
    if rows and first["distinct"] <= MOST_CLEAN[role] and field == prefix + role:
        return Recommendation(field, tuple(sorted(r["value"] for r in rows)), {r["value"]: r["value"] for r in rows}, False)
    return Recommendation(field, tuple(wanted), {r["value"]: r["mapped"] for r in rows}, True)


@dataclass(frozen=True)
class Schema:
    """What a collection's fields should become, and how many notes each change concerns."""

    type: Recommendation
    area: Recommendation
    gist: str | None
    tags: str | None
    notes_without_gist: int
    type_updates: int
    area_updates: int
    new_frontmatter: int


def recommend_schema(notes: DataFrame, fields: DataFrame, prefix: str = "note_") -> Schema:
    """The recommendations for all four roles. Notes count as without a gist if they have frontmatter without the gist
    field; without any such field all notes do."""
    profile = field_profile(fields).persist()  # a row a field, for all four roles
    roles = {r: recommend(fields, r, prefix, profile) for r in ("type", "area")}
    gist, tags = (candidates(profile, r).first() for r in ("gist", "tags"))
    profile.unpersist()
    total, having = notes.count(), fields.select("path").distinct().count()

    def updates(rec: Recommendation) -> int:
        if not rec.needs_migration or not rec.existing:
            return 0
        rows = value_counts(fields).filter(F.col("field") == rec.existing)
        return estimate(rows.select("value", "n", rec.target(F.col("value")).alias("mapped"))).first()["n"]

    return Schema(roles["type"], roles["area"], gist and gist["field"], tags and tags["field"], having - gist["n"] if gist else total, updates(roles["type"]), updates(roles["area"]), total - having)


CHANGE = "array<struct<field:string,action:string,old_value:string,new_value:string,reason:string>>"


def migration_plan(notes: DataFrame, type_: Recommendation, area: Recommendation, prefix: str = "note_") -> DataFrame:
    """(path, has_frontmatter, changes) of the notes to change. ``notes`` have path and fields (map; null: no frontmatter).

    A type or area whose value maps to another is updated; a missing type is added as ``note``; gists are left to people.
    """
    roles = {"type": type_, "area": area}
    held = {f"_{r}": F.col("fields")[x.existing] if x.existing else F.lit(None).cast("string") for r, x in roles.items()}
    notes = once(notes.select("path", "fields"), **held, _own=F.coalesce(F.col("fields")[prefix + "type"], F.lit("")), _has=F.col("fields").isNotNull())
    notes = once(notes, **{f"_to_{r}": x.target(F.col(f"_{r}")) if x.existing else F.lit(None).cast("string") for r, x in roles.items()})
    has = F.col("_has")

    def change(field: str, action: str, old: Column, new: Column, reason: Column) -> Column:
        return F.struct(F.lit(prefix + field).alias("field"), F.lit(action).alias("action"), old.cast("string").alias("old_value"), new.alias("new_value"), reason.alias("reason"))

    def updated(role: str) -> Column:
        value, mapped = F.col(f"_{role}"), F.col(f"_to_{role}")
        reason = F.concat(value, F.lit(" is not in the schema and becomes "), mapped)
        return F.when(has & (value != "") & mapped.isNotNull() & (mapped != value), change(role, "update", value, mapped, reason))

    added = change("type", "add", F.lit(None), F.lit("note"), F.lit("no type yet"))
    own, old = F.col("_own"), F.coalesce("_type", F.lit(""))
    parts = [F.when(~has | ((old == "") & (own == "")), added), updated("type"), updated("area")]
    changes = F.array_compact(F.array(*[p.cast(CHANGE[6:-1]) for p in parts]))
    return once(notes, changes=changes).select("path", has.alias("has_frontmatter"), "changes").filter((F.size("changes") > 0) | ~F.col("has_frontmatter"))


def migration_summary(plan: DataFrame) -> DataFrame:
    """(field, action, n) of all changes."""
    return plan.select(F.explode("changes").alias("c")).groupBy("c.field", "c.action").agg(F.count("*").alias("n"))


def review(plan: DataFrame, health: DataFrame) -> DataFrame:
    """(score, band, type_changes, area_changes, new_frontmatter, total), one row: what a migration comes to."""
    count = lambda role: F.sum(F.size(F.filter("changes", lambda c: F.endswith(c["field"], F.lit(role)) & ((c["action"] == "update") | F.col("has_frontmatter")))))
    sums = plan.agg(F.coalesce(count("type"), F.lit(0)).alias("type_changes"), F.coalesce(count("area"), F.lit(0)).alias("area_changes"), F.count_if(~F.col("has_frontmatter")).alias("new_frontmatter"))
    rows = health.select("score", "band").crossJoin(sums)  # one row by one row
    return rows.withColumn("total", F.col("type_changes") + F.col("area_changes") + F.col("new_frontmatter"))


def migration_preview(plan: DataFrame, most: int = 5) -> DataFrame:
    """(path, adds, updates) of the first files of a plan."""
    count = lambda action: F.size(F.filter("changes", lambda c: c["action"] == action))
    return plan.orderBy("path").limit(most).select("path", count("add").alias("adds"), count("update").alias("updates"))


def apply_migration(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, new_content) of the planned notes (path, content): new frontmatter, or the changed lines. A field that keeps
    its name has its line replaced, another gets a line at the end of the frontmatter and the old one stays."""
    rows = notes.join(plan, "path").select("path", "content", "changes", F.regexp_like("content", F.lit(FENCED)).alias("fenced"))
    lines = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(": "), c["new_value"])), "\n")
    fresh = F.concat(F.lit("---\n"), F.when(lines != "", F.concat(lines, F.lit("\n"))).otherwise(""), F.lit("---\n"), F.col("content"))
    raw = F.regexp_extract("content", FENCED, 1)
    rest = F.substring("content", F.char_length(F.regexp_extract("content", FENCED, 0)) + 1, F.char_length("content"))
    held = F.split(raw, "\n")
    key = lambda x: F.regexp_extract(x, r"^(\w+):", 1)
    to = lambda x: F.filter("changes", lambda c: (c["action"] == "update") & (c["field"] == key(x)))
    kept = F.transform(held, lambda x: F.when(F.size(to(x)) > 0, F.concat(key(x), F.lit(": "), F.get(to(x), F.lit(0))["new_value"])).otherwise(x))
    has = F.transform(held, key)
    added = F.transform(F.filter("changes", lambda c: ~F.array_contains(has, c["field"])), lambda c: F.concat(c["field"], F.lit(": "), c["new_value"]))
    changed = F.concat(F.lit("---\n"), F.array_join(F.concat(kept, added), "\n"), F.lit("\n---"), rest)
    return rows.select("path", F.when(F.col("fenced"), changed).otherwise(fresh).alias("new_content"))
