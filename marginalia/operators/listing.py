"""Listing, looking up and projecting notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Presets of fields, the fields there are, and limits.
PRESETS = {"default": ("title", "path", "gist"), "standard": ("title", "path", "gist", "type", "status", "area", "tags")}
FIELDS = ("title", "path", "gist", "type", "status", "area", "tags", "source", "modified", "created")
DEFAULT, MOST = 50, 500


def resolve_fields(spec: str | None) -> list[str]:
    """The columns of a preset (default, standard, all) or of a comma list; unknown names are left out."""
    name = (spec or "default").strip().lower()
    if name == "all":
        return list(FIELDS)
    return list(PRESETS.get(name, ())) or [x for x in (p.strip().lower() for p in name.split(",")) if x in FIELDS]


def project(notes: DataFrame, spec: str | None = None) -> DataFrame:
    """Title and path always, and the fields asked for that the notes have."""
    notes = notes if "title" in notes.columns else notes.withColumn("title", F.col("name"))
    wanted = dict.fromkeys(["title", "path", *resolve_fields(spec)])
    return notes.select(*[x for x in wanted if x in notes.columns])


def as_json(notes: DataFrame, spec: str | None = None) -> DataFrame:
    """(path, json): a note's fields as a JSON object, absent ones left out."""
    rows = project(notes, spec)
    return rows.select("path", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("json"))


def list_notes(notes: DataFrame, type: str | None = None, area: str | None = None, limit: int = DEFAULT, fields: str | None = None) -> DataFrame:  # noqa: A002
    """The first notes by name that meet equalities; the limit is from 1 to 500, 0 being the default."""
    for name, value in (("type", type), ("area", area)):
        notes = notes if value is None else notes.filter(F.col(name) == value)
    return project(notes.orderBy("name", "path").limit(min(max(limit or DEFAULT, 1), MOST)), fields)


def get_note(notes: DataFrame, wanted: str) -> DataFrame:
    """The first note by name whose name is, or whose path contains, what is wanted."""
    return notes.filter((F.col("name") == wanted) | F.contains("path", F.lit(wanted))).orderBy("name", "path").limit(1)


def pick_fields(fields: Column, wanted: list[str]) -> Column:
    """A map of fields with the wanted keys alone."""
    return F.map_filter(fields, lambda k, v: k.isin(*wanted) if wanted else F.lit(False))
