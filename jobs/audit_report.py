"""Audits a table of notes and writes what it finds, partitioned by check.

A source with the column ``content`` holds notes as files (path, name, content, modified); one with ``doc_id`` holds plain documents,
which are made notes first. Each run replaces the report as a whole, so it can be repeated.

    python -m jobs.audit_report --source /data/notes --target /data/audit --config jobs/audit_report.json
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_config
from marginalia.config import NotesConfig
from marginalia.operators import audit
from marginalia.sources import notes as src

#: The validation schema, as the collection's config has it; the checks; whether frontmatter is parsed as YAML too.
DEFAULTS = {"schema": {}, "checks": ["schema", "wikilinks", "orphans", "stale_gists"], "yaml": False}
FINDINGS = "name string, code string, severity string, arg string, check string"


def files_of(source: DataFrame, config: NotesConfig) -> DataFrame:
    files = source if "content" in source.columns else src.rendered(src.corpus(source), config.field_prefix)
    return files.select("path", "name", "content", "modified")


def findings(files: DataFrame, config: NotesConfig, checks: list[str], yaml: bool = False) -> DataFrame:
    """(name, code, severity, arg, check) of all that the checks find. Links and names need no frontmatter, so they come from the
    files as they are."""
    notes, names, links = src.parse_notes(files, config.field_prefix), files.select("name"), src.links(files)

    def found(rows: DataFrame, check: str, code: str, severity: str, arg: Column) -> DataFrame:
        return rows.select("name", F.lit(code).alias("code"), F.lit(severity).alias("severity"), arg.cast("string").alias("arg"), F.lit(check).alias("check"))

    made = {
        "schema": lambda: audit.violations(notes, config, yaml).select("name", "code", "severity", "arg", F.lit("schema").alias("check")),
        "wikilinks": lambda: found(audit.broken_links(links, names).withColumnRenamed("src", "name"), "wikilinks", "broken_link", "error", F.col("dst")),
        "orphans": lambda: found(audit.orphans(links, names), "orphans", "orphan", "warning", F.lit(None)),
        "stale_gists": lambda: found(audit.stale(notes, config.field_prefix), "stale_gists", "stale_gist", "warning", F.col("gist_date")),
    }
    if unknown := set(checks) - set(made):
        raise ValueError(f"no checks {', '.join(sorted(unknown))}")
    out = notes.sparkSession.createDataFrame([], FINDINGS)
    for check in checks:
        out = out.unionByName(made[check]())
    return out


def run(spark: SparkSession, source: str, target: str, config: dict | None = None) -> DataFrame:
    """Writes the report of ``source`` (Parquet) to ``target``, and returns it as it is read back."""
    c = DEFAULTS | (config or {})
    rules, table = NotesConfig.from_dict(c["schema"]), spark.read.parquet(source)
    findings(files_of(table, rules), rules, c["checks"], c["yaml"]).write.mode("overwrite").partitionBy("check").parquet(target)
    report = spark.read.schema(FINDINGS).parquet(target)
    counts = {(r["check"], r["severity"]): r["n"] for r in report.groupBy("check", "severity").agg(F.count("*").alias("n")).collect()}  # a row a check
    log("audit_report").info("read %d rows from %s", table.count(), source)
    for (check, severity), n in sorted(counts.items()):
        log("audit_report").info("wrote %d findings of %s (%s) to %s", n, check, severity, target)
    return report


if __name__ == "__main__":
    command_line("audit_report", __doc__, ("source", "target"), lambda spark, a: run(spark, a.source, a.target, read_config(spark, a.config, DEFAULTS)))
