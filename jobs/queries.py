"""The jobs as queries: each runs twice into one new folder that all executors share, and returns what is there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import audit_report, index_upkeep
from marginalia.plans import sql
from marginalia.plans.queries import VIOLATIONS
from marginalia.sources.shared import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all documents, title and whole text, in an index that is kept up. The second run finds nothing new."""
    at = _folder(spark, "job1")
    for _ in range(2):
        index = index_upkeep.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/mark")
    return index.postings().select("doc_id", "field", "term", "tf", "dl")


def job2_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings about all documents, as notes. The second run replaces them by the same."""
    at = _folder(spark, "job2")
    for _ in range(2):
        report = audit_report.run(spark, f"{sf_dir}/documents.parquet", at)
    return report


_INDEX = f"""WITH t AS (SELECT doc_id, 'title' AS field, {sql.terms("'doc-' || doc_id")} AS t FROM documents UNION ALL SELECT doc_id, 'body', {sql.terms("text")} FROM documents)
SELECT doc_id, field, term, count(*) AS tf, CAST(any_value(dl) AS INTEGER) AS dl FROM (SELECT doc_id, field, len(t) AS dl, unnest(t) AS term FROM t) GROUP BY doc_id, field, term"""

_AUDIT = f"""WITH {sql.NOTES}, {sql.LINKS}, {VIOLATIONS}
SELECT name, code, severity, arg, 'schema' AS "check" FROM violations
UNION ALL SELECT src, 'broken_link', 'error', dst, 'wikilinks' FROM links WHERE dst NOT IN (SELECT name FROM notes)
UNION ALL SELECT DISTINCT name, 'orphan', 'warning', NULL, 'orphans' FROM notes WHERE name NOT IN (SELECT dst FROM links)
UNION ALL SELECT name, 'stale_gist', 'warning', strftime(gist_date, '%Y-%m-%d'), 'stale_gists' FROM notes WHERE gist IS NOT NULL AND gist_date < CAST(modified AS DATE)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_index_upkeep, job2_audit_report)}


def oracle_sql() -> dict[str, str]:
    return {"job1_index_upkeep": _INDEX, "job2_audit_report": _AUDIT}
