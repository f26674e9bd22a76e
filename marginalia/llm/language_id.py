"""Language identification of web pages by Bayesian evidence fusion.

Three kinds of evidence multiply: the likelihood of the visible text under hashed byte n-gram models of each language,
the likelihood of the language that the markup declares (which sites copy and forget, so its reliability is estimated
from the pages themselves), and a prior for the page's host. Host priors are smoothed hierarchically: a host's votes
lean on its address suffix, a suffix's on all pages. Votes are the text posteriors in thousandths, so that sums are
exact in any order, and grouped aggregations add them up; a page's own vote is taken out of its host's.

The candidates are all languages that label a document, by primary subtag ('en-US' is 'en'). The n-gram model of each is
fitted on at most ``SAMPLE`` of its labelled documents, a documented bound. ``PASS`` models at most are broadcast at a time
(64 MB); of more languages, each further ``PASS`` take one more pass over the pages. Evidence is held in arrays, votes in
sparse ones, so that plans are as wide for a thousand languages as for four.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kernels import CHUNK, LOWER, U, chunks, list_values, lists, mix
from .storage import MOST_HOT, Work, join_hot

SAMPLE, BUCKETS, PASS = 4000, 1 << 14, 512
#: Log probabilities are multiples of 1/UNIT, so that their sums are exact in any order.
UNIT = 1 << 18
SMOOTHING, TEMPER, SUFFIX_WEIGHT, HOST_WEIGHT, VOTES = 0.5, 0.2, 50.0, 5.0, 1000
_MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*+>|<!--.*?-->|<[^>]*>|&[a-z0-9#]{1,10};")
_BLOCK, _COMMENT_END, _TAG_END, _REFERENCE = re.compile(rb"(?i)<(script|style)\b"), re.compile(b"-->"), re.compile(b">"), re.compile(rb"(?i)&[a-z0-9#]{1,10};")
_BLOCK_END = {x: re.compile(rb"(?i)</" + x + rb"\s*+>") for x in (b"script", b"style")}
#: An end of a block with something between its name and its bracket, which is none.
_LOOSE_END = re.compile(rb"</(?:script|style)\s*+[^>\s]")


def ngrams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bucket of each run of two and of three bytes inside a text, ASCII letters lower-cased, and its text; in blocks."""
    d, ends = data[at[0] : at[-1]], at[1:] - at[0]
    for lo in range(0, len(d), CHUNK):
        part = LOWER[d[lo : lo + CHUNK + 2]].astype(U)
        of = np.searchsorted(ends, np.arange(lo, lo + len(part)), "right")
        for k, salt in ((2, U(0xA54FF53A5F1D36F1)), (3, U(0x510E527FADE682D1))):
            n = max(min(len(part) - k + 1, CHUNK), 0)
            run = np.zeros(n, U)
            for j in range(k):
                run = (run << U(8)) | part[j : n + j]
            whole = of[:n] == of[k - 1 : k - 1 + n]
            yield (mix(run[whole] ^ salt) & U(BUCKETS - 1)).astype(np.int64), of[:n][whole]


def _closed(html: bytes) -> bool:
    """Whether each markup that begins also ends, so that a search for its end never runs through the rest in vain."""
    low = html.lower()
    ends = [(b"<!--", b"-->"), (b"<script", b"</script"), (b"<style", b"</style"), (b"<", b">")]
    return all(low.rfind(begin) <= low.rfind(end) for begin, end in ends) and not _LOOSE_END.search(low)


def visible(html: str | None) -> bytes:
    """The text of a page without scripts, styles, comments, tags and character references, in time linear in its length:
    what is opened and never closed is looked for once."""
    page = (html or "").encode()
    if _closed(page):
        return _MARKUP.sub(b" ", page)
    out, at, gone = [], 0, set()

    def end_of(begin: int, name: bytes, pattern: re.Pattern) -> int:
        found = None if name in gone else pattern.search(page, begin)
        if found is None:
            gone.add(name)
        return found.end() if found else -1

    while (begin := page.find(b"<", at)) >= 0:
        out.append(page[at:begin])
        named = _BLOCK.match(page, begin)
        end = end_of(named.end(), named[1].lower(), _BLOCK_END[named[1].lower()]) if named else -1
        if end < 0 and page.startswith(b"<!--", begin):
            end = end_of(begin + 4, b"--", _COMMENT_END)
        if end < 0:
            end = end_of(begin + 1, b">", _TAG_END)
        if end < 0:  # every end has a bracket, so nothing ends after this
            at = begin
            break
        out.append(b" ")
        at = end
    return b"".join(_REFERENCE.sub(b" ", x) for x in [*out, page[at:]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, code = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
        for lo, hi, data, at in chunks(batch.column(0)):
            for bucket, of in ngrams(data, at):
                u, n = np.unique(code[lo:hi][of] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[u // BUCKETS], pa.string()), pa.array(u % BUCKETS, pa.int64()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])


def _fit(rows: pa.Table) -> pa.Table:
    """The log probability of each bucket, out of the counts of one language."""
    counts = np.full(BUCKETS, SMOOTHING)
    counts[np.asarray(rows["bucket"])] += np.asarray(rows["n"])
    return pa.table({"lang": rows["lang"].slice(0, 1), "logs": lists(np.round(np.log(counts / counts.sum()) * UNIT) / UNIT, [BUCKETS])})


def train(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(lang, logs): the log probability of each bucket in each language, from labelled documents (doc_id, text, lang)."""
    primary = F.regexp_extract(F.lower(F.trim(F.col("lang"))), r"^([^-_\s]+)", 1)
    text = F.col("text").cast("string")
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc_id"), primary.alias("lang"), text.alias("text")).filter("lang is not null and lang <> ''")
    sizes = known.groupBy("lang").agg(F.count_distinct("doc_id").alias("size"))
    # of a large language only a share is ranked, which is at least ``most`` but for chance; fewer than MOST_HOT are large
    large = sizes.filter(F.col("size") > F.greatest(F.lit(2 * most), F.lit(known.count()) / MOST_HOT))
    share = F.coalesce(2 * most / F.col("size"), F.lit(1.0))
    known = known.join(F.broadcast(large), "lang", "left").filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30)).drop("size")
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("lang", "doc_id").distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place")
    rows = known.join(chosen, ["lang", "doc_id"], "left_semi").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return counts.groupBy("lang").applyInArrow(_fit, "lang string, logs array<double>")


def _scores(model):
    """The log likelihood of each page's text in each language of a model (a column each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out = []
                for _, _, data, at in chunks(pa.array([visible(x) for x in part.column("html").to_pylist()], pa.large_binary()).cast(pa.large_string())):
                    counts = np.zeros((len(at) - 1) * BUCKETS)
                    for bucket, of in ngrams(data, at):
                        counts += np.bincount(of * BUCKETS + bucket, minlength=len(counts))
                    out.append(counts.reshape(-1, BUCKETS) @ table)
                flat = np.concatenate(out)
                rest = part.drop_columns(["html"])
                yield pa.RecordBatch.from_arrays([*rest.columns, lists(flat.ravel(), [flat.shape[1]] * len(flat))], [*rest.schema.names, "logs"])

    return run


def _table(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, n)


def _voted(langs: list[str]):
    """Tempers the likelihoods and adds each page's votes, of which the first counts the page itself, and what it declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(langs)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                logs = TEMPER * _table(part.column("logs"), len(langs))
                logs -= logs.max(axis=1, keepdims=True)
                e = np.exp(logs)
                votes = np.hstack([np.ones((len(e), 1)), np.floor(VOTES * e / e.sum(axis=1, keepdims=True) + 0.5)]).astype(np.int64)
                row, lang = np.nonzero(votes)
                sparse = pa.StructArray.from_arrays([pa.array(lang - 1, pa.int32()), pa.array(votes[row, lang])], ["l", "v"])
                said = [x if x in known else "other" if x else "none" for x in part.column("declared").to_pylist()]
                names = ["page_id", "host", "suffix", "declared"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], lists(logs.ravel(), [len(langs)] * len(logs)), lists(sparse, np.bincount(row, minlength=len(votes))), pa.array(said, pa.string())], [*names, "logs", "votes", "said"])

    return run


def _fused(langs: list[str], of_lang: np.ndarray):
    """The posterior of each page out of its likelihoods and the votes of its host, its suffix and its declaration."""

    def dense(column: pa.Array, n: int) -> np.ndarray:
        x, at = column.flatten(), np.asarray(column.value_lengths())
        out = np.zeros((len(at), n + 1))
        out[np.repeat(np.arange(len(at)), at), np.asarray(x.field("l"))] = np.asarray(x.field("v")) / VOTES
        return out[:, :n]  # the count of rows, at -1, is in the last place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = len(langs), np.array(langs, object)
        overall = (of_lang + 1) / (of_lang.sum() + n)
        smooth = lambda votes, prior, weight: (votes + weight * prior) / (votes.sum(axis=1, keepdims=True) + weight)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                logs = _table(part.column("logs"), n)
                own, host, suffix, said = (dense(part.column(c), n) for c in ("votes", "host_votes", "suffix_votes", "said_votes"))
                prior = smooth(host - own, smooth(suffix, overall, SUFFIX_WEIGHT), HOST_WEIGHT)
                # P(declared | language) is smoothed by one page for each pair; what may be declared are the languages, none and another
                both = logs + np.log((said + 1) / (of_lang + n + 2)) + np.log(prior)
                confidence = 1 / np.exp(both - both.max(axis=1, keepdims=True)).sum(axis=1)
                best = [pa.array(names[x.argmax(axis=1)], pa.string()) for x in (logs, both)]
                kept = ["page_id", "host", "suffix", "declared"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *best, pa.array(confidence)], [*kept, "text_lang", "lang", "confidence"])

    return run


def _sums(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, {key}_votes, weight): the votes of a key's rows, a number for each language that has some, and how many rows there are."""
    each = rows.select(key, F.explode("votes").alias("x")).groupBy(key, F.col("x.l").alias("l")).agg(F.sum("x.v").alias("v"), F.count("*").alias("n"))
    return each.groupBy(key).agg(F.collect_list(F.struct("l", "v")).alias(f"{key}_votes"), F.max(F.when(F.col("l") < 0, F.col("n"))).alias(weight))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def declared_of(html: Column) -> Column:
    """The primary subtag of the language that the markup declares, or an empty string: that of the first html tag, else
    of the first meta tag that names a content language. Tags are split off first, so that unclosed ones cost one look."""
    attributes = F.substring_index(F.get(F.split(html, r"(?i)<html(?=[\s/>])", 2), 1), ">", 1)
    tag = F.regexp_extract(attributes, r"""(?i)(?:^|\s|/)(?:xml:)?lang\s*+=\s*+["']?([A-Za-z]{2,8})""", 1)
    metas = F.transform(F.split(html, r"(?i)<meta(?=[\s/])"), lambda x: F.substring_index(x, ">", 1))
    first = F.get(F.filter(F.slice(metas, 2, F.size(metas)), lambda x: F.contains(F.lower(x), F.lit("content-language"))), 0)
    meta = F.regexp_extract(first, r"""(?i)\bcontent\s*+=\s*+["']?\s*+([A-Za-z]{2,8})""", 1)
    return F.lower(F.coalesce(F.when(tag != "", tag), F.when(meta != "", meta), F.lit("")))


def identify_languages(pages: DataFrame, docs: DataFrame, most: int = SAMPLE, at_once: int = PASS) -> DataFrame:
    """(page_id, host, suffix, declared, text_lang, lang, confidence) of each row of ``pages`` (page_id, url, html).

    ``docs`` (doc_id, text, lang) are the labelled documents. A page without text, url or declaration goes by the
    evidence that is left, at last by the prior of all pages; ties go to the language first by name. Repeated rows
    count and are scored each. A very long page is read whole, its runs in blocks. An empty table gives an empty result.
    Columns of other names are ignored. Without a labelled language lang is null and the confidence 0. ``at_once`` models
    are broadcast together; the result doesn't depend on it.
    """
    spark = pages.sparkSession
    work = Work(spark, "language")
    models = work.cut(train(docs, most), "models")
    langs = sorted(r["lang"] for r in models.select("lang").collect())  # a row a language
    html = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), host_of(F.col("url").cast("string")).alias("host"), declared_of(html).alias("declared"))
    rows = rows.select("page_id", "html", "host", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), "declared")
    if not langs:
        missing = F.lit(None).cast("string")
        return rows.select("page_id", "host", "suffix", "declared", missing.alias("text_lang"), missing.alias("lang"), F.lit(0.0).alias("confidence"))
    small = "page_id bigint, host string, suffix string, declared string"

    def scored(rows: DataFrame, some: list[str], schema: str):
        got = models.filter(F.col("lang").isin(some)).toArrow().sort_by("lang")
        model = spark.sparkContext.broadcast(np.ascontiguousarray(list_values(got["logs"])[0].reshape(-1, BUCKETS).T))
        return rows.mapInArrow(_scores(model), f"{schema}, logs array<double>"), model

    if len(langs) <= at_once:
        seen, _ = scored(rows, langs, small)
    else:
        numbered = work.cut(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        parts = []
        for k in range(0, len(langs), at_once):
            part, model = scored(numbered, langs[k : k + at_once], f"{small}, row bigint")
            parts.append(work.cut(part.withColumn("part", F.lit(k)), "scores"))
            model.unpersist()
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "logs"))), lambda x: x["logs"]))
        seen = union.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("page_id", "host", "suffix", "declared")], joined.alias("logs"))
    seen = work.cut(seen.mapInArrow(_voted(langs), f"{small}, logs array<double>, votes array<struct<l: int, v: bigint>>, said string"), "evidence")

    by_said = work.cut(_sums(seen, "said", "declaring"), "said")
    sums = {r["l"]: r["v"] for r in by_said.select(F.explode("said_votes").alias("x")).groupBy("x.l").agg(F.sum("x.v").alias("v")).collect()}  # a row a language
    of_lang, total = np.array([sums.get(i, 0) for i in range(len(langs))]) / VOTES, sums.get(-1, 0)
    # suffixes join the hosts, and pages join one table of hosts; a host counts once for the size of its suffix
    hosts = work.cut(_sums(seen.select("votes", F.struct("host", "suffix").alias("key")), "key", "pages").select("key.*", F.col("key_votes").alias("votes"), "pages"), "hosts")
    by_host = join_hot(hosts, _sums(hosts, "suffix", "hosts"), "suffix", "hosts", hosts.count())
    by_host = work.cut(by_host.select("host", F.col("votes").alias("host_votes"), "suffix_votes", "pages"), "priors")
    joined = join_hot(join_hot(seen, by_said, "said", "declaring", total), by_host, "host", "pages", total)
    work.keep(seen, by_said, by_host)
    return joined.mapInArrow(_fused(langs, of_lang), f"{small}, text_lang string, lang string, confidence double")
