"""The tag catalogue, tag suggestions, merges and discovery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import tokenize
from ..functions.vectors import Embedder, normalise
from .knn import BLOCK, DIGITS, similar_pairs, unit

# Thresholds and scores of suggestions.
THRESHOLD, NAME_SCORE, ALIAS_SCORE, DISCOVERED, KEYWORD = 0.3, 1.0, 0.95, 0.8, 0.1
#: Tags that are looked for at once.
TAGS = 10_000

# General tags of a new catalogue: name, description, aliases. Names and aliases are fixed values.
SEEDS = [
    ("gpu", "graphics processors and the computing done on them", ["vram", "graphics_card"]),
    ("cuda", "programming of NVIDIA's graphics processors", ["nvidia_cuda"]),
    ("mps", "computing on the graphics processors of Apple's chips", ["metal"]),
    ("mig", "one graphics processor split into several instances", []),
    ("nvlink", "fast links between graphics processors", []),
    ("time_slicing", "one processor shared by turns", []),
    ("k8s", "containers run and scheduled on clusters", ["kubernetes"]),
    ("inference", "running trained models and serving their answers", ["model_serving"]),
    ("llm", "large language models, 언어 모델", ["large_language_model", "gpt"]),
    ("ml_ops", "operating machine learning: from training runs to releases", ["mlops"]),
    ("distributed", "work spread over many machines", []),
    ("aws", "Amazon's cloud and its services", ["amazon"]),
    ("gcp", "Google's cloud and its services", ["google_cloud"]),
    ("agents", "programs that plan and use tools by themselves", ["ai_agents"]),
    ("mcp", "a protocol that gives models context and tools", ["model_context_protocol"]),
    ("embedding", "texts as vectors that lie close if they mean alike, 임베딩", ["embeddings"]),
    ("rag", "generation that looks up what it needs to know", []),
    ("deep_learning", "neural networks of many layers, 딥러닝", ["dl"]),
    ("transformer", "networks built from attention", []),
    ("architecture", "how systems are designed and put together", []),
    ("search", "finding what is wanted in a collection, 검색", []),
    ("meeting", "talks, what was said and decided, 회의", ["회의"]),
    ("onboarding", "the first weeks of someone new", []),
    ("health", "body, mind and keeping well, 건강", ["건강"]),
    ("finance", "money: earning, saving, investing, 재정", ["재정"]),
    ("routine", "habits and the order of a day", []),
    ("portfolio", "a selection of finished work", []),
    ("resume", "education and jobs held, for applications", ["cv"]),
]

# Words that are no tags.
STOPWORDS_EN = """the a an this that these those i you he she it we they me him her us them my your his its our their mine
yours ours theirs who whom whose which what whoever whatever in on at to for of with by from up down into onto upon out off
over under above below between among through during before after about against and or but nor so yet because although though
while whereas if unless until since when where whether is am are was were be been being have has had having do does did doing
will would shall should may might must can could very really just only also too even still already now then here there always
never often sometimes not no yes all any some each every both few more most other such own same than as how why""".split()
STOPWORDS_KO = """이 가 은 는 을 를 의 에 에서 으로 로 와 과 하고 이랑 랑 도 만 부터 까지 에게 한테 께 에게서 한테서 보다 처럼 같이 대로 만큼
밖에 나 저 너 당신 그 그녀 우리 저희 너희 그들 이것 그것 저것 여기 거기 저기 어디 누구 무엇 뭐 이런 그런 저런 이렇게 그렇게 저렇게 그리고 그러나
그래서 하지만 그런데 따라서 그러므로 또한 또 및 혹은 또는 하다 되다 있다 없다 이다 아니다 같다 하는 되는 있는 없는 인 인데 것 수 등 때 중 후 전 내 간
측 점 개 번 분 년 월 일 시 초 매우 아주 너무 정말 진짜 참 꽤 좀 조금 많이 잘 더 덜 가장 제일 특히 바로 곧 이미 아직 항상 자주 가끔 절대 결코 전혀 거의
왜 어떻게 얼마나 언제 어디서 하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열 삼 사 오 육 칠 팔 구 십 백 천 기반 활용 구현 방법 사용 관련 대한 위한 통한 정리
분석 설명 소개 개요 요약 정의 비교 검토 자동 수동 직접 간접 합니다 입니다 됩니다 있습니다 없습니다 같은 다른 파일 문서 페이지 내용 정보 데이터 오늘 내일
어제 지금 나중 최근 현재 보기 하기 되기 만들기 사용하기""".split()
# Endings of Korean verbs and particles.
VERB_ENDINGS = """입니다 습니다 됩니다 합니다 있습니다 이다 한다 된다 있다 없다 이야 야 이에요 에요 예요 었다 았다 였다 했다 됐다 었습니다 았습니다
였습니다 했습니다 니까 습니까 는가 인가 나요 까요 하고 하며 하면 해서 하여 하니 으며 으면 으니 어서 아서 하는 되는 있는 없는 같은 으로 에서 에게 한테 처럼
같이""".split()
PARTICLES = "가 이 는 은 를 을 의 에 로 과 와 랑".split()


def is_stopword(word: Column) -> Column:
    """Whether a lower-cased word is no tag: a listed word, a verb form with over three bytes before its ending, or a word
    with a particle and at least two bytes before it."""
    longer = lambda end, more: F.endswith(word, F.lit(end)) & (F.octet_length(word) > len(end.encode()) + more)
    out = word.isin(*dict.fromkeys(STOPWORDS_EN + STOPWORDS_KO))
    for end in VERB_ENDINGS:
        out = out | longer(end, 3)
    for end in PARTICLES:
        out = out | longer(end, 1)
    return out


def seed_catalogue(spark: SparkSession, tags: DataFrame | None = None) -> DataFrame:
    """(name, description, aliases, usage_count) of the seeds, or ``tags`` with the seeds they lack."""
    seeds = spark.createDataFrame([(*x, 0) for x in SEEDS], "name string, description string, aliases array<string>, usage_count bigint")
    return seeds if tags is None else tags.select(*seeds.columns).unionByName(seeds.join(tags.select("name"), "name", "left_anti"))


def catalogue(notes: DataFrame, least: int = 2, key: str = "path") -> DataFrame:
    """(name, description, usage_count) of the tags of at least ``least`` notes. A description quotes the start of the
    first three gists, by key, or names for want of one: 200 characters. Only the smallest three are kept on the way."""
    rows = notes.select(F.explode(F.array_distinct("tags")).alias("name"), key, F.coalesce("gist", F.col("name")).alias("text"))
    counts = rows.groupBy("name").agg(F.count("*").alias("usage_count")).filter(F.col("usage_count") >= least)
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(key))).filter("r <= 3")
    quoted = first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "; ").alias("quotes"))
    described = F.concat(F.col("name"), F.lit(". Used in contexts like: "), F.left("quotes", F.lit(200)))
    return counts.join(quoted, "name").select("name", described.alias("description"), "usage_count")


def list_tags(tags: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, usage_count, aliases), most used first; ``aliases`` (name, alias) are joined if they are a table of their own."""
    if aliases is not None:
        grouped = aliases.groupBy("name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
        tags = tags.join(grouped, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return tags.select("name", "usage_count", "aliases").orderBy(F.desc("usage_count"), "name")


def add_tag(tags: DataFrame, name: str, description: str, embedder: Embedder | None = None) -> DataFrame:
    """``tags`` with a new tag, unused and without aliases, whose vector is that of its description; a name that there is
    already changes nothing."""
    row = (name, description, [], 0, [float(x) for x in (embedder or Embedder()).query(description)])
    new = tags.sparkSession.createDataFrame([row], "name string, description string, aliases array<string>, usage_count bigint, vec array<double>")
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(tags.schema[c].dataType).alias(c) for c in tags.columns])
    return tags.unionByName(new.join(tags.select("name"), "name", "left_anti").select(*tags.columns))


def add_alias(tags: DataFrame, name: str, alias: str) -> DataFrame:
    """``tags`` with one more alias of a tag; none changes if there is no such tag."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return tags.withColumn("aliases", F.when(F.col("name") == name, F.array_distinct(F.concat(aliases, F.array(F.lit(alias))))).otherwise(aliases))


def delete_tag(tags: DataFrame, aliases: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tags, aliases) without a tag and its aliases (name, alias)."""
    return tags.filter(F.col("name") != name), aliases.filter(F.col("name") != name)


def tag_count(tags: DataFrame) -> DataFrame:
    """(n, is_empty), one row."""
    return tags.agg(F.count("*").alias("n")).select("n", (F.col("n") == 0).alias("is_empty"))


def tag_vectors(notes: DataFrame, embedder: Embedder | None = None, least: int = 2) -> DataFrame:
    """(name, vec) of the tags of at least ``least`` notes: the vector of all their gists, or names for want of one, as if
    these were one text. Sums of token vectors are added up by batch and then by tag; no text is gathered."""
    model = embedder or Embedder()
    rows = notes.select(F.explode(F.array_distinct("tags")).alias("name"), tokenize(F.coalesce("gist", F.col("name"))).alias("tokens"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, tuple[int, np.ndarray]] = {}
            for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, total = held.get(name, (0, np.zeros(model.dimension)))
                held[name] = (n + 1, total + model.matrix(tokens).sum(axis=0) if tokens else total)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([v.tolist() for _, v in held.values()], pa.list_(pa.float64()))], ["name", "n", "sums"])

    each = rows.mapInArrow(sums, "name string, n bigint, sums array<double>").select("name", "n", F.posexplode("sums").alias("i", "v"))
    each = each.groupBy("name", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).filter(F.col("n") >= least)
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])  # a number a dimension
    return each.groupBy("name").agg(vec.alias("vec")).select("name", normalise(F.col("vec")).alias("vec"))


def find_tag(tags: DataFrame, wanted: str) -> DataFrame:
    """The tag of that name or else of that alias; found by alias it shows none."""
    hit = tags.withColumn("by_name", F.col("name") == wanted).filter(F.col("by_name") | F.array_contains("aliases", wanted))
    shown = F.when(F.col("by_name"), F.col("aliases")).otherwise(F.array().cast("array<string>"))
    return hit.orderBy(F.desc("by_name"), "name").limit(1).withColumn("aliases", shown).drop("by_name")


SUGGESTED = "array<struct<tag:string,score:double,reason:string>>"


class Matcher:
    """Finds the names and aliases of some tags in lower-cased texts, all in one reading, and their cosines to vectors."""

    def __init__(self, tags: list[tuple[str, list[str], list[float] | None]], least: float):
        self.least, self.tags = least, tags
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (name, aliases, _) in enumerate(tags):
            for j, word in enumerate([name, *aliases]):
                places.setdefault(word.lower(), []).append((i, j))
        self.always = places.pop("", [])
        self.places = list(places.values())
        self.words = list(places)
        with_vec = [i for i, t in enumerate(tags) if t[2]]
        self.with_vec = np.array(with_vec, np.int64)
        self.rows = unit(np.array([tags[i][2] for i in with_vec], float)) if with_vec else np.zeros((0, 0))
        self.made = None

    def _automaton(self):
        """Made once a worker: a broadcast matcher is one object there."""
        if self.made is None and self.words:
            import ahocorasick

            self.made = ahocorasick.Automaton()
            for i, word in enumerate(self.words):
                self.made.add_word(word, i)
            self.made.make_automaton()
        return self.made

    def _scores(self, vectors: list) -> dict[int, np.ndarray]:
        """The cosines of all tags with a vector to each vector of their dimension, by its place: one product of matrices."""
        fit = [i for i, v in enumerate(vectors) if v is not None and len(self.rows) and len(v) == self.rows.shape[1]]
        scores = np.round(unit(np.array([vectors[i] for i in fit], float)) @ self.rows.T, DIGITS) if fit else ()
        return dict(zip(fit, scores, strict=True))

    def __call__(self, texts, vectors) -> list[list[dict]]:
        texts, vectors, out = list(texts), list(vectors), []
        for at in range(0, len(texts), BLOCK):
            out += self._block(texts[at : at + BLOCK], self._scores(vectors[at : at + BLOCK]))
        return out

    def _block(self, texts: list, scores: dict[int, np.ndarray]) -> list[list[dict]]:
        automaton, out = self._automaton(), []
        for place, text in enumerate(texts):
            first: dict[int, int] = {}
            for i, j in self.always:
                first[i] = min(j, first.get(i, j))
            for k in {k for _, k in automaton.iter(text)} if automaton and text else ():
                for i, j in self.places[k]:
                    first[i] = min(j, first.get(i, j))
            found = {i: (NAME_SCORE, "name") if j == 0 else (ALIAS_SCORE, f"alias:{self.tags[i][1][j - 1]}") for i, j in first.items()}
            if (score := scores.get(place)) is not None:
                found = {int(self.with_vec[i]): (float(score[i]), "semantic") for i in np.flatnonzero(score >= self.least)} | found
            out.append([{"tag": self.tags[i][0], "score": s, "reason": why} for i, (s, why) in sorted(found.items())])
        return out


def suggest(texts: DataFrame, tags: DataFrame, text: str = "text", key: str = "doc_id", least: float = THRESHOLD) -> DataFrame:
    """(key, tag, score, reason): the tags whose name the text holds score 1, those of which it holds an alias 0.95, others
    their cosine to the text, if that is enough.

    ``TAGS`` tags at a time are broadcast and found in one reading of a text, in Arrow batches; a larger catalogue takes more
    passes. No row is paired with a row. ``texts`` may have the vector ``vec``, tags too. A tag without a name is left out.
    """
    with_vec = "vec" in texts.columns and "vec" in tags.columns
    spark, last, out = texts.sparkSession, None, None
    rows = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"), (F.col("vec").cast("array<double>") if with_vec else F.lit(None).cast("array<double>")).alias("vec"))
    # tags may share a name, so a page ends at a name and what else tells rows apart
    listed = tags.select("name", "aliases", *(["vec"] if with_vec else [])).filter("name is not null")
    listed = listed.withColumn("_rest", F.to_json(F.struct(*[c for c in listed.columns if c != "name"]))).dropDuplicates(["name", "_rest"])
    while True:
        some = (listed if last is None else listed.filter((F.col("name") > last[0]) | ((F.col("name") == last[0]) & (F.col("_rest") > last[1])))).orderBy("name", "_rest").limit(TAGS).collect()
        if some:
            last = some[-1]["name"], some[-1]["_rest"]
            matcher = spark.sparkContext.broadcast(Matcher([(r["name"], list(r["aliases"] or []), list(r["vec"]) if with_vec and r["vec"] is not None else None) for r in some], least))
            part = rows.select(key, F.explode(_suggested(matcher)(F.col("low"), F.col("vec"))).alias("x")).select(key, "x.*")
            out = part if out is None else out.unionByName(part)
        if len(some) < TAGS:
            return texts.limit(0).select(key, F.lit("").alias("tag"), F.lit(0.0).alias("score"), F.lit("").alias("reason")) if out is None else out


def _suggested(matcher):
    def run(texts: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series(matcher.value(texts, vectors))

    return F.pandas_udf(run, SUGGESTED)


def best(rows: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` best suggestions of each text."""
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "tag"))).filter(F.col("r") <= k).drop("r")


def similar_tags(tags: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, score) of the pairs of tags with vectors at least so similar."""
    return similar_pairs(tags, "name", "vec", least)


def merges(tags: DataFrame, least: float = 0.7) -> DataFrame:
    """(keep, merge, score): of each similar pair the more used tag stays; of equals the first by name."""
    pairs = similar_pairs(tags, "name", "vec", least, carry="usage_count")
    first = F.col("ca") >= F.col("cb")
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("merge"), "score")


def from_similar(similar: DataFrame, own: Column | list[str], least: int = 2, limit: int = 5) -> DataFrame:
    """(tag, count, score): the tags of similar notes (tags, score) that the note itself lacks and at least ``least`` of
    them have, with the best score among these."""
    lacked = F.array_except("tags", own if isinstance(own, Column) else F.array(*map(F.lit, own)).cast("array<string>"))
    rows = similar.select(F.explode(F.array_distinct(lacked)).alias("tag"), "score")
    out = rows.groupBy("tag").agg(F.count("*").alias("count"), F.max("score").alias("score")).filter(F.col("count") >= least)
    return out.orderBy(F.desc("count"), F.desc("score"), "tag").limit(limit)


def keywords(text: str, embedder: Embedder, limit: int = 10) -> list[tuple[str, float]]:
    """The words of one text nearest to it as a whole, above a floor, on the driver."""
    import re

    if hasattr(embedder, "keywords"):  # subwords are merged into words by their tokenizer
        return embedder.keywords(text, KEYWORD, limit)
    return embedder.nearest_words([x for x in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if x], KEYWORD, limit)


def keyword_rows(texts: DataFrame, embedder: Embedder, text: str = "text", key: str = "doc_id", limit: int = 10) -> DataFrame:
    """(key, tag, score) of the words of each text nearest to it as a whole: in Arrow batches, without a shuffle."""

    whole = hasattr(embedder, "keywords")
    best = (lambda t: embedder.keywords(t or "", KEYWORD, limit)) if whole else lambda t: embedder.nearest_words([] if t is None else list(t), KEYWORD, limit)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": w, "score": s} for w, s in best(t)] for t in values])

    found = F.pandas_udf(run, T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType())])))
    return texts.select(key, F.explode(found(F.col(text) if whole else tokenize(F.col(text)))).alias("x")).select(key, "x.*")


def discover(suggested: DataFrame, found: DataFrame, limit: int, key: str = "doc_id", least: float = THRESHOLD) -> DataFrame:
    """Suggestions with the discovered keywords added at 0.8 of their score: not those under three bytes, stopwords, or
    tags that are suggested already."""
    new = found.filter((F.octet_length("tag") >= 3) & ~is_stopword(F.col("tag"))).join(suggested.select(key, "tag"), [key, "tag"], "left_anti")
    new = new.select(key, "tag", F.round(F.col("score") * DISCOVERED, DIGITS).alias("score"), F.lit("keyword").alias("reason")).filter(F.col("score") >= least)
    return best(suggested.select(key, "tag", "score", "reason").unionByName(new), limit, key)


def resolve(manual: Column, auto: Column, limit: int, auto_tag: bool = True) -> Column:
    """The tags of a note to save: the manual ones, trimmed, in order, and then the suggested ones, without repeats and at
    most ``limit``; without suggestions there is no limit."""
    own = F.filter(F.transform(F.coalesce(manual, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    if not auto_tag:
        return F.array_distinct(own)
    return F.slice(F.array_distinct(F.concat(own, F.coalesce(auto, F.array().cast("array<string>")))), 1, limit)
