"""The operators that learn: counts against brute force, models by what they get right on rows they haven't seen."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import classifier, kernels, language_id, lm_score
from marginalia.llm import quality_rules as rules
from marginalia.llm.classifier import classify_quality
from marginalia.llm.doc_stats import counted, statistics
from marginalia.llm.language_id import declared_of, identify_languages, ngrams, visible
from marginalia.llm.lm_score import CLASSES, ROUNDS, START, WORDS, Model, frequent_counts, grouped, lm_scores, sequences
from marginalia.llm.quality_rules import platt, quality_rules

from . import corpus

LABELS = "doc_id bigint, quality int, toxic int"


def rated(n=300):
    """Good prose and two kinds of junk, with labels."""
    rng, docs, labels = random.Random(11), [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = corpus.words(rng, rng.randrange(30, 150), 500)
        if not good:
            w = [x + "###" for x in w] if rng.random() < 0.5 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w) + ".", "en", "a", 0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_rules_counts(spark):
    docs, labels = rated(60)
    rng = random.Random(12)
    eight = corpus.words(rng, 8)
    docs += [(100, " ".join(eight * 3 + corpus.words(rng, 30)), None, None, 0), (101, "a b\nc\n a b\na b\n\n \nc\n" * 2, None, None, 0), (102, None, None, None, 0), (None, "é #*$ %&|<> " * 9, None, None, 0), docs[0]]
    got = quality_rules(corpus.frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    texts = {d[0]: d[1] or "" for d in docs}
    for r in got:
        t = texts[r["doc_id"]]
        w = t.encode().split()
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_rules_verdicts(spark):
    docs, labels = rated()
    seen = {i: q for i, q, _ in labels}
    got = quality_rules(corpus.frame(spark, docs), spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)).filter("doc_id % 3 = 0").collect()
    assert np.mean([r["kept"] == bool(seen[r["doc_id"]]) for r in got]) > 0.97
    unlabelled = quality_rules(corpus.frame(spark, docs), spark.createDataFrame([], LABELS)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)
    assert quality_rules(corpus.frame(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def brute_features(text):
    """(kind, feature) -> share of the kind's occurrences."""
    words = (text or "").encode().split()
    ids = [xxhash.xxh64_intdigest(w) for w in words]
    chars = [text[i : i + 4] for i in range(len(text or "") - 3)]
    kinds = [Counter(ids), Counter(zip(ids, ids[1:])), Counter(chars)]
    return [{k: v / sum(c.values()) for k, v in c.items()} for c in kinds]


def test_rules_features_are_words_pairs_and_characters():
    """A feature has one place, whatever text it is in, and the shares of its kind add up."""
    texts = ["é a b", "a b a b é a", "日本語テキスト x", "", None, "abc", "a" * 40, "日本語テ a b"]
    (c,) = counted(pa.array(texts, pa.string()))
    got = list(rules._features_of(c))
    for text, (places, values) in zip(texts, got, strict=True):
        expected = brute_features(text)
        assert len(places) == sum(map(len, expected)) and sorted(np.round(values, 6)) == sorted(round(v, 6) for k in expected for v in k.values())
    weights = np.random.default_rng(1).normal(size=rules.DIMENSIONS)
    assert rules.margins(c, weights, 0.5) == pytest.approx([0.5 + weights[p] @ v for p, v in got])


def test_rules_verdict_is_that_of_the_regression(spark):
    """kept against the margin summed feature by feature in numpy."""
    docs, labels = rated(120)
    table, known = corpus.frame(spark, docs), spark.createDataFrame(labels, LABELS)
    weights, bias, a, b = rules.train(table, known)
    assert all(np.array_equal(x, y) for x, y in zip((weights, bias, a, b), rules.train(table.repartition(7), known), strict=True))
    got = {r["doc_id"]: r for r in quality_rules(table, known).collect()}
    for i, text, *_ in docs:
        ((places, values),) = rules._features_of(next(counted(pa.array([text]))))
        p = 1 / (1 + math.exp(-(a * (bias + sum(weights[k] * v for k, v in zip(places, values))) + b)))
        assert got[i]["probability"] == pytest.approx(p, abs=1e-6) and got[i]["kept"] == (not got[i]["base_failed"] and p >= 0.5)


def test_rules_training_is_bounded(spark, monkeypatch):
    """Few features fit: fewer rows are taken, always the same ones; a row repeated many times is one."""
    docs, labels = rated(80)
    known = spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(rules, "MOST_FEATURES", 9000)
    one, two = (rules.train(corpus.frame(spark, rows), known) for rows in (docs, docs[::-1] + docs[:5] * 30))
    assert np.array_equal(one[0], two[0]) and one[1:] == two[1:] and (one[0] != 0).sum() < 9000


def test_platt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.8 * x - 0.5)))).astype(float)
    a, b = platt(x, y)
    assert abs(a - 0.8) < 0.1 and abs(b + 0.5) < 0.15


def test_classifier(spark):
    docs, labels = rated()
    docs += [(None, "no id", None, None, 0), (1000, None, None, None, 0), (1001, "", None, None, 0), docs[3]]
    seen = {i: q for i, q, _ in labels}
    got = classify_quality(corpus.frame(spark, docs), spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0), (2000, 7, 0)], LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in seen]
    assert np.mean([r["predicted"] == seen[r["doc_id"]] for r in held]) > 0.95


def test_classifier_against_brute_force(spark):
    """Scores against Gaussian log densities with inverted covariances, from all training rows at once."""
    docs, labels = rated(200)
    x = np.array([statistics(next(counted(pa.array([d[1]]))))[0] for d in docs])
    y = np.array([q for _, q, _ in labels])
    train = np.array([zlib.crc32(str(d[0]).encode()) % 5 != 0 for d in docs])
    own = {k: x[train & (y == k)] for k in (0, 1)}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in own.values()) / train.sum()
    logs = {}
    for k, v in own.items():
        weight = len(v) / (len(v) + 10 * x.shape[1]) * (1 - classifier.POOLED)
        cov = weight * np.cov(v.T, bias=True) + (1 - weight) * pooled
        cov = (1 - classifier.DIAGONAL) * cov + classifier.DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(x.shape[1])
        off = x - v.mean(axis=0)
        logs[k] = np.log(len(v) / train.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
    d = logs[1] - logs[0]
    d = np.sign(d) * x.shape[1] * np.log1p(np.abs(d) / x.shape[1])
    a, b = platt(d[train], y[train])
    expected = 1 / (1 + np.exp(-(a * d + b)))
    got = {r["doc_id"]: r["score"] for r in classify_quality(corpus.frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()}
    assert [got[d[0]] for d in docs] == pytest.approx(expected, abs=1e-5)


def test_classifier_ignores_held_out_labels(spark):
    docs, labels = rated(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in classify_quality(corpus.frame(spark, docs), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_classifier_without_two_classes(spark, labels):
    got = classify_quality(corpus.frame(spark, rated(10)[0]), spark.createDataFrame(labels, LABELS)).collect()
    assert len({r["score"] for r in got}) == 1 and len(got) == 10
    assert classify_quality(corpus.frame(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def chain(n=400):
    """Texts in which a word tells the next one."""
    rng, docs = random.Random(13), []
    for i in range(n):
        w, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{w}")
            w = (w * 7 + 3) % 40 if rng.random() < 0.8 else rng.randrange(40)
        docs.append((i, " ".join(out), "en", "a", 0))
    return docs


def test_lm_base_scores(spark):
    docs = [*corpus.rows(), *chain(20)]
    got = lm_scores(corpus.frame(spark, docs)).collect()
    assert len(got) == len(docs)
    tokens = {(d[0], d[1]): [*(d[1] or "").encode().lower().split(), None] for d in docs}
    apart = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for d in docs if not apart(d[0]) for t in tokens[d[0], d[1]])
    n, v = sum(c.values()), len(c)
    expected = sorted((str(d[0]), apart(d[0]), len(w := tokens[d[0], d[1]]), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 6)) for d in docs)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected


def test_lm_learns_contexts(spark):
    got = lm_scores(corpus.frame(spark, chain())).filter("held_out").collect()
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / n > sum(r["base_score"] for r in got) / n + 0.1


def test_lm_is_alike_for_all_partitions(spark):
    """A context that one of many partitions has is learned as well as in one partition."""
    docs = corpus.frame(spark, chain(120)).select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in lm_scores(docs.repartitionByRange(n, "doc_id")).collect()} for n in (1, 24))
    assert len(one) == 120 and all(many[i] == pytest.approx(one[i], abs=1e-2) for i in one)


def test_lm_rounds_go_on_from_each_other():
    """Each round raises the likelihood of the training tokens."""
    rng = np.random.default_rng(5)
    ranked, counts = rng.integers(1, 1 << 62, 60).astype(np.uint64), np.full(60, 50)
    h, of = np.repeat(ranked[rng.permutation(60)][None], 50, axis=0).ravel(), np.zeros(3000, np.int64)
    model, scores = Model(ranked, counts, 3000, 60), []
    for _ in range(4):
        scores.append(model.log10(h, of)[0].sum())
        model.step(h, of)
    assert scores == sorted(scores) and scores[-1] > scores[1] + 100


def test_lm_tables_follow_the_corpus(monkeypatch):
    sizes = [Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, 0).rows for total in (0, 10**6, 10**7, 10**9)]
    assert sizes == [1 << 13, 1 << 13, 1 << 15, 1 << 15]
    column = pa.array(["a b c", "", None, "d " * 50, "e"] * 20)
    whole = list(grouped(column))
    monkeypatch.setattr(lm_score, "GROUP", 30)
    monkeypatch.setattr(kernels, "CHUNK", 40)
    parts = list(grouped(column))
    assert len(whole) == 1 < len(parts) and np.array_equal(np.concatenate([h for h, _ in parts]), whole[0][0])
    same = lambda of: of[1:] == of[:-1]
    assert all(same(of).sum() + len(set(of.tolist())) == len(of) for _, of in parts)


def test_lm_rare_tokens_by_join(spark, monkeypatch):
    from marginalia.llm import lm_score

    docs = corpus.rows()
    plain = lm_scores(corpus.frame(spark, docs)).collect()
    monkeypatch.setattr(lm_score.frequent_counts, "__defaults__", (600,))
    few = lm_scores(corpus.frame(spark, docs)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in rows)
    assert key(plain) == key(few)


@pytest.mark.parametrize("kinds", [0, 900, 5000])
def test_lm_frequent_tokens_are_bounded_whatever_the_ties(spark, kinds):
    """Many tokens of one count are no reason to take none, or all."""
    rng = np.random.default_rng(2)
    rows = [(int(h), 1) for h in rng.integers(-(1 << 62), 1 << 62, kinds)] + [(i, 5000 + 7 * i) for i in range(min(kinds, 40))]
    h, c = frequent_counts(spark.createDataFrame(rows, "h bigint, c bigint"), 1000)
    assert len(h) == len(set(h.tolist())) and list(c) == sorted(c, reverse=True) and (c > 1).sum() == min(kinds, 40)
    assert len(h) == kinds + 40 if kinds == 900 else 800 * bool(kinds) <= len(h) <= 1000


def test_lm_scores_are_those_of_the_model(spark):
    """score against the model's factors, multiplied token by token: class, place in the class, and share of the rest."""
    docs = [*corpus.rows(), *chain(60)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scores(corpus.frame(spark, docs)).collect()}
    apart = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = {d: next(sequences(pa.array([d[1]], pa.string())))[0] for d in docs}
    training = [texts[d] for d in docs if not apart(d[0])]
    counts = Counter(int(t) for x in training for t in x)
    ranked = sorted(counts, key=lambda t: (-counts[t], t))
    model = Model(np.array(ranked, np.uint64), np.array([counts[t] for t in ranked]), sum(counts.values()), len(ranked))
    h, of = np.concatenate(training), np.repeat(np.arange(len(training)), [len(x) for x in training])
    for _ in range(ROUNDS):
        model.step(h, of)
    rank = {t: i for i, t in enumerate(ranked)}

    def softmax(bias, weights, places):
        logits = bias.astype(float) + sum(weights[p].astype(float) for p in places)
        return np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()

    for d in docs[:40] + docs[-10:]:
        total, before, two = 0.0, int(START), int(START)
        for t in map(int, texts[d]):
            f = Model.features(np.array([two, before, t], np.uint64), np.zeros(3, np.int64))[:, 2:] if before != int(START) else Model.features(np.array([t], np.uint64), np.zeros(1, np.int64))
            if before != int(START) and two == int(START):
                f = Model.features(np.array([before, t], np.uint64), np.zeros(2, np.int64))[:, 1:]
            r = rank.get(t, len(ranked))
            c = min(r // WORDS, CLASSES)
            p = softmax(model.class_bias, model.of_class, model.places(f)[:, 0])[c]
            if c < CLASSES:
                p *= softmax(model.word_bias[c], model.of_word, model.places(f, np.array([c]))[:, 0])[r % WORDS]
            else:
                p *= (counts.get(t, 0) + 1) / (model.rest_count + model.rest_kinds + 1)
            total, before, two = total + math.log10(p), t, before
        assert got[d[0], len(texts[d])]["score"] == pytest.approx(total, rel=2e-3, abs=2e-2)


def test_lm_is_a_distribution():
    """Over all known tokens and one unknown the probabilities add up to 1, after training too."""
    rng = np.random.default_rng(3)
    ranked, counts = rng.integers(1, 1 << 62, 700).astype(np.uint64), np.sort(rng.integers(1, 500, 700))[::-1].copy()
    model = Model(ranked, counts, int(counts.sum()), 700)
    model.step(rng.choice(ranked, 5000, p=counts / counts.sum()), np.zeros(5000, np.int64))
    total, pairs = 0.0, np.stack([np.full(700, ranked[5]), ranked], axis=1).ravel()
    p, other = model.log10(pairs, np.repeat(np.arange(700), 2))
    share = np.where(other[1::2], np.log10(counts + 1.0) - model.log_rest, 0.0)
    total = (10 ** (p[1::2] + share)).sum()
    p, _ = model.log10(np.array([ranked[5], 99], np.uint64), np.zeros(2, np.int64))
    assert total + 10 ** (p[1] - model.log_rest) == pytest.approx(1, abs=1e-5) and CLASSES * WORDS < 700


def test_lm_empty(spark):
    assert lm_scores(corpus.frame(spark, [])).collect() == []
    alone = [(i, "a b", "en", "a", 0) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm_scores(corpus.frame(spark, alone)).collect()} == {(0, 0, 0.0, 0.0)}


TRAIN = {"en": "the of and to that with this have from they what were when your said there", "fr": "les des une que dans pour est sur avec plus par mais nous vous leur tout", "de": "der die und das nicht mit sich auf dem den ein ist auch als wie nach"}


def pages():
    rng, docs, out = random.Random(14), [], []
    for i in range(120):
        lang = ("en", "fr", "de")[i % 3]
        docs.append((i, " ".join(rng.choices(TRAIN[lang].split(), k=40)), lang))
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        text = " ".join(rng.choices(TRAIN[lang].split(), k=12))
        out.append((i, f"https://www.{lang}{i % 4}.example/x", f"<html lang='{lang if i % 9 else 'en'}-XX'><script>the of and</script><p>{text}</p>", lang))
    return docs, out


def test_language_id(spark):
    docs, rows = pages()
    known = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    extra = [(500, "https://a@www.fr1.example:80/", "", None), (501, None, "<html lang=de>", None), (502, "nonsense", None, None), (0, rows[0][1], rows[0][2], None)]
    got = identify_languages(spark.createDataFrame([r[:3] + ("c", "c") for r in rows + extra], "page_id bigint, url string, html string, lang string, logs string"), known).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) + len(extra)
    assert np.mean([by[i]["lang"] == lang for i, _, _, lang in rows]) > 0.97
    assert by[500]["lang"] == "fr" and by[500]["host"] == "www.fr1.example" and by[501]["lang"] == "de" and by[502]["lang"] in ("en", "fr", "de")
    assert all(0 < r["confidence"] <= 1 for r in got)


def test_language_id_against_brute_force(spark):
    """Every probability by loops over dictionaries."""
    docs, rows = pages()
    rows += [(500 + i, f"http://{h}/", f"<html lang={l}>{t}", None) for i, (h, l, t) in enumerate([("www.fr1.example", "de", ""), ("", "xx", "the of"), ("x.test", "en", "der die und"), ("www.en1.example", "", "que pour")])]
    buckets = lambda text: [int(b) for bs, _ in ngrams(np.frombuffer(text, np.uint8), np.array([0, len(text)])) for b in bs]
    langs = ["de", "en", "fr"]
    counts = {k: Counter(b for _, t, lang in docs if lang == k for b in buckets(t.encode())) for k in langs}
    log = {k: {b: math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * language_id.BUCKETS)) for b in range(language_id.BUCKETS)} for k in langs}
    page = {}
    for i, url, html, _ in rows:
        raw = [0.2 * sum(log[k][b] for b in buckets(visible(html))) for k in langs]
        e = [math.exp(v - max(raw)) for v in raw]
        host = url.split("/")[2] if "://" in url else ""
        found = re.search(r"<html lang='?([a-z]*)", html)[1]
        page[i] = (raw, [math.floor(1000 * v / sum(e) + 0.5) / 1000 for v in e], host, host.split(".")[-1], found)
    said = lambda p: p[4] if p[4] in langs else "other" if p[4] else "none"
    total = [sum(p[1][j] for p in page.values()) for j in range(3)]
    overall = [(x + 1) / (sum(total) + 3) for x in total]
    tables = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string"), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = {r["page_id"]: r for r in identify_languages(*tables).collect()}
    assert got == {r["page_id"]: r for r in identify_languages(*tables, at_once=2).collect()}
    for i, (raw, votes, host, suffix, _) in page.items():
        of = lambda test: [sum(p[1][j] for p in page.values() if test(p)) for j in range(3)]
        by_suffix, by_host = of(lambda p: p[3] == suffix), of(lambda p: p[2] == host)  # noqa: B023
        prior = [(x + 50 * o) / (sum(by_suffix) + 50) for x, o in zip(by_suffix, overall)]
        others = [h - v for h, v in zip(by_host, votes)]
        prior = [(x + 5 * p) / (sum(others) + 5) for x, p in zip(others, prior)]
        kind = of(lambda p: said(p) == said(page[i]))  # noqa: B023
        logs = [r + math.log((k + 1) / (t + 5)) + math.log(p) for r, k, t, p in zip(raw, kind, total, prior)]
        e = [math.exp(v - max(logs)) for v in logs]
        assert got[i]["lang"] == langs[logs.index(max(logs))] and got[i]["confidence"] == pytest.approx(1 / sum(e), rel=1e-3)


def test_language_id_rare_and_many_languages(spark):
    """A language of one document among many, 500 languages in about the time of 4, and tags with a region."""
    rng = random.Random(15)
    alphabet = [chr(0x4E00 + i) for i in range(5000)]
    own = {f"q{chr(97 + k // 26)}{chr(97 + k % 26)}": alphabet[10 * k : 10 * k + 10] for k in range(500)}
    text = lambda lang: " ".join("".join(rng.choices(own[lang], k=4)) for _ in range(20))
    docs = [(i, text("qaa"), "qaa" if i % 2 else "QAA-XX") for i in range(300)] + [(1000 + i, text(k), k) for i, k in enumerate(own) if k != "qaa"]
    rows = [(i, f"https://{k}.example/", f"<html lang={k}><p>{text(k)}</p>") for i, k in enumerate(own)]
    took = {}
    for n in (4, 500):
        began = time.monotonic()
        got = identify_languages(spark.createDataFrame(rows[:n], "page_id bigint, url string, html string"), spark.createDataFrame(docs[: 299 + n], "doc_id bigint, text string, lang string"), 20).collect()
        took[n] = time.monotonic() - began
        assert {r["page_id"]: r["text_lang"] for r in got} == dict(list(enumerate(own))[:n])
    assert took[500] < 2 * took[4] + 15


PIECES = ["<", ">", "<!--", "-->", "<script", "</script>", "</SCRIPT >", "<style x>", "</style", "</scriptx>", "&amp;", "&", ";", "a", " ", "<p>", "/"]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_visible_is_what_the_markup_leaves(pieces):
    page = "".join(pieces)
    assert visible(page) == re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]{1,10};", b" ", page.encode())


@pytest.mark.parametrize("open_", ["<!--", "<script ", "<", "<style>", "</script x", "<!-- --><", "&am", "<html <meta ", "<script></script"])
def test_unclosed_markup_takes_linear_time(open_):
    page = open_ * (20_000_000 // len(open_))
    began = time.monotonic()
    visible(page)
    assert time.monotonic() - began < 60


def test_declared_language(spark):
    rows = ["<HTML class=x Lang = 'de-AT'>", "<html><meta content='fr' http-equiv=\"Content-Language\">", "<meta http-equiv=content-language content=es-MX>", "<htmlx lang=de>", None, "<html lang=en " * 1_000_000, "<meta " * 1_000_000]
    got = spark.createDataFrame([(x,) for x in rows], "html string").select(declared_of(F.col("html")).alias("d")).collect()
    assert [r["d"] for r in got] == ["de", "fr", "es", "", "", "en", ""]


def test_language_id_empty(spark):
    docs, rows = pages()
    table = lambda x: spark.createDataFrame([r[:3] for r in x], "page_id bigint, url string, html string")
    known = lambda x: spark.createDataFrame(x, "doc_id bigint, text string, lang string")
    assert identify_languages(table([]), known(docs)).collect() == []
    got = identify_languages(table(rows), known([(1, "text", None)])).collect()
    assert {(r["lang"], r["confidence"]) for r in got} == {(None, 0.0)} and len(got) == len(rows)
