import hashlib
import random
import re

from marginalia.llm import decontaminate as dc

from . import corpus


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[k : k + n]:
                    hit |= set(range(s, s + n))
                    found |= {str(item)} if item is not None else set()
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def data(short):
    rng = random.Random(8)
    items = [(i, " ".join(corpus.words(rng, rng.randrange(14, 40), 300))) for i in range(12)]
    items += [(100, items[0][1]), (101, None), (102, "?!"), (None, items[3][1]), (5, items[5][1])]
    if short:
        items += [(20, "lonely"), (21, "two words"), (22, "just three words"), (23, " ".join(corpus.words(rng, 7)))]
    texts = [None, "", "...", "LONELY heart", "a lonely two Words here", "just three words"]
    for _ in range(30):
        t = corpus.words(rng, rng.randrange(5, 200), 300)
        if rng.random() < 0.7:
            v = split(rng.choice(items[:12])[1])
            k = rng.randrange(len(v) - 13 + 1)
            t[rng.randrange(len(t)) : 0] = v[k : k + rng.randrange(11, 20)]
        texts.append(", ".join(t) if rng.random() < 0.5 else " ".join(t))
    texts.append(items[2][1] + " " + items[2][1].upper() + "Ä")
    return items, [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(6, texts[6], None, None, None), (None, items[1][1], None, None, None)]


def check(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.decontaminate(corpus.frame(spark, docs), bench).collect()
    assert len(got) == len(docs)
    texts = {r[0]: r[1] for r in docs}
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items), r


def test_against_brute_force(spark):
    check(spark, *data(short=False))


def test_short_items(spark):
    check(spark, *data(short=True))


def test_shuffled_lookup(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    check(spark, *data(short=False))


def test_empty_tables(spark):
    items, docs = data(short=False)
    assert dc.decontaminate(corpus.frame(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).collect() == []
    check(spark, [], docs)
