import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from marginalia.llm import phrases as P

from . import corpus


def brute(data, max_n=3, least=10, share=50, best=2000):
    counts, totals = Counter(), Counter()
    low = str.maketrans(ascii_uppercase, ascii_lowercase)
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    found = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out: dict = {}
    for (lang, p), a in found.items():
        longer = (b for (g, q), b in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(P.SCALE * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:best])]


def data():
    rng, out = random.Random(11), []
    names = ["New York", "new\tYORK City", "a b a b a b", "straße öl Ä", "x.y z", "in the", "of the year 2020"]
    for i in range(400):
        words = [rng.choice(names) if rng.random() < 0.4 else f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(rng.randrange(1, 40))]
        out.append((i, "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x1c "]) for w in words), rng.choice(["en", "en", "en", "de", None, "und", "a\tb", ""]), "s", 1))
    return out + [out[3]] * 20 + [(900, None, "en", None, None), (901, "", None, None, None), (None, " ..\n", "fr", None, None), (902, "alone", "fr", None, None)]


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_against_brute_force(spark, max_n):
    rows = data()
    got = sorted(map(tuple, P.mine_phrases(corpus.frame(spark, rows), max_n).collect()))
    want = sorted(brute(rows, max_n))
    assert got == want and len(want) > 40 and any(len(r[2].split()) == max_n for r in want)


def test_ranks_within_groups_and_a_short_list(spark, monkeypatch):
    rows = data()
    monkeypatch.setattr(P, "SPREAD", (5, 3))
    assert sorted(map(tuple, P.mine_phrases(corpus.frame(spark, rows), least=3, best=7).collect())) == sorted(brute(rows, least=3, best=7))


def test_texts_in_stretches_and_a_filter_that_lets_all_pass(spark, monkeypatch):
    rows = data() + [(950, "the very long text goes on. " * 60_000, "en", None, None)]
    monkeypatch.setattr(P, "MAX_BITS", 64)
    assert sorted(map(tuple, P.mine_phrases(corpus.frame(spark, rows), chunk=1 << 15).collect())) == sorted(brute(rows))


def test_scores_beyond_64_bits(spark):
    n = 10**14 - 1
    got = spark.range(1).select(P.score(F.lit(n - 5), F.lit(n), F.lit(n + 3))).first()[0]
    assert got == 10**6 * (n - 5) ** 2 // (n * (n + 3))


def test_empty_table(spark):
    assert P.mine_phrases(corpus.frame(spark, [])).collect() == []
