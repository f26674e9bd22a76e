import hashlib
import random
from collections import defaultdict

import pytest

from marginalia.llm.substring_dedup import substring_dedup

from . import corpus


def brute(data, window):
    first, ids = {}, defaultdict(list)
    words = [(i, (t or "").encode().split()) for i, t, *_ in data]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        ids[i].append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return ids


@pytest.mark.parametrize(("window", "start"), [(13, 7), (30, 4), (5, 7)])
def test_against_brute_force(spark, window, start):
    rng, data = random.Random(9), corpus.rows()
    loop = corpus.words(rng, 9) * 20
    data += [(1000, " ".join(loop), None, None, 0), (1001, " ".join(loop[3:]), None, None, 0), (1002, data[0][1], None, None, 0), (1002, " ".join(corpus.words(rng, 50)), None, None, 0)]
    rng.shuffle(data)
    expected = brute(data, window)
    got = defaultdict(list)
    for r in substring_dedup(corpus.frame(spark, data), window, start).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_nothing_to_remove(spark):
    assert substring_dedup(corpus.frame(spark, [])).collect() == []
    got = substring_dedup(corpus.frame(spark, [(1, "a b c", "en", "a", 0), (2, None, "en", "a", 0)])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (3, 0)]
