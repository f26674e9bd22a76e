import hashlib
from collections import defaultdict

import pytest

from marginalia.llm import mix as mixing
from marginalia.llm.mix import mix

from . import corpus

WEIGHTS = (5, 2, 1)


def fill(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(spark, data):
    got = mix(corpus.frame(spark, data)).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    keys = defaultdict(list)  # of the rows that are alike in the result
    for i, t, _, s, _ in data:
        n = len((t or "").encode().split())
        sizes[s] += n
        keys[i, s, n].append(hashlib.md5(f"0:{f'text:{t or str()}' if i is None else i}".encode()).hexdigest())
    goal = fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    by_source = defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[r["source"]].append(r)
    for s, rows in by_source.items():
        assert sum(r["taken"] for r in rows) == int(goal[s] + 0.5)
        start, expected = 0, []
        for _, i, n in sorted((k, repr(i), n) for (i, own, n), ks in keys.items() if own == s for k in ks):
            whole, rest = divmod(int(goal[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
            expected.append((i, n, whole * n + min(n, max(0, rest - start))))
            start += n
        assert sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in rows) == sorted(expected)
    return sorted(map(tuple, got), key=repr)


def test_against_brute_force(spark):
    data = corpus.rows()
    assert check(spark, data) == check(spark, data[::-1])


def test_repeats_and_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    monkeypatch.setattr(mixing, "RANGE", 4)
    monkeypatch.setattr(mixing, "GROUP", 3)
    data = [(1, "a b c", "en", "a", 0)] * 50 + [(None, f"x {i}" + " y" * (i % 5), "en", "a", 0) for i in range(40)] + [(None, None, "en", "a", 0)] * 9 + [(i, "d " * i, "en", "b", 0) for i in range(2, 30)]
    check(spark, data)


def test_limits(spark):
    check(spark, [(i, "a b c " * (300 if i == 0 else 1), "en", s, 0) for i, s in enumerate(["z", "a", "a", "b", "c", "d", None, "é"])])


def test_without_words(spark):
    check(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert mix(corpus.frame(spark, [])).collect() == []
