import random

import pytest

from marginalia.llm import storage
from marginalia.llm.components import components
from marginalia.llm.near_dedup import near_duplicates
from marginalia.llm.storage import Work

from . import corpus


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """doc_id -> (size, component) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, data):
    expected = brute({r[0]: r for r in data if r[0] is not None}.values())
    got = near_duplicates(corpus.frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def test_against_brute_force(spark):
    got = check(spark, corpus.rows())
    nulls = [r for r in got if r["doc_id"] is None]
    assert len(nulls) == 2 and all(r["kept"] for r in nulls)


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_of_one_text(spark, seed):
    """Members that aren't linked with their hub but with each other."""
    rng = random.Random(seed)
    base, out = corpus.words(rng, 150), []
    for _ in range(25):
        far = corpus.edited(rng, base, rng.randrange(2, 9))
        out += [" ".join(corpus.edited(rng, far, rng.randrange(0, 4))) for _ in range(6)]
    rng.shuffle(out)
    check(spark, [(i, t, "en", "a", 0) for i, t in enumerate(out)])


def test_second_template_and_repeats(spark):
    """Copies of a template that isn't linked with its hub make no pairs with each other again; repeated rows make no more
    sets than one."""
    rng = random.Random(8)
    base = corpus.words(rng, 300, 10**9)
    second = base[:40] + corpus.words(rng, 30, 10**9) + base[70:]
    data = [(0, " ".join(base)), (1, " ".join(corpus.edited(rng, base, 1)))] + [(2 + i, " ".join(corpus.edited(rng, second, 2))) for i in range(120)]
    data += [data[0]] * 300 + [data[1]] * 300
    check(spark, [(*r, "en", "a", 0) for r in data])


def test_empty_table(spark):
    assert near_duplicates(corpus.frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(Work(spark, "test"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    for node in parent:
        assert got.get(node, node) == find(node)


def test_hot_and_other_keys_join_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, None] * 5)], "k bigint, v bigint")
    table = spark.createDataFrame([(1, 50, "a"), (2, 5, "b"), (3, 5, "c"), (4, 0, "d")], "k bigint, n bigint, x string")
    expected = sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    for most in (1, 2, 4096):
        monkeypatch.setattr(storage, "MOST_HOT", most)
        assert sorted(map(tuple, storage.join_hot(rows, table, "k", "n", 65).collect())) == expected and len(expected) == 60


@pytest.mark.parametrize("seed", range(3))
def test_members_that_add_or_lack(spark, seed):
    """Members of one hub that aren't linked with it: near subsets, pages of a template, and those that share what they add."""
    rng = random.Random(seed)
    common, extra = [f"c{i}" for i in range(240)], [[f"e{k}_{i}" for i in range(70)] for k in range(4)]
    texts = [common + [f"hub{i}" for i in range(30)]]
    for i in range(140):
        kind, own = rng.randrange(5), [f"o{i}_{k}" for k in range(rng.choice([20, 35, 50]))]
        start = rng.randrange(0, 200)
        if kind == 0:  # a page of the template
            texts.append(common + own)
        elif kind == 1:  # one that lacks a stretch, as others do
            texts.append(common[: start // 50 * 50] + common[start // 50 * 50 + 45 :] + own[: rng.randrange(0, 8)])
        elif kind == 2:  # one that shares a block with others, and little else that the hub lacks
            texts.append(common + rng.choice(extra) + own[: rng.randrange(0, 12)])
        elif kind == 3:  # a shorter copy
            texts.append(common[: 160 + rng.randrange(0, 80)])
        else:
            texts.append(common[start:] + rng.choice(extra)[: rng.randrange(30, 70)])
    check(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)])
