import hashlib
from collections import Counter

import pytest

from marginalia.llm.shard import SLOTS, _preference, lookup_table, place

from . import corpus


def brute(shards, slots):
    owner, orders = {}, []
    for name in shards:
        start, step = _preference(name, slots)
        orders.append([(start + k * step) % slots for k in range(slots)])
    places = [iter(o) for o in orders]
    while len(owner) < slots:
        for i, p in enumerate(places):
            if len(owner) < slots:
                owner[next(x for x in p if x not in owner)] = i
    return [owner[k] for k in range(slots)]


def test_table_against_brute_force():
    names = [f"s{i}" for i in range(7)]
    assert lookup_table(names, 211) == brute(names, 211)


def test_even_and_stable():
    names = [f"s{i}" for i in range(64)]
    table = lookup_table(names)
    counts = Counter(table)
    assert len(table) == SLOTS and max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_table(names[:-1])
    assert sum(a != b for a, b in zip(table, fewer) if a != 63) < 0.1 * SLOTS


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            lookup_table(names, slots)


def test_rows(spark):
    data = corpus.rows()
    df = corpus.frame(spark, data)
    got = place(df, [f"s{i}" for i in range(5)], 1009).collect()
    assert len(got) == len(data)
    table = lookup_table([f"s{i}" for i in range(5)], 1009)
    for r in got:
        key = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + (r["text"] or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009
        assert r["slot"] == slot and r["shard"] == f"s{table[slot]}"
    assert place(corpus.frame(spark, [])).collect() == []
