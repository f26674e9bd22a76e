"""Smart saving of many requests against saving them one by one."""

import numpy as np
import pytest

from marginalia.operators.smart_save import smart_save

ROWS = "id bigint, vec array<double>"


def brute(requests, index, least, most=3):
    cos = lambda x, y: round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 9) if x and y and any(x) and any(y) else 0.0
    created, out = [], {}
    for i, v in sorted(requests):
        close = sorted((-cos(v, w), False, j) for j, w in index if cos(v, w) >= least)[:most]
        close += [(-cos(v, w), True, j) for j, w in created if cos(v, w) >= least]
        out[i] = ("needs_decision" if close else "create", [(r, j, -s) for s, r, j in sorted(close)][:most])
        if not close:
            created.append((i, v))
    return out


@pytest.mark.parametrize("least", [0.6, 0.95])
def test_as_if_one_by_one(spark, tmp_path, least):
    rng = np.random.default_rng(1)
    index = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(12)] + [(90, None)]
    requests = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(0, 120)]
    requests += [(200 + i, requests[i][1]) for i in range(0, 120, 9)]  # repeated ones
    angle = [(700 + i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3)), 0.0, 0.0, 9.0, 0.0]) for i in range(30)]  # a chain
    requests += angle + [(400, None), (401, [0.0] * 6), (402, [0.0] * 6), (5000, index[3][1])]
    got = {r["id"]: (r["decision"], [(c["request"], c["id"], c["score"]) for c in r["close"]]) for r in smart_save(spark.createDataFrame(requests, ROWS).repartition(5), spark.createDataFrame(index, ROWS), least, str(tmp_path / "work")).collect()}
    want = brute(requests, index, least)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, close) in want.items():
        assert [c[:2] for c in got[k][1]] == [c[:2] for c in close] and np.allclose([c[2] for c in got[k][1]], [c[2] for c in close], atol=1e-8), k


def test_a_long_chain_and_nothing(spark, tmp_path):
    chain = [(i, [float(np.cos(i * 0.1)), float(np.sin(i * 0.1))]) for i in range(12)]  # each like the next alone
    got = {r["id"]: r["decision"] for r in smart_save(spark.createDataFrame(chain, ROWS), spark.createDataFrame([], ROWS), float(np.cos(0.11)), str(tmp_path / "a")).collect()}
    assert got == {i: "needs_decision" if i % 2 else "create" for i in range(12)}
    assert smart_save(spark.createDataFrame([], ROWS), spark.createDataFrame(chain, ROWS), 0.5, str(tmp_path / "b")).collect() == []
