import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import kernels
from marginalia.llm.kernels import Tokens, chunks, grams
from marginalia.llm.storage import Bloom
from marginalia.llm.substring_dedup import anchors, lengths

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b\x1cé😀|#", max_size=40)), max_size=12)


@settings(deadline=None, max_examples=60)
@given(texts, st.booleans())
def test_tokens_are_words(values, lower):
    got = []
    for _, _, data, at in chunks(pa.array(values, pa.string())):
        t = Tokens(data, at, lower)
        h = t.hashes()
        for i in range(len(t.count)):
            span = range(t.first[i], t.first[i + 1])
            got.append([(t.data[t.starts[k] : t.ends[k]].tobytes(), int(h[k])) for k in span])
    expected = [(v or "").encode() for v in values]
    expected = [(b.lower() if lower else b).split() for b in expected]
    assert [[w for w, _ in x] for x in got] == expected
    known = {}
    for w, h in (p for x in got for p in x):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(kernels, "CHUNK", 100)
    column = pa.array(["x" * n for n in (10, 50, 60, 500, 1, 99, 1, 0)]).slice(1)
    parts = [(lo, hi, int(at[-1] - at[0])) for lo, hi, _, at in chunks(column)]
    assert [p[:2] for p in parts] == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 7)]
    assert all(n <= 100 or hi - lo == 1 for lo, hi, n in parts)


def test_grams_depend_on_order_and_length():
    h = np.arange(1, 30, dtype=np.uint64)
    assert grams(h, 3)[0] != grams(h[[1, 0, 2]], 3)[0] and grams(h[:2], 2)[0] != grams(h[:1], 1)[0]
    assert len(grams(h, 30)) == 0


def test_anchors_against_brute_force():
    rng = random.Random(2)
    for span in (1, 2, 3, 7, 8, 13):
        g = np.array([rng.randrange(9) for _ in range(50)], np.uint64)
        assert list(anchors(g, span)) == [i + int(np.argmin(g[i : i + span])) for i in range(len(g) - span + 1)]
    assert lengths(13, 7) == [7, 13] and lengths(50, 7) == [7, 14, 28, 50] and lengths(5, 7) == [5]


def test_bloom_has_no_false_negatives(spark):
    ids = spark.range(0, 3000, 3)
    bloom = Bloom(ids, "id")
    rows = spark.range(3000).select("id", bloom.places("id").alias("p")).toArrow()
    places = np.asarray(rows["p"].combine_chunks().flatten())
    passed = np.asarray(rows["id"])[Bloom.passing(bloom.words.value, places)]
    assert set(range(0, 3000, 3)) <= set(passed.tolist()) and len(passed) < 1200


def test_long_words_of_special_form_differ():
    """Two words of Thue-Morse form have equal polynomials in any odd base modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    words = ["".join("ab"[x ^ turn] for x in bits) for turn in (0, 1)] + ["x" * n for n in (63, 64, 65, 66)]
    column = pa.array([" ".join(words)])
    ((_, _, data, at),) = chunks(column)
    assert len(set(Tokens(data, at).hashes().tolist())) == len(words)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(6)
    text = " ".join("w" * rng.randrange(1, 90) + str(rng.randrange(50)) for _ in range(3000))
    whole = Tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).hashes()
    monkeypatch.setattr(kernels, "UP", kernels.UP[: 256 + kernels.LONG + 1])
    assert (Tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).hashes() == whole).all()


def test_very_long_texts_take_bounded_memory():
    """200 MB: some bytes for each of the text, not one number or more for each."""
    text = np.frombuffer(("some words of a text " * (10 << 20))[: 200 << 20].encode(), np.uint8)
    tracemalloc.start()
    n = len(Tokens(text, np.array([0, len(text)])).hashes())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 40 << 20 and peak < 12 * len(text)
