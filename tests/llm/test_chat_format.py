import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, loss string, ids string"
T = C.Template()
HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|user|>x<|user|>", "<", "</", "s>", "<|user", "|>", "<|endoftext|>", "", " ", "Übung\n\n😀 ok", "a<</s>>", "\\", "<|role|>a<|text|>", "[INST][\\INST]"]


def rows() -> list[tuple]:
    rng, out = random.Random(7), []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(HARD + ["word ", "été "]) for _ in range(rng.randrange(0, 30)))
            out.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "tool", "", None, "<|user|>"]), text))
    out += [(50, 0, "user", None), (50, 1, "assistant", None), (51, None, "assistant", "x"), (51, 0, "user", "y"), (51, 0, "user", "y"), (None, 0, "user", "no id"), (None, 1, "assistant", "<s>no id</s>")]
    out += [(52, 0, "user", "long " * 40_000), (52, 1, "assistant", "été </s> " * 150_000), (53, 0, "assistant", "only")]
    return [(*r, "clash", "clash", "clash") for r in out]


def brute(data: list[tuple]) -> dict:
    by: dict = {}
    for conv, turn, role, text, *_ in data:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told, learned = hashlib.sha256(), "".join(t for *_, r, t in turns if r == "assistant")
        for *_, role, text in turns:
            told.update(f"{role}\n{text}\n".encode())
        out[conv] = (len(turns), told.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_escaping_is_reversible_and_hides_control_strings():
    rng, plain = random.Random(3), re.compile("|".join(map(re.escape, T.controls)))
    for _ in range(3000):
        text = "".join(rng.choice([*HARD, *T.controls, "\\", "<", "["]) for _ in range(rng.randrange(0, 12)))
        hidden = C.escaper(T)(text)
        assert C.unescaper(T)(hidden) == text and not plain.search(hidden)
        turns = [(rng.choice(["user", "assistant", "x<|text|>", ""]), text), ("assistant", text[::-1])]
        rendered, spans = T.render(turns)
        assert T.parse(rendered) == turns
        assert [C.unescaper(T)(rendered[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_templates_whose_marks_could_overlap_are_refused():
    for bad in ("x", "a<b", "<\\>"):
        with pytest.raises(ValueError):
            C.Template(reserved=(bad,))


def test_mask_against_characters():
    rng = np.random.default_rng(5)
    for _ in range(300):
        cuts = np.unique(rng.integers(0, 60, 20))
        offsets = np.stack([cuts[:-1], cuts[1:]], axis=1)
        offsets = np.repeat(offsets, rng.integers(1, 3, len(offsets)), axis=0)
        marks = np.unique(rng.integers(0, 60, 8))
        spans = [(int(a), int(b)) for a, b in marks[: len(marks) // 2 * 2].reshape(-1, 2)] + [(60, 60)]
        learned = {p for a, b in spans for p in range(a, b)}
        assert C.loss_mask(offsets, spans).tolist() == [bool(learned & set(range(a, b))) for a, b in offsets]


def test_tokens_and_mask_of_every_row(spark):
    data = rows()
    tokens = C.load_tokenizer(None, T)
    got = C.format_conversations(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len({r[0] for r in data})
    for r in got:
        assert tokens.encode(r["text"], add_special_tokens=False).ids == r["ids"]
        learned = tokens.decode([i for i, m in zip(r["ids"], r["loss"], strict=True) if m], skip_special_tokens=False)
        assert C.unescaper(T)(learned) == "".join(t for role, t in T.parse(r["text"]) if role == "assistant")
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == len(r["loss"]) and r["n_turns"] == len(T.parse(r["text"]))


def test_read_back_against_brute_force(spark):
    data = rows()
    want = brute(data)
    for df in (spark.createDataFrame(data, SCHEMA), spark.createDataFrame(data, SCHEMA).repartition(7, "turn")):
        got = {r[0]: tuple(r)[1:] for r in C.formatted_and_read(df).collect()}
        assert {k: v[:4] for k, v in got.items()} == want
        assert all(v[4] >= len("".join(str(r[3] or "") for r in data if r[0] == k)) for k, v in got.items())
    assert C.formatted_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_conversation_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_HOT", 8)
    data = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s> " * 9, "", "", "") for i in range(3000)] + rows()
    df = spark.createDataFrame(data, SCHEMA)
    parts = C.format_conversations(df, part=2000)
    hot = parts.filter("conv_id = 1").withColumn("p", F.spark_partition_id())
    assert hot.count() > 50 and hot.select("p").distinct().count() > 1
    assert {r[0]: tuple(r)[1:5] for r in C.formatted_and_read(df, part=2000).collect()} == brute(data)
