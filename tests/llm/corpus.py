"""Small corpora with the awkward cases: nulls, empty and long texts, repeated rows, near copies, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng: random.Random, text: list[str], changes: int) -> list[str]:
    out = list(text)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base, passage = words(rng, 160), words(rng, 60)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(40)]
    texts += [" ".join(base)] * 6 + [" ".join(edited(rng, base, rng.randrange(0, 12))) for _ in range(60)]
    texts += [" ".join(words(rng, 30) + passage + words(rng, 30)) for _ in range(15)]
    texts += [None, "", " \n\t ", "one", "one", "One", "two words", "ÄÖ über straße ß", "a\x0bb\x0cc\x1cd", " ".join(words(rng, 6000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(i, texts[k], "en", [None, "a", "b", "c"][k % 4], len(texts[k] or "")) for i, k in enumerate(order)]
    return out + [out[5], (None, texts[40], None, None, None), (None, None, None, None, None)]


def frame(spark, data=None, extra: bool = True):
    """The rows as a table, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if not extra:
        return df
    names = ("rep", "keys", "hashes", "label", "score", "kept", "size", "rid", "pos", "key", "bucket", "target", "_key", "slot", "probability")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(x) for x in names])
