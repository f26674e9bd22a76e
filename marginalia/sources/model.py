"""Static token vectors from model files: a tensor file in the public safetensors format and a tokenizer's vocabulary."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np

from ..functions.vectors import SubwordEmbedder


def read_tensors(path: str) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file as float arrays: F32, F16 and BF16."""
    raw = Path(path).read_bytes()
    (size,) = struct.unpack("<Q", raw[:8])
    out = {}
    for name, x in json.loads(raw[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        begin, end = x["data_offsets"]
        data = raw[8 + size + begin : 8 + size + end]
        if x["dtype"] == "BF16":
            values = (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
        elif x["dtype"] in ("F32", "F16"):
            values = np.frombuffer(data, {"F32": "<f4", "F16": "<f2"}[x["dtype"]]).astype(np.float32)
        else:
            continue
        out[name] = values.reshape(x["shape"])
    return out


def token_table(tensors: str, tokenizer: str, name: str = "embeddings") -> dict[str, list[float]]:
    """token -> vector, for ``create_embedder``: the rows of an embedding tensor by the ids of a tokenizer.json's
    vocabulary, with tokens cleaned as words."""
    rows = read_tensors(tensors)[name]
    vocabulary = json.loads(Path(tokenizer).read_text(encoding="utf-8"))["model"]["vocab"]
    pairs = vocabulary.items() if isinstance(vocabulary, dict) else ((t, i) for i, (t, _) in enumerate(vocabulary))
    table: dict[str, list[float]] = {}
    for token, i in sorted(pairs, key=lambda p: p[1]):
        if i < len(rows):
            table.setdefault(clean_token(token), rows[i].tolist())
    return table


def subword_model(tensors: str, tokenizer: str, name: str = "embeddings") -> SubwordEmbedder:
    """The embedder of a static model: its tensor file and its tokenizer.json."""
    return SubwordEmbedder(read_tensors(tensors)[name], Path(tokenizer).read_text(encoding="utf-8"))


def clean_token(token: str) -> str:
    """A subword without its marks, in lower case."""
    for mark in ("Ġ", "##", "▁"):
        token = token.removeprefix(mark)
    return token.lower()
