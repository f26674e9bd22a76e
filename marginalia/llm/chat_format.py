"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered into one text: a mark for the role, the text, a mark for the end. Marks are special
tokens of the tokenizer, and control strings inside texts are escaped, reversibly, so no text can pass for a mark. The
rendered text is encoded once, with offsets; the sorted spans of the turns that count for the loss are intersected with the
spans of the tokens by binary search, which gives the mask.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import MOST_HOT, Work

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a part of a conversation, if it has several turns, and of the parts that are encoded and sent on at once.
PART, SENT = 1 << 22, 1 << 19


@dataclass(frozen=True)
class Template:
    """The marks of a rendered conversation. ``roles`` have a mark each, other roles are named between ``other`` and ``named``;
    ``reserved`` strings are escaped like marks, as they are control strings elsewhere. A control string starts with a
    character that stands nowhere else in it, so that no two can overlap."""

    roles: tuple[str, ...] = ("system", "user", "assistant")
    learned: tuple[str, ...] = ("assistant",)
    other: str = "<|role|>"
    named: str = "<|text|>"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    escape: str = "\\"

    def __post_init__(self) -> None:
        first = {x[:1] for x in self.controls}
        if any(len(x) < 2 or self.escape in x or first & set(x[1:]) for x in self.controls):
            raise ValueError("a control string needs two characters, of which the first starts control strings only, and no escape")

    @property
    def marks(self) -> tuple[str, ...]:
        return (*[f"<|{r}|>" for r in self.roles], self.other, self.named, self.end)

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.marks, *self.reserved)

    def pattern(self) -> str:
        """A control string with any number of escapes after its first character, in three groups."""
        starts = "".join(sorted({re.escape(x[0]) for x in self.controls}))
        # longest first, so that it doesn't matter whether one string starts another
        rests = "|".join(re.escape(x[1:]) for x in sorted(self.controls, key=len, reverse=True))
        return rf"([{starts}])({re.escape(self.escape)}*)({rests})"

    def render(self, turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """(the text of the turns, the spans in it of the texts that are learned), in order."""
        add, out, spans, at = escaper(self), [], [], 0
        for role, text in turns:
            head = f"<|{role}|>" if role in self.roles else f"{self.other}{add(role)}{self.named}"
            body = add(text)
            if role in self.learned:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), spans

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a rendered text: the reverse of ``render``."""
        take, out = unescaper(self), []
        for turn in text.split(self.end)[:-1]:
            head, role = next(((f"<|{r}|>", r) for r in self.roles if turn.startswith(f"<|{r}|>")), (self.other, None))
            if role is None:
                name, _, body = turn[len(head) :].partition(self.named)
                out.append((take(name), take(body)))
            else:
                out.append((role, take(turn[len(head) :])))
        return out


@lru_cache(8)
def escaper(template: Template):
    found, mark = re.compile(template.pattern()), template.escape
    return lambda text: found.sub(lambda m: m[1] + mark + m[2] + m[3], text)


@lru_cache(8)
def unescaper(template: Template):
    found, n = re.compile(template.pattern()), len(template.escape)
    return lambda text: found.sub(lambda m: m[1] + m[2][n:] + m[3], text)


@lru_cache(2)
def load_tokenizer(path: str | None, template: Template):
    """A tokenizer with the marks of a template as special tokens. Without a path the public one is taken, where it is installed."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    out = Tokenizer.from_file(path)
    out.add_special_tokens(list(template.marks))
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (start, end) share a character with one of the sorted spans: the first span that ends after a token
    starts is found by binary search."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array([s for s in spans if s[0] < s[1]] or [(0, 0)]).T
    at = np.searchsorted(ends, offsets[:, 0], side="right")
    return (at < len(ends)) & (starts[np.minimum(at, len(ends) - 1)] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text under the mask, in order; tokens that are parts of one character share its span."""
    s, e = starts[loss], ends[loss]
    if not len(s):
        return []
    new = np.flatnonzero(np.concatenate([[True], s[1:] > np.maximum.accumulate(e)[:-1]]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    reach = np.maximum.accumulate(e)
    return [text[a:b] for a, b in zip(s[new].tolist(), reach[last].tolist(), strict=True)]


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """(conv_id, turns) of sorted rows: whole conversations, or stretches of turns of those that are very long."""
    turns, size, of = [], 0, None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and (conv != of or size + len(text) > most):
                yield of, turns
                turns, size = [], 0
            of = conv
            turns.append((role, text))
            size += len(text)
    if turns:
        yield of, turns


def _encode(kind: pa.DataType, first: int, convs: list, held: list[tuple[str, list, int]], tokenizer) -> pa.RecordBatch:
    found = tokenizer.encode_batch([x[0] for x in held], add_special_tokens=False)
    offsets = [np.array(f.offsets, np.int32).reshape(-1, 2) for f in found]
    ends = np.cumsum([0, *map(len, offsets)]).astype(np.int32)
    listed = lambda values, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), t))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(convs, kind), pa.array(range(first, first + len(held)), pa.int64()), pa.array([x[0] for x in held]), pa.array([x[2] for x in held], pa.int64()),
            listed([np.array(f.ids, np.int32) for f in found], pa.int32()), listed([o[:, 0] for o in offsets], pa.int32()), listed([o[:, 1] for o in offsets], pa.int32()),
            listed([loss_mask(o, x[1]) for o, x in zip(offsets, held, strict=True)], pa.bool_()),
        ],
        ["conv_id", "part", "text", "n_turns", "ids", "starts", "ends", "loss"],
    )


def format_conversations(conversations: DataFrame, template: Template = Template(), tokenizer: str | None = None, part: int = PART) -> DataFrame:
    """(conv_id, part, text, n_turns, ids, starts, ends, loss) of conversations (conv_id, turn, role, text): the rendered text, its
    tokens with their spans in it, and whether each counts for the loss.

    Turns stand in the order of turn, null first, then role and text; repeated rows are repeated turns. A null text or role
    is an empty one; rows without a conv_id are one conversation; other columns are left out, whatever their names. An
    empty text has no token. A conversation is one row; one of more than ``part`` characters has a row for each stretch of its
    turns, numbered in order: marks are tokens of their own, so its tokens are those of the whole. A text of any length
    is encoded whole. An empty table gives an empty result.

    Rows meet by conversation and are sorted, never held as a group. Conversations of more than one in MOST_HOT of all
    characters, and of many parts, are dealt by ranges of their turns instead, so that several tasks share one.
    """
    kind = conversations.schema["conv_id"].dataType
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    limit = max(total // MOST_HOT, 4 * part)
    hot = [] if total <= limit else [r[0] for r in sizes.filter(F.col("size") > limit).select("conv_id").collect()]  # MOST_HOT at most
    schema = f"conv_id {kind.simpleString()}, part bigint, text string, n_turns bigint, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, first, convs, held, size = load_tokenizer(tokenizer, template), TaskContext.get().partitionId() << 32, [], [], 0
        for conv, turns in _parts(batches, part):
            convs.append(conv)
            held.append((*template.render(turns), len(turns)))
            size += len(held[-1][0])
            if size >= SENT:
                yield _encode(key, first, convs, held, tokens)
                first, convs, held, size = first + len(held), [], [], 0
        if held:
            yield _encode(key, first, convs, held, tokens)

    from pyspark.sql.pandas.types import to_arrow_type

    key, order = to_arrow_type(kind), ["conv_id", "turn", "role", "text"]
    in_order = lambda df: df.sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, schema)
    if not hot:
        return in_order(rows.repartition("conv_id"))
    chosen = F.broadcast(conversations.sparkSession.createDataFrame([(x,) for x in hot], f"_hot {kind.simpleString()}"))
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.col("conv_id").eqNullSafe(F.col("_hot"))
    return in_order(rows.join(chosen, same, "left_anti").repartition("conv_id")).unionByName(in_order(rows.join(chosen, same, "left_semi").repartitionByRange(tasks, *order)))


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self, conv: object):
        self.conv, self.turns, self.loss, self.n, self.chars, self.formatted = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray, template: Template) -> None:
        for role, body in template.parse(text):
            self.n += 1
            self.turns.update(f"{role}\n{body}\n".encode())
        for stretch in masked_text(text, starts, ends, loss):
            plain = unescaper(template)(stretch)
            self.chars += len(plain)
            self.loss.update(plain.encode())
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from what ``format_conversations`` gives: turns are
    parsed out of the text, learned text is what the masked tokens span. Parts are read in order, one at a time."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(formatted.schema["conv_id"].dataType)
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        for batch in batches:
            convs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = np.asarray(batch.column(2).offsets)
            starts, ends, loss = (np.asarray(batch.column(i).values.to_numpy(zero_copy_only=False)) for i in (2, 3, 4))
            for i, (conv, text) in enumerate(zip(convs, texts, strict=True)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(text, *(x[at[i] : at[i + 1]] for x in (starts, ends, loss)), template)
            if done:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([now.row()])

    return formatted.select("conv_id", "part", "text", "starts", "ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "starts", "ends", "loss").mapInArrow(run, schema)


def formatted_and_read(conversations: DataFrame, template: Template = Template(), tokenizer: str | None = None, part: int = PART) -> DataFrame:
    """The digests of conversations out of their written formatted form."""
    return read_back(Work(conversations.sparkSession, "chat").cut(format_conversations(conversations, template, tokenizer, part), "formatted"), template)
