"""Operator 5, chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with character offsets; the sorted spans of the assistant's texts are
intersected with the token spans by binary search, which marks the tokens that the loss counts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, check_columns, read

by_value(__name__)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: str, one_line: bool = False) -> str:
    """No "<" is left, so no control string can stand in a text; on one line, no line feed either."""
    out = text.replace("\\", "\\\\").replace("<", "\\l")
    return out.replace("\n", "\\n") if one_line else out


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\n", "\n") for p in parts)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that the loss counts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}\n", escape(text)
        out += [head, body, CLOSE, "\n"]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role), unescape(rest.rpartition(CLOSE)[0])))
    return turns


def masked(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Which tokens overlap a span; both lists are sorted, so each span finds its tokens by binary search."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = [False] * len(offsets)
    for a, b in spans:
        if a < b:
            for k in range(bisect_right(ends, a), bisect_left(starts, b)):
                out[k] = True
    return out


def under(formatted: str, offsets: list[tuple[int, int]], mask: list[bool]) -> list[str]:
    """The stretches of text under masked tokens; tokens that share a character count it once."""
    out, start, to = [], None, 0
    for (a, b), on in zip(offsets, mask, strict=True):
        if on and start is None:
            start, to = a, b
        elif on and a <= to:
            to = max(to, b)
        elif start is not None:
            out.append(formatted[start:to])
            start, to = (a, b) if on else (None, to)
    return out + ([formatted[start:to]] if start is not None else [])


def tokenizer(path: str = VOCABULARY):
    """The public vocabulary with the control strings as tokens of their own, so no token spans a turn's edge."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False) for x in (OPEN, CLOSE)])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def formatted(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): the formatted text, token ids, offsets, loss mask.

    Rows go by turn, then role, then text; null role and text are empty, null turns come first, a null conv_id is a
    conversation of its own, repeated rows are turns of their own and empty tables give no rows. A conversation is
    rendered whole by one task, since its tokens are one sequence; texts are gathered per conversation only."""
    check_columns(turns, "conv_id", "turn", "role", "text")
    blank = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", "turns.role", "turns.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            out = []
            for role, text in zip(b.column(1), b.column(2), strict=True):
                f, spans = render(list(zip(role.as_py(), text.as_py(), strict=True)))
                e = t.encode(f, add_special_tokens=False)
                out.append((f, e.ids, [a for a, _ in e.offsets], [z for _, z in e.offsets], masked(e.offsets, spans)))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

    return whole.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digest(out: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back: turns, text under the mask, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, s, e, m in zip(*(b.column(k) for k in range(1, 5)), strict=True):
                f = f.as_py()
                turns = parse(f)
                loss = "".join(map(unescape, under(f, list(zip(s.as_py(), e.as_py(), strict=True)), m.as_py())))
                sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
                rows.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(f)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    schema = f"conv_id {out.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return out.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, schema)


PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return digest(formatted(turns.unionByName(probe)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<', '\l')) + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n')) + 15 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
