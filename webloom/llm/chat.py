"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text alone under the loss
mask. What follows the last assistant turn goes into one more example without a loss span, so that no turn is lost.

A turn is written ``### role: text</turn>`` and a line end. In roles and texts ``\\``, ``<``, ``#`` and ``:`` (in
roles only) get a backslash before them, so no text can end a turn or open one, and the reader
takes the backslashes out again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "assistant"
EXAMPLE = "conv_id long, example int, is_last boolean, text string, loss_start int, loss_length int"
_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("is_last", pa.bool_()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32())])
_READ = "conv_id long, example int, is_last boolean, n_turns long, turns_sha256 string, loss string, formatted_chars long"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("is_last", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64())])
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)  # possessive, so no place is kept for each character
#: Characters of examples that a batch holds, or one example.
BATCH = 4 << 20


def escape(text: str, more: str = "") -> str:
    for c in "\\<#" + more:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    # Between doubled backslashes one stands for what follows it; no list of single characters is made.
    parts = text.split("\\\\")
    for c in "<#:":
        parts = [p.replace("\\" + c, c) for p in parts]
    return "\\".join(parts)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _examples(turns: list[dict]) -> Iterator[tuple[bool, str, int, int]]:
    text, open_turns = "", False
    for k, turn in enumerate(turns):
        role, body = turn["role"] or "", escape(turn["text"] or "")
        head = f"### {escape(role, ':')}: "
        start = len(text) + len(head)
        text += f"{head}{body}</turn>\n"
        open_turns = role != TARGET
        if not open_turns:
            yield k == len(turns) - 1, text, start, len(body)
    if open_turns:
        yield True, text, 0, 0


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        rows.clear()
        return batch

    for batch in batches:
        for k in range(batch.num_rows):
            for n, (last, text, start, length) in enumerate(_examples(batch.column(1)[k].as_py())):
                rows.append((batch.column(0)[k].as_py(), n, last, text, start, length))
                held += len(text)
                if held >= BATCH:
                    yield out()
                    held = 0
    if rows:
        yield out()


def format_chat(turns: DataFrame) -> DataFrame:
    """Examples: ``conv_id``, ``example``, ``is_last``, ``text``, and the loss span in code points.

    Defined cases: a null text or role is empty; turns that share a number are ordered by role and text; repeated
    rows are repeated turns; each row with a null ``conv_id`` is a conversation of its own; a null turn number comes first; a conversation
    without assistant turns gives one example without a span; other columns are ignored; an empty
    table gives an empty one. Only the turns of one conversation, which an example must hold anyway, come together.
    """
    row = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
    whole = turns.groupBy("conv_id", _alone()).agg(F.sort_array(F.collect_list("row")).alias("turns"))
    return whole.select("conv_id", "turns").mapInArrow(_format, EXAMPLE)


def _alone() -> Column:
    """A number of its own for each row without a conversation, so that it is grouped with no other."""
    return F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, n, last, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = read_turns(text) if last else ()
            sha = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest() if last else None
            rows.append((conv, n, last, len(turns), sha, unescape(text[start : start + length]), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ_ARROW, strict=True)], schema=_READ_ARROW)


def read_back(examples: DataFrame) -> DataFrame:
    """Of each conversation, from its examples alone: turns, loss text and lengths with digests.

    An example without a ``conv_id`` is all that there is of its conversation.
    """
    read = examples.select("conv_id", "example", "is_last", "text", "loss_start", "loss_length").mapInArrow(_read, _READ)
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    sums = [F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("formatted_chars").alias("formatted_chars"), F.count("*").alias("n_examples")]
    whole = read.groupBy("conv_id", _alone()).agg(*sums)
    out = ["conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"]
    return whole.select(*out)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_chat(turns.unionByName(extra)))


#: Formatted characters are those of the texts and of the escapes, heads and ends of all prefixes.
OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  length(regexp_replace(text, '[\\<#]', 'xx', 'g')) + length(regexp_replace(role, '[\\<#:]', 'xx', 'g')) + 14 AS c FROM t),
p AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM p GROUP BY conv_id
"""
