"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string, such
as ``chatml`` here. It is called with the turns up to the first, the second and
so on, and consecutive outputs are compared: if an output begins with the one
before, the turn's span is what was added. If it does not, the template has
rewritten history at that turn; the turn is marked and the conversation is not
used for spans (its formatted text is still the whole output).

Where in its span a turn's text lies is found the same way: the template also
renders the turn with another, made-up text, and what both outputs have in
common at either end frames the text.

Scale: conversations meet by one shuffle on conv_id and are read in order, one
at a time. Every conversation is rendered prefix by prefix, whatever its size, as
only that shows a rewriting that a later turn undoes; for a template that is not
looked into this takes work that grows with the square of a conversation's length.
Who can do without it may set ``PREFIX_CHARS``: a conversation whose prefixes have
more characters of text and which has more than ``SEGMENT`` turns is then rendered
in segments, each after the last turn before it, and the row says in
``checked_prefixes`` that not all prefixes were rendered whole. The whole
conversation is still rendered once and compared with the pieces. Where they
differ, where a segment seems rewritten or where the template fails on one, the
conversation is rendered prefix by prefix from its start.
"""

from __future__ import annotations

import hashlib
import math
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm._scratch import schema

SEGMENT = 64
#: Characters of text in all prefixes of a conversation up to which each is rendered; no bound, so that no result depends on a conversation's size.
PREFIX_CHARS = math.inf
Template = Callable[[list[tuple[str, str]]], str]

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(?=im_start\|>|im_end\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|(?=im_start\|>|im_end\|>)")


def escape(text: str) -> str:
    r"""No control string is left: <|im_end|> becomes <\|im_end|>, <\|im_end|> becomes <\\|im_end|> and so on."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def chatml(turns: list[tuple[str, str]]) -> str:
    """<|im_start|>role, a line end, the text, <|im_end|> and a line end for each turn."""
    return "".join(f"{START}{escape(role)}\n{escape(text)}{END}\n" for role, text in turns)


def _frame(one: str, other: str) -> tuple[int, int]:
    """How many characters two strings share at their start, and at their end beyond that."""
    lead = len(os.path.commonprefix([one, other]))
    return lead, len(os.path.commonprefix([one[lead:][::-1], other[lead:][::-1]]))


def render(turns: list[tuple[str, str]], template: Template = chatml, segment: int = SEGMENT) -> tuple[str, list[dict], int | None]:
    """(formatted text, spans, position of the turn at which history is rewritten or None).

    A span has start and end of the whole turn, and text_start and text_end of
    its text within. Two made-up texts without a common start or end give the
    frame around a turn's text: its lead and tail are the same for any text.
    """
    if checked_prefixes(turns, segment) < len(turns):
        try:
            out, spans, rewritten = _pieces(turns, template, segment)
        except Exception:  # a template may reject a part of a conversation
            out, spans, rewritten = "", [], None
        # A rewriting found in the first segment is one of whole prefixes.
        if rewritten is not None and rewritten < segment or rewritten is None and spans and template(turns) == out:
            return out, spans, rewritten
    return _pieces(turns, template, max(len(turns), 1))


def checked_prefixes(turns: list[tuple[str, str]], segment: int = SEGMENT) -> int:
    """How many prefixes ``render`` shows the template at least: all of them, or those of the first segment."""
    chars = sum((len(turns) - i) * len(text) for i, (_, text) in enumerate(turns))
    return len(turns) if len(turns) <= segment or chars <= PREFIX_CHARS else segment


def _pieces(turns: list[tuple[str, str]], template: Template, segment: int) -> tuple[str, list[dict], int | None]:
    """``render`` with each segment after the first rendered behind the one turn before it; no spans where that turn looks different there."""
    out, spans, first = "", [], 0
    while first < len(turns):
        seen = turns[first - 1 : first] if first else []
        shown = template(seen)
        if seen and not shown.endswith(out[spans[-1]["start"] :]):
            return out, [], None
        cut = len(shown) if seen else 0
        for role, text in turns[first : first + segment]:
            longer, one, two = (template([*seen, (role, t)]) for t in (text, "a", "bb"))
            if not all(x.startswith(shown) for x in (longer, one, two)):
                return template(turns), [], len(spans)
            lead, tail = _frame(one[len(shown) :], two[len(shown) :])
            start, end = (len(out) + len(x) - cut for x in (shown, longer))
            spans.append({"start": start, "end": end, "text_start": start + lead, "text_end": end - tail})
            seen = [*seen, (role, text)]
            shown = longer
        out += shown[cut:]
        first += segment
    return out, spans, None


_SPAN = "array<struct<turn:bigint,role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>>"


def _format(template: Template, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by conversation and turn; one conversation is held at a time."""
        current, numbers, turns = None, [], []
        done: list[tuple] = []
        size = 0

        def close():
            text, spans, rewritten = render(turns, template, segment)
            spans = [{"turn": n, "role": role, **span} for n, (role, _), span in zip(numbers, turns, spans)]
            done.append((current[0], len(turns), text, spans, None if rewritten is None else numbers[rewritten], rewritten is not None, checked_prefixes(turns, segment)))
            return len(text)

        def batch_of(rows):
            span = pa.struct([("turn", pa.int64()), ("role", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end"))])
            kinds = [conv_kind, pa.int64(), pa.string(), pa.list_(span), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "formatted", "spans", "rewritten_at", "rewritten", "checked_prefixes"])

        for batch in batches:
            conv_kind = batch.column(0).type
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (conv,):
                    if current is not None:
                        size += close()
                    current, numbers, turns = (conv,), [], []
                    if size > 4_000_000 or len(done) >= 1000:
                        yield batch_of(done)
                        done, size = [], 0
                numbers.append(turn)
                turns.append((role or "", text or ""))
        if current is not None:
            close()
            yield batch_of(done)

    return run


def format_chats(conversations: DataFrame, template: Template = chatml, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans, rewritten_at (a turn number), rewritten and checked_prefixes (fewer than n_turns if not all were rendered).

    spans hold turn, role, start, end, text_start and text_end, offsets in code
    points of formatted. Turns are taken by turn, null first, then role, then
    text, so ties and repeated rows have one order and all count. A null text
    or role is empty; rows with a null conv_id are one conversation. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    kind = schema([conversations.schema["conv_id"]], f"n_turns bigint, formatted string, spans {_SPAN}, rewritten_at bigint, rewritten boolean, checked_prefixes bigint")
    return rows.mapInArrow(_format(template, segment), kind)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
            turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for span in spans:
                # The role is read from the output too: it stands between the start mark and the text.
                head = text[span["start"] : span["text_start"]]
                role = unescape(head[len(START) : -1])
                said = unescape(text[span["text_start"] : span["text_end"]])
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
            out.append((turns.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = {"turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_turns"), *columns], names=["conv_id", "n_turns", *kinds])


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the text of ``format_chats``: its loss mask covers each assistant text."""
    kind = schema([formatted.schema["conv_id"]], "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return formatted.select("conv_id", "n_turns", "formatted", "spans").mapInArrow(_read_back, kind)


def oracle_sql() -> str:
    """The contract's columns in DuckDB SQL, from the conversations themselves and the template's rule."""
    said = f"{END}{START}assistant ok"
    escaped = r"regexp_replace(text, '<(\\*)\|(im_start\|>|im_end\|>)', '<\\\1|\2', 'g')"
    frame = len(START) + 1 + len(END) + 1
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({frame} + length(role) + length({escaped}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
