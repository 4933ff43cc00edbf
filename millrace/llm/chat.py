"""Chat formatting: conversations rendered by a compiled template, with a loss mask.

Rows are dealt by conversation and sorted by turn; a conversation streams through
the template turn by turn and comes out in parts of about ``PART`` characters with
the spans of generated text, so one of any length needs the memory of a turn and a
part.  Texts and roles are escaped so that no control string can stand in them, and
``read_back`` recovers every turn from the formatted text alone.

Defined results: null texts and roles are empty; null conversation ids are one
conversation; null turns come first; rows of one turn are ordered by role and text;
repeated rows are repeated turns; a very long text is one turn, in memory of a constant
times its size; an empty table gives an empty table; extra columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.template import compile_template

PART = 1 << 20
#: Every control string begins with one of the first two; the backslash marks an escape.
_ESCAPE = str.maketrans({"<": "\\l", "[": "\\s", "\\": "\\b"})
_PLAIN = {"\\l": "<", "\\s": "[", "\\b": "\\", "\\g": ">"}
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<<{{ m.role | escape_role }}>>\n{{ m.text | escape }}\n<</>>{% endif %}"
    "{% endfor %}"
)
_TURN = re.compile(r"\[INST\] (?P<user>[^\[<]*) \[/INST\]|<s>(?P<assistant>[^\[<]*)</s>|<<(?P<role>[^\[<>]*)>>\n(?P<text>[^\[<]*)\n<</>>")


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def escape_role(role: str) -> str:
    """As ``escape``; a role ends at an angle bracket, so it holds none of the other kind either."""
    return escape(role).replace(">", "\\g")


FILTERS = {"escape": lambda x: escape(x or ""), "escape_role": lambda x: escape_role(x or "")}


def unescape(text: str) -> str:
    return re.sub(r"\\[lsbg]", lambda m: _PLAIN[m[0]], text)


def turns_of(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation given in pieces."""
    held = ""
    for piece in pieces:
        held += piece
        if len(piece) and held[-1] not in "]>":
            continue
        at = 0
        while m := _TURN.match(held, at):
            yield (unescape(m["role"]), unescape(m["text"])) if m["role"] is not None else next((k, unescape(v)) for k, v in m.groupdict().items() if v is not None)
            at = m.end()
        held = held[at:]
    if held:
        raise ValueError("the formatted text isn't whole")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template, FILTERS)
        ready: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], _SPANS)], ["conv_id", "part", "formatted", "loss"])

        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            part, pieces, spans, length = 0, [], [], 0
            for piece, generated in write(messages=({"role": r or "", "text": t or ""} for _, r, t in rows)):
                if generated and piece:
                    spans.append({"start": length, "end": length + len(piece)})
                pieces.append(piece)
                length += len(piece)
                if length >= PART:
                    ready.append((conv, part, "".join(pieces), spans))
                    yield out()
                    ready, part, pieces, spans, length, size = [], part + 1, [], [], 0, 0
            if length or not part:
                ready.append((conv, part, "".join(pieces), spans))
                size += length
            if size >= PART or len(ready) >= 1000:
                yield out()
                ready, size = [], 0
        if ready:
            yield out()

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, formatted and loss (spans of code points) of every conversation;
    the parts of one follow each other in a partition."""
    named = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_formatter(template), "conv_id long, part long, formatted string, loss array<struct<start:int,end:int>>")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    found: list[tuple] = []
    for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
        loss, size, chars = hashlib.sha256(), 0, 0

        def texts() -> Iterator[str]:
            nonlocal size, chars
            for _, _, text, spans in parts:
                size += len(text)
                for x in spans:
                    own = unescape(text[x["start"] : x["end"]])
                    chars += len(own)
                    loss.update(own.encode())
                yield text

        said, n = hashlib.sha256(), 0
        for role, text in turns_of(texts()):
            said.update(f"{role}\n{text}\n".encode())
            n += 1
        found.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size))
        if len(found) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], _DIGEST)
            found = []
    if found:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], _DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of the turns and of the text under the loss mask, from the formatted text."""
    return formatted.mapInArrow(_reader, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')) as n, length(role) + length(role) - length(regexp_replace(role, '[\\<>\[]', '', 'g')) as r from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(case role when 'user' then n + 15 when 'assistant' then n + 7 else r + n + 11 end)::bigint as formatted_chars
from e group by conv_id
"""
