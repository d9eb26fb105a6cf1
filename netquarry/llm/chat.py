"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The formatter renders
successive prefixes of a conversation and compares consecutive outputs: what the next render adds is
that turn's span. A render that does not begin with the one before has rewritten history; the
conversation is then marked ``rewrites`` and the first changed position is kept, since masks made
from earlier spans would be wrong there. Within a span, the turn's text is located by rendering the
same prefix with another text in the last turn: the common prefix and suffix are the template's own.

Conversations are streamed in order within sorted partitions, never collected. A template that
declares ``context`` (how many turns before a turn can change its rendering) is restarted every
``WINDOW`` turns on its declared context, so a conversation of n turns costs O(n * WINDOW) and memory
for WINDOW turns; the output is then several parts, in order, which concatenate to the full string.
A template without ``context`` is rendered whole, which is quadratic in the turns.

Defined cases: rows of a conversation are ordered by turn (null first), then role, then text, so
repeated rows and ties are turns of their own; null text or role is empty; rows with a null conv_id
are one conversation; very long texts are rendered and escaped whole; rows that a table of op3 already
has for conversation -7 are turns of the one that the query adds; an empty table gives no rows; extra columns, also with clashing names, are
ignored. One conversation's ordered digest is sequential by definition, so one task streams it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Turns rendered together before the context is restarted.
WINDOW = 32
#: Characters of a finished part, so that no output row grows with its conversation.
PART_CHARS = 1 << 20
PARTS = "conv_id long, part long, formatted string, starts array<long>, ends array<long>, text_starts array<long>, text_ends array<long>, loss array<boolean>, rewrites boolean, changed_at long, last boolean"

Turns = list[tuple[str, str]]

OPEN, END = "### ", " </turn>\n"
_COLON = "\\:"  # a colon inside a role
_TURN = re.compile(r"((?:[^\\:]|\\.)*): (.*)", re.DOTALL)


def escape(text: str) -> str:
    """Reversible: a backslash goes before each backslash, ``#`` and ``<``, so no text holds a control string."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    out, at = [], 0
    while (slash := text.find("\\", at)) >= 0:
        out += (text[at:slash], text[slash + 1 : slash + 2])
        at = slash + 2
    return "".join(out) + text[at:]


@dataclass(frozen=True)
class Template:
    """render: turns to a string. context: turns before a turn that its rendering can depend on (None: all)."""

    render: Callable[[Turns], str]
    context: int | None = None

    def __call__(self, turns: Turns) -> str:
        return self.render(turns)


def _marked(turns: Turns) -> str:
    return "<chat>\n" + "".join(f"{OPEN}{escape(role).replace(':', _COLON)}: {escape(text)}{END}" for role, text in turns)


#: Marks turns as ``### role: text </turn>`` below one header line.
MARKED = Template(_marked, context=0)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving (slices compare fast)."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _text_span(template: Template, turns: Turns, before: int, now: str) -> tuple[int, int]:
    """Where the last turn's text lies in ``now``: probes with empty and one-letter texts show the template's own tail and head."""
    role = turns[-1][0]
    empty = template([*turns[:-1], (role, "")])
    if not turns[-1][1] or empty == now:
        at = max(before, _common(empty, template([*turns[:-1], (role, "x")])))
        return at, at
    a, b = template([*turns[:-1], (role, "a")]), template([*turns[:-1], (role, "b")])
    start = max(before, _common(a, b))
    tail = len(a) - start - 1
    return start, len(now) - tail


def render_turns(template: Template, turns: Turns, skip: int = 0):
    """(start, end, text start, text end) of each turn after the first ``skip``, the full string, and where history was first rewritten (None: nowhere)."""
    now = template(turns[:skip])
    spans, changed = [], None
    for k in range(skip, len(turns)):
        after = template(turns[: k + 1])
        same = _common(now, after)
        if same < len(now) and changed is None:
            changed = same
        start = min(same, len(now))
        spans.append((start, len(after), *_text_span(template, turns[: k + 1], start, after)))
        now = after
    return spans, now, changed


def _parts(template: Template, loss_roles: frozenset[str], rows):
    """rows: (conv_id, role, text) in order. Yields PARTS as dicts, streaming."""
    for conv_id, last, first_part, context, turns in _windows(template, rows):
        spans, whole, changed = render_turns(template, [*context, *turns], len(context))
        begin = 0 if first_part == 0 else len(template(context))
        whole = whole[begin:]
        starts, ends, t0, t1 = ([s[k] - begin for s in spans] for k in range(4))
        yield {
            "conv_id": conv_id, "part": first_part, "formatted": whole, "starts": starts, "ends": ends, "text_starts": t0, "text_ends": t1,
            "loss": [role in loss_roles for role, _ in turns], "rewrites": changed is not None, "changed_at": None if changed is None else changed - begin, "last": last,
        }


def _windows(template: Template, rows):
    """(conv_id, last, part, context, turns): windows of each conversation in turn; one window if the template declares no context."""
    held, at, part, context, size = [], None, 0, [], 0
    for conv_id, role, text in rows:
        if at is None or at[0] != conv_id:
            if held:
                yield at[0], True, part, context, held
            held, at, part, context, size = [], (conv_id,), 0, [], 0
        elif template.context is not None and (len(held) >= WINDOW or size >= PART_CHARS):
            yield at[0], False, part, context, held
            context = [*context, *held][-template.context :] if template.context else []
            held, part, size = [], part + 1, 0
        held.append((role or "", text or ""))
        size += len(text or "")
    if held:
        yield at[0], True, part, context, held


def _ordered(conversations: DataFrame) -> DataFrame:
    return conversations.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _flush(rows: list[dict]):
    import pyarrow as pa

    kinds = {"starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "text_starts": pa.list_(pa.int64()), "text_ends": pa.list_(pa.int64()), "loss": pa.list_(pa.bool_()), "conv_id": pa.int64(), "part": pa.int64(), "changed_at": pa.int64(), "formatted": pa.string(), "rewrites": pa.bool_(), "last": pa.bool_()}
    names = [c.split()[0] for c in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)


def format_chats(conversations: DataFrame, template: Template = MARKED, loss_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """PARTS: the formatted strings with each turn's span, its text's span and its loss flag, in order within partitions. Offsets are code points of the part."""
    roles = frozenset(loss_roles)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)

        out, size = [], 0
        for part in _parts(template, roles, rows()):
            out.append(part)
            size += len(part["formatted"])
            if size >= 4 << 20:
                yield _flush(out)
                out, size = [], 0
        if out:
            yield _flush(out)

    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).withColumn("conv_id", F.col("conv_id").cast("long"))
    return _ordered(rows).select("conv_id", "role", "text").mapInArrow(run, PARTS)


def _read_turns(formatted: str, starts, ends):
    for a, b in zip(starts, ends, strict=True):
        span = formatted[a:b]
        opened = span.find(OPEN)
        if opened < 0 or not span.endswith(END):
            raise ValueError(f"not a marked turn: {span[:80]!r}")
        body = span[opened + len(OPEN) : -len(END)]
        role, text = _TURN.fullmatch(body).groups()
        yield unescape(role), unescape(text)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of MARKED output, from the formatted strings and spans alone; the parts of a conversation follow each other in their partition."""

    def run(batches):
        import pyarrow as pa

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rewrites": False}

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        state = fresh()
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                for role, text in _read_turns(p["formatted"], p["starts"], p["ends"]):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                for a, b, masked in zip(p["text_starts"], p["text_ends"], p["loss"], strict=True):
                    if masked:
                        text = unescape(p["formatted"][a:b])
                        state["loss"].update(text.encode())
                        state["loss_chars"] += len(text)
                state["chars"] += len(p["formatted"])
                state["rewrites"] |= p["rewrites"]
                if p["last"]:
                    rows.append((p["conv_id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"]))
                    state = fresh()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


HARD = r"\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("turn", F.col("turn").cast("long"))
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(hard)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^:]', '', 'g')) AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(escaped + 15) AS BIGINT) AS formatted_chars,
  false AS rewrites
FROM e GROUP BY conv_id
"""
