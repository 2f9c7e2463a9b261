"""Chat formatting from an event log.

A log holds, per conversation and message, events ordered by a sequence number:

* ``start``  opens the message (``body`` is the role),
* ``delta``  appends ``body``,
* ``edit``   replaces ``cut`` code points at ``at`` by ``body``,
* ``regen``  throws away everything generated so far.

``fold_events`` deals the log out by (conversation, message), sorts each part
by sequence and folds it into final messages, ``render`` marks the turns and
``read_back`` parses the rendered text again.

Hot keys: folding is keyed by message, so a conversation with a third of all
rows is folded by many tasks; only the digests of ``read_back``, which are
sequential by definition, stream one conversation through one task, holding a
single turn at a time.

Defined results: null text or role is empty; a null conversation id is one
conversation of its own; rows repeated in (conversation, turn, role, text) are
all kept; ties in a turn are ordered by the log's message key, or by role and
whole text where ``read_back`` is asked for it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The template's control strings (fixed values).
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
DELTA_CHARS = 64
EVENT_COLUMNS = ("conv_id", "turn", "msg", "copies", "seq", "kind", "at", "cut", "body")
_LIKE_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\Z", re.S)

MESSAGES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("msg", pa.string()), ("copies", pa.int64()),
                      ("role", pa.string()), ("text", pa.string())])
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("msg", pa.string()), ("copies", pa.int64()),
                      ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def escape(text: str) -> str:
    """No control string is left: every ``<\\..\\|`` gets one more backslash."""
    return _LIKE_CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A streaming log that ends in the given rows: every message arrives in
    deltas; an assistant's first draft is regenerated, other roles' first
    delta is mistyped and edited.  Equal rows become one message with a count."""
    rows = (conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                                 text_of("role").alias("role"), text_of("text").alias("text"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")))
    # The key tells the messages of a turn apart and is never as long as the text.
    rows = rows.withColumn("msg", F.concat(F.col("role"), F.lit("\n"), F.substring("text", 1, 64), F.lit("\n"),
                                           F.sha2(F.col("text"), 256)))

    def event(kind, body, at=0, cut=0):
        return F.struct(F.lit(kind).alias("kind"), F.lit(at).cast("bigint").alias("at"),
                        (cut if not isinstance(cut, int) else F.lit(cut)).cast("bigint").alias("cut"),
                        body.alias("body"))

    n = F.char_length("text")
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(delta_chars))).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(starts, lambda s: event("delta", F.col("text").substr(s, F.lit(delta_chars))))
    head = F.substring("text", 1, delta_chars)
    draft = F.array(event("delta", F.reverse(head)), event("regen", F.lit("")))
    typo = F.array(event("delta", F.concat(F.lit("#"), F.reverse(head))),
                   event("edit", F.lit(""), 0, F.char_length(head) + 1))
    log = F.concat(F.array(event("start", F.col("role"))),
                   F.when(F.col("role") == "assistant", draft).otherwise(typo), deltas)
    return (rows.select("conv_id", "turn", "msg", "copies", F.posexplode(log).alias("seq", "e"))
            .select("conv_id", "turn", "msg", "copies", F.col("seq").cast("bigint"), "e.*"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, role, parts, done = None, "", [], []

    def flush():
        out = pa.RecordBatch.from_pylist(done, schema=MESSAGES)
        done.clear()
        return out

    def close():
        if key is not None:
            done.append(dict(zip(("conv_id", "turn", "msg", "copies"), key), role=role, text="".join(parts)))

    for b in batches:
        cols = [b.column(c).to_pylist() for c in EVENT_COLUMNS]
        for conv, turn, msg, copies, _, kind, at, cut, body in zip(*cols):
            if key != (conv, turn, msg, copies):
                close()
                key, role, parts = (conv, turn, msg, copies), "", []
            if kind == "start":
                role = body or ""
            elif kind == "delta":
                parts.append(body or "")
            elif kind == "regen":
                parts = []
            elif kind == "edit":
                whole, at, cut = "".join(parts), max(at or 0, 0), max(cut or 0, 0)
                parts = [whole[:at], body or "", whole[at + cut:]]
        if len(done) >= 2000:
            yield flush()
    close()
    yield flush()


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, msg, copies, role, text) of a log."""
    keys = ["conv_id", "turn", "msg", "copies"]
    return (events.select(*EVENT_COLUMNS).repartition(*keys).sortWithinPartitions(*keys, "seq")
            .mapInArrow(_fold, ddl(MESSAGES)))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One formatted segment per turn; a conversation's text is its segments in
    the order (turn, msg), each ``copies`` times.  ``loss_start`` and
    ``loss_end`` bound, in the segment's code points, what the loss covers."""
    def run(batches):
        for b in batches:
            segs, starts, ends = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                head = f"{TURN_START}{escape_role(role or '')}\n"
                seg = f"{head}{escape(text or '')}{TURN_END}\n"
                on = role == loss_role
                segs.append(seg)
                starts.append(len(head) if on else 0)
                ends.append(len(seg) - len(TURN_END) - 1 if on else 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "turn", "msg", "copies")), pa.array(segs, pa.string()),
                 pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=SEGMENTS)
    return messages.mapInArrow(run, ddl(SEGMENTS))


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = _TURN.match(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape_role(m[1]), unescape(m[2])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, done = object(), None, []

    def close():
        if state:
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for b in batches:
        for conv, copies, seg, lo, hi in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "copies", "segment", "loss_start", "loss_end"))):
            if state is None or conv != current:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(seg)
            loss = unescape(seg[lo:hi])
            turn, masked = f"{role}\n{text}\n".encode("utf-8", "surrogatepass"), loss.encode("utf-8", "surrogatepass")
            for _ in range(copies):
                state[0] += 1
                state[1].update(turn)
                state[2] += len(loss)
                state[3].update(masked)
                state[4] += len(seg)
        if len(done) >= 2000:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, d)) for d in done], schema=DIGEST)
            done = []
    close()
    yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, d)) for d in done], schema=DIGEST)


def said(segment: Column) -> tuple[Column, Column]:
    """(role, text) of a formatted turn, as ``parse_segment`` gives them."""
    def plain(c):
        return F.regexp_replace(c, _ESCAPED.pattern, r"<$1|")
    line = F.instr(segment, "\n")
    role = plain(F.substr(segment, F.lit(len(TURN_START) + 1), line - 1 - len(TURN_START)))
    text = F.substr(segment, line + 1, F.char_length(segment) - line - len(TURN_END) - 1)
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")), plain(text)


def read_back(segments: DataFrame, by_text: bool = False) -> DataFrame:
    """Parse the formatted segments again and digest each conversation.  Ties in
    a turn go by ``msg``, or by role and whole text with ``by_text``."""
    dealt = (segments.select("conv_id", "turn", "msg", "copies", "segment", "loss_start", "loss_end")
             .repartition("conv_id"))
    role, text = said(F.col("segment"))
    ties = [role, text] if by_text else ["msg"]
    return (dealt.sortWithinPartitions("conv_id", "turn", *ties).mapInArrow(_digest, ddl(DIGEST)))
