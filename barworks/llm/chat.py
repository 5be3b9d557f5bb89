"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to one string. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what is new is the span of the last
turn. A template whose output for a prefix is not the beginning of its output for the next one
rewrites history, and the turn at which it does is marked.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Control strings of the template below; a backslash escapes them, itself, and colons in roles.
HEAD, END = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def marked_template(turns: list[Turn]) -> str:
    """``### role: text </turn>`` per turn, control strings inside roles and texts escaped."""
    return "".join(f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{END}" for role, text in turns)


def read_turn(piece: str) -> Turn:
    """Role and text from one turn of :func:`marked_template`."""
    head = _ROLE.match(piece)
    if not head or not piece.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(piece[head.end() : -len(END)])


def spans(turns: Iterator[Turn], template: Template) -> Iterator[tuple[int, str, bool]]:
    """(start, piece, rewritten) per turn, from renders of the whole conversation up to it."""
    held: list[Turn] = []
    last = template([])
    for turn in turns:
        held.append(turn)
        now = template(list(held))
        rewritten = not now.startswith(last)
        common = len(last)
        if rewritten:
            common = next((i for i, (a, b) in enumerate(zip(last, now)) if a != b), min(len(last), len(now)))
        yield common, now[common:], rewritten
        last = now


def format_turns(conversations: DataFrame, template: Template = marked_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, pos, role, start, piece, loss, rewritten) per turn.

    ``piece`` is what the turn added to the rendered conversation, ``start`` its first character
    there, ``loss`` whether its text is trained on. Rows of a conversation go by turn (null first),
    ties by role and text; null roles and texts are empty; rows with a null conv_id are one
    conversation; repeated rows are turns of their own. Every prefix is rendered whole, so any
    template and rewrites of any turn are seen, and work grows with the square of a conversation's
    length. Turns stream through a task in order, and it holds those of one conversation.
    An empty table gives an empty result; other columns are ignored.
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "pos", "role", "start", "piece", "loss", "rewritten"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        feed: deque[Turn] = deque()
        step, open_id, pos = None, object(), 0
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))
            for conv, role, text in rows:
                if conv != open_id:
                    open_id, pos = conv, 0
                    step = spans(iter(feed.popleft, None), template)
                feed.append((role, text))
                start, piece, rewritten = next(step)
                out.append((conv, pos, role, start, piece, role in trained, rewritten))
                pos += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    prepared(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    width = max(2, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        formatted, "conv_id long, pos long, role string, start long, piece string, loss boolean, rewritten boolean"
    )


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation, from the output of :func:`format_turns` with its own template:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten).

    Takes the rows as they leave that function, without a shuffle in between: each conversation
    streams through the task that formatted it.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def batch_of(done: list) -> pa.RecordBatch:
            rows = [(s["id"], s["n"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["rewritten"]) for s in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            done = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "piece", "loss", "rewritten")))
            for conv, pos, piece, loss, rewritten in rows:
                if pos == 0:
                    if state:
                        done.append(state)
                    state = {"id": conv, "n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "rewritten": False}
                role, text = read_turn(piece)
                state["n"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
                if loss:
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["size"] += len(piece)
                state["rewritten"] |= rewritten
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([state])

    return turns.mapInArrow(
        digested,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean",
    )
