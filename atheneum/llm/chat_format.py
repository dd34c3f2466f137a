"""Chat formatting by schema fingerprints.

Sources hold conversations in many layouts: one row a turn, a prompt with its completion, an instruction with input
and output, lists of messages under various names. A record's fingerprint is the hash of its sorted nested field
paths. It selects a declarative mapping, which says where turns, roles and texts are; a new layout is a new entry of
``MAPPINGS``, not new code. The canonical turns are then written with a template whose control strings are escaped
inside texts, so that the formatted text can be read back exactly, with the characters that carry the training loss.

Cases: null texts and roles are empty; a null turn number comes first; rows of one turn number are ordered by role, then
text; a conversation of any length streams through one task turn by turn, in bounded memory; records whose fingerprint has no mapping raise an
error that shows their paths; null records and those without turns give none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# --- layouts -------------------------------------------------------------------------------------------------------


def field_paths(value: Any, at: str = "") -> set[str]:
    """The paths of all leaves: ``a.b`` for a field, ``a[]`` for the elements of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Mapping(NamedTuple):
    """Where the turns are. ``each``: path of a list of turns with ``role`` and ``text`` in each; without it, the
    ``fields`` are the turns, as pairs of role and the fields whose texts, joined by a blank line, they say. ``rename``: whether
    other names of roles become user and assistant."""

    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: bool = True


ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_LIST = {
    ("messages[].role", "messages[].content"): Mapping("messages", "role", "content"),
    ("messages[].from", "messages[].value"): Mapping("messages", "from", "value"),
    ("conversations[].from", "conversations[].value"): Mapping("conversations", "from", "value"),
    ("conversations[].role", "conversations[].content"): Mapping("conversations", "role", "content"),
    ("dialog.turns[].speaker", "dialog.turns[].text"): Mapping("dialog.turns", "speaker", "text"),
}
_FIELDS = {
    ("prompt", "completion"): Mapping(fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    ("prompt", "response"): Mapping(fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    ("question", "answer"): Mapping(fields=(("user", ("question",)), ("assistant", ("answer",)))),
    ("instruction", "output"): Mapping(fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    ("instruction", "input", "output"): Mapping(fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    ("system", "prompt", "completion"): Mapping(fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
}
#: One row a turn: the role is a field of the record.
TURN_ROW = Mapping(role="role", text="text", rename=False)
MAPPINGS: dict[str, Mapping] = {fingerprint(k): v for k, v in (_LIST | _FIELDS | {("role", "text"): TURN_ROW}).items()}
#: Fields beside a record's turns: they identify it and take no part in its fingerprint.
KEY_FIELDS = ("id", "conv_id", "turn")


def at_path(record: Any, path: str) -> Any:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def turns_of(record: dict | None, mappings: dict[str, Mapping] = MAPPINGS) -> list[tuple[str, str]]:
    """The canonical (role, text) turns of a record."""
    record = {k: v for k, v in (record or {}).items() if k not in KEY_FIELDS}
    if not record:
        return []
    paths = field_paths(record)
    mapping = mappings.get(fingerprint(paths))
    if mapping is None:
        if paths <= {f"{m.each}[]" for m in mappings.values() if m.each}:
            return []
        raise ValueError(f"no mapping for records with the fields {sorted(paths)}")
    if mapping.fields:
        found = [(role, "\n\n".join(t for f in fields if (t := at_path(record, f)))) for role, fields in mapping.fields]
    else:
        each = at_path(record, mapping.each) if mapping.each else [record]
        found = [(x.get(mapping.role), x.get(mapping.text)) for x in each or []]
    return [(ROLES.get(r, r) if mapping.rename else r, t) for r, t in ((r or "", t or "") for r, t in found)]


def canonical_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, turn, role, text) of JSON records of any mapped layout, turns counted from 0."""
    kind = records.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *t) for i, x in zip(batch.column("id").to_pylist(), batch.column("record").to_pylist(), strict=True) for n, t in enumerate(turns_of(json.loads(x) if x else None))]
            ids, n, roles, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(n, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=[id_col, "turn", "role", "text"])

    return records.select(F.col(id_col).alias("id"), F.col(json_col).alias("record")).mapInArrow(tidy(read), f"`{id_col}` {kind}, turn long, role string, text string")


# --- template ------------------------------------------------------------------------------------------------------

OPEN, CLOSE, BEGIN, END, ROLE = "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]"
CONTROLS = (OPEN, CLOSE, BEGIN, END, ROLE)
_ESCAPED = re.compile(r"\\(\\|" + "|".join(map(re.escape, CONTROLS)) + ")")
_TO_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The formatted turn, and the span in it under the loss mask (assistants' texts only)."""
    body = escape(text)
    if role == "user":
        return f"{BEGIN}{OPEN} {body} {CLOSE}{END}", None
    if role == "assistant":
        start = len(BEGIN) + 1
        return f"{BEGIN} {body}{END}", (start, start + len(body))
    return f"{BEGIN}{ROLE}{escape(role)}{ROLE} {body}{END}", None


_CONTROL = re.compile(r"(?:\\(?:\\|" + "|".join(map(re.escape, CONTROLS)) + "))|" + "|".join(map(re.escape, CONTROLS)))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text: a scan over control strings that aren't escaped."""
    turns, begin, marks = [], 0, []
    for m in _CONTROL.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if m[0] == BEGIN:
            begin, marks = m.end(), []
        elif m[0] == END:
            if marks and marks[0][0] == OPEN:
                turns.append(("user", unescape(formatted[marks[0][2] + 1 : marks[1][1] - 1])))
            elif marks:
                turns.append((unescape(formatted[marks[0][2] : marks[1][1]]), unescape(formatted[marks[1][2] + 1 : m.start()])))
            else:
                turns.append(("assistant", unescape(formatted[begin + 1 : m.start()])))
        else:
            marks.append((m[0], m.start(), m.end()))
    return turns


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text) to the same rows with formatted, loss_start and loss_end.

    A conversation's formatted text is its rows' ``formatted`` in the order of turn, role and text, one after the other; the loss span counts
    characters within the row.
    """
    kind = turns.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # Each row is a record in a layout of its own: its fingerprint selects how role and text are read.
                ((role, text),) = turns_of({"role": role, "text": text})
                done.append(format_turn(role, text))
            spans = [x[1] or (None, None) for x in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array([x[0] for x in done], pa.string()), pa.array([x[0] for x in spans], pa.int64()), pa.array([x[1] for x in spans], pa.int64())],
                names=["id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
            )

    rows = turns.select(F.col(id_col).alias("id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(tidy(write), f"id {kind}, turn long, role string, text string, formatted string, loss_start long, loss_end long")
    return made.select(F.col("id").alias(id_col), "turn", "role", "text", "formatted", "loss_start", "loss_end")


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from what ``format_turns`` wrote: turns, digests of turns and of the text under the loss mask, length.

    A digest runs over a whole conversation, so its rows stream through one task, sorted; only running digests are held.
    """
    kind = formatted.schema[id_col].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = object(), None, []

        def close():
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def ready():
            columns = zip(*out, strict=True) if out else [()] * 6
            types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return made

        ids = None
        for batch in batches:
            ids = batch.column("id").type
            for i, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "formatted", "loss_start", "loss_end")), strict=True):
                if i != key or state is None:
                    close()
                    key, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    loss = unescape(text[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield ready()
        close()
        if out:
            yield ready()

    rows = formatted.select(F.col(id_col).alias("id"), "turn", "role", "text", "formatted", "loss_start", "loss_end").repartition("id").sortWithinPartitions(F.col("id"), F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("id", "formatted", "loss_start", "loss_end").mapInArrow(tidy(fold), f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
