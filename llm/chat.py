"""Chat formatting of records in many layouts.

A record is JSON. The set of its nested field paths (``messages[].role``) is hashed, and
the hash selects a declarative mapping from those fields to turns: which fields
hold a turn's text, and its role. Canonical turns are then written by one template, with
marks around each turn; the template's marks and other models' control strings are
escaped inside texts, reversibly, so that no text can open or close a turn. The
characters of the assistant's texts form the loss mask.

The formatted text of a conversation is a sequence of pieces, one per turn, that follow
each other without anything between. A conversation of any length is read piece by piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import column

# The template's marks, and control strings that other models react to.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
#: Other names of the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}, key=lambda tail: (-len(tail), tail)))
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")


@dataclass(frozen=True)
class Layout:
    """Turns of one record: (role, text path) in order, or a list of turns.

    ``turns`` are (role, paths): the texts at the paths, those that are there, make one turn,
    joined by line breaks. With ``each``, every element of that list is a turn with its
    role and text at the two paths of ``turns``. An empty ``each`` is the record itself. Without
    ``role`` the elements are texts, of a user and an assistant in turn. ``beside`` are fields
    that may be there too and add nothing: they repeat what the mapping reads, or describe it.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    beside: tuple[str, ...] = ()


# Where fields of two layouts stand together, the one that says more is read: messages before a
# prompt, instructions before a text that renders them.
LAYOUTS = (
    Layout("turn", ("role",), ("text",), each="", role="role", text="text", beside=("context",)),
    Layout("turn_text", ("text",), (), each="", role="role", text="text"),
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), (("system", ("system",)),), "messages", "role", "content", ("prompt", "text")),
    Layout("message_texts", ("messages[]",), ("system",), (("system", ("system",)),), "messages", beside=("prompt", "text")),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", "system"), (("system", ("system",)),), "conversations", "from", "value", ("prompt", "text")),
    Layout("prompt_response", ("prompt",), ("response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), beside=("text",)),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), beside=("text",)),
    Layout("instruction", ("instruction",), ("input", "output", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), beside=("text",)),
    Layout("instruction_context", ("instruction",), ("context", "response", "system"), (("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",))), beside=("text",)),
    Layout("question_answer", ("question", "answer"), ("context", "system"), (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), beside=("text",)),
)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of all fields that hold something; lists add ``[]``. Nulls hold nothing."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return set() if value is None else {at}


def fingerprint(paths) -> int:
    """The hash of a set of field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode())


def _selections() -> dict[int, Layout]:
    found: dict[int, Layout] = {}
    for layout in LAYOUTS:
        others = (*layout.optional, *layout.beside)
        for n in range(len(others) + 1):
            for some in combinations(others, n):
                found.setdefault(fingerprint({*layout.required, *some}), layout)
    return found


SELECTIONS = _selections()
_KNOWN = frozenset(p for layout in LAYOUTS for p in (*layout.required, *layout.optional, *layout.beside))


def layout_of(record) -> Layout | None:
    """The mapping that a record's fields select; fields that no mapping knows are ignored."""
    return SELECTIONS.get(fingerprint(field_paths(record) & _KNOWN))


def _as_text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record) -> list[tuple[str, str]]:
    """Role and text of each turn of a record; none if no mapping is selected."""
    layout = layout_of(record)
    if layout is None:
        return []
    found = []
    for role, paths in layout.turns:
        texts = [_as_text(record[p]) for p in paths if record.get(p) is not None]
        if texts:
            found.append((role, "\n".join(texts)))
    if layout.each is not None:
        for place, item in enumerate(record[layout.each] if layout.each else [record]):
            if layout.each and not layout.role:
                # A null is a turn that is not there; those after it keep their roles.
                if item is not None:
                    found.append((("user", ASSISTANT)[place % 2], _as_text(item)))
            elif isinstance(item, dict):
                role = _as_text(item.get(layout.role))
                found.append((ROLES.get(role, role) if layout.each else role, _as_text(item.get(layout.text))))
    return found


def escape(text: str) -> str:
    """The text with a backslash more behind the first character of each control string."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def piece_of(role: str, text: str) -> tuple[str, int, int]:
    """One turn by the template, and where its loss lies (start and end; -1 without)."""
    head, body = f"{OPEN}{_line(role)}\n", escape(text)
    loss = (len(head), len(head) + len(body)) if role == ASSISTANT else (-1, -1)
    return (f"{head}{body}{CLOSE}", *loss)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn in a formatted text."""
    at = 0
    while at < len(formatted):
        end = formatted.find(CLOSE, at)
        if not formatted.startswith(OPEN, at) or end < 0:
            raise ValueError(f"no turn at character {at}")
        line, _, body = formatted[at + len(OPEN) : end].partition("\n")
        yield _role(line), unescape(body)
        at = end + len(CLOSE)


def _parsed(raw: str | None) -> tuple[object, list[tuple[str, str]]]:
    """The value of a record's text (None if it is no JSON) and its turns."""
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        value = None
    return value, turns_of(value) if isinstance(value, dict) else []


def pieces(df: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """The formatted text of JSON records, in pieces: the keys, ``place`` (the turn's place in
    its record), ``piece``, ``loss_start`` and ``loss_end`` (characters within the piece).

    Text that is no JSON object, and records whose fields select no mapping, have no pieces:
    they are the rows of ``unmapped``.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("place", T.IntegerType()),
            T.StructField("piece", T.StringType()),
            T.StructField("loss_start", T.IntegerType()),
            T.StructField("loss_end", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[], [], [], []]
            for row, raw in enumerate(column(batch, record)):
                for place, turn in enumerate(_parsed(raw)[1]):
                    rows.append(row)
                    for values, item in zip(out, (place, *piece_of(*turn))):
                        values.append(item)
            kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(v, t) for v, t in zip(out, kinds)], names=[*keys, "place", "piece", "loss_start", "loss_end"]
            )

    return df.select(*keys, record).mapInArrow(run, schema)


def unmapped(df: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """The records without pieces: the keys, ``reason``, ``fingerprint`` and ``fields``.

    The reason is ``no record`` (null or empty), ``no object`` (other JSON, or none) or ``no
    layout``. Only the last has a fingerprint, 16 hex digits of all its field paths, and
    these paths in order, one a line. Each row is in ``pieces`` or here.
    """
    names = ("reason", "fingerprint", "fields")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, T.StringType()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, raw in enumerate(column(batch, record)):
                value, turns = _parsed(raw)
                if turns:
                    continue
                rows.append(row)
                if isinstance(value, dict):
                    paths = field_paths(value)
                    out.append(("no layout", f"{fingerprint(paths):016x}", "\n".join(sorted(paths))))
                else:
                    out.append(("no object" if raw else "no record", None, None))
            kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            found = [pa.array([line[i] for line in out], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(kept + found, names=[*keys, *names])

    return df.select(*keys, record).mapInArrow(run, schema)


def unmapped_layouts(df: DataFrame, record: str = "record") -> DataFrame:
    """How many records were left out for each reason and set of fields."""
    return unmapped(df, [], record).groupBy("reason", "fingerprint", "fields").agg(F.count(F.lit(1)).alias("records"))


def formatted(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Key and whole ``formatted`` text, for conversations that fit into a value."""
    line = F.array_sort(F.collect_list(F.struct(*order, "place", "piece")))
    return parts.groupBy(key).agg(F.array_join(F.transform(line, lambda x: x["piece"]), "").alias("formatted"))


def read_back(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What the formatted conversations say, read from their text.

    One row per conversation: the key, n_turns, turns_sha256 (role, line break, text, line
    break per turn), loss_chars and loss_sha256 (the unescaped text under the loss mask)
    and formatted_chars. Turns follow ``order``, nulls first, then their pieces. A
    conversation's pieces pass by in order and only its hashes are held, so its length
    does not matter.
    """
    schema = T.StructType(
        [parts.schema[key]]
        + [
            T.StructField(name, T.StringType() if name.endswith("sha256") else T.LongType())
            for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def close() -> None:
            if state is not None:
                turns, turns_hash, chars, loss_hash, length = state
                out.append((current, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), length))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=schema.names)

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            for k, piece, start, end in zip(*[column(batch, c) for c in (key, "piece", "loss_start", "loss_end")]):
                if state is None or k != current:
                    close()
                    current, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start >= 0:
                    loss = unescape(piece[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(piece)
            if len(out) >= 1000:
                yield batch_of()
                out.clear()
        close()
        yield batch_of()

    ordered = parts.repartition(key).sortWithinPartitions(key, *order, "place", "piece")
    return ordered.select(key, "piece", "loss_start", "loss_end").mapInArrow(run, schema)
