"""Chat formatting: records of any known layout become turns, turns become marked training text with a loss mask.

A record is a JSON object. The nested paths of its fields that hold something are hashed: that fingerprint selects a
mapping, a declaration of where turns stand, so each layout is looked at once per task and all its other records follow
from the hash. Turns are written as

    <|im_start|>role, line feed, text, <|im_end|>, line feed

with control strings inside roles and texts escaped, so that the formatted text reads back to the same turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacloud.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
PART = 4 << 20      # code points from which on a formatted conversation goes on in a further part


@dataclass(frozen=True)
class Messages:
    """Turns are the objects of the array at path (the record itself where path is empty)."""
    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=lambda: ROLES)

    def needs(self) -> set[str]:
        return {f"{self.path}[].{self.role}"} if self.path else {self.role}

    def turns(self, record: dict) -> list[tuple[str, str]]:
        items = _value(record, self.path) if self.path else [record]
        return [(self.roles.get(_text(m.get(self.role)), _text(m.get(self.role))), _text(m.get(self.text))) for m in items if isinstance(m, dict)]


@dataclass(frozen=True)
class Fields:
    """Turns are single fields: (role, paths) each, the paths' texts joined by an empty line; absent turns are left out
    unless all of their record's turns are needed."""
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    needed: tuple[str, ...]

    def needs(self) -> set[str]:
        return set(self.needed)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out = []
        for role, paths in self.parts:
            found = [_text(v) for p in paths if (v := _value(record, p)) is not None]
            if found:
                out.append((role, "\n\n".join(found)))
        return out


#: Layouts by name; of several that fit a record the one that needs most paths is taken, then the first.
MAPPINGS = {
    "messages": Messages("messages", "role", "content"),
    "conversations": Messages("conversations", "from", "value"),
    "turn": Messages("", "role", "text", {}),
    "instruction": Fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("instruction", "output")),
    "prompt_completion": Fields((("user", ("prompt",)), ("assistant", ("completion",))), ("prompt", "completion")),
    "prompt_response": Fields((("system", ("system_prompt",)), ("user", ("prompt",)), ("assistant", ("response",))), ("prompt", "response")),
    "question_answer": Fields((("user", ("context", "question")), ("assistant", ("answer",))), ("question", "answer")),
}


def _text(value: object) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # no lone surrogates


def _value(record: object, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def field_paths(record: object) -> set[str]:
    """Nested paths of all fields that are not null: a.b for objects, a[].b for objects in arrays."""
    paths, open_ = set(), [("", record)]
    while open_:
        at, value = open_.pop()
        if isinstance(value, dict):
            open_ += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list):
            open_ += [(at + "[]", v) for v in value]
        if at and value is not None:
            paths.add(at)
    return paths


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def mapping_of(paths: set[str], mappings: dict) -> str | None:
    """The name of the mapping whose paths are all there, the one with most of them."""
    fits = [name for name, m in mappings.items() if m.needs() <= paths]
    return max(fits, key=lambda name: len(mappings[name].needs()), default=None)


def to_turns(records: DataFrame, record: str = "record", mappings: dict | None = None) -> DataFrame:
    """One row per turn of each record: the other columns of records, and layout (the mapping's name), fingerprint,
    place (from 0 in the record), role, text.

    A record that is null, no JSON object, of no known layout or without turns gives one row with null place, role and
    text, so no record is lost; layout and fingerprint are null where nothing was found. Null texts and roles become
    empty ones, numbers and objects in their place their JSON. Columns of the added names are replaced; repeated rows
    give repeated turns; an empty table gives an empty one. No rows move."""
    mappings = MAPPINGS if mappings is None else mappings
    added = {"layout": pa.string(), "fingerprint": pa.string(), "place": pa.int64(), "role": pa.string(), "text": pa.string()}
    columns = [c for c in records.columns if c not in {*added, record}]
    schema = records.select(columns).schema
    for name in added:
        schema = schema.add(name, "long" if name == "place" else "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in slices(batches, column=record):
            rows, new = [], []
            for i, source in enumerate(batch.column(record).to_pylist()):
                value = _parsed(source)
                paths = field_paths(value) if value is not None else set()
                mark = fingerprint(paths) if paths else None
                if mark not in known:
                    known[mark] = mapping_of(paths, mappings)
                layout = known[mark]
                turns = mappings[layout].turns(value) if layout else []
                for place, (role, text) in enumerate(turns):
                    rows.append(i)
                    new.append((layout, mark, place, role, text))
                if not turns:
                    rows.append(i)
                    new.append((layout, mark, None, None, None))
            kept = batch.select(columns).take(pa.array(rows, pa.int64())) if columns else None
            yield pa.record_batch([*(kept.columns if kept else ()), *(pa.array([n[k] for n in new], t) for k, t in enumerate(added.values()))],
                                  names=[*columns, *added])

    return records.select(*columns, record).mapInArrow(run, schema)


def _parsed(source: str | None) -> dict | None:
    try:
        value = json.loads(source) if source else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Every <| gets a backslash between, one more where there are some: no control string is left."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: DataFrame, key: str = "conv_id", order: Sequence[str] = ("turn",), learn: Sequence[str] = ("assistant",),
                 part: int = PART) -> DataFrame:
    """Conversations as marked text: (key, part, text, loss), a conversation's parts in order in one partition.

    turns has key, the order columns, role and text. loss is an array of (start, stop) code points of text that training
    learns: the escaped texts of the roles in learn, without marks. Turns go by the order columns, nulls first, then
    role and text; repeated rows are repeated turns; a null key is a conversation of its own; null role and text are
    empty; an empty table gives an empty one. Rows move once, by key, and stream through sorted: a task holds one part
    (a single turn is never cut), however many rows one conversation has. That one conversation's rows stay in one
    task, since its text is one sequence."""
    order = [c for c in order if c != key]
    wanted = turns.select(key, *order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = wanted.repartition(key).sortWithinPartitions(key, *order, "role", "text")
    schema = turns.select(key).schema.add("part", "long").add("text", "string").add("loss", T.ArrayType(T.StructType().add("start", "long").add("stop", "long")))
    learned = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, size, pieces, loss = _NONE, 0, 0, [], []
        done: list[tuple] = []
        held = 0
        for batch in batches:
            for who, role, text in zip(*(batch.column(c).to_pylist() for c in (key, "role", "text")), strict=True):
                if pieces and (who != now or size >= part):
                    done.append((now, number, "".join(pieces), loss))
                    held += size
                    number, size, pieces, loss = number + 1, 0, [], []
                    if held >= part:
                        yield _parts(done, key, _kind(batch, key))
                        done, held = [], 0
                if who != now:
                    now, number = who, 0
                head, body = f"{START}{_escape_role(role)}\n", escape(text)
                if role in learned:
                    loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
                pieces += [head, body, END, "\n"]
                size += len(head) + len(body) + len(END) + 1
        if pieces:
            done.append((now, number, "".join(pieces), loss))
        if done:
            yield _parts(done, key, _kind(batch, key))

    return sorted_.select(key, "role", "text").mapInArrow(run, schema)


_NONE = object()
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _kind(batch: pa.RecordBatch, key: str) -> pa.DataType:
    return batch.schema.field(key).type


def _parts(done: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    who, number, text, loss = zip(*done, strict=True)
    return pa.record_batch([pa.array(who, kind), pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array(loss, _LOSS)],
                           names=[key, "part", "text", "loss"])


def read_part(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of formatted text."""
    turns = []
    for piece in text.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((_unescape_role(role), unescape(rest[:-len(END) - 1])))
    return turns


def digests(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """What formatted conversations say, read back from their text and loss mask: key, n_turns, turns_sha256 (of role,
    line feed, text, line feed per turn), loss_chars, loss_sha256 (of all unescaped text under the mask) and
    formatted_chars, in code points.

    parts comes from format_turns: the parts of a conversation follow each other in one partition. Hashes run on from
    part to part, so a task holds one part at a time."""
    schema = parts.select(key).schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add(
        "loss_sha256", "string").add("formatted_chars", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = _NONE, None
        for batch in batches:
            out = []
            for who, text, loss in zip(*(batch.column(c).to_pylist() for c in (key, "text", "loss")), strict=True):
                if state is None or who != now:
                    if state is not None:
                        out.append(state.row(now))
                    now, state = who, _Digest()
                state.add(text, loss)
            if out:
                yield _table(out, names, _kind(batch, key))
        if state is not None:
            yield _table([state.row(now)], names, _kind(batch, key))

    return parts.select(key, "text", "loss").mapInArrow(run, schema)


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.learned, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in read_part(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescape(text[span["start"]:span["stop"]])
            self.learned += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)

    def row(self, who: object) -> tuple:
        return who, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def _table(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
