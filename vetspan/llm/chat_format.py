"""Chat formatting: a finite-state machine over roles and a declarative template give text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches


@dataclass(frozen=True)
class Turn:
    """How a role's turns are written: opening, text, closing; and whether the text is learnt."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, and the machine: which roles may follow which state (a state is the last role, "" at the start)."""

    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<s>[SYS] ", " [/SYS]"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", " </s>", loss=True)})
    #: Any other role is written with its name.
    other: Turn = Turn("[ROLE] ", " </s>")
    name_end: str = " [/ROLE] "
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]")
    escape: str = "\\"

    def escaped(self, text: str) -> str:
        """Double the escape sign, and put one behind the first character of each control string."""
        doubled = text.replace(self.escape, self.escape * 2)
        return re.sub("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls), lambda m: m[0] + self.escape, doubled)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.S)

    def segments(self, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str, bool]], int]:
        """(role, written text, loss flag) pieces, end to end, and the number of the first turn out of order (-1: none).

        A conversation that ends in another state than a final one is out of order at its length. Turns
        out of order are written as the others are, so no text is lost.
        """
        state, wrong, out = "", -1, []
        for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
            if wrong < 0 and role not in self.follows.get(state, ()):
                wrong = i
            state = role
            turn = self.turns.get(role, self.other)
            out.append((role, turn.opening if role in self.turns else turn.opening + self.escaped(role) + self.name_end, False))
            out.append((role, self.escaped(text), turn.loss))
            out.append((role, turn.closing, False))
        if wrong < 0 and state not in self.final:
            wrong = len(roles)
        return out, wrong

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) turns of a formatted conversation; written texts hold no control string, so the marks are unambiguous."""
        known = [f"{re.escape(t.opening)}(?P<r{i}>.*?){re.escape(t.closing)}" for i, t in enumerate(self.turns.values())]
        named = f"{re.escape(self.other.opening)}(?P<name>.*?){re.escape(self.name_end)}(?P<rest>.*?){re.escape(self.other.closing)}"
        out, at, roles = [], 0, list(self.turns)
        for m in re.compile("|".join([*known, named]), re.S).finditer(formatted):
            if m.start() != at:
                raise ValueError(f"unmarked text at {at}")
            at = m.end()
            which = next((i for i in range(len(roles)) if m[f"r{i}"] is not None), None)
            out.append((roles[which], self.unescaped(m[f"r{which}"])) if which is not None else (self.unescaped(m["name"]), self.unescaped(m["rest"])))
        if at != len(formatted):
            raise ValueError(f"unmarked text at {at}")
        return out


SEGMENT = T.StructType([T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("loss", T.BooleanType())])


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, formatted, segments array<struct<role, start, length, loss>>, valid, first_error, from rows conv_id, turn, role, text.

    start and length count code points of `formatted`. Turns stand in the order of turn; equal turns in
    that of role and text, null turns first, repeated rows stay. Null text and role count as empty, rows
    with a null conv_id are one conversation. A conversation is one row, so it has to fit into a task's
    memory; format_turns has no such bound. An empty table gives no rows; other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("valid", T.BooleanType()), T.StructField("first_error", T.IntegerType())])
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, segments, wrong = [], [], []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                pieces, first = template.segments(roles, texts)
                at, own = 0, []
                for role, text, loss in pieces:
                    own.append({"role": role, "start": at, "length": len(text), "loss": loss})
                    at += len(text)
                formatted.append("".join(p[1] for p in pieces))
                segments.append(own)
                wrong.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(formatted, pa.string()), pa.array(segments, kind), pa.array([w < 0 for w in wrong], pa.bool_()), pa.array([None if w < 0 else w for w in wrong], pa.int32())], schema.names)

    return small_batches(plain).mapInArrow(run, schema)


def read_conversations(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, turns array<struct<role, text>> parsed from `formatted`, loss_text: what stands under the loss flags, unescaped, formatted_chars, valid and first_error; no rows of an empty table."""
    turns = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("turns", turns), T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType()), formatted.schema["valid"], formatted.schema["first_error"]])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, loss = [], []
            texts = batch.column("formatted").to_pylist()
            for text, segments in zip(texts, batch.column("segments").to_pylist(), strict=True):
                found.append([{"role": r, "text": t} for r, t in template.parsed(text)])
                loss.append("".join(template.unescaped(text[s["start"] : s["start"] + s["length"]]) for s in segments if s["loss"]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(found, kind), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("valid"), batch.column("first_error")], schema.names)

    return small_batches(formatted.select("conv_id", "formatted", "segments", "valid", "first_error")).mapInArrow(run, schema)


def format_turns(rows: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, position, written, segments, first_error, valid, from rows conv_id, turn, role, text: one row per turn.

    The turns' `written` end to end are `formatted` of format_conversations, and so are their segments, whose
    start counts from the begin of the conversation. first_error and valid are of the conversation as if it
    ended with the turn. Only the machine's state and the running length are held, so a conversation may
    be of any size; it is one task's, in the order of position.
    """
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("written", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("first_error", T.LongType()), T.StructField("valid", T.BooleanType())])
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, at, place, wrong = object(), "", 0, 0, -1
        for batch in batches:
            places, written, segments, errors = [], [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != own:
                    own, state, at, place, wrong = conv, "", 0, 0, -1
                if wrong < 0 and role not in template.follows.get(state, ()):
                    wrong = place
                pieces, _ = template.segments([role], [text])
                marks = []
                for name, piece, loss in pieces:
                    marks.append({"role": name, "start": at, "length": len(piece), "loss": loss})
                    at += len(piece)
                places.append(place)
                written.append("".join(p[1] for p in pieces))
                segments.append(marks)
                state, place = role, place + 1
                errors.append(wrong if wrong >= 0 else None if state in template.final else place)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(written, pa.string()), pa.array(segments, kind), pa.array(errors, pa.int64()), pa.array([e is None for e in errors], pa.bool_())], schema.names)

    return small_batches(dealt).mapInArrow(run, schema)


def digest_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, first_error of each conversation, parsed from format_turns.

    turns_sha256 is over role, line feed, text, line feed of each turn, loss_sha256 over what stands under
    the loss flags, unescaped; valid and first_error are the machine's after the last turn. `turns` has to
    come from format_turns itself, whose rows stand in order. An empty table gives no rows.
    """
    schema = T.StructType([turns.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("valid", T.BooleanType()), T.StructField("first_error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said, learnt, sums, wrong = None, None, None, [0, 0, 0], None

        def closed() -> tuple:
            return own, sums[0], said.hexdigest(), sums[1], learnt.hexdigest(), sums[2], wrong is None, wrong

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()))], schema.names)

        for batch in batches:
            done, ids = [], batch.schema.field("conv_id").type
            for conv, written, segments, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "written", "segments", "first_error")), strict=True):
                if said is None or conv != own:
                    if said is not None:
                        done.append(closed())
                    own, said, learnt, sums = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, text in template.parsed(written):
                    said.update(f"{role}\n{text}\n".encode())
                    sums[0] += 1
                for s in segments:
                    if s["loss"]:
                        start = s["start"] - segments[0]["start"]
                        text = template.unescaped(written[start : start + s["length"]])
                        learnt.update(text.encode())
                        sums[1] += len(text)
                sums[2] += len(written)
                wrong = error
            if done:
                yield batch_of(done)
        if said is not None:
            yield batch_of([closed()])

    return small_batches(turns.select("conv_id", "written", "segments", "first_error")).mapInArrow(run, schema)
