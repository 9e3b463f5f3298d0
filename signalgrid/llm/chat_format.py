"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts. The sorted set of its nested field
paths (array positions left out) is hashed to a fingerprint; the fingerprint selects a
declarative mapping, which turns the record into canonical turns (role, text). A template
writes the turns as one string; control strings inside roles and texts are escaped, so
the string reads back to the same turns. Spans of the assistant's texts form the loss mask.

Null texts and roles are empty. Turns are ordered by number, then role and text, so ties and
repeated rows have one order. A conversation is one record: it is one row of work.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths; elements of an array share the path `[]`."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            out |= paths_of(v, f"{prefix}.{k}" if prefix else k)
        return out or {prefix}
    if isinstance(value, list):
        out = {f"{prefix}[]"}
        for v in value:
            if isinstance(v, dict | list):
                out |= paths_of(v, f"{prefix}[]")
        return out
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of messages, or single fields in a fixed order."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # (role, path); fields of one role in sequence are joined by a blank line
    roles: tuple[tuple[str, str], ...] = ()  # names of roles in the layout -> canonical names


#: Known layouts (fixed values).
LAYOUTS: tuple[Mapping, ...] = (
    Mapping(("messages[]", "messages[].role", "messages[].content"), messages="messages", role="role", text="content"),
    Mapping(("conversations[]", "conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping(("prompt", "completion"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), ("input", "system"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("data.question", "data.answer"), fields=(("user", "data.question"), ("assistant", "data.answer"))),
)


def _registry(layouts: tuple[Mapping, ...]) -> dict[str, Mapping]:
    """Fingerprints of every layout, with each choice of its optional fields; lists may also be empty."""
    out = {}
    for m in layouts:
        for bits in range(1 << len(m.optional)):
            out[fingerprint({*m.required, *(p for i, p in enumerate(m.optional) if bits >> i & 1)})] = m
        if m.messages:
            out[fingerprint({f"{m.messages}[]"})] = m
    return out


def canonical(record: dict, registry: dict[str, Mapping]) -> list[tuple[str, str]] | None:
    """Turns of a record, None for an unknown layout. Fields other than those of the layout make it unknown,
    but for `id`, which every layout may have. So do values of other types than the layout's: messages are
    objects, roles and texts are strings or null (null: empty)."""
    m = registry.get(fingerprint(paths_of({k: v for k, v in record.items() if k != "id"})))
    if m is None:
        return None
    if m.messages:
        names = dict(m.roles)
        if not all(isinstance(x, dict) and isinstance(x.get(f), str | None) for x in record[m.messages] for f in (m.role, m.text)):
            return None
        return [(names.get(x.get(m.role) or "", x.get(m.role) or ""), x.get(m.text) or "") for x in record[m.messages]]
    turns: list[tuple[str, str]] = []
    for role, path in m.fields:
        value = record
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if not isinstance(value, str | None):
            return None
        if path not in m.required and value is None:
            continue
        if turns and turns[-1][0] == role and path not in m.required:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{value}" if value else turns[-1][1])
        else:
            turns.append((role, value or ""))
    return turns


@dataclass(frozen=True)
class Template:
    """Each turn is open + role + mid + text + close. Escapes write the characters that begin a
    control string as the escape character and a letter, so none can occur inside a text."""

    begin: str = "<s>"
    open: str = "[INST]"
    mid: str = "[/INST]"
    close: str = "</s>"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))

    def escape(self, text: str) -> str:
        for plain, coded in self.escapes:
            text = text.replace(plain, coded)
        return text

    def unescape(self, text: str) -> str:
        plain = {coded: p for p, coded in self.escapes}
        return re.sub(r"\\.", lambda m: plain[m[0]], text, flags=re.S)

    def write(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted string, and the spans of it that carry loss."""
        parts, at, mask = [self.begin], len(self.begin), []
        for role, text in turns:
            head, body = f"{self.open}{self.escape(role)}{self.mid}", self.escape(text)
            if role == LOSS_ROLE:
                mask.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.close]
            at += len(head) + len(body) + len(self.close)
        return "".join(parts), mask

    def read(self, formatted: str) -> list[tuple[str, str]]:
        turn = re.compile(f"{re.escape(self.open)}([^<\\[]*){re.escape(self.mid)}([^<\\[]*){re.escape(self.close)}")
        at, turns = len(self.begin), []
        while at < len(formatted):
            m = turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns


def format_records(records: DataFrame, template: Template = Template(), layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """From (conv_id, record as JSON): conv_id, layout (fingerprint), formatted, loss spans.

    Unknown layouts and broken JSON give a null `formatted`, with the fingerprint to look them up by."""
    registry = _registry(layouts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, texts, spans = [], [], []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                turns = canonical(record, registry) if isinstance(record, dict) else None
                marks.append(fingerprint(paths_of({k: v for k, v in record.items() if k != "id"})) if isinstance(record, dict) else None)
                text, mask = template.write(turns) if turns is not None else (None, None)
                texts.append(text)
                spans.append(mask if mask is None else [{"begin": a, "end": b} for a, b in mask])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(texts, pa.string()), pa.array(spans, kind)],
                                             ["conv_id", "layout", "formatted", "loss"])

    return records.select(F.col("conv_id").cast("bigint"), "record").mapInArrow(
        kernel, "conv_id bigint, layout string, formatted string, loss array<struct<begin:bigint,end:bigint>>")


def as_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation, in the layout that fits its roles: a user and an assistant row
    become prompt and completion, with a system row before them instruction and output; longer ones are
    lists of messages (odd ids with the names from and value)."""
    turns = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    # All turns of a conversation are one output row by definition; nothing else is grouped.
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.get("t", F.lit(i))["text"]
    named = F.when(F.col("r") == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))).when(
        F.col("r") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))).when(
        (F.col("conv_id") % 2 != 0) & ~F.exists("t", lambda x: x["role"].isin("human", "gpt")),
        F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations")))).otherwise(
        F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    return grouped.withColumn("r", roles).select("conv_id", named.alias("record"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted strings and loss spans say."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, chars, loss_sha, size = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = template.read(text) if text is not None else []
                loss = "".join(template.unescape(text[s["begin"]: s["end"]]) for s in spans or ())
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                size.append(len(text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()),
                 pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        kernel, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("p")).select("p.*")
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
    return read_back(format_records(as_records(rows)))
