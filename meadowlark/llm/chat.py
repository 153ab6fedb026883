"""Chat formatting: heterogeneous records are told apart by the shape of their fields and brought to canonical turns.

A record's fingerprint is a hash of its sorted nested field paths. Each known fingerprint selects a declarative mapping,
a list of places from which roles and texts are taken. Where the hash of all paths is unknown, that of the paths which
mappings name decides, so further fields ride along; then the layout with the most fields that are all there. Canonical turns are written by a template whose control strings
can't occur in escaped texts, so the formatted text can be read back without loss.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_paths(value, path: str = "") -> Iterator[str]:
    """The leaf paths of a parsed record, list items as ``[]``; an empty list or object is a leaf of its own."""
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from field_paths(inner, f"{path}.{key}")
    elif isinstance(value, list) and value:
        for inner in value:
            yield from field_paths(inner, f"{path}[]")
    else:
        yield path


def fingerprint(paths: Iterable[str]) -> str:
    """A hash of the set of field paths; order and repetition don't matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Mapping(NamedTuple):
    """Either ``items`` (a list's field, with the keys of role and text) or ``fields``: (field, role) in turn order.

    ``other_names``: roles may go by ROLE_NAMES. A system field that is empty or absent gives no turn, unless ``always``.
    """

    items: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    other_names: bool = False
    always: bool = False


_MESSAGES = Mapping("messages", "role", "content")
_SHARED = Mapping("conversations", "from", "value", other_names=True)


def _pair(asked: str, told: str) -> Mapping:
    return Mapping(fields=(("system", "system"), (asked, "user"), (told, "assistant")))


#: Field paths of the known layouts and their mappings; a further layout is a further row.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    ((".messages[].role", ".messages[].content"), _MESSAGES),
    ((".messages[].role",), _MESSAGES),
    ((".messages[].content",), _MESSAGES),
    ((".messages",), _MESSAGES),
    ((".conversations[].from", ".conversations[].value"), _SHARED),
    ((".conversations[].from",), _SHARED),
    ((".conversations",), _SHARED),
    ((".instruction", ".input", ".output"), Mapping(fields=(("instruction", "system"), ("input", "user"), ("output", "assistant")), always=True)),
    ((".prompt", ".completion"), _pair("prompt", "completion")),
    ((".prompt", ".response"), _pair("prompt", "response")),
    ((".question", ".answer"), _pair("question", "answer")),
    ((".instruction", ".output"), _pair("instruction", "output")),
)
BY_FINGERPRINT = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}
_NAMED = {path for paths, _ in LAYOUTS for path in paths}
_LISTS = {f".{mapping.items}" for _, mapping in LAYOUTS if mapping.items}

#: Other names of the roles in shared layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def mapping_of(paths: set[str]) -> Mapping | None:
    """The mapping of a record with these field paths; of several that fit, the one that names more, the first listed."""
    # a text may be a list of parts, whose paths lie below its own; a list of turns is only named itself where it is empty
    named = {n for n in _NAMED if n in paths or (n not in _LISTS and any(p.startswith((f"{n}[", f"{n}.")) for p in paths))}
    found = BY_FINGERPRINT.get(fingerprint(paths)) or BY_FINGERPRINT.get(fingerprint(named))
    if found is None:
        fitting = [layout for layout in LAYOUTS if named.issuperset(layout[0])]
        found = max(fitting, key=lambda layout: len(layout[0]))[1] if fitting else None
    return found


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) pairs; null roles and texts count as empty, items that are no objects as texts without a role."""
    if mapping.items is None:
        pairs = [(role, _string(record.get(field))) for field, role in mapping.fields]
        return [(role, text) for role, text in pairs if mapping.always or role != "system" or text]
    listed = record.get(mapping.items) or []
    listed = listed if isinstance(listed, list) else [listed]
    pairs = [(_string(x.get(mapping.role)), _string(x.get(mapping.text))) if isinstance(x, dict) else ("", _string(x)) for x in listed]
    return [(ROLE_NAMES.get(role, role) if mapping.other_names else role, text) for role, text in pairs]


def _string(value) -> str:
    """A text; of a list of parts, their texts one after another; anything else as JSON."""
    if isinstance(value, list) and value:
        return "".join(_string(part["text"] if isinstance(part, dict) and "text" in part else part) for part in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: Column) -> Column:
    """A struct (fingerprint, turns, reason) of a column of JSON records.

    Records that can't be read have null turns and a reason: null record, no JSON, no object, or unknown layout.
    """

    @F.pandas_udf("fingerprint string, turns array<struct<role string, text string>>, reason string")
    def convert(records: pd.Series) -> pd.DataFrame:
        rows = []
        for text in records:
            try:
                parsed = json.loads(text) if text is not None else None
            except ValueError:
                rows.append((None, None, "no JSON"))
                continue
            if not isinstance(parsed, dict):
                rows.append((None, None, "null record" if text is None else "no object"))
                continue
            paths = set(field_paths(parsed))
            mapping = mapping_of(paths)
            pairs = None if mapping is None else [{"role": r, "text": t} for r, t in turns_of(parsed, mapping)]
            rows.append((fingerprint(paths), pairs, "unknown layout" if mapping is None else None))
        return pd.DataFrame(rows, columns=["fingerprint", "turns", "reason"])

    return convert(record)


def escape(text: Column) -> Column:
    """``text`` without ``<``: backslash becomes ``\\0`` and ``<`` becomes ``\\1``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def format_turns(turns: Column) -> Column:
    """``<turn>role<text>text</turn>`` for each turn, all in one string."""
    one = lambda t: F.concat(F.lit("<turn>"), escape(t["role"]), F.lit("<text>"), escape(t["text"]), F.lit("</turn>"))
    return F.array_join(F.transform(turns, one), "")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, texts unescaped: array of (role, text)."""
    marked = F.filter(F.split(formatted, "<turn>"), lambda part: part != "")

    def read(part: Column) -> Column:
        sides = F.split(F.replace(part, F.lit("</turn>"), F.lit("")), "<text>")
        return F.struct(unescape(F.get(sides, F.lit(0))).alias("role"), unescape(F.get(sides, F.lit(1))).alias("text"))

    return F.transform(marked, read)


def loss_spans(formatted: Column) -> Column:
    """Where the loss counts: (start, length) of each assistant's escaped text, in code points from 0."""
    parts = F.filter(F.split(formatted, "<turn>"), lambda part: part != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        head = F.length(F.substring_index(part, "<text>", 1)) + len("<turn><text>")
        body = F.length(part) - head + len("<turn>") - len("</turn>")
        span = F.struct((state["at"] + head).cast("int").alias("start"), body.cast("int").alias("length"))
        spans = F.when(part.startswith("assistant<text>"), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(part) + len("<turn>")).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, step, lambda state: state["spans"])


def conversation_records(rows: DataFrame, varied: bool = False) -> DataFrame:
    """One JSON record per conversation, from rows by turn (ties by role and text).

    In the messages layout, or with ``varied`` in one of several by conv_id, as records from several sources come; the
    turns that are read back are the same. A conversation's turns meet in one task, as its record does in the output; rows
    are never dropped, and texts are taken whole, however long. Further columns and their names don't matter.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    messages = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    if not varied:
        return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
    name = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = F.transform("all", lambda t: F.struct(name(t["role"]).alias("from"), t["content"].alias("value")))
    roles = F.transform("all", lambda t: t["role"])
    text = lambda k: F.get("all", F.lit(k))["content"]
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    record = (
        F.when((kind == 1) & ~F.arrays_overlap(roles, F.array(*[F.lit(x) for x in ROLE_NAMES])), F.to_json(F.struct(shared.alias("conversations"))))
        .when((kind == 2) & (roles == F.array(F.lit("user"), F.lit("assistant"))), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(kind == 3, F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("conversations").alias("source"), messages.alias("messages"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``key``, fingerprint, formatted, reason, unread and loss_spans.

    Records that can't be read keep their row, with a reason and the record as ``unread``; formatted is null for them.
    Only ``key`` and ``record`` are taken from the table, so its further columns and their names don't matter; fields of
    a record that its mapping doesn't name are left out of the formatted text.
    """
    converted = records.select(key, F.col(record).alias("__r"), canonical_turns(F.col(record)).alias("c"))
    formatted = converted.select(
        key, F.col("c.fingerprint").alias("fingerprint"), format_turns(F.col("c.turns")).alias("formatted"),
        F.col("c.reason").alias("reason"), F.when(F.col("c.reason").isNotNull(), F.col("__r")).alias("unread"),
    )
    return formatted.withColumn("loss_spans", loss_spans(F.col("formatted")))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from the formatted strings: turn count, hashes of the turns and of the text under the loss mask."""
    read = formatted.select(
        key,
        "fingerprint",
        F.length("formatted").cast("long").alias("formatted_chars"),
        parse_turns(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss"),
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "fingerprint",
    )
