"""Chat formatting by schema fingerprint.

A record's nested field paths, those that any mapping knows, sorted and hashed, select a declarative mapping; the mapping makes
canonical turns of it (role, text), and one template writes them. Further fields of a record, such as an id, don't matter. Control strings inside roles and texts are broken up by an escape character,
reversibly, so that the written form can be read back and no text can start or end a turn.

Records are JSON, a layout of its own in each row. Nulls inside records are empty strings, and half surrogates are replaced; a record that is
null, no JSON object, nested too deeply to be read or of an unknown layout (such as a list of turns that are no objects) has no layout, no
turns and an empty text. Rows of the same conversation and turn (ties)
are ordered by role, then text. A null conversation id is a conversation too. Repeated
rows are turns of their own, a text of any length is kept whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied

ESCAPE = "␛"
TURN, END = "<|turn|>", "<|end|>"
#: Strings that mark turns here or in other templates.
CONTROLS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: name, list of turns with the role's and text's field; or single fields by role, joined if a role has several.
MAPPINGS = (
    {"name": "messages/text", "list": "messages", "role": "role", "text": "text"},
    {"name": "messages/content", "list": "messages", "role": "role", "text": "content"},
    {"name": "conversations/from", "list": "conversations", "role": "from", "text": "value", "roles": ROLES},
    {"name": "prompt/response", "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "prompt/completion", "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "system/prompt/response", "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "instruction/output", "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"name": "instruction/input/output", "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "question/answer", "fields": (("user", ("question",)), ("assistant", ("answer",)))},
)


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a record; [] stands for a list's elements."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def _own_paths(mapping: dict) -> list[set[str]]:
    """What a mapping maps: all its fields, or an empty list."""
    if "list" in mapping:
        return [{f"{mapping['list']}[].{mapping['role']}", f"{mapping['list']}[].{mapping['text']}"}, {f"{mapping['list']}[]"}]
    return [{f for _, names in mapping["fields"] for f in names}]


KNOWN = frozenset().union(*(x for m in MAPPINGS for x in _own_paths(m)))


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found & KNOWN)).encode()).hexdigest()[:16]


def fingerprints() -> dict[str, dict]:
    """Mappings by the fingerprint of what they map."""
    out: dict[str, dict] = {}
    for m in MAPPINGS:
        for x in _own_paths(m):
            out.setdefault(fingerprint(x), m)
    return out


def _said(x: object) -> str:
    text = x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def canonical(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "list" in mapping:
        roles = mapping.get("roles", {})
        said = [(_said(t.get(mapping["role"])), _said(t.get(mapping["text"]))) for t in record[mapping["list"]]]
        return [(roles.get(role, role), text) for role, text in said]
    return [(role, "\n\n".join(x for n in names if (x := _said(record.get(n))) or len(names) == 1)) for role, names in mapping["fields"]]


def turns_of(raw: str | None, known: dict[str, dict]) -> tuple[str | None, list[tuple[str, str]]]:
    """A record's layout and turns; none if it can't be read."""
    try:
        record = json.loads(raw) if raw is not None else None
        found = paths(record) if isinstance(record, dict) else set()
        if (mapping := known.get(fingerprint(found))) is None:
            return None, []
        if "list" in mapping and not all(isinstance(t, dict) for t in record[mapping["list"]]):
            return None, []
        return mapping["name"], canonical(record, mapping)
    except (ValueError, RecursionError):
        return None, []


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}{ESCAPE}.{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}(.)", lambda m: {".": "", "n": "\n"}.get(m[1], ESCAPE), text) if ESCAPE in text else text


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of assistants' texts in it: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), ESCAPE + 'n')}\n", escape(text)
        parts += [head, body, f"{END}\n"]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_READ = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def format_chats(records: DataFrame) -> DataFrame:
    """conv_id, layout (mapping's name), formatted, loss (spans of code points in it) for records (conv_id, record JSON)."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = fingerprints()
        for b in batches:
            layouts, texts, loss = [], [], []
            for raw in b.column(1).to_pylist():
                layout, turns = turns_of(raw, known)
                text, spans = write(turns) if layout else ("", [])
                layouts.append(layout)
                texts.append(text)
                loss.append([{"lo": lo, "hi": hi} for lo, hi in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(loss, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["conv_id", "layout", "formatted", "loss"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(tidied(run), "conv_id bigint, layout string, formatted string, loss array<struct<lo: bigint, hi: bigint>>")


def from_rows(rows: DataFrame) -> DataFrame:
    """One record a conversation from rows by turn (conv_id, turn, role, text)."""
    empty = F.lit("")
    said = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(said)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from nothing but their text and loss mask."""
    small_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, learnt = read(text), "".join([unescape(text[x["lo"] : x["hi"]]) for x in loss])
                out.append((len(turns), hexed("".join([f"{r}\n{t}\n" for r, t in turns])), len(learnt), hexed(learnt), len(text)))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))] if out else [b.column(0), *(pa.array([], k) for k in kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(tidied(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return read_back(format_chats(from_rows(rows.unionByName(more))))
