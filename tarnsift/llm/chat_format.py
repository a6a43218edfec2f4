"""Chat formatting by schema fingerprints.

A record's nested field paths, those that any mapping knows, are hashed; the hash picks a declarative mapping
that turns the layout (rows of turns, message lists, prompt and response, instruction and output) into turns
(conv_id, seq, role, text). Turns are written one block each, so no conversation is ever one value:

    ### role:\\n  escaped text  \\n</turn>\\n

Inside texts backslash, # and < get a backslash, so neither mark can occur there, and removing it restores
the text. Each block carries the span of its text under the loss mask: the assistant's.

Defined cases: null text or role is empty; turns are ordered by number, then role and text, nulls first; rows
repeated are turns of their own; a null conv_id is a conversation; a table of an unknown layout raises, a JSON record of
one, or that is no JSON object, is a rejected row; an empty list or a null record has no turns; an empty table gives
an empty result; texts may be of any length, one turn is one value; a conversation's turns stream through one task in
order, and only digests are held; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field paths -> mapping. rows: columns of a turn; list: column, role and text field of its structs;
#: fields: (role, path) in order, empty ones left out. names: other spellings of roles.
LAYOUTS: list[dict] = [
    {"paths": ["conv_id", "turn", "role", "text"], "rows": ["turn", "role", "text"]},
    {"paths": ["conv_id", "turn", "from", "value"], "rows": ["turn", "from", "value"], "names": {"human": "user", "gpt": "assistant"}},
    {"paths": ["conv_id", "messages.role", "messages.content"], "list": ["messages", "role", "content"]},
    {"paths": ["conv_id", "conversations.from", "conversations.value"], "list": ["conversations", "from", "value"], "names": {"human": "user", "gpt": "assistant"}},
    {"paths": ["conv_id", "prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["conv_id", "prompt", "completion"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["conv_id", "system", "prompt", "response"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"paths": ["conv_id", "instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    {"paths": ["conv_id", "instruction", "input", "output"], "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
]
KNOWN = {p for layout in LAYOUTS for p in layout["paths"]}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, before: str = "") -> list[str]:
    """Dotted paths of the leaves; array elements have no step of their own."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, before)
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name)]
    return [before]


def value_paths(value, before: str = "") -> list[str]:
    if isinstance(value, list):
        return [p for v in value for p in value_paths(v, before)]
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in value_paths(v, f"{before}.{k}" if before else k)]
    return [before]


def _named(role: Column, layout: dict) -> Column:
    out = F.coalesce(role, F.lit(""))
    for given, name in layout.get("names", {}).items():
        out = F.when(out == given, name).otherwise(out)
    return out


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of a table whose whole schema has one layout."""
    paths = schema_paths(records.schema)
    layout = MAPPINGS.get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no mapping for the layout {sorted(set(paths) & KNOWN)}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if "rows" in layout:
        seq, role, said = layout["rows"]
        return records.select("conv_id", F.col(seq).cast("long").alias("seq"), _named(F.col(role), layout).alias("role"), text(F.col(said)).alias("text"))
    if "list" in layout:
        column, role, said = layout["list"]
        turns = records.select("conv_id", F.posexplode(column).alias("seq", "m"))
        return turns.select("conv_id", F.col("seq").cast("long"), _named(F.col("m")[role], layout).alias("role"), text(F.col("m")[said]).alias("text"))
    made = [F.struct(F.lit(k).cast("long").alias("seq"), F.lit(role).alias("role"), text(F.col(path)).alias("text")) for k, (role, path) in enumerate(layout["fields"])]
    return records.select("conv_id", F.explode(F.filter(F.array(*made), lambda t: t["text"] != "")).alias("t")).select("conv_id", "t.*")


def turns_of(raw: str | None, beside: tuple[str, ...] = ("conv_id",)) -> tuple[list[tuple[int, str, str]], str | None]:
    """(turns, problem) of one JSON object by its own layout; beside: paths that stand in columns of their own."""
    if raw is None or not raw.strip():
        return [], None
    try:
        value = json.loads(raw)
    except ValueError:
        return [], "not JSON"
    if not isinstance(value, dict):
        return [], "not an object"
    said = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    lists = {layout["list"][0] for layout in LAYOUTS if "list" in layout}
    if any(value.get(k) == [] for k in lists):
        return [], None  # no turns: an empty list has no paths to tell its layout by
    paths = value_paths(value)
    layout = MAPPINGS.get(fingerprint([*beside, *paths])) or MAPPINGS.get(fingerprint(["conv_id", *paths]))
    if layout is None:
        return [], "unknown layout"
    names = layout.get("names", {})
    named = lambda x: names.get(x, said(x)) if isinstance(x, str) else said(x)
    if "rows" in layout:
        seq, role, text = layout["rows"]
        return [(int(value.get(seq) or 0), named(value.get(role)), said(value.get(text)))], None
    if "list" in layout:
        top, role, text = layout["list"]
        return [(k, named(m.get(role)), said(m.get(text))) for k, m in enumerate(value[top])], None
    there = [(role, said(value[path])) for role, path in layout["fields"] if value.get(path)]
    return [(k, *turn) for k, turn in enumerate(there)], None


def _read_json(records: DataFrame, column: str, beside: tuple[str, ...]) -> DataFrame:
    @F.pandas_udf("struct<turns:array<struct<seq:long,role:string,text:string>>,problem:string>")
    def read(batch: pd.Series) -> pd.DataFrame:
        found = [turns_of(raw, beside) for raw in batch]
        return pd.DataFrame({"turns": [[{"seq": k, "role": r, "text": t} for k, r, t in turns] for turns, _ in found], "problem": [p for _, p in found]})

    return records.select("*", read.asNondeterministic()(F.col(column)).alias("_read"))


def canonical_turns_of_json(records: DataFrame, column: str, turn: str | None = None) -> DataFrame:
    """(conv_id, seq, role, text) of a column of JSON objects, each with a layout of its own, beside conv_id; with a
    column turn, records are turns in that order. Records without a mapping are left to rejected_json()."""
    rows = _read_json(records, column, ("conv_id", "turn") if turn else ("conv_id",))
    rows = rows.select("conv_id", *([F.col(turn).cast("long").alias("_at")] if turn else []), F.explode("_read.turns").alias("t"))
    seq = F.col("_at") if turn else F.col("t.seq")
    return rows.select("conv_id", seq.alias("seq"), F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def rejected_json(records: DataFrame, column: str) -> DataFrame:
    """The records that canonical_turns_of_json() has no mapping for, with the problem."""
    return _read_json(records, column, ("conv_id",)).filter(F.col("_read.problem").isNotNull()).select(*records.columns, F.col("_read.problem").alias("problem"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq, block, and mask_start, mask_end within the block (equal: no loss)."""
    role = F.replace(F.regexp_replace(F.col("role"), r"([\\#<:])", r"\\$1"), F.lit("\n"), F.lit("\\n"))
    head, body = F.concat(F.lit("### "), role, F.lit(":\n")), escaped(F.col("text"))
    begin = F.length(head)
    return turns.select(
        "conv_id", "seq", F.concat(head, body, F.lit("\n</turn>\n")).alias("block"), begin.alias("mask_start"),
        (begin + F.when(F.col("role") == "assistant", F.length(body)).otherwise(0)).alias("mask_end"),
    )


_UNESCAPE = re.compile(r"\\(.)", re.S)


def parsed(block: str) -> tuple[str, str]:
    """role and text of a block."""
    head, _, body = block.partition("\n")
    role = _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], head[4:-1])
    return role, _UNESCAPE.sub(r"\1", body.removesuffix("\n</turn>\n"))


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from blocks: counts and digests. Rows stream in order, one at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []

        def closed() -> dict:
            return now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()}

        for batch in batches:
            for conv, block, start, end in zip(batch["conv_id"], batch["block"], batch["mask_start"], batch["mask_end"]):
                conv = None if pd.isna(conv) else conv
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        done.append(closed())
                    now = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                role, text = parsed(block)
                now["n_turns"] += 1
                now["turns_sha256"].update(f"{role}\n{text}\n".encode())
                loss = _UNESCAPE.sub(r"\1", block[start:end])
                now["loss_chars"] += len(loss)
                now["loss_sha256"].update(loss.encode())
                now["formatted_chars"] += len(block)
            if done:
                yield pd.DataFrame(done).astype({"conv_id": "Int64"})
                done = []
        if now is not None:
            yield pd.DataFrame([closed()]).astype({"conv_id": "Int64"})

    # turns of one number go by role, then text, as they were before marks were escaped
    bare = lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1")
    head = F.substring_index("block", "\n", 1)
    role = bare(F.replace(F.expr("substr(_head, 5, length(_head) - 5)"), F.lit("\\n"), F.lit("\n")))
    text = bare(F.expr("substr(block, length(_head) + 2, length(block) - length(_head) - 10)"))
    dealt = blocks.repartition("conv_id").withColumn("_head", head).withColumn("_role", role).withColumn("_text", text)
    ordered = dealt.sortWithinPartitions("conv_id", "seq", "_role", "_text")
    return ordered.select("conv_id", "block", "mask_start", "mask_end").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
