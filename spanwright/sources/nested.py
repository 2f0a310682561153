"""Nested records to related flat tables: path-value-ordinal triples, grouped by repeated ancestor, pivoted per group.

A record is walked once in document order. Every leaf gives a triple (path, value, ordinals of the arrays above it);
triples that share their innermost repeated ancestor belong to one table, and those of one array element are one row.
The pivot happens while the record is walked, so a record is held alone and nothing is shuffled. Each row keeps the
record's key, its parent's position and its own.

Defined cases: a null or empty array has no rows; a null element takes its position but is no row; an element without
any value is a row without values; a record that is null or no object gives its root row only if it was an object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import emit, ship

ROWS = "node string, ordinals array<int>, parent_pos int, child_pos int, cells map<string,string>"


def triples(record: object) -> Iterator[tuple[str, object, tuple[int, ...]]]:
    """(path, value, ordinals) of a decoded record in document order; arrays add [] to the path and an ordinal.

    Elements and objects are announced by a triple of their own with the value ..., so that empty ones are seen too.
    """
    stack: list[tuple[str, object, tuple[int, ...]]] = [("", record, ())]
    while stack:
        path, v, at = stack.pop()
        if isinstance(v, dict):
            yield path, ..., at
            stack += [(f"{path}.{k}" if path else k, x, at) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[]", x, (*at, i)) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            yield path, v, at


def _ancestor(path: str) -> str:
    """The innermost repeated ancestor of a path, or '' for the record itself."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""


def pivot(record: object) -> Iterator[tuple[str, tuple[int, ...], dict[str, str]]]:
    """(repeated ancestor, ordinals, cells) of each row of each table of a record, in order of appearance."""
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str]] = {}
    home: dict[str, str] = {}
    for path, v, at in triples(record):
        node = home.get(path)
        if node is None:
            node = home[path] = _ancestor(path)
        cells = rows.setdefault((node, at), {})
        if v is not ...:
            name = path[len(node) :].lstrip(".") or "value"
            cells[name] = v if isinstance(v, str) else json.dumps(v)
    for (node, at), cells in rows.items():
        yield node, at, cells


def _walk(keys: list[str], nodes: set[str] | None, cells: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            idx, out = [], []
            for i, s in enumerate(pdf["record"]):
                if not s:
                    continue
                try:
                    record = json.loads(s)
                except ValueError:
                    continue
                for node, at, c in pivot(record):
                    if nodes is None or node in nodes:
                        idx.append(i)
                        out.append((node, list(at), at[-2] if len(at) > 1 else -1, at[-1] if at else -1, c if cells else {}))
            res = pdf.iloc[idx][keys].reset_index(drop=True)
            for k, name in enumerate(("node", "ordinals", "parent_pos", "child_pos", "cells")):
                res[name] = [o[k] for o in out]
            yield from emit(res)

    return run


def nested_rows(df: DataFrame, keys: dict[str, Column], record: Column, nodes: list[str] | None = None, cells: bool = True) -> DataFrame:
    """All rows of all tables of each record (a struct or JSON text); nodes limits them to some repeated ancestors."""
    ship(df.sparkSession)
    named = [c.alias(n) for n, c in keys.items()]
    kind = df.select(record.alias("r")).schema["r"].dataType
    text = record if isinstance(kind, T.StringType) else F.to_json(record)
    src = df.select(*named, text.alias("record"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "record")
    return src.mapInPandas(_walk(list(keys), None if nodes is None else set(nodes), cells), f"{schema}, {ROWS}")


def table_of(rows: DataFrame, node: str, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """One typed child table: keys, parent_pos, child_pos and the named cells cast to their types (null if uncastable)."""
    return rows.where(F.col("node") == node).select(*keys, "parent_pos", "child_pos", *[F.expr(f"try_cast(cells[{json.dumps(c)}] as {t})").alias(c.replace(".", "_").replace("[]", "")) for c, t in columns.items()])


def flat_tables(df: DataFrame, keys: dict[str, Column], record: Column, tables: dict[str, tuple[str, dict[str, str]]]) -> dict[str, DataFrame]:
    """Named flat tables {name: (node, {cell: type})} of one record column."""
    rows = nested_rows(df, keys, record, [n for n, _ in tables.values()])
    return {name: table_of(rows, node, cols, list(keys)) for name, (node, cols) in tables.items()}


#: A line that starts a block of a rendered prompt: a label in capitals, perhaps blanks, and a colon.
SECTION = r"^[ \t]*[A-Z][A-Z0-9_]*(?:[ _/-][A-Z0-9]+)*[ \t ]*:"


def sections(text: Column) -> Column:
    """ARRAY<STRUCT<label, body>> of the labelled blocks of a text in order; text before the first label is none."""
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)(?=" + SECTION + ")"), lambda b: b.rlike(SECTION))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^([^:]*):", 1)).alias("label"), F.regexp_replace(F.regexp_replace(b, r"^[^:]*:\s*", ""), r"\s+$", "").alias("body")))


def child_positions(openai_chat: DataFrame, generic_log: DataFrame) -> DataFrame:
    """Where each child of the chat and generic records stands: (source_table, row_no, child_kind, parent_pos, child_pos)."""
    key = {"row_no": F.col("row_no")}
    message, choice, call = "request.messages[]", "response.choices[]", "response.choices[].message.tool_calls[]"
    hit, section = "retrieval.hits[]", "input.sections[]"
    kinds = F.create_map(*[F.lit(x) for p in ((message, "message"), (choice, "choice"), (call, "tool_call"), (hit, "hit"), (section, "section")) for x in p])
    slim = F.struct(
        F.struct(F.transform("request.messages", lambda m: F.when(m.isNotNull(), F.struct(m["role"].alias("role")))).alias("messages")).alias("request"),
        F.struct(
            F.transform(
                "response.choices",
                lambda c: F.when(c.isNotNull(), F.struct(c["finish_reason"].alias("finish_reason"), F.struct(F.transform(c["message"]["tool_calls"], lambda t: F.when(t.isNotNull(), F.struct(t["id"].alias("id")))).alias("tool_calls")).alias("message"))),
            ).alias("choices")
        ).alias("response"),
    )
    log = F.struct(
        F.struct(F.transform("retrieval.hits", lambda h: F.when(h.isNotNull(), F.struct(h["doc_id"].alias("doc_id")))).alias("hits")).alias("retrieval"),
        F.struct(F.transform(sections(F.col("input.rendered_prompt")), lambda s: F.struct(s["label"].alias("label"))).alias("sections")).alias("input"),
    )
    chat = nested_rows(openai_chat, key, slim, [message, choice, call], cells=False).withColumn("source_table", F.lit("openai_chat"))
    logs = nested_rows(generic_log, key, log, [hit, section], cells=False).withColumn("source_table", F.lit("generic_log"))
    return chat.unionByName(logs).select("source_table", "row_no", kinds[F.col("node")].alias("child_kind"), "parent_pos", "child_pos")
