"""Rendering nodes and edges as lines, and packing lines into a token budget."""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, CUT = 200, 197
HIDDEN = {"embedding", "_emb_code", "_id", "_label", "_src", "_dst", "_type"}


def estimate_tokens(text: str) -> int:
    return len(text) // 4


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def shorten(text: Column) -> Column:
    return F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, CUT), F.lit("..."))).otherwise(text)


def _value(v: Any) -> str:
    if isinstance(v, str) and len(v) > LONGEST:
        v = v[:CUT] + "..."
    if isinstance(v, (datetime.date, datetime.datetime)):
        v = v.isoformat()
    return json.dumps(v, ensure_ascii=False, default=str)


def node_line(node: str, props: dict[str, Any]) -> str:
    shown = {k: v for k, v in props.items() if v is not None and k not in HIDDEN and k != "_source"}
    body = f" {{{', '.join(f'{k}: {_value(v)}' for k, v in shown.items())}}}" if shown else ""
    return node + body + (f" [source: {props['_source']}]" if props.get("_source") else "")


def edge_line(src: str, kind: str, dst: str, props: dict[str, Any] | None = None) -> str:
    shown = {k: v for k, v in (props or {}).items() if v is not None and k not in HIDDEN}
    return f"{src} -[{kind}{' {' + ', '.join(f'{k}: {_value(v)}' for k, v in shown.items()) + '}' if shown else ''}]-> {dst}"


def pack(lines: list[str], budget: int | None = None, has_nodes: bool | None = None) -> tuple[str, bool]:
    """The text of all lines that fit, in order; a line too long is skipped and later ones may still fit. (text, whether any was left out)"""
    budget = budget or 2000
    text, left_out = "", False
    for line in lines:
        longer = text + "\n" + line if text else line
        if budget > 0 and estimate_tokens(longer) <= budget:
            text = longer
        else:
            left_out = True
    return text, left_out


def rendered_nodes(df: DataFrame, label: str, key: str) -> DataFrame:
    """``node_id``, ``line`` of every row, rendered by the executors for exports of whole tables."""
    shown = [c for c in df.columns if c not in HIDDEN and c != "_source"]
    def one(c: str) -> Column:
        value = shorten(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ": "), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)))
    body = F.array_join(F.array_compact(F.array(*map(one, shown))), ", ")
    source = F.when(F.col("_source").isNotNull(), F.concat(F.lit(" [source: "), "_source", F.lit("]"))).otherwise("") if "_source" in df.columns else F.lit("")
    ident = F.concat(F.lit(label + ":"), F.col(key).cast("string"))
    return df.select(ident.alias("node_id"), F.concat(ident, F.lit(" {"), body, F.lit("}"), source).alias("line"))
