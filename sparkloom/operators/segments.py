"""Indexes made of segments that are never changed: one of a whole table, and one of each later change to it.

A segment holds the rows of its change and the keys that the change touched, deleted ones included. A row of a segment counts only if no later segment
touched its key. The list of segments is published in versions, as a store's catalog is; it says up to which write of the table it goes. A table
that was replaced, or whose deltas were folded before the index saw them, is indexed anew, as is one with MOST_SEGMENTS segments.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import BUCKET, DELETED, GraphStore, create_file, list_names, read_small

MOST_SEGMENTS = 16
_TRIES = 5


def newest_state(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """(number, state) of the newest complete list."""
    for name in reversed(list_names(spark, f"{root}/state")):
        if text := read_small(spark, f"{root}/state/{name}"):
            return int(name[1:-5]), json.loads(text)
    return 0, None


def segments_of(store: GraphStore, name: str, root: str, write: Callable[[DataFrame, DataFrame | None, str, list[dict]], dict]) -> list[dict]:
    """The segments that together are the table as the store sees it now, made where they are missing.

    ``write(rows, touched keys or None, folder, earlier segments)`` writes a segment and says what to remember of it.
    """
    for _ in range(_TRIES):
        entry = store.entry(name)
        epoch, upto = entry.get("epoch", 0), entry.get("next", 0)
        number, state = newest_state(store.spark, root)
        if state and state["epoch"] == epoch and state["upto"] == upto:
            return state["segments"]
        late = [d for d in entry.get("deltas", []) if state and d["seq"] >= state["upto"]]
        folder = f"{root}/{uuid.uuid4().hex}"
        if state is None or state["epoch"] != epoch or state["upto"] > upto or len(late) != upto - state["upto"] or len(state["segments"]) >= MOST_SEGMENTS:
            if state and state["epoch"] == epoch and state["upto"] > upto:  # a reader of an earlier version: an index of its own, not published
                return [write(store.table(name), None, folder, [])]
            made = [write(store.table(name), None, folder, [])]
        else:
            changes, key = store.changes(name, late), store.keys(name)[0]
            made = [*state["segments"], write(changes.where(~F.col(DELETED)).drop(DELETED, BUCKET), changes.select(F.col(key).alias("key")), folder, state["segments"])]
        if create_file(store.spark, f"{root}/state/v{number + 1:08d}.json", json.dumps({"epoch": epoch, "upto": upto, "segments": made})):
            return made
    return made  # others are faster: what was made is right for this reader all the same


def touched_after(spark: SparkSession, segments: list[dict], number: int) -> DataFrame | None:
    """``key``: what the segments after ``number`` touched; None if nothing."""
    later = [spark.read.parquet(f"{s['folder']}/touched") for s in segments[number + 1 :]]
    return reduce(DataFrame.unionByName, later).distinct() if later else None
