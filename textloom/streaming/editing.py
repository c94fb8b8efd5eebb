"""Editing as streams: autosave after a quiet time, and the life of suggestions. Each has a batch twin.

Events are rows (doc_id, ts timestamp, ...). Watermarks are ours: the product has a timer instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

QUIET = "600 milliseconds"
#: What an action makes of a suggestion; an edit by the user clears all that are pending, one by the program does not.
RESULTS = {"accept": "accepted", "dismiss": "dismissed", "add": "pending"}


def autosaves(events: DataFrame, quiet: str = QUIET, late: str = "10 minutes") -> DataFrame:
    """doc_id, saved_at, content, edits: a save for each session of edits with no gap of `quiet`, with the latest
    content. Works on streams (append mode: a save appears once the watermark has passed it) and on tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("doc_id", F.session_window("ts", quiet).alias("w")).agg(F.max_by("content", F.struct("ts", "content")).alias("content"), F.count("*").alias("edits")).select("doc_id", F.col("w.end").alias("saved_at"), "content", "edits")


def autosaves_by_gaps(events: DataFrame, quiet_seconds: float) -> DataFrame:
    """The same of a table, by gaps between neighbouring events: a session ends where the next event is `quiet_seconds`
    away or more."""
    w = Window.partitionBy("doc_id").orderBy("ts", "content")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = lambda c: F.unix_micros(c)
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap >= int(quiet_seconds * 1_000_000)), 1).otherwise(0)).withColumn("_s", F.sum("_new").over(w))
    return rows.groupBy("doc_id", "_s").agg(F.max_by("content", F.struct("ts", "content")).alias("content"), F.count("*").alias("edits"), F.max("ts").alias("last")).select("doc_id", "last", "content", "edits")


def lifecycle(events: DataFrame) -> DataFrame:
    """doc_id, sugg_id, status after all events (doc_id, seq, action, sugg_id) of a table.

    add, accept and dismiss act on a suggestion; clear (an edit by the user, or a new analysis) drops all that the
    document has. Actions on suggestions that are gone or decided do nothing, so the first decision after the last
    addition counts.
    """
    clears = events.where("action = 'clear'").groupBy("doc_id").agg(F.max("seq").alias("_clear"))
    live = events.where("sugg_id is not null").join(clears, "doc_id", "left").where("_clear is null or seq > _clear")
    added = live.where("action = 'add'").groupBy("doc_id", "sugg_id").agg(F.max("seq").alias("_add"))
    decided = live.where("action in ('accept', 'dismiss')").join(added, ["doc_id", "sugg_id"]).where("seq > _add").groupBy("doc_id", "sugg_id").agg(F.min_by("action", "seq").alias("action"))
    out = added.join(decided, ["doc_id", "sugg_id"], "left")
    return out.select("doc_id", "sugg_id", F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "dismiss", "dismissed").otherwise("pending").alias("status"))


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """doc_id, sugg_id, status, seq: each change of a suggestion's state, as events stream in; the state of a document is
    its suggestions. A document's events count in the order of seq within a batch."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, stats = state.get if state.exists else ([], [])
        now = dict(zip(ids, stats))
        out: list[tuple[Any, ...]] = []
        rows = pd.concat(list(frames)).sort_values(["seq"], kind="stable")
        for seq, action, sugg in zip(rows["seq"], rows["action"], rows["sugg_id"]):
            if action == "clear":
                out += [(key[0], s, "cleared", seq) for s in now]
                now = {}
            elif action == "add":
                now[sugg] = "pending"
                out.append((key[0], sugg, "pending", seq))
            elif now.get(sugg) == "pending" and action in RESULTS:
                now[sugg] = RESULTS[action]
                out.append((key[0], sugg, now[sugg], seq))
        state.update((list(now), list(now.values())))
        yield pd.DataFrame(out, columns=["doc_id", "sugg_id", "status", "seq"])

    return events.select("doc_id", "seq", "action", "sugg_id").groupBy("doc_id").applyInPandasWithState(
        step, "doc_id long, sugg_id string, status string, seq long", "ids array<string>, stats array<string>", "append", GroupStateTimeout.NoTimeout)


def active_suggestion(events: DataFrame) -> DataFrame:
    """doc_id, active: the suggestion last selected (action `select`), unless it was decided or cleared since."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    last = events.where("action in ('select', 'accept', 'dismiss', 'clear')").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select("doc_id", F.when(F.col("action") == "select", F.col("sugg_id")).alias("active"))


def progress(status: DataFrame) -> DataFrame:
    """Events `loading:NN%` and the like as state and percent."""
    return status.select("*", F.substring_index("event", ":", 1).alias("state"), F.regexp_extract("event", r":(\d+)%", 1).try_cast("int").alias("percent"))
