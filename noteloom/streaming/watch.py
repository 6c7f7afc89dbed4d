"""Change capture: ignore rules, debounce by sessions, and collapse of bursts; the same for batches and streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEBOUNCE, BURST = "500 milliseconds", 200


def glob_regex(pattern: str) -> str:
    """fnmatch without flags: a star crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def accepted(path: Column, patterns: list[str] = ()) -> Column:
    """Markdown files that no rule hides: dot names never; a pattern hides a name, a folder, a whole path or any part of one."""
    parts = F.split(path, "/")
    ok = F.lower(path).endswith(".md") & ~F.exists(parts, lambda p: p.startswith("."))
    for pattern in patterns:
        regex = glob_regex(pattern.strip("/"))
        ok = ok & ~path.rlike(regex) & ~F.exists(parts, _like(regex))
    return ok


def _like(regex: str):
    return lambda part: part.rlike(regex)


#: Slots of one gap that a block of a batch's sessions has at most, and groups that a session's paths are counted in.
SLOTS, GROUPS = 4096, 256


def debounced(events: DataFrame, gap: str = DEBOUNCE, burst: int = BURST) -> DataFrame:
    """events (root, ts, path, dropped) as batches (root, start, end, kind, n_paths, paths): a batch ends when nothing came for the gap.

    A batch of ``burst`` paths or more, or one with a dropped buffer, is ``bulk`` and names no paths.
    """
    if events.isStreaming:
        grouped = events.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.collect_set("path").alias("paths"), F.max("dropped").alias("dropped"))
        grouped = grouped.select("root", "w.start", "w.end", "dropped", F.size("paths").alias("n_paths"), "paths")
    else:
        grouped = _sessions(events, gap, burst)
    bulk = F.col("dropped") | (F.col("n_paths") >= burst)
    return grouped.select("root", "start", "end", F.when(bulk, "bulk").otherwise("changed").alias("kind"), "n_paths", F.when(bulk, F.array().cast("array<string>")).otherwise(F.array_sort("paths")).alias("paths"))


def _sessions(events: DataFrame, gap: str, burst: int) -> DataFrame:
    """(root, start, end, dropped, n_paths, paths) of a batch's sessions; paths may be without some where they number burst or more.

    No task holds or sorts a session: events of one slot, as wide as the gap, are of one session, so only slots are put in order, each block
    of them by itself and the blocks by their ends. What a session holds is counted path by path.
    """
    wait = F.expr(f"interval {gap}")
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + wait)
    floor = lambda x, step: x - F.pmod(x, step)
    each = events.filter("ts is not null").select("root", "path", "dropped", F.unix_micros("ts").alias("at")).withColumn("slot", floor(F.col("at"), width))
    inside = W.partitionBy("root", "block").orderBy("slot")
    slots = each.groupBy("root", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last")).withColumn("block", floor(F.col("slot"), width * SLOTS))
    slots = slots.withColumn("opened", F.when(F.col("first") - F.lag("last").over(inside) > width, F.col("first")))
    blocks = slots.groupBy("root", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("opened").alias("opened"))
    along = W.partitionBy("root").orderBy("block")
    late = F.lag("last").over(along)
    blocks = blocks.withColumn("own", F.when(late.isNull() | (F.col("first") - late > width), F.col("first")))
    open_ = F.last(F.coalesce("opened", "own"), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(F.col("root").alias("r"), F.col("block").alias("b"), F.coalesce("own", open_).alias("open"))
    slots = slots.withColumn("opened", F.last("opened", ignorenulls=True).over(inside)).join(blocks, F.col("root").eqNullSafe(F.col("r")) & (F.col("block") == F.col("b")))
    slots = slots.select("r", F.col("slot").alias("s"), F.coalesce("opened", "open").alias("start"))
    placed = each.join(slots, F.col("root").eqNullSafe(F.col("r")) & (F.col("slot") == F.col("s")))
    paths = placed.groupBy("root", "start", "path").agg(F.max("dropped").alias("dropped"), F.max("at").alias("last"))
    few = paths.groupBy("root", "start", F.pmod(F.xxhash64("path"), F.lit(GROUPS))).agg(F.max("dropped").alias("dropped"), F.max("last").alias("last"), F.count("path").alias("n"), F.collect_list("path").alias("paths"))
    some = F.when((F.col("n") < burst) & ~F.coalesce("dropped", F.lit(False)), F.col("paths"))
    found = few.groupBy("root", "start").agg(F.max("dropped").alias("dropped"), F.max("last").alias("last"), F.sum("n").cast("int").alias("n_paths"), F.flatten(F.collect_list(some)).alias("paths"))
    return found.select("root", F.timestamp_micros("start").alias("start"), (F.timestamp_micros("last") + wait).alias("end"), "dropped", "n_paths", "paths")


def stream(events: DataFrame, gap: str = DEBOUNCE, burst: int = BURST, late: str = "1 second") -> DataFrame:
    """debounced() over a stream; ts must be a timestamp."""
    return debounced(events.withWatermark("ts", late), gap, burst)


def dispatch(batches: DataFrame, act, checkpoint: str, **trigger):
    """A running query that hands each batch of stream() on: act(kind, paths), once for each root's batch in order of its end.

    Paths number fewer than a burst, and bulk batches name none, so what comes to the driver is bounded by the number of batches.
    """

    def each(df: DataFrame, _: int) -> None:
        for r in df.orderBy("end", "root").select("kind", "paths").toLocalIterator():
            act(r.kind, list(r.paths))

    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"processingTime": "1 second"})).start()
