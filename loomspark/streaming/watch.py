"""Watching source trees and event streams with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, hash): added, changed or removed."""
    met = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def watch_files(spark: SparkSession, root: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Call ``rebuild`` with each batch of new files; ``once`` works off what is there and stops."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    writer = files.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def cooled(rebuild: Callable[[DataFrame, int], None], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """``rebuild`` at most once in ``seconds``: a batch that comes earlier waits, so what changes meanwhile is in the next
    batch and no change is lost."""
    ended: list[float] = []

    def run(batch: DataFrame, number: int) -> None:
        if ended:
            wait(max(0.0, ended[-1] + seconds - clock()))
        rebuild(batch, number)
        ended[:] = [clock()]

    return run


def poll_interval(files: int, quiet_rounds: int = 0) -> float:
    """Seconds to the next look at a tree: 2, 5 or 10 by its size, doubled while nothing changes, 30 at most."""
    base = 2.0 if files < 2_000 else 5.0 if files < 10_000 else 10.0
    return min(30.0, base * 2**quiet_rounds)


def debounced(changes: DataFrame, quiet: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes (ts, path) that a quiet period ends: a session window."""
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("changes")).select("burst.start", "burst.end", "changes")


def severity_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of diagnostics (ts, severity) per window, for streams and tables alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", window).alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "severity", "n")
