"""Follow a collection's folder: what was added, changed or went since the last look, by a state for each path.

``poll`` lists the folder (no file is opened), compares the listing with the one before
and appends the differences to a table of sightings. A Structured Streaming query reads
the sightings as they come and keeps, for each path, what it was last known to be; so a
sighting that comes twice, or late, changes nothing. What it emits goes to
``Engine.apply``, which opens just these files. All of it may be repeated after a
failure: sightings by their numbers, a micro-batch by the hashes of bodies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.engine import Engine
from tarn.sources import files

#: A sighting: the number of the look, and the file's moment of change (microseconds) and length, -1 where it is gone.
SIGHTING = "path string, scan long, modified_us long, length long"
CHANGE = "path string, modified_us long, change string"
STATE = "scan long, modified_us long, length long"


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A path's change by its newest sighting against what was known of it; nothing if there is none."""
    newest = max((tuple(int(x) for x in row) for pdf in frames for row in pdf[["scan", "modified_us", "length"]].itertuples(index=False)), default=None)
    known = tuple(state.get) if state.exists else (-1, 0, -1)
    if newest is None or newest[0] < known[0]:
        return
    state.update(newest)
    if newest[1:] == known[1:] or newest[2] < 0 and known[2] < 0:
        return
    change = "gone" if newest[2] < 0 else "added" if known[2] < 0 else "changed"
    yield pd.DataFrame({"path": [key[0]], "modified_us": [newest[1]], "change": [change]})


def changed(sightings: DataFrame) -> DataFrame:
    """path, modified_us, change of a stream of sightings."""
    return sightings.groupBy("path").applyInPandasWithState(step, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def poll(engine: Engine, collection: str, place: str) -> int:
    """Look at the folder once and append what differs from the last look; the look's number. One at a time."""
    spark, c = engine.spark, engine._collections()[collection]
    looks = _numbers(spark, f"{place}/listings")
    last = looks[-1] if looks else 0
    listed = files.listing(spark, c["path"], c["pattern"] or files.PATTERN, c["ignore"]).select("path", F.unix_micros("modified_at").alias("modified_us"), "length")
    listed.write.mode("overwrite").parquet(f"{place}/listings/{last + 1}.tmp")
    now = spark.read.parquet(f"{place}/listings/{last + 1}.tmp")
    before = spark.read.parquet(f"{place}/listings/{last}") if looks else now.limit(0)
    seen = now.join(before, ["path", "modified_us", "length"], "left_anti")
    gone = before.select("path").join(now, "path", "left_anti").select("path", F.lit(0).cast("long").alias("modified_us"), F.lit(-1).cast("long").alias("length"))
    rows = seen.unionByName(gone).select("path", F.lit(last + 1).cast("long").alias("scan"), "modified_us", "length")
    rows.write.mode("append").parquet(f"{place}/sightings")
    # the listing takes its name last: a look that was cut off is made again under the same number
    path, fs = _fs(spark, f"{place}/listings")
    fs.rename(path(f"{place}/listings/{last + 1}.tmp"), path(f"{place}/listings/{last + 1}"))
    for k in looks:
        fs.delete(path(f"{place}/listings/{k}"), True)
    return last + 1


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(at).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, at: str) -> list[int]:
    path, fs = _fs(spark, at)
    names = [x.getPath().getName() for x in fs.listStatus(path(at))] if fs.exists(path(at)) else []
    return sorted(int(n) for n in names if n.isdigit())


def follow(engine: Engine, collection: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Look once and start following; with ``once``, take what was seen and end. Later looks are calls of ``poll`` with the same ``checkpoint``."""
    poll(engine, collection, checkpoint)
    sightings = engine.spark.readStream.schema(SIGHTING).option("cleanSource", "delete").parquet(f"{checkpoint}/sightings")

    def refresh(batch: DataFrame, number: int) -> None:
        events = batch.select("path", F.timestamp_micros("modified_us").alias("modified_at"), "change").persist()
        if not events.isEmpty():
            engine.apply(collection, events)
        events.unpersist()

    writer = changed(sightings).writeStream.outputMode("update").foreachBatch(refresh).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if once else writer).start()
