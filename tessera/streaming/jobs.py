"""Incremental runs as Structured Streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.operators.pruning import attach_slide_size
from tessera.operators.segmentation_scores import contingency
from tessera.operators.stitch import stitch_on_grid
from tessera.session import small_enough, stable_copy

DETECTIONS = (
    "mode int, c int, r int, x0 int, y0 int, x1 int, y1 int, ft int, fb int, fl int, fr int, "
    "inst_id bigint, bx0 int, by0 int, bx1 int, by1 int, slide_id int"
)


TILE_ARRIVALS = "slide_id int, mode int, c int, r int, done_at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class TileArrivals(StatefulProcessor):
    """State of one slide: the tiles seen, and the timer that gives it up for late.

    The tiles of a slide bound its state.  A tile that arrives twice counts once.  A slide is released when its last
    tile is there; one that waits longer than ``patience_ms`` of event time for its next tile is released as late, and
    once more if it is completed after that.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tiles = handle.getMapState("tiles", "mode int, c int, r int", "at bigint")
        self.seen = handle.getValueState("seen", "n bigint, due bigint, complete boolean")

    def handleInputRows(self, key, rows, timerValues):
        known = self.seen.exists()
        n, due, complete = self.seen.get() if known else (0, 0, False)
        expected, latest, arrived = None, 0, {}
        for pdf in rows:
            for tile in pdf.itertuples(index=False):
                expected, latest = int(tile.n_tiles), max(latest, int(tile.done_at.timestamp() * 1000))
                arrived[int(tile.mode), int(tile.c), int(tile.r)] = latest
        if complete or expected is None:
            return
        # the state is a process away: it is read once, and written only for tiles that go on waiting
        before = {tuple(place) for place in self.tiles.keys()} if known else set()
        fresh = {place: at for place, at in arrived.items() if place not in before}
        n += len(fresh)
        if due:
            self.handle.deleteTimer(due)
            due = 0
        complete = n >= expected
        if complete and before:
            self.tiles.clear()
        if not complete:
            for place, at in fresh.items():
                self.tiles.updateValue(place, (at,))
            due = max(latest + self.patience_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
        self.seen.update((n, due, complete))
        if complete:
            yield pd.DataFrame({"slide_id": [key[0]], "tiles": [n], "late": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, _, complete = self.seen.get()
        if not complete:
            self.seen.update((n, 0, False))
            yield pd.DataFrame({"slide_id": [key[0]], "tiles": [n], "late": [True]})

    def close(self) -> None:
        pass


def released_slides(arrivals: DataFrame, layout: DataFrame, patience: str = "1 hour") -> DataFrame:
    """Stream ``slide_id, tiles, late`` of slides whose tiles have all arrived, or that have waited too long.

    ``arrivals`` is a stream of ``TILE_ARRIVALS``; ``layout(slide_id, n_tiles)`` says how many tiles a slide has.
    """
    wait = arrivals.sparkSession.sql(f"select cast(interval {patience} as interval day to second) i").first()["i"]
    known = arrivals.withWatermark("done_at", "0 seconds").join(layout.select("slide_id", F.col("n_tiles").cast("long").alias("n_tiles")), "slide_id")
    return known.groupBy("slide_id").transformWithStateInPandas(
        TileArrivals(int(wait.total_seconds() * 1000)), "slide_id int, tiles bigint, late boolean", "Append", "EventTime"
    )


def stitch_arriving_slides(
    spark: SparkSession,
    detections: str,
    arrivals: str,
    slides: DataFrame,
    layout: DataFrame,
    output: str,
    checkpoint: str,
    pitch: int,
    margin: int = 64,
    patience: str = "1 hour",
    files_at_once: int = 1000,
    packed: bool = False,
) -> StreamingQuery:
    """Stitch each slide once its tiles are there; the stream of finished tiles is all it needs.

    Every tile appends a row to ``arrivals`` after its detections, if any, are in the slide's folder of ``detections``.  A batch
    joins the detections with the slides it releases, whose folders alone are read (dynamic partition pruning); each slide
    has its own output folder with dynamic overwrite, so a batch that is replayed writes the same folders again.  With
    ``packed``, for more slides than a file system likes folders, a batch has one folder, which its replay overwrites;
    ``latest_stitched`` reads each slide from the last batch that has it.  ``detections`` may be packed in either case.
    """
    stream = spark.readStream.schema(TILE_ARRIVALS).option("maxFilesPerTrigger", files_at_once).parquet(arrivals)

    def stitch_batch(batch: DataFrame, epoch: int) -> None:
        ready = batch.select("slide_id", "late").groupBy("slide_id").agg(F.min("late").alias("late"))
        ready = stable_copy(ready)
        if ready.isEmpty():
            return
        ready = F.broadcast(ready) if small_enough(ready) else ready
        rows = batch.sparkSession.read.schema(DETECTIONS).parquet(detections).join(ready, "slide_id")
        stitched = stitch_on_grid(attach_slide_size(rows, slides), pitch, margin)
        if packed:
            stitched.drop("proc_w", "proc_h").write.mode("overwrite").parquet(f"{output}/batch={epoch}")
            return
        (
            stitched.drop("proc_w", "proc_h")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("slide_id")
            .parquet(output)
        )

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # read when the query starts
    try:
        return (
            released_slides(stream, layout, patience)
            .writeStream.foreachBatch(stitch_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def latest_stitched(spark: SparkSession, output: str) -> DataFrame:
    """What ``stitch_arriving_slides`` wrote ``packed``: a slide that was late first counts as it was done again."""
    rows = spark.read.parquet(output)
    last = rows.groupBy("slide_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["slide_id", "batch"], "left_semi").drop("batch")


_COUNTS = "head string, channel int, true int, pred int, n bigint"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    # a version counts once its writer has committed it
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def running_contingency(px: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running (head, channel, true, pred) counts of a pixel stream, kept as versioned tables under ``path``.

    Batch k adds its own counts to the newest version before it and writes version k.  A batch that is replayed after
    a failure starts from the same version and writes the same one, so nothing counts twice; the two newest versions
    are kept.  A version has at most heads x classes^2 rows; a new run starts from a new checkpoint and a new path.
    """
    spark = px.sparkSession

    def merge(batch: DataFrame, k: int) -> None:
        earlier = [v for v in _versions(spark, path) if v < k]
        total = contingency(batch).select("head", F.col("channel").cast("int"), F.col("true").cast("int"), F.col("pred").cast("int"), "n")
        if earlier:
            total = total.unionByName(spark.read.schema(_COUNTS).parquet(f"{path}/v{earlier[-1]}"))
        summed = total.groupBy("head", "channel", "true", "pred").agg(F.sum("n").alias("n"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{path}/v{k}")
        for old in earlier[:-1]:
            _delete(spark, f"{path}/v{old}")

    return px.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_contingency(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of ``running_contingency``; no rows before the first."""
    versions = _versions(spark, path)
    return spark.read.schema(_COUNTS).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], _COUNTS)


def arriving_tables(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Stream over the Parquet files a path or pattern names, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def settle(query: StreamingQuery) -> None:
    """Wait for an available-now query to finish and surface its error."""
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
