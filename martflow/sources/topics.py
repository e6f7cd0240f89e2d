"""Topics of JSON text, on Kafka or on files.

A bus has one area per writing job.  On Kafka the area is not used and the
``topic`` column of each row names its topic.  On files the job's rows are
partitioned by topic under the area; the file sink's commit log, or a mark per
micro-batch, keeps a replay from being written again.  Kafka output is
at-least-once.  Readers drop repeats by key (``operators.repeats``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from martflow.operators.parse import once
from martflow.session import file_system

# The area of topics that come from outside.
INTAKE = "intake"

TOPIC_ROW = "value STRING, topic STRING"


@dataclass(frozen=True)
class FileBus:
    """Topics as folders: ``<root>/<job>/topic=<name>/``.

    ``batched_jobs`` write from ``foreachBatch`` into ``batch_id=<n>`` folders
    below that.  A mark, set after the write, keeps a replayed micro-batch from
    writing again; one that was lost before its mark replaces its own folders.
    """

    root: str
    max_files_per_trigger: int | None = None
    batched_jobs: frozenset[str] = frozenset({"base_log", "base_db", "unique_visitor", "order_wide"})

    def _load(self, reader, job: str, topic: str) -> DataFrame:
        if job == INTAKE:
            # Written by others, without a commit log: list this topic's folder only.
            return reader.schema("value STRING").format("text").load(f"{self.root}/{job}/topic={topic}")
        schema = TOPIC_ROW + (", batch_id BIGINT" if job in self.batched_jobs else "")
        rows = reader.schema(schema).format("text").load(f"{self.root}/{job}")
        return rows.filter(F.col("topic") == topic).select("value")

    def read(self, spark: SparkSession, job: str, topic: str, whole: bool = False) -> DataFrame:
        """The topic as a stream; ``whole`` takes in all that is there at once."""
        reader = spark.readStream
        if self.max_files_per_trigger and not whole:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return self._load(reader, job, topic)

    def read_batch(self, spark: SparkSession, job: str, topic: str) -> DataFrame:
        return self._load(spark.read, job, topic)

    def writer(self, rows: DataFrame, job: str) -> DataStreamWriter:
        return (rows.select("value", "topic").writeStream.outputMode("append").format("text")
                .partitionBy("topic").option("path", f"{self.root}/{job}"))

    def write_batch(self, rows: DataFrame, job: str, batch_id: int) -> None:
        # Readers pass over names that begin with an underscore.
        fs, mark = file_system(rows.sparkSession, f"{self.root}/{job}/_written/{batch_id}")
        if fs.exists(mark):
            return
        (rows.select("value", "topic", F.lit(batch_id).alias("batch_id")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("topic", "batch_id")
         .text(f"{self.root}/{job}"))
        fs.create(mark).close()


@dataclass(frozen=True)
class KafkaBus:
    """Topics on a Kafka cluster; needs the Kafka connector on the class path."""

    servers: str
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int | None = None

    def read(self, spark: SparkSession, job: str, topic: str, whole: bool = False) -> DataFrame:
        """The topic as a stream; ``whole`` takes it from its beginning, all at once."""
        reader = (spark.readStream.format("kafka")
                  .option("kafka.bootstrap.servers", self.servers)
                  .option("subscribe", topic)
                  .option("startingOffsets", "earliest" if whole else self.starting_offsets))
        if self.max_offsets_per_trigger and not whole:
            reader = reader.option("maxOffsetsPerTrigger", self.max_offsets_per_trigger)
        return reader.load().select(F.col("value").cast("string").alias("value"))

    def read_batch(self, spark: SparkSession, job: str, topic: str) -> DataFrame:
        rows = (spark.read.format("kafka")
                .option("kafka.bootstrap.servers", self.servers)
                .option("subscribe", topic).load())
        return rows.select(F.col("value").cast("string").alias("value"))

    def writer(self, rows: DataFrame, job: str) -> DataStreamWriter:
        return (rows.select("value", "topic").writeStream.outputMode("append")
                .format("kafka").option("kafka.bootstrap.servers", self.servers))

    def write_batch(self, rows: DataFrame, job: str, batch_id: int) -> None:
        rows.select("value", "topic").write.format("kafka").option("kafka.bootstrap.servers", self.servers).save()


Bus = FileBus | KafkaBus


def in_time_order(rows: DataFrame, time: str, files: int, weight: Column | None = None) -> DataFrame:
    """``rows`` so that a write gives at most ``files`` files, each a stretch of ``time``
    before that of the next by name.  They hold about as many rows, or as much of
    ``weight``, a whole number that counts as 1 if it is null or less."""
    if weight is None:
        return rows.repartitionByRange(files, F.col(time))
    parts = F.sequence(F.lit(1), F.greatest(weight.cast("int"), F.lit(1)))
    spread = rows.select(F.col(time).alias("t"), F.explode(parts))
    ends = spread.agg(F.percentile_approx("t", [i / files for i in range(1, files)], 10_000)).first()[0] or []
    before = F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col(time))
    return rows.repartitionById(files, F.size(before))


def keep_order(spark: SparkSession, folder: str) -> bool:
    """Gives the files of ``folder`` modification times that rise with their names: a file
    stream with ``maxFilesPerTrigger`` takes them in that order.

    False if the file system does not keep the times.  Then take all files at once,
    since rows out of their order could be late.
    """
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        return True
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    if not files:
        return True
    modified = lambda p: fs.getFileStatus(p).getModificationTime()
    first = max(map(modified, files)) - len(files)
    for i, path in enumerate(files):
        fs.setTimes(path, first + i, -1)
    return [modified(p) for p in files] == list(range(first, first + len(files)))


def to_messages(df: DataFrame, topic) -> DataFrame:
    """Rows as ``(value, topic)``; ``topic`` is a name or a column."""
    topic = F.lit(topic) if isinstance(topic, str) else topic
    return df.select(F.to_json(F.struct("*")).alias("value"), topic.alias("topic"))


def with_clock(rows: DataFrame, time: str, watermark: str, idle_s: float | None) -> DataFrame:
    """``rows`` with a watermark on ``time`` that goes on when their topic is idle.

    The watermark follows the newest row, or the clock less ``idle_s`` if that is
    later: a topic that is silent for longer holds no window of a join or union
    open, and a row that comes later still is dropped as late.  For event times that
    follow the clock.  With None the topic's own rows alone move its watermark.
    """
    if idle_s is None:
        return rows.withWatermark(time, watermark)
    clock = rows.sparkSession.readStream.format("rate").load()
    late = F.col("timestamp") - F.make_dt_interval(secs=F.lit(idle_s))
    ticks = clock.select(*[(late if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema],
                         F.lit(True).alias("_tick"))
    timed = rows.withColumn("_tick", F.lit(False)).unionByName(ticks).withWatermark(time, watermark)
    # Spark pushes a filter below the watermark unless it uses the event time.
    return timed.filter(F.when(~F.col("_tick"), F.col(time)).isNotNull()).drop("_tick")


def topic_view(spark: SparkSession, bus: Bus, job: str, topic: str, view: str, schema: str,
               event_time: str, delay: str) -> DataFrame:
    """A topic as a SQL view with a computed event-time column and watermark.

    ``schema`` is the JSON schema, ``event_time`` a SQL expression over it that
    becomes the column ``rowtime``.
    """
    rows = (bus.read(spark, job, topic)
            .select(once(F.from_json("value", schema)).alias("v")).select("v.*")
            .withColumn("rowtime", F.expr(event_time)).withWatermark("rowtime", delay))
    rows.createOrReplaceTempView(view)
    return rows
