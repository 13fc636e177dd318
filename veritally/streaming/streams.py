"""The jobs that follow a stream of records or labelling actions.

Each keeps its checkpoint and its results under one path (or the checkpoint where it is told to).
Run again with the same paths, after an end or a loss, it goes on from where it stopped. Results
are a store of buckets: families of groups (of a few columns, so that a batch of few groups
touches few), each cut in 2 ** depth parts by a hash of the key. A micro-batch writes a new version
of the buckets that it touches, and of every other bucket the version before stays. A bucket that
outgrows ``max_rows`` makes its family twice as fine. A batch that runs twice reads the versions before it
and gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veritally.operators.store import latest_records
from veritally.operators.tasks import run_progress

PLACE = ["family", "depth", "part"]


@dataclass(frozen=True)
class Store:
    """Rows by ``keys`` under a path, in families by ``groups``; ``rollup`` keeps what it makes of each bucket beside it."""

    path: str
    keys: tuple[str, ...]
    groups: tuple[str, ...] = ()
    families: int = 16
    max_rows: int = 1_000_000
    rollup: Callable[[DataFrame], DataFrame] | None = None

    def family(self) -> Column:
        return F.pmod(F.xxhash64(*(self.groups or self.keys)), F.lit(self.families)).cast("int")

    def part(self, depth: Column) -> Column:
        """The low bits of a hash that is not the family's."""
        bits = (F.pow(F.lit(2), depth) - 1).cast("long")
        return F.xxhash64(F.lit("part"), *self.keys).bitwiseAND(bits).cast("int")

    def versions(self, spark: SparkSession, kind: str = "rows", before: int | None = None) -> dict[tuple[int, int, int], list[tuple[int, str]]]:
        """Of each bucket (family, depth, part) its versions in order and their folders: metadata alone."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/v=*/family=*/depth=*/part=*")
        out: dict[tuple[int, int, int], list[tuple[int, str]]] = {}
        for found in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []:
            folder = found.getPath().toString()
            v, *place = (int(x.split("=")[1]) for x in folder.split("/")[-4:])
            if before is None or v < before:
                out.setdefault(tuple(place), []).append((v, folder))
        return {k: sorted(v) for k, v in out.items()}

    @staticmethod
    def depths(versions: dict) -> dict[int, int]:
        """The depth of each family: its finest."""
        out: dict[int, int] = {}
        for family, depth, _ in versions:
            out[family] = max(depth, out.get(family, 0))
        return out

    def newest(self, versions: dict) -> dict[tuple[int, int, int], str]:
        depths = self.depths(versions)
        return {k: v[-1][1] for k, v in versions.items() if k[1] == depths[k[0]]}

    def read(self, spark: SparkSession, schema, kind: str = "rows") -> DataFrame:
        folders = sorted(self.newest(self.versions(spark, kind)).values())
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, n: int, depths: dict[int, int], mode: str) -> None:
        """Each bucket by one task."""
        spark = rows.sparkSession
        of = spark.createDataFrame([(f, depths.get(f, 0)) for f in range(self.families)], "family int, depth int")
        rows = rows.withColumn("family", self.family()).join(F.broadcast(of), "family").withColumn("part", self.part(F.col("depth")))
        rows.repartition(*PLACE).write.mode(mode).partitionBy(*PLACE).parquet(f"{self.path}/rows/v={n}")

    def merge(self, batch: DataFrame, n: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Combine a micro-batch with the buckets that it touches. The last version before it is kept, older ones go."""
        spark, schema = batch.sparkSession, batch.schema
        versions = self.versions(spark, before=n)
        depths, newest = self.depths(versions), self.newest(versions)
        batch = batch.persist()
        of = spark.createDataFrame([(f, depths.get(f, 0)) for f in range(self.families)], "family int, depth int")
        places = batch.withColumn("family", self.family()).join(F.broadcast(of), "family").select("family", "depth", self.part(F.col("depth")).alias("part"))
        touched = [tuple(r) for r in places.distinct().collect()]  # names of buckets, which are max_rows each
        old = [newest[t] for t in touched if t in newest]
        self.write(combine(batch.unionByName(spark.read.schema(schema).parquet(*old)) if old else batch), n, depths, "overwrite")
        batch.unpersist()
        now = {k: v[-1][1] for k, v in self.versions(spark).items() if v[-1][0] == n}
        sizes = spark.read.parquet(f"{self.path}/rows/v={n}").groupBy(*PLACE).count().collect() if now else []
        finer: dict[int, int] = {}
        for r in sizes:
            more = max(0, (-(-r["count"] // self.max_rows) - 1).bit_length())
            finer[r.family] = max(finer.get(r.family, 0), more)
        finer = {f: depths.get(f, 0) + more for f, more in finer.items() if more}
        if finer:  # all of a family, once for each doubling
            whole = [folder for k, folder in (newest | now).items() if k[0] in finer]
            self.write(spark.read.schema(schema).parquet(*whole), n, finer, "append")
        if self.rollup and now:
            written = self.newest(self.versions(spark, before=n + 1))
            new = spark.read.option("basePath", f"{self.path}/rows/v={n}").parquet(*[f for k, f in written.items() if f"/v={n}/" in f])
            self.rollup(new).repartition(*PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(f"{self.path}/rollup/v={n}")
        for kind in ("rows", "rollup"):
            self._prune(spark, kind, n)

    def _prune(self, spark: SparkSession, kind: str, n: int) -> None:
        """Of each bucket the version that batch n read stays, and its own; coarser ones of a family that was split before go."""
        before = self.versions(spark, kind, before=n)
        depths = self.depths(before)
        gone = [x[1] for k, v in before.items() for x in (v if k[1] < depths[k[0]] else v[:-1])]
        for folder in gone:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _finish(writer, checkpoint: str) -> None:
    """Run on all that is there."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def record_rollup(groups: list[str]) -> Callable[[DataFrame], DataFrame]:
    """records, ok and fail of each of ``groups`` in a bucket: the parts of a roll-up that sums give."""

    def of(rows: DataFrame) -> DataFrame:
        good = F.col("error").isNull() & F.col("is_ai_modified").isNotNull()
        return rows.groupBy(*PLACE, *groups).agg(F.count("*").alias("records"), F.count_if(good).alias("ok"), F.count_if(~good).alias("fail"))

    return of


def stream_upsert(records: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str | None = None, groups: list[str] | None = None, **how) -> DataFrame:
    """Latest record per key of a stream, after all that is there. groups (of keys): what a batch has few of. how: fields of ``Store``."""
    columns = [*keys, *[c for c in records.columns if c not in keys]]
    store = Store(path, tuple(keys), tuple(groups or ()), **how)
    combine = lambda rows: latest_records(rows, keys, order).select(*columns)
    _finish(records.select(*columns).writeStream.foreachBatch(lambda batch, n: store.merge(batch, n, combine)), checkpoint or f"{path}/checkpoint")
    return store.read(records.sparkSession, records.select(*columns).schema)


def stream_rollup(records: DataFrame, keys: list[str], order: list[str], groups: list[str], path: str, checkpoint: str | None = None, **how) -> DataFrame:
    """groups, records, ok, fail of the latest records of a stream, kept up batch by batch.

    A batch makes anew the parts of the roll-up that belong to the buckets it touches; the roll-up is their sum.
    """
    stream_upsert(records, keys, order, path, checkpoint, groups, rollup=record_rollup(groups), **how)
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    schema = ", ".join([f"{g} {kinds[g]}" for g in groups] + [f"{c} long" for c in ("records", "ok", "fail")])
    store = Store(path, tuple(keys), tuple(groups), **how)
    return store.read(records.sparkSession, schema, "rollup").groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("records", "ok", "fail")])


def stream_progress(records: DataFrame, by: list[str], path: str, checkpoint: str | None = None) -> DataFrame:
    """ok and fail per group of a stream (and right and accuracy where records have a label), kept by Spark as running
    aggregates: a batch brings the groups that changed."""
    counts = run_progress(records, by).withColumn("_seen", F.lit(0).cast("long"))
    names = [c for c in counts.columns if c not in (*by, "accuracy")]
    store = Store(path, tuple(by), families=1)
    newest = lambda rows: rows.groupBy(*by).agg(F.max_by(F.struct(*names), "_seen").alias("x")).select(*by, "x.*")

    def put(batch: DataFrame, n: int) -> None:
        store.merge(batch.select(*by, *names).withColumn("_seen", F.lit(n).cast("long")), n, newest)

    _finish(counts.writeStream.outputMode("update").foreachBatch(put), checkpoint or f"{path}/checkpoint")
    out = store.read(records.sparkSession, counts.select(*by, *names).schema).drop("_seen")
    return out.withColumn("accuracy", F.try_divide("right", F.col("ok") + F.col("fail"))) if "right" in names else out


class Standing(StatefulProcessor):
    """The stack of a log in keyed state: place -> submit, image -> its place, and the height. An action reads and writes one entry of each."""

    def __init__(self, key: list[str]):
        self.key = key

    def init(self, handle) -> None:
        self.submits = handle.getMapState("submits", "place long", "image_no long, choice string, seq long")
        self.images = handle.getMapState("images", "image_no long", "place long")
        self.height = handle.getValueState("height", "height long, changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        height, changes = self.height.get() if self.height.exists() else (0, 0)
        changed: dict[int, tuple] = {}  # of this batch's images alone: the last change
        actions = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, action, image, choice in zip(actions["seq"], actions["action"], actions["image_no"], actions["choice"], strict=True):
            if action == "undo" and height:
                height, changes = height - 1, changes + 1
                gone = self.submits.getValue((height,))
                self.submits.removeKey((height,))
                self.images.removeKey((gone[0],))
                changed[gone[0]] = (*gone, False, changes)
            elif action == "submit" and not self.images.containsKey((int(image),)):
                choice = None if pd.isna(choice) else choice
                self.submits.updateValue((height,), (int(image), choice, int(seq)))
                self.images.updateValue((int(image),), (height,))
                height, changes = height + 1, changes + 1
                changed[int(image)] = (int(image), choice, int(seq), True, changes)
        self.height.update((height, changes))
        out = pd.DataFrame(list(changed.values()), columns=["image_no", "choice", "seq", "stands", "changes"])
        for i, (name, value) in enumerate(zip(self.key, key, strict=True)):
            out.insert(i, name, value)
        yield out

    def close(self) -> None:
        pass


def stream_human(log: DataFrame, path: str, checkpoint: str | None = None, by: list[str] = ["evaluator"]) -> DataFrame:  # noqa: B006
    """by, image_no, choice, seq: the standing submits of a stream of actions (by, seq, action, image_no, choice).

    Actions of a micro-batch are taken in order of seq. State is kept by Spark per log and entry (RocksDB), and a batch
    emits only the images whose standing it changed, which are merged into the store.
    """
    spark = log.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", image_no long, choice string, seq long, stands boolean, changes long"
    provider, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        acts = log.where("action = 'undo' or (action = 'submit' and image_no is not null)").select(*by, "seq", "action", "image_no", "choice")
        kept = acts.groupBy(*by).transformWithStateInPandas(Standing(by), schema, "Update", "None")
        store = Store(path, (*by, "image_no"), tuple(by))
        latest = lambda rows: latest_records(rows, [*by, "image_no"], ["changes"])
        _finish(kept.writeStream.outputMode("update").foreachBatch(lambda batch, n: store.merge(batch, n, latest)), checkpoint or f"{path}/checkpoint")
    finally:
        spark.conf.set(provider, was) if was else spark.conf.unset(provider)
    return store.read(spark, kept.schema).where("stands").select(*by, "image_no", "choice", "seq")
