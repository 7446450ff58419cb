"""References to records that do not exist, tracked incrementally.

The state is a folder of append-only tables: the parent index (each key with the times from and until which a
record with it lives, one folder per month in which a life ends), the references by bucket of their key, and
the log of events, whose last event of each reference tells the pending orphans. A batch changes it so: new
references probe the parents that are still alive; parents that arrive at a key without a living one resolve
the references that wait there; the end of the last living parent reopens them. A batch writes its own
rows and events and rewrites nothing; parents whose life ended before it are not read, nor, as the join is
on the bucket too, references of buckets in which nothing turns. No group is collected, and AQE may split
the partition of a hot key, as the joins allow that on the reference's side.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.storage import shared_folder, side_by_side

REF = ["ref_id", "scope", "key", "at"]
PARENT = ["scope", "key", "since", "until"]


NEVER = "9999-12"


@dataclass(frozen=True)
class Orphans:
    """The state after a batch: where it lies, its key types, and the time up to which it is known."""

    folder: str
    types: tuple[str, str, str]
    until: dt.datetime | None = None
    buckets: int = 8

    def _read(self, name: str, schema: str) -> DataFrame | None:
        spark = SparkSession.active()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def _ref(self) -> str:
        ref, scope, key = self.types
        return f"ref_id {ref}, scope {scope}, key {key}, at timestamp_ntz"

    @property
    def parents(self) -> DataFrame | None:
        return self._read("parents", f"scope {self.types[1]}, key {self.types[2]}, since timestamp_ntz, until timestamp_ntz, ends string")

    @property
    def refs(self) -> DataFrame | None:
        return self._read("refs", f"{self._ref}, bucket int")

    @property
    def log(self) -> DataFrame:
        """One row per event (opened, resolved, reopened) of a reference."""
        schema = f"{self._ref}, event string"
        found = self._read("log", schema)
        return found if found is not None else SparkSession.active().createDataFrame([], schema)

    @property
    def pending(self) -> DataFrame:
        """References without a living parent, as known at ``until``, and since when."""
        last = self.log.groupBy("ref_id", "scope", "key").agg(F.max("at").alias("at"), F.max_by("event", "at").alias("event"))
        return last.where("event <> 'resolved'").drop("event")


def empty(refs: DataFrame, folder: str | None = None, buckets: int = 8) -> Orphans:
    """A state before all batches, for references of these key types; below the shared folder if none is given."""
    own = folder or f"{shared_folder(refs.sparkSession).rstrip('/')}/orphans-{uuid.uuid4().hex}"
    return Orphans(own, tuple(refs.schema[c].dataType.simpleString() for c in REF[:3]), None, buckets)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("scope", "key"), F.lit(buckets)).cast("int")


def unmatched(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a parent of their scope and key that lives at the time ``at``.

    A parent lives from ``since`` (inclusive) until ``until`` (exclusive; null: for ever). References with
    a null scope or key match nothing; a null ``at`` can't be placed in time and matches nothing either.
    """
    p = parents.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), "since", "until")
    lives = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return refs.join(p, (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k")) & lives, "left_anti")


def turns(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scope, key, turn``: the times at which keys get a living parent, and at which they lose the last one.

    A parent that follows at the very end of another leaves no gap; one that ends before it starts never lives.
    """
    lived = parents.where((F.col("until").isNull() | (F.col("until") > F.col("since"))) & F.col("scope").isNotNull() & F.col("key").isNotNull())
    p = lived.select(F.col("scope").alias("_s"), F.col("key").alias("_k"), F.col("since").alias("_a"), F.col("until").alias("_b"))
    same = (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k"))
    just_before = (F.col("_a") < F.col("turn")) & (F.col("_b").isNull() | (F.col("_b") >= F.col("turn")))
    then = (F.col("_a") <= F.col("turn")) & (F.col("_b").isNull() | (F.col("_b") > F.col("turn")))
    starts = lived.select("scope", "key", F.col("since").alias("turn")).distinct().join(p, same & just_before, "left_anti")
    ends = lived.where("until is not null").select("scope", "key", F.col("until").alias("turn")).distinct().join(p, same & then, "left_anti")
    return starts, ends


def advance(state: Orphans, refs: DataFrame, parents: DataFrame, until: dt.datetime | None = None) -> Orphans:
    """The state after a batch of new references and parents, as known at ``until`` (null: at the end).

    Batches must come in order of time: references and parents of a batch carry times at or before
    ``until`` and after that of the batch before; ``until`` of a parent may lie in the future. A record
    that is delivered again counts at its earliest time. The log has an opening at a reference's own time,
    and after it every time at which its key gets a living parent (resolved) or loses the last one
    (reopened), so that any split into batches gives the same log.
    """
    stamp = lambda t: F.lit(t.isoformat()).cast("timestamp_ntz")  # noqa: E731, as text, so that no time zone comes in
    month = lambda c: F.date_format(c, "yyyy-MM")
    known = state.refs
    refs = refs.groupBy("ref_id", "scope", "key").agg(F.min("at").alias("at")).withColumn("bucket", _bucket(state.buckets))
    if known is not None:
        r, k = refs.alias("r"), known.alias("k")
        refs = r.join(k, reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*REF[:3], "bucket"]]), "left_anti")
    parents = parents.groupBy("scope", "key", "until").agg(F.min("since").alias("since")).select(*PARENT)
    parents = parents.withColumn("ends", F.coalesce(month("until"), F.lit(NEVER)))
    new = f"batch={uuid.uuid4().hex}"
    side_by_side(
        lambda: refs.repartition("bucket").write.partitionBy("bucket").parquet(f"{state.folder}/refs/{new}"),
        lambda: parents.repartition(F.col("ends"), F.pmod(F.hash("scope", "key"), F.lit(8))).write.partitionBy("ends").parquet(f"{state.folder}/parents/{new}"),
    )
    own_refs, every = refs, state.refs
    index = state.parents
    if state.until is not None:
        index = index.where(F.col("ends") >= state.until.strftime("%Y-%m"))  # the dead before this batch matter no more
        own_refs = every.where(F.col("at") > stamp(state.until))
    opened = unmatched(own_refs if state.until is not None else every, index).select(*REF)
    now = stamp(until or dt.datetime(9999, 12, 31))
    new_turn = (F.col("turn") <= now) & (F.col("turn") > stamp(state.until) if state.until is not None else F.lit(True))

    def turned(at: DataFrame) -> DataFrame:
        t = at.where(new_turn).withColumn("bucket", _bucket(state.buckets)).select(F.col("scope").alias("_s"), F.col("key").alias("_k"), "turn", F.col("bucket").alias("_b"))
        met = every.join(t, (F.col("bucket") == F.col("_b")) & (F.col("scope") == F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("turn") > F.col("at")))
        return met.select("ref_id", "scope", "key", F.col("turn").alias("at"))

    resolved, reopened = map(turned, turns(index))
    event = lambda df, name: df.select("ref_id", "scope", "key", "at", F.lit(name).alias("event"))
    log = event(opened, "opened").unionByName(event(resolved, "resolved")).unionByName(event(reopened, "reopened")).distinct()
    log.write.parquet(f"{state.folder}/log/{new}")
    return replace(state, until=until)


def replay(refs: DataFrame, parents: DataFrame, step: str = "month", most: int | None = None) -> Orphans:
    """The state after a history that is loaded batch by batch, one for each ``step`` of time, or, if there are
    more than ``most``, for as many steps in a row as make that number of batches.

    Times of references and starts of parents place a row in its batch; rows without one are left out. The
    history is cut into batches by one write of each table, so that each batch reads its own rows only.
    """
    spark = refs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}"
    place = lambda c: F.date_format(F.date_trunc(step, F.col(c).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("step")

    def cut(name: str, df: DataFrame, at: str) -> None:
        # a third of all rows may be of one step, so rows of a step go to several tasks
        own = df.where(F.col(at).isNotNull()).select("*", place(at))
        own.repartition(F.col("step"), F.pmod(F.hash("scope", "key"), F.lit(8))).write.partitionBy("step").parquet(f"{folder}/{name}")

    side_by_side(lambda: cut("new-refs", refs.select(*REF), "at"), lambda: cut("new-parents", parents.select(*PARENT), "since"))
    schema = {"new-refs": refs.select(*REF).schema, "new-parents": parents.select(*PARENT).schema}
    read = {n: spark.read.schema(x.add("step", "string")).parquet(f"{folder}/{n}") for n, x in schema.items()}
    steps = sorted({r.step for d in read.values() for r in d.select("step").distinct().collect()})  # periods, from the names of folders
    state = empty(refs, folder)
    many = -(-len(steps) // (most or len(steps))) if steps else 1
    for n in range(0, len(steps), many):
        own, later = steps[n : n + many], steps[n + many : n + many + 1]
        end = dt.datetime.fromisoformat(later[0]) - dt.timedelta(microseconds=1) if later else None
        state = advance(state, *[read[n].where(F.col("step").isin(own)).drop("step") for n in ("new-refs", "new-parents")], end)
    return state


def counts(log: DataFrame, table: str, period: str = "month") -> DataFrame:
    """Snapshot of the log: ``source_table, period, opened, resolved, reopened`` counts of events."""
    return (
        log.groupBy(F.lit(table).alias("source_table"), F.date_trunc(period, F.col("at").cast("timestamp")).cast("timestamp_ntz").alias("period"))
        .agg(*[F.count_if(F.col("event") == e).alias(e) for e in ("opened", "resolved", "reopened")])
    )
