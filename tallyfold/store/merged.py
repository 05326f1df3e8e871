"""The merged store: normalised result tables that grow by commits of whole sessions.

A commit writes all tables below names of its own, split by policy and session bucket, checks what it has written, and only
then creates the next manifest, one small file that lists the commits in use. A run that ends
before that leaves the old state; a reader sees one manifest and so one state. A commit holds every row of the
sessions it touches, so the last commit of a session supersedes its rows in earlier ones, and sessions that no one
touches are not written again. Compaction writes the rows in use once more as one commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tallyfold.operators.result_tables import CHECKS, REMAINDER, RESULT, TABLES
from tallyfold.store import files

PLACE = [T.StructField("commit", T.StringType()), T.StructField("policy", T.StringType()), T.StructField("bucket", T.IntegerType())]


#: Tables that are written at the same time.
WRITERS = 4


class Conflict(RuntimeError):
    """Another run has committed since this one read the store."""


@dataclass(frozen=True)
class Manifest:
    """version; commits in use, oldest first; the last batch of each stream that feeds the store."""

    version: int = 0
    commits: tuple[str, ...] = ()
    batches: Mapping[str, int] = field(default_factory=dict)


class MergedStore:
    """Result tables below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, most_commits: int = 16) -> None:
        self.spark, self.root, self.buckets, self.most_commits = spark, root.rstrip("/"), buckets, most_commits

    def head(self) -> Manifest:
        known = [n for n in files.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not known:
            return Manifest()
        got = json.loads(files.read_text(self.spark, f"{self.root}/manifest/{known[-1]}"))
        return Manifest(got["version"], tuple(got["commits"]), got["batches"])

    def commit(self, tables: Mapping[str, DataFrame], policy: str, stream: str | None = None, batch: int = 0) -> Manifest:
        """Writes whole sessions; a batch of a stream that is in the store already changes nothing."""
        head = self.head()
        if stream is not None and head.batches.get(stream, -1) >= batch:
            return head
        placed = {name: rows.withColumn("policy", F.lit(policy)) for name, rows in tables.items()}
        batches = {**head.batches, **({stream: batch} if stream is not None else {})}
        after = replace(head, version=head.version + 1, batches=batches)
        name = self._written(placed, after.version)
        after = self._published(replace(after, commits=(*head.commits, name)))
        return self.compact() if len(after.commits) > self.most_commits else after

    def compact(self) -> Manifest:
        """All rows in use as one commit; the earlier ones stay until ``vacuum``, for readers of the manifests before."""
        head = self.head()
        name = self._written({t: self.read(t, head=head) for t in TABLES}, head.version + 1)
        return self._published(replace(head, version=head.version + 1, commits=(name,)))

    def vacuum(self) -> list[str]:
        """Removes manifests but the last, and commits that it doesn't list, also those of runs that ended early."""
        head = self.head()
        gone = {c for t in TABLES for c in files.names(self.spark, f"{self.root}/{t}")} - {f"commit={c}" for c in head.commits}
        for old in files.names(self.spark, f"{self.root}/manifest"):
            if old != f"{head.version:010d}.json":
                files.remove(self.spark, f"{self.root}/manifest/{old}")
        for t in TABLES:
            for c in gone:
                files.remove(self.spark, f"{self.root}/{t}/{c}")
        return sorted(gone)

    def read(self, table: str, policy: str | None = None, head: Manifest | None = None) -> DataFrame:
        """The rows in use with commit, policy and bucket; of one policy, only its folders are read."""
        head = head or self.head()
        rows = self._rows(table, head.commits)
        if policy is not None:
            rows = rows.where(F.col("policy") == policy)
        if len(head.commits) < 2:
            return rows
        # Commit names sort by their order. Sessions of the first commit are in use unless a later one has them.
        later = self._rows(RESULT, head.commits[1:]).groupBy("session_id", "policy").agg(F.max("commit").alias("_last"))
        return rows.join(later, ["session_id", "policy"], "left").where("_last is null or _last = commit").drop("_last").select(*rows.columns)

    def _rows(self, table: str, commits: tuple[str, ...]) -> DataFrame:
        schema = T.StructType([*T.StructType.fromDDL(TABLES[table]).fields, *PLACE])
        if not commits:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.root}/{table}/commit={c}" for c in commits]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders)

    def _written(self, tables: Mapping[str, DataFrame], version: int) -> str:
        """The name of a new commit, written and checked."""
        name = f"{version:010d}-{uuid.uuid4().hex[:12]}"

        def write(table: str) -> None:
            columns = T.StructType.fromDDL(TABLES[table]).fields
            ok = F.coalesce(F.expr(CHECKS.get(table, "true")), F.lit(False))
            refuse = F.raise_error(F.concat(F.lit(f"a row of {table} breaks its rules, session "), F.col("session_id").cast("string")))
            rows = tables[table].select(*[F.col(f.name).cast(f.dataType) for f in columns], "policy")
            rows = rows.withColumn("policy", F.when(ok, F.col("policy")).otherwise(refuse))
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int"))
            # Rebalancing gathers a bucket into few files and splits one that a large session fills.
            rows.hint("rebalance", F.col("bucket")).write.partitionBy("policy", "bucket").parquet(f"{self.root}/{table}/commit={name}")

        # The small tables' jobs run beside those of the large ones.
        with ThreadPoolExecutor(WRITERS) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(write), t) for t in TABLES]:
                done.result()
        fault = restored(self._rows("charge", (name,)), self._rows("turn", (name,)), self._rows("attribution", (name,)), self._rows(RESULT, (name,)))
        bad = fault.where("fault is not null").limit(1).collect()
        if bad:
            raise ValueError(f"stored result of session {bad[0].session_id} does not add up: {bad[0].fault}")
        return name

    def _published(self, after: Manifest) -> Manifest:
        text = json.dumps({"version": after.version, "commits": after.commits, "batches": dict(after.batches)})
        path = f"{self.root}/manifest/{after.version:010d}.json"
        if f"{after.version:010d}.json" in files.names(self.spark, f"{self.root}/manifest"):
            raise Conflict(path)
        files.create(self.spark, path, text)
        return after


def restored(charge: DataFrame, turn: DataFrame, attribution: DataFrame, result: DataFrame) -> DataFrame:
    """session_id, policy, fault: whether a session's attributions, its remainder included, give its charges, and its turns what is covered."""
    key = ["session_id", "policy"]
    zero = F.lit(0).cast("bigint")
    sums = (
        charge.select(*key, F.col("cost_micros").alias("seen"), zero.alias("split"), zero.alias("turns"), zero.alias("results"), zero.alias("through"))
        .unionByName(attribution.select(*key, F.col("cost_micros").alias("split")), allowMissingColumns=True)
        .unionByName(turn.select(*key, F.lit(1).alias("turns")), allowMissingColumns=True)
        .unionByName(result.select(*key, F.lit(1).alias("results"), F.col("covered_through_turn").alias("through")), allowMissingColumns=True)
        .groupBy(*key)
        .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("seen", "split", "turns", "results", "through")])
    )
    fault = (
        F.when(F.col("results") != 1, "result").when(F.col("turns") != F.col("through"), "turns").when(F.col("split") != F.col("seen"), "total")
    )
    return sums.select(*key, fault.alias("fault"))


def stored_results(store: MergedStore, policy: str | None = None) -> DataFrame:
    """The results in use with what they conclude; totals are sums of the stored rows, never stored themselves."""
    head = store.head()
    rest = F.col("target_kind") == REMAINDER
    sums = store.read("attribution", policy, head).groupBy("session_id", "policy").agg(
        F.sum(F.when(rest, 0).otherwise(F.col("cost_micros"))).alias("attributed_micros"),
        F.sum(F.when(rest, F.col("cost_micros")).otherwise(0)).alias("unattributed_micros"), F.count(F.lit(1)).alias("attributions"),
    )
    zero = F.lit(0).cast("bigint")
    out = store.read(RESULT, policy, head).join(sums, ["session_id", "policy"], "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("attributed_micros", "unattributed_micros", "attributions")})
    return out.withColumn("total_micros", F.col("attributed_micros") + F.col("unattributed_micros"))
