"""Keyed tables as Parquet in hash buckets, with one small manifest a version.

A row lies in the bucket of its key's hash. A manifest lists, per bucket, the folders that hold it,
its rows and a digest of them; folders are never changed once written. An upsert reads and writes only
the buckets that hold incoming keys, adds a folder to those that new keys fall into, then puts the next manifest in place, which only one writer
can do. A bucket whose rows came out the same keeps its old folder, so two versions differ in content
exactly where their manifests differ: that is what ``differing`` and the change feed rest on.

Writers are optimistic. One that finds a newer manifest than the one it started from goes on if none
of its buckets moved meanwhile; else it does its work again on the newer one, a bounded number of
times. A writer that dies leaves folders that no manifest names, which ``vacuum`` collects later.
Manifests grow with the number of buckets, not with rows; ``rebucket`` deals a table out anew.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.tables import set_values, upsert
from ..registry import KEYS, SIDE_TABLES, TABLES, columns, conform, schema_of
from .files import child_names, file_system, put_if_absent, read_text, with_retry

CSV_TABLES = ["announcements", "awards", "contracts", "entities", "materiality", "changes"]
BUCKETS, ATTEMPTS, FOLDERS = 16, 8, 8
#: Tables derived for look-ups: contract table, and the column whose hash places a row.
DERIVED = {"contract_events": ("awards", "contract_uid")}


class Conflict(RuntimeError):
    """Other writers kept changing the same buckets."""


@dataclass(frozen=True)
class Version:
    """A manifest. ``upto``: versions of other tables that this one was derived from."""

    number: int = 0
    n_buckets: int = BUCKETS
    columns: tuple[str, ...] = ()
    buckets: dict[int, dict] = field(default_factory=dict)
    upto: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def parse(text: str) -> Version:
        d = json.loads(text)
        return Version(d["number"], d["n_buckets"], tuple(d["columns"]), {int(b): e for b, e in d["buckets"].items()}, d["upto"])


class Store:
    """A folder with one sub-folder per table; any Hadoop path will do. Readers of an old version are undisturbed."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.own: dict[str, int] = {}  # the last version of each table that this object put in place

    # manifests

    def _contract(self, table: str) -> tuple[str, str, str]:
        """The contract table of a table's columns, its key, and the column that places its rows."""
        like, by = DERIVED.get(table, (table, columns(table)[0] if table not in DERIVED else None))
        return like, KEYS.get(like) or columns(like)[0], by

    def _versions(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in child_names(self.spark, f"{self.root}/{table}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, table: str, number: int | None = None) -> Version:
        """The newest version, or that of a number; version 0 is the empty one before all."""
        found = self._versions(table)
        number = (found[-1] if found else 0) if number is None else number
        if number == 0:
            return Version(0, self.buckets, tuple(columns(self._contract(table)[0])))
        return Version.parse(read_text(self.spark, f"{self.root}/{table}/manifests/{number:08d}.json"))

    def numbers(self, *tables: str) -> dict[str, int]:
        """The newest version of each table: what a later ``differing`` starts from."""
        return {t: (self._versions(t) or [0])[-1] for t in tables}

    # reading

    def _schema(self, table: str, version: Version) -> StructType:
        return StructType([f for f in schema_of(self._contract(table)[0]) if f.name in version.columns])

    def frame(self, table: str, version: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version's buckets, all or some, in contract form."""
        which = version.buckets if buckets is None else {b: version.buckets[b] for b in buckets if b in version.buckets}
        schema = self._schema(table, version)
        paths = sorted(f"{self.root}/{table}/{p}" for e in which.values() for p in e["paths"])
        raw = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return conform(raw, self._contract(table)[0])

    def read(self, table: str, version: int = -1) -> DataFrame:
        """The newest version, or an older one: -2 is the one before."""
        found = self._versions(table)
        return self.frame(table, self.manifest(table, found[version] if len(found) >= -version else 0))

    def bucket(self, column: Column, version: Version) -> Column:
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(version.n_buckets)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame, column: str, version: Version) -> list[int]:
        """The buckets that some keys fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(column), version)).distinct().collect())

    def read_keys(self, table: str, keys: DataFrame, column: str | None = None) -> DataFrame:
        """The rows whose placing column is among ``keys``; only the buckets of those are read."""
        by = self._contract(table)[2]
        now = self.manifest(table)
        found = self.frame(table, now, self.buckets_of(table, keys, column or by, now))
        return found.join(keys.select(F.col(column or by).alias(by)).distinct(), by, "left_semi").select(found.columns)

    def moved(self, table: str, since: int) -> bool:
        """Whether any bucket's content isn't what it was in version ``since``: two manifests tell."""
        old, new = self.manifest(table, since), self.manifest(table)
        return old.number != new.number and (old.n_buckets, old.buckets) != (new.n_buckets, new.buckets)

    def differing(self, table: str, since: int) -> tuple[DataFrame, DataFrame]:
        """Rows before and after, of the buckets whose content isn't what it was in version ``since``."""
        old, new = self.manifest(table, since), self.manifest(table)
        if old.n_buckets != new.n_buckets:
            return self.frame(table, old), self.frame(table, new)
        moved = [b for b in {*old.buckets, *new.buckets} if old.buckets.get(b) != new.buckets.get(b)]
        return self.frame(table, old, moved), self.frame(table, new, moved)

    def changed_keys(self, table: str, since: int) -> DataFrame:
        """key, old, new: the rows (as structs, null where there is none) of keys whose row isn't what it was."""
        key = self._contract(table)[1]
        sides = []
        for name, df in zip(("old", "new"), self.differing(table, since), strict=True):
            rest = F.struct(*[F.col(c) for c in df.columns])
            sides.append(df.select(F.col(key).alias("key"), rest.alias(name)))
        return sides[0].join(sides[1], "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))

    # writing

    def _put(self, table: str, df: DataFrame, version: Version) -> dict[int, dict]:
        """Writes rows in their buckets' folders; what a manifest says of each bucket. Hot buckets are split among tasks."""
        by = self._contract(table)[2]
        path = f"data/{uuid.uuid4().hex}"
        df.withColumn("bucket", self.bucket(F.col(by), version)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/{table}/{path}")
        names = df.columns
        written = self.spark.read.schema(StructType([*df.schema, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{table}/{path}")
        sums = [F.sum(F.xxhash64(F.lit(k), *names).cast("decimal(20,0)")) for k in (0, 1)]  # whatever the order of rows
        told = written.groupBy("bucket").agg(F.count("*").alias("n"), F.array(*sums).alias("digest")).collect()
        return {r.bucket: {"paths": [f"{path}/bucket={r.bucket}"], "rows": r.n, "digest": [str(int(x)) for x in r.digest]} for r in told}

    def _commit(self, table: str, base: Version, touched: list[int], new: dict[int, dict], upto: dict[str, int]) -> bool:
        """The next manifest, or False if a bucket that was read and written has moved since ``base``."""
        while True:
            now = self.manifest(table)
            if now.number != base.number and (now.n_buckets != base.n_buckets or any(now.buckets.get(b) != base.buckets.get(b) for b in touched)):
                return False
            buckets = {b: e for b, e in now.buckets.items() if b not in touched} | new
            made = replace(now, number=now.number + 1, columns=base.columns, buckets=buckets, upto={**now.upto, **upto})
            if now.number and replace(made, number=now.number) == now:
                return True  # nothing changed
            if put_if_absent(self.spark, f"{self.root}/{table}/manifests/{made.number:08d}.json", made.text()):
                self.own[table] = made.number
                return True

    def _write(self, table: str, plan: Callable[[Version], tuple[list[int], list[int], DataFrame | None]], upto: dict[str, int] | None, attempts: int = ATTEMPTS) -> None:
        """Carries out ``plan``: buckets to replace, buckets to add to, and the rows that replace or are added."""
        for attempt in range(attempts):
            base = replace(self.manifest(table), columns=tuple(columns(self._contract(table)[0])))
            replaced, added, rows = plan(base)
            entries = self._put(table, rows, base) if rows is not None else {}
            for b, e in entries.items():
                o = base.buckets.get(b)
                if o and b in added:
                    entries[b] = {"paths": o["paths"] + e["paths"], "rows": o["rows"] + e["rows"], "digest": [str(int(x) + int(y)) for x, y in zip(o["digest"], e["digest"], strict=True)]}
                elif o and (o["rows"], o["digest"]) == (e["rows"], e["digest"]):
                    entries[b] = o
            gone = {b: base.buckets[b] for b in added if b in base.buckets and b not in entries}
            if self._commit(table, base, [*replaced, *added], entries | gone, upto or {}):
                return
            time.sleep(0.05 * (attempt + 1) * random.random())
        raise Conflict(f"{table}: {attempts} attempts met other writers in the same buckets")

    def rewrite(self, table: str, touch: Callable[[Version], list[int] | None], make: Callable[[DataFrame], DataFrame], upto: dict[str, int] | None = None, attempts: int = ATTEMPTS) -> None:
        """Replaces the rows of some buckets (None: of all) by what ``make`` makes of them, on whatever version that holds for."""

        def plan(base: Version) -> tuple[list[int], list[int], DataFrame | None]:
            touched = touch(base)
            touched = list(range(base.n_buckets)) if touched is None else touched
            return touched, [], conform(make(self.frame(table, base, touched)), self._contract(table)[0]) if touched else None

        self._write(table, plan, upto, attempts)

    def write(self, table: str, df: DataFrame, upto: dict[str, int] | None = None) -> None:
        """The whole table anew; buckets that come out the same stay."""
        self.rewrite(table, lambda _: None, lambda _: df, upto)

    def create(self) -> None:
        for t in TABLES:
            if not self._versions(t):
                put_if_absent(self.spark, f"{self.root}/{t}/manifests/{1:08d}.json", replace(self.manifest(t, 0), number=1).text())

    def stage(self, rows: DataFrame, owner: str = "any") -> DataFrame:
        """``rows`` written once beside the tables: what made them isn't asked again, however often they are read."""
        path = f"{self.root}/_staged/{owner}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def unstage(self, owner: str = "any") -> None:
        fs, p = file_system(self.spark, f"{self.root}/_staged/{owner}")
        fs.delete(p, True)

    def upsert(self, table: str, rows: DataFrame, position: str | None = None, upto: dict[str, int] | None = None, staged: bool = False) -> int:
        """Rows in place of those with their keys; the number of distinct keys written. ``staged`` rows are read again, not written first.

        ``position`` orders repeats, the last wins; without it the repeat with the greatest hash of its contents does, whatever the
        order of rows. A null key is an error. A bucket that holds none of the keys yet gets the rows as a further folder, unread, so
        tables that only grow are never rewritten but for a bucket of ``FOLDERS`` folders, which becomes one.
        """
        like, key, by = self._contract(table)
        at = position or "__pos"
        owner = uuid.uuid4().hex
        rows = conform(rows if position else rows.withColumn(at, F.xxhash64(*rows.columns)), like, at)
        rows = rows if staged else self.stage(rows, owner)
        written = [0]

        def plan(base: Version) -> tuple[list[int], list[int], DataFrame]:
            told = rows.groupBy(self.bucket(F.col(by), base).alias("b")).agg(F.countDistinct(key).alias("n")).collect()
            touched = sorted(r.b for r in told)
            written[0] = sum(r.n for r in told)
            held = [b for b in touched if b in base.buckets]
            full = {b for b in held if len(base.buckets[b]["paths"]) >= FOLDERS}
            keys = self.frame(table, base, held).select(key, by).join(rows.select(key).distinct(), key, "left_semi")
            replaced = sorted({*self.buckets_of(table, keys, by, base)} | full) if held else []
            return replaced, [b for b in touched if b not in replaced], conform(upsert(self.frame(table, base, replaced), rows, key, at), like)

        try:
            self._write(table, plan, upto)
            return written[0]
        finally:
            self.unstage(owner)

    def replace_rows(self, table: str, gone: DataFrame, rows: DataFrame, upto: dict[str, int] | None = None) -> None:
        """Takes out the rows that have a key of ``gone`` (key and placing column) and puts in ``rows``; both may be in several buckets."""
        like, key, by = self._contract(table)
        places = gone.select(by).unionByName(rows.select(by)).distinct()
        drop = gone.select(key).unionByName(rows.select(key)).distinct()
        self.rewrite(table, lambda v: self.buckets_of(table, places, by, v), lambda old: old.join(drop, key, "left_anti").unionByName(conform(rows, like)), upto)

    def mark_statuses(self, statuses: DataFrame) -> None:
        """Sets extraction_status from (announcement_id, status)."""
        patch = statuses.select("announcement_id", F.col("status").alias("extraction_status"))
        self.rewrite("announcements", lambda v: self.buckets_of("announcements", patch, "announcement_id", v), lambda old: set_values(old, patch, "announcement_id", "extraction_status"))

    def mark_status(self, announcement_ids: DataFrame, status: str) -> None:
        self.mark_statuses(announcement_ids.select("announcement_id", F.lit(status).alias("status")))

    # upkeep

    def adopt(self, table: str, raw: DataFrame) -> None:
        """Rows of an older form as the table's new version; columns that they lack are left out until ``migrate``."""
        like, _, _ = self._contract(table)
        base = self.manifest(table)
        own = tuple(c for c in columns(like) if c in raw.columns)
        entries = self._put(table, conform(raw, like).select(*own), base)
        if not self._commit(table, replace(base, columns=own), list(range(base.n_buckets)), entries, {}):
            raise Conflict(table)

    def migrate(self) -> dict[str, list[str]]:
        """Columns the newest versions lack, added as null by a manifest alone; nothing is dropped, retyped or rewritten."""
        added = {}
        for t in TABLES:
            now = self.manifest(t)
            if gone := [c for c in columns(t) if c not in now.columns]:
                added[t] = gone
                if not self._commit(t, replace(now, columns=tuple(columns(t))), [], {}, {}):
                    raise Conflict(t)
        return added

    def rebucket(self, table: str, n_buckets: int) -> None:
        """The same rows in another number of buckets."""
        base = self.manifest(table)
        wider = replace(base, n_buckets=n_buckets, number=base.number + 1)
        wider = replace(wider, buckets=self._put(table, self.frame(table, base), wider))
        if not put_if_absent(self.spark, f"{self.root}/{table}/manifests/{wider.number:08d}.json", wider.text()):
            raise Conflict(table)

    def vacuum(self, keep: int = 2, grace_seconds: float = 3600) -> None:
        """All but the newest versions go, with folders that no kept manifest names; younger ones than ``grace_seconds`` may be a writer's at work and stay."""
        for t in [*TABLES, *SIDE_TABLES, *DERIVED]:
            numbers = self._versions(t)
            for n in numbers[:-keep]:
                fs, p = file_system(self.spark, f"{self.root}/{t}/manifests/{n:08d}.json")
                fs.delete(p, False)
            used = {p.split("/")[1] for n in numbers[-keep:] for e in self.manifest(t, n).buckets.values() for p in e["paths"]}
            fs, p = file_system(self.spark, f"{self.root}/{t}/data")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in used and s.getModificationTime() / 1000 <= time.time() - grace_seconds:
                    fs.delete(s.getPath(), True)

    def export(self, folder: str) -> list[str]:
        """Every table as Parquet, six also as CSV with a header; a target in use is tried again."""
        out = []
        for t in TABLES:
            df = self.read(t)
            with_retry(lambda df=df, t=t: df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet"))
            out.append(f"{t}.parquet")
            if t in CSV_TABLES:
                with_retry(lambda df=df, t=t: df.write.mode("overwrite").option("header", True).csv(f"{folder}/{t}.csv"))
                out.append(f"{t}.csv")
        return out

    def counts(self) -> dict[str, int]:
        """Rows of each table, from the manifests alone."""
        return {t: sum(e["rows"] for e in self.manifest(t).buckets.values()) for t in TABLES}
