"""Tables that grow batch by batch: segments, manifests, tombstones, compaction.

A store is a folder with several tables of one key (a document). Each batch writes its rows of all tables into a segment
of its own, with a list of the keys that it replaces or deletes, and then a manifest that names all segments. Readers
take the newest manifest, so they see a batch in all tables or in none, whenever its writer stops. A key's rows are those
of the newest segment that lists it; older ones are buried.

Segments have levels. Where FAN of them have one level, they become one segment of the next, without buried rows; each
row is so rewritten once a level, about log(batches) times. Rows that must be found again by a key or by another
column (indexed tables) lie in as many buckets as give each about BUCKET rows: a batch reads only the buckets that its
keys fall into, in each of the few segments, and never the whole table.

The folder must be on a file system that renames atomically. Files that no manifest names any more stay until vacuum()."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Segments of one level before they are merged; rows of a bucket of an indexed table, about; buckets that a lookup names one by one (with more of them it reads all: the batch itself is that large).
FAN, BUCKET, NAMED = 4, 50_000, 2_000


@dataclass(frozen=True)
class Segment:
    """One batch, or several merged ones. number: the newest batch in it, which orders segments; tables: path and rows of each table; buckets: of each indexed table, by column."""

    name: str
    level: int
    number: int
    tables: dict[str, int]
    buckets: dict[str, int]


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last: int = -1
    segments: list[Segment] = field(default_factory=list)
    schemas: dict[str, dict] = field(default_factory=dict)


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


def bucket_of(column: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


class Store:
    """key: the column that all tables share; indexed: table to the columns that rows are looked up by; logs: tables whose rows are only ever added. A table's columns are those of its first rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, indexed: dict[str, list[str]] | None = None, logs: tuple[str, ...] = (), fan: int = FAN):
        self.spark, self.path, self.key, self.indexed, self.logs, self.fan = spark, path, key, indexed or {}, logs, fan

    # Files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self) -> Manifest:
        """The newest manifest; what it names is complete."""
        versions = self._versions()
        if not versions:
            return Manifest()
        at, fs = self._fs(f"{self.path}/manifest/{versions[-1]:012}.json")
        stream = fs.open(at)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        d = json.loads(text)
        return Manifest(d["version"], d["last"], [Segment(**s) for s in d["segments"]], d["schemas"])

    def _publish(self, m: Manifest) -> None:
        """Writes a manifest beside the others under a name that must be new: all of it is there at once."""
        text = json.dumps({"version": m.version, "last": m.last, "segments": [s.__dict__ for s in m.segments], "schemas": m.schemas})
        draft, fs = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/manifest/{m.version:012}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {m.version} is there already")

    # Reading

    def _rows(self, m: Manifest, s: Segment, table: str) -> DataFrame:
        """Rows of a segment's table; a table with several indexes is stored once for each, the first of them is read."""
        of = f"/{self.indexed[table][0]}" if table in self.indexed else ""
        schema = StructType.fromJson(m.schemas[table])
        return self.spark.read.schema(schema).parquet(f"{self.path}/segment/{s.name}/{table}{of}").select(*[f"`{c}`" for c in schema.names], F.lit(s.number).alias("_number"))

    def _keys(self, segments: list[Segment]) -> DataFrame:
        """Each key with the number of the newest segment that lists it."""
        out = None
        for s in segments:
            k = self.spark.read.parquet(f"{self.path}/segment/{s.name}/keys").withColumn("_number", F.lit(s.number))
            out = k if out is None else out.unionByName(k)
        return out.groupBy(self.key).agg(F.max("_number").alias("_newest"))

    def _union(self, m: Manifest, segments: list[Segment], table: str) -> DataFrame | None:
        out = None
        for s in segments:
            if table in s.tables:
                rows = self._rows(m, s, table)
                out = rows if out is None else out.unionByName(rows)
        return out

    def _alive(self, m: Manifest, segments: list[Segment], table: str) -> DataFrame | None:
        rows = self._union(m, segments, table)
        if rows is None or table in self.logs or len(segments) == 1:
            return rows
        newest = self._keys(segments)
        return rows.join(newest, self.key).where(F.col("_number") == F.col("_newest")).drop("_newest")

    def read(self, table: str, manifest: Manifest | None = None) -> DataFrame:
        """The table as the newest manifest (or a given one) has it; an error for one that no batch has had rows of."""
        m = manifest or self.manifest()
        out = self._alive(m, m.segments, table)
        return self.spark.createDataFrame([], StructType.fromJson(m.schemas[table])) if out is None else out.drop("_number")

    def lookup(self, table: str, column: str, values: DataFrame) -> DataFrame | None:
        """Rows of an indexed table whose `column` is among values' column of that name: only buckets that these fall into are read. None where no segment has the table."""
        m = self.manifest()
        schema = StructType([*StructType.fromJson(m.schemas[table]).fields, StructField("_bucket", IntegerType())]) if table in m.schemas else None
        out = None
        wanted = values.select(column).where(F.col(column).isNotNull()).distinct()
        for s in (s for s in m.segments if table in s.tables):
            n = s.buckets[f"{table}/{column}"]
            hit = [r[0] for r in wanted.select(bucket_of(column, n)).distinct().limit(NAMED + 1).collect()] if n > 1 else []
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/segment/{s.name}/{table}/{column}")
            if 0 < len(hit) <= NAMED:
                rows = rows.where(F.col("_bucket").isin(hit))
            rows = rows.drop("_bucket").withColumn("_number", F.lit(s.number))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return None
        found = out.join(wanted, column, "left_semi")
        return self._not_buried(found, m.segments)

    def _not_buried(self, found: DataFrame, segments: list[Segment]) -> DataFrame:
        """Found rows that no newer segment replaces: its keys are looked up by bucket, too."""
        keys = found.select(self.key).distinct()
        newest = None
        for s in segments:
            n = s.buckets["keys"]
            hit = [r[0] for r in keys.select(bucket_of(self.key, n)).distinct().limit(NAMED + 1).collect()] if n > 1 else []
            k = self.spark.read.parquet(f"{self.path}/segment/{s.name}/keys")
            if 0 < len(hit) <= NAMED:
                k = k.where(F.col("_bucket").isin(hit))
            k = k.select(self.key, F.lit(s.number).alias("_of"))
            newest = k if newest is None else newest.unionByName(k)
        newest = newest.join(keys, self.key, "left_semi").groupBy(self.key).agg(F.max("_of").alias("_newest"))
        return found.join(newest, self.key).where(F.col("_number") == F.col("_newest")).drop("_number", "_newest")

    # Writing

    def _write(self, name: str, keys: DataFrame, tables: dict[str, DataFrame], level: int, number: int) -> Segment:
        base, counts, buckets = f"{self.path}/segment/{name}", {}, {}
        for table, rows in tables.items():
            if table not in self.indexed:
                rows.write.parquet(f"{base}/{table}")
                counts[table] = self.spark.read.schema(rows.schema).parquet(f"{base}/{table}").count()
                continue
            rows.write.parquet(f"{base}/plain/{table}")
            plain = self.spark.read.schema(rows.schema).parquet(f"{base}/plain/{table}")
            counts[table] = plain.count()
            for column in self.indexed[table]:
                n = buckets[f"{table}/{column}"] = max(1, -(-counts[table] // BUCKET))
                plain.withColumn("_bucket", bucket_of(column, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{base}/{table}/{column}")
        keys = keys.select(self.key).distinct()
        n = buckets["keys"] = max(1, -(-keys.count() // BUCKET))
        keys.withColumn("_bucket", bucket_of(self.key, n)).repartition("_bucket").sortWithinPartitions("_bucket").write.parquet(f"{base}/keys")
        return Segment(name, level, number, counts, buckets)

    def commit(self, number: int, keys: DataFrame, tables: dict[str, DataFrame], before_publish: Callable[[], None] | None = None) -> bool:
        """Adds batch `number`: rows of all tables, which take the place of all earlier rows of `keys`. A batch that is there already adds nothing (False)."""
        m = self.manifest()
        if number <= m.last:
            return False
        schemas = {t: rows.schema.jsonValue() for t, rows in tables.items()} | m.schemas
        tables = {t: rows.select(*[f"`{f['name']}`" for f in schemas[t]["fields"]]) for t, rows in tables.items()}
        s = self._write(uuid.uuid4().hex, keys, tables, 0, number)
        if before_publish:
            before_publish()
        self._publish(Manifest(m.version + 1, number, [*m.segments, s], schemas))
        return True

    def delete(self, number: int, keys: DataFrame) -> int:
        """Buries all rows of keys (KW7); returns how many rows of keyed tables that were."""
        gone = keys.select(self.key).distinct()
        n = sum(self.read(t).join(gone, self.key, "left_semi").count() for t in self.manifest().schemas if t not in self.logs)
        return n if self.commit(number, gone, {}) else 0

    def compact(self) -> int:
        """Merges levels that are full; returns the number of merges. Each takes neighbours, so the order of batches stays."""
        merges = 0
        while True:
            m = self.manifest()
            run: list[Segment] = []
            for s in reversed(m.segments):  # the newest level that is full
                if run and s.level != run[0].level:
                    if len(run) >= self.fan:
                        break
                    run = []
                run.insert(0, s)
            if len(run) < self.fan:
                return merges
            at = m.segments.index(run[0])
            tables = {t: rows.drop("_number") for t in m.schemas if (rows := self._alive(m, run, t)) is not None}
            keys = self._keys(run)
            if at == 0:
                # Nothing older is left to bury: keys without rows go.
                held = [rows.select(self.key) for t, rows in tables.items() if t not in self.logs]
                have = held[0] if held else keys.select(self.key).limit(0)
                for h in held[1:]:
                    have = have.unionByName(h)
                keys = keys.join(have.distinct(), self.key, "left_semi")
            merged = self._write(uuid.uuid4().hex, keys, tables, run[0].level + 1, run[-1].number)
            self._publish(Manifest(m.version + 1, m.last, [*m.segments[:at], merged, *m.segments[at + len(run) :]], m.schemas))
            merges += 1

    def vacuum(self) -> int:
        """Deletes folders that the newest manifest does not name, and older manifests: call it where no reader uses them any more. Returns the number of folders."""
        kept, (at, fs) = {s.name for s in self.manifest().segments}, self._fs(f"{self.path}/segment")
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        for v in self._versions()[:-1]:
            fs.delete(self._fs(f"{self.path}/manifest/{v:012}.json")[0], False)
        return len(gone)
