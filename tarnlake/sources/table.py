"""Versioned Parquet tables: immutable files and a log of commits.

A commit writes its files into a folder of its own and then creates the next log entry, which fails if
another writer took that number; the loser plans anew on the new version. Log entries go through
Hadoop's file system, so a table may lie in any store it knows.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Commits between two checkpoints of the log, so that a read opens few entries.
CHECKPOINT = 10
#: Characters of text that a file's range holds; the greatest is rounded up.
PREFIX = 32
#: Values of a key that are told one by one when files are looked for, not by their range.
FEW = 4096
#: A version that was claimed so long ago without an entry belongs to a writer that died.
STALE_SECONDS = 600


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Commit:
    version: int
    timestamp: str
    operation: str
    metrics: dict
    add: list[dict]
    remove: list[str]
    schema: dict
    partition_by: list[str]


class Table:
    """A table at a path. Reads see one version; writers never change files that a version names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # -- log -----------------------------------------------------------------

    def _fs(self, path: str):
        p = self._hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:20]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> Commit:
        return Commit(**json.loads(self._read(self._hadoop.Path(self._entry(version)))))

    def _store(self, commit: Commit) -> None:
        fs, p = self._fs(self._entry(commit.version))
        fs.mkdirs(p.getParent())
        body = json.dumps(commit.__dict__, default=str).encode()
        # a whole entry appears under a name of its own, and is then renamed to the number unless that is taken
        draft = self._hadoop.Path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(body))
        stream.close()
        claim = self._hadoop.Path(f"{self.path}/_log/{commit.version:020d}.claim")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(claim) and not fs.exists(p) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
                fs.delete(claim, False)  # its writer died before the entry
            raise CommitConflict(f"version {commit.version} of {self.path} is taken") from e
        # a claim may have been taken for dead meanwhile: only what is there afterwards tells who won
        moved = not fs.exists(p) and fs.rename(draft, p)
        if not moved or self._read(p) != body:
            fs.delete(draft, False)
            raise CommitConflict(f"version {commit.version} of {self.path} is taken")
        if commit.version % CHECKPOINT == CHECKPOINT - 1:
            self._checkpoint(commit.version)

    def _read(self, p) -> bytes:
        stream = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _checkpoint(self, version: int) -> None:
        """The live files of a version as one file; it only spares reads, so a lost one does no harm."""
        fs, p = self._fs(f"{self.path}/_log/{version:020d}.live")
        draft = self._hadoop.Path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(self.files(version)).encode()))
        stream.close()
        fs.rename(draft, p)

    def exists(self) -> bool:
        return bool(self.versions())

    def version(self) -> int:
        """The latest version, -1 before the first."""
        return max(self.versions(), default=-1)

    def commits(self, version: int | None = None, after: int = -1) -> list[Commit]:
        """All commits up to a version (the latest) that follow another."""
        known = self.versions()
        last = max(known, default=-1) if version is None else version
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        return [self._load(v) for v in known if after < v <= last]

    def history(self) -> DataFrame:
        """version, timestamp, operation, operation_metrics; the latest first."""
        rows = [(c.version, c.timestamp, c.operation, {k: str(v) for k, v in c.metrics.items()}) for c in reversed(self.commits())]
        return self.spark.createDataFrame(rows, "version int, timestamp string, operation string, operation_metrics map<string,string>")

    # -- reading ---------------------------------------------------------------

    def files(self, version: int | None = None) -> list[dict]:
        live: dict[str, dict] = {}
        last, start = self.version() if version is None else version, -1
        fs, p = self._fs(f"{self.path}/_log")
        if fs.exists(p):
            start = max((int(n[:20]) for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".live") and int(n[:20]) <= last), default=-1)
        if start >= 0:
            live = {a["path"]: a for a in json.loads(self._read(self._hadoop.Path(f"{self.path}/_log/{start:020d}.live")))}
        for c in self.commits(version, start):
            for gone in c.remove:
                live.pop(gone, None)
            live |= {a["path"]: a for a in c.add}
        return list(live.values())

    def schema(self, version: int | None = None) -> T.StructType:
        last = self.version() if version is None else version
        return T.StructType.fromJson(self.commits(version, last - 1)[-1].schema)

    def read(self, version: int | None = None, where: Column | None = None, bounds: dict[str, tuple] | None = None, within: dict[str, list] | None = None) -> DataFrame:
        """One version's rows. bounds (column: (low, high), either may be None) and within (column: values) also skip files whose stored ranges hold no such row. Both take what casts to the column's type."""
        files = self.files(version)
        schema = self.schema(version)
        for c, ends in (bounds or {}).items():
            low, high = self._keys(schema[c], ends)
            files = [f for f in files if not _outside(f.get("stats", {}).get(c), low, high)]
        for c, values in (within or {}).items():
            keys = sorted(k for k in self._keys(schema[c], values) if k is not None)
            files = [f for f in files if not _without(f.get("stats", {}).get(c), keys)]
        df = self._open(files, schema)
        for c, (low, high) in (bounds or {}).items():
            df = df if low is None else df.filter(F.col(c) >= _as(low, schema[c].dataType))
            df = df if high is None else df.filter(F.col(c) <= _as(high, schema[c].dataType))
        for c, values in (within or {}).items():
            df = df.filter(F.col(c).isin([_as(v, schema[c].dataType) for v in values]))
        return df if where is None else df.filter(where)

    def added(self, version: int, after: int) -> DataFrame:
        """The rows that commits beyond ``after`` and up to a version have added, as they were; rewrites of the same rows don't count."""
        paths = [f for c in self.commits(version, after) if c.metrics.get("data_change", True) for f in c.add]
        return self._open(paths, self.schema(version))

    def _open(self, files: list[dict], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f['path']}" for f in files])

    def _keys(self, field: T.StructField, values) -> list:
        """The values of a column as ranges store them."""
        values = list(values)
        keys = [range_key(_as(v, field.dataType), field.dataType).alias(f"_{i}") for i, v in enumerate(values)]
        return list(self.spark.sql("SELECT 1 AS one").select(*keys).first()) if keys else []

    # -- writing ---------------------------------------------------------------

    def _write(self, df: DataFrame, stats: list[str], partition_by: list[str]) -> tuple[list[dict], int]:
        """Files of a commit with rows and ranges of some columns, from one pass over what was written."""
        folder = f"data/{uuid.uuid4().hex}"
        out = df
        if partition_by:  # files hold ranges of the values, so that bounds skip files; a hot value is parted by its other columns
            rest = [F.xxhash64(*[c for c in df.columns if c not in partition_by])] if len(df.columns) > len(partition_by) else []
            out = df.repartitionByRange(*[F.col(c) for c in partition_by], *rest)
        out.write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        kinds = {f.name: f.dataType for f in df.schema}
        aggs = [F.count("*").alias("rows"), *[f(range_key(F.col(c), kinds[c])).alias(f"{n}_{c}") for c in stats for n, f in (("min", F.min), ("max", F.max))]]
        rows = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(*aggs).collect()  # one row for each file of this commit
        add = [{"path": f"{folder}/{r['name']}", "rows": r["rows"], "stats": {c: [r[f"min_{c}"], _beyond(r[f"max_{c}"]) if c in text else r[f"max_{c}"]] for c in stats}} for r in rows]
        return add, sum(a["rows"] for a in add)

    def _layout(self, base: int) -> list[str]:
        """By what columns the last commit that had any laid its files."""
        return next((c.partition_by for v in range(base, -1, -1) for c in self.commits(v, v - 1) if c.partition_by), [])

    def _commit(self, operation: str, add: list[dict], remove: list[str], schema: T.StructType, metrics: dict, base: int, partition_by: list[str]) -> Commit:
        commit = Commit(base + 1, datetime.now(UTC).isoformat(), operation, metrics, add, remove, json.loads(schema.json()), partition_by)
        self._store(commit)
        return commit

    def _attempt(self, plan: Callable[[int], Commit | None], tries: int = 5) -> Commit | None:
        for i in range(tries):
            try:
                return plan(self.version())
            except CommitConflict:
                if i == tries - 1:
                    raise
        return None

    @staticmethod
    def _ranged(df: DataFrame, by: list[str]) -> list[str]:
        """Columns whose ranges files keep: dates, times, whole numbers, and of texts, which are long to read again, those that the files are laid by."""
        return [f.name for f in df.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType | T.LongType | T.IntegerType) or (isinstance(f.dataType, T.StringType) and f.name in by)]

    def append(self, df: DataFrame, partition_by: list[str] | None = None, operation: str = "APPEND", metrics: dict | None = None) -> Commit | None:
        """Add rows; none makes no commit."""
        by = partition_by or []
        add, n = self._write(df, self._ranged(df, by), by)
        if not n and not metrics and self.exists():
            return None
        schema = df.schema
        return self._attempt(lambda base: self._commit(operation, add, [], _merged(self.schema() if base >= 0 else None, schema), {"num_inserted": n} | (metrics or {}), base, by))

    def overwrite(self, df: DataFrame, partition_by: list[str] | None = None, metrics: dict | None = None) -> Commit:
        """A new snapshot; the rows may come from this very table."""
        by = partition_by or []
        add, n = self._write(df, self._ranged(df, by), by)
        return self._attempt(lambda base: self._commit("OVERWRITE", add, [f["path"] for f in self.files()] if base >= 0 else [], df.schema, {"num_inserted": n} | (metrics or {}), base, by))

    def create_or_get(self, df: DataFrame, key: list[str] | None = None, partition_by: list[str] | None = None) -> bool:
        """Create from rows, one for each key; False where the table is there already."""
        if self.exists():
            return False
        self.append(latest_by(df, key) if key else df, partition_by, "CREATE")
        return True

    def merge_insert(self, source: DataFrame, key: list[str], partition_by: list[str] | None = None, bounded_by: str | None = None) -> Commit | None:
        """Insert source rows whose key the table lacks, each key once. bounded_by: a column that follows from the key, whose range in the source limits what is read of the table."""

        def plan(base: int) -> Commit | None:
            own = latest_by(source, key)
            if base >= 0:
                limits = None
                if bounded_by:
                    text = lambda c: c if isinstance(source.schema[bounded_by].dataType, T.LongType | T.IntegerType) else c.cast("string")
                    r = source.agg(text(F.min(bounded_by)).alias("low"), text(F.max(bounded_by)).alias("high"), F.count_if(F.col(bounded_by).isNull()).alias("none")).first()
                    limits = {bounded_by: (r["low"], r["high"])} if r["low"] is not None and not r["none"] else None
                there = self.read(base, bounds=limits).select(*[F.col(k).alias(f"_{k}") for k in key])
                same = reduce(lambda a, b: a & b, [own[k].eqNullSafe(there[f"_{k}"]) for k in key])  # a null key is a key
                own = own.join(there, same, "left_anti").select(*source.columns)
            add, n = self._write(own, self._ranged(own, partition_by or []), partition_by or [])
            if not n and base >= 0:
                return None
            return self._commit("MERGE", add, [], _merged(self.schema() if base >= 0 else None, source.schema), {"num_inserted": n, "num_updated": 0, "num_deleted": 0}, base, partition_by or [])

        return self._attempt(plan)

    def replace_keys(self, df: DataFrame, keys: list[str], affected: DataFrame | None = None, partition_by: list[str] | None = None) -> Commit:
        """Delete the rows of some keys (those of ``affected``, else of df) and insert df, in one commit. Files without such keys stay as they are, others keep the layout of the table. A null key is a key."""

        def plan(base: int) -> Commit:
            gone = (affected if affected is not None else df).select(*keys).distinct()
            if base < 0:
                by = partition_by or []
                add, n = self._write(df, self._ranged(df, by), by)
                return self._commit("REPLACE", add, [], df.schema, {"num_inserted": n, "num_deleted": 0}, base, by)
            by, schema = partition_by or self._layout(base), _merged(self.schema(base), df.schema)
            ranged = [k for k in keys if k in self._ranged(df, by)]
            of = lambda k: range_key(F.col(k), schema[k].dataType)
            ends = gone.agg(F.count("*").alias("n"), *[f(of(k)).alias(f"{n}_{k}") for k in ranged for n, f in (("min", F.min), ("max", F.max))], *[F.count_if(F.col(k).isNull()).alias(f"none_{k}") for k in ranged]).first()
            ranged = [k for k in ranged if not ends[f"none_{k}"]]
            touched = [f for f in self.files(base) if not any(_outside(f["stats"].get(k), ends[f"min_{k}"], ends[f"max_{k}"]) for k in ranged)] if ends["n"] else []
            for k in ranged:  # a key of few values skips files between them too
                values = [r[0] for r in gone.select(of(k).alias("v")).distinct().limit(FEW + 1).collect()] if len(touched) > 1 else []
                if 0 < len(values) <= FEW:
                    touched = [f for f in touched if not _without(f["stats"].get(k), sorted(values))]
            new = df
            if touched:
                old, out = self._open(touched, schema), gone.select(*[F.col(k).alias(f"_{k}") for k in keys])
                same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(out[f"_{k}"]) for k in keys])
                new = old.join(out, same, "left_anti").unionByName(df, allowMissingColumns=True)
            add, n = self._write(new, self._ranged(new, by), by)
            before = sum(f["rows"] for f in touched)
            return self._commit("REPLACE", add, [f["path"] for f in touched], schema, {"rows_written": n, "rows_before": before}, base, by)

        return self._attempt(plan)

    def vacuum(self, keep_versions: int = 10) -> int:
        """Delete files that a commit has added and that none of the last versions names; returns how many. Older versions can't be read afterwards. Files that no commit names may belong to a writer at work, however old, and stay."""
        last = self.versions()[-keep_versions:]
        if not last:
            return 0
        named = {f["path"] for v in last for f in self.files(v)}
        fs, _ = self._fs(self.path)
        gone = 0
        for path in {f["path"] for c in self.commits(last[0]) for f in c.add} - named:
            gone += int(fs.delete(self._hadoop.Path(f"{self.path}/{path}"), False))
        return gone

    def optimize(self, zorder: list[str] | None = None, files: int = 1) -> Commit:
        """Rewrite the same rows into fewer files, laid along a Z-order curve over the given columns."""

        def plan(base: int) -> Commit:
            df, by = self.read(base), [] if zorder else self._layout(base)
            laid = zordered(df, zorder, files) if zorder else df if by else df.repartition(files)
            add, n = self._write(laid, self._ranged(df, by), by)
            return self._commit("OPTIMIZE", add, [f["path"] for f in self.files(base)], df.schema, {"rows": n, "files": len(add), "data_change": False}, base, by)

        return self._attempt(plan)


def _beyond(text: str | None) -> str | None:
    """A bound above all texts with this beginning."""
    return text + "\U0010ffff" if text is not None and len(text) >= PREFIX else text


def _as(value, kind: T.DataType) -> Column:
    """A given value in a column's type. A time without a zone is one of the session's, not of this process's."""
    plain = isinstance(value, datetime) and value.tzinfo is None
    return F.lit(value.isoformat(sep=" ") if plain else value).cast(kind)


def range_key(value: Column, kind: T.DataType) -> Column:
    """A value as ranges store and compare it: whole numbers, days, microseconds, and the beginning of a text. None depends on the session's time zone."""
    if isinstance(kind, T.StringType):
        return F.left(value, F.lit(PREFIX))
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        clock = F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value)
        return F.unix_date(value.cast("date")).cast("long") * 86_400_000_000 + (clock * 1_000_000).cast("long")
    return F.unix_micros(value) if isinstance(kind, T.TimestampType) else value.cast("long")


def _outside(stats: list | None, low, high) -> bool:
    """Whether a file's range surely lies outside [low, high], all as range_key gives them."""
    if not stats or stats[0] is None:
        return False
    return (low is not None and stats[1] < low) or (high is not None and stats[0] > high)


def _without(stats: list | None, keys: list) -> bool:
    """Whether a file's range surely holds none of some sorted keys."""
    if not stats or stats[0] is None:
        return False
    at = bisect_left(keys, stats[0])
    return at == len(keys) or keys[at] > stats[1]


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The old columns, then new ones: columns may be added, never change their type."""
    if old is None:
        return new
    have = {f.name: f for f in old}
    for f in new:
        if f.name in have and have[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([*old.fields, *[f for f in new if f.name not in have]])


def latest_by(df: DataFrame, key: list[str], newest: str = "ingested_at") -> DataFrame:
    """One row for each key: the newest, ties by all other columns. Tasks keep one row for each key before the shuffle."""
    order = [c for c in (newest,) if c in df.columns] + [c for c in df.columns if c not in key and c != newest]
    best = F.max_by(F.struct(*df.columns), F.struct(*(order or key))).alias("_best")
    return df.groupBy(*key).agg(best).select("_best.*")


def zordered(df: DataFrame, columns: list[str], files: int, bits: int = 8) -> DataFrame:
    """Rows in ranges of a curve that interleaves the bits of each column's quantile."""
    cuts = {c: df.approxQuantile(c, [i / (1 << bits) for i in range(1, 1 << bits)], 1 / (1 << (bits + 1))) for c in columns if not isinstance(df.schema[c].dataType, T.TimestampType | T.TimestampNTZType)}
    place = {}
    for c in columns:
        if c in cuts:
            value, own = F.col(c).cast("double"), sorted(set(cuts[c]))
        else:
            seconds = F.unix_micros(F.col(c).cast("timestamp")).cast("double")
            own = sorted(set(df.select(seconds.alias("v")).approxQuantile("v", [i / (1 << bits) for i in range(1, 1 << bits)], 1 / (1 << (bits + 1)))))
            value = seconds
        edges = F.array(*[F.lit(float(x)) for x in own])
        place[c] = F.size(F.filter(edges, lambda e, value=value: e <= value))
    z = reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(place[c], b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + i) for b in range(bits) for i, c in enumerate(columns)])
    return df.withColumn("_z", z).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
