"""Landing to Bronze, incremental Silver with a stored watermark, and incremental marts."""

from __future__ import annotations

import logging
import os
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, dimensions, facts, heat, joins, sessions
from ..quality import metrics, reconcile
from ..sources import raw
from ..sources.table import Table
from .daily import Daily
from .registry import record_lineage

WATERMARK = "pipeline_name string, last_processed_event_time timestamp, updated_at timestamp, last_batch_id string"
#: Hot users and products are sliced by days.
SLICE = 86_400
LANDED = "file string, bronze_version int"
#: Files of the table of landed files beyond which they are made one.
NOTES = 64
LOG = logging.getLogger("tarnlake")
CRASH = ("TARNLAKE_CRASH", "TARNLAKE_SIMULATE_CRASH", "SIMULATE_CRASH")


@dataclass
class Lake:
    """Tables of all layers below one root."""

    spark: SparkSession
    root: str
    #: Rows from which on a user or product may be hot.
    hot_rows: int = heat.LEAST

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}")

    # -- Bronze -----------------------------------------------------------------

    def land(self, path: str, now: datetime, batch_id: str | None = None) -> dict:
        """Read raw files, set aside what does not parse, stamp the rest and append it.

        The files of each landing are named by its commit, those without a valid row too; only files that no
        commit names are read. See ``landed``.
        """
        began, batch_id = time.monotonic(), batch_id or uuid.uuid4().hex[:8]
        bronze = self.table("bronze")
        there = self.spark.createDataFrame([(f,) for f in raw.files(self.spark, path)], "file string")
        files = sorted(r[0] for r in there.join(self.landed().read(), "file", "left_anti").collect())
        if not files:
            return {"rows": 0, "valid": 0, "quarantined": 0, "quarantine_pct": 0.0, "batch_id": batch_id}
        rows = raw.read_csv(self.spark, files).withColumn("source_file", F.col("_metadata.file_path"))
        valid, bad, counts = raw.split_corrupt(rows)
        raw.write_quarantine(bad, f"{self.root}/quarantine", batch_id)
        stamped = raw.stamp_lineage(valid.withColumnRenamed("source_file", "_file"), batch_id, now, "").withColumn("source_file", F.col("_file")).drop("_file")
        bronze.append(stamped, ["event_date"], metrics={"files": files})
        rows.unpersist()
        self.told("bronze", began, batch_id, now, counts["rows"], counts["valid"], [path], "bronze", quarantined_rows=counts["quarantined"], null_rate_pct=counts["quarantine_pct"])
        return counts | {"batch_id": batch_id}

    def landed(self) -> Table:
        """A row for each raw file that a commit of Bronze names, brought up to Bronze's log.

        Only commits beyond the last one noted are read. The log decides: a run that dies before it has noted a
        commit leaves it to the next one, and two runs that note the same commits only repeat rows.
        """
        bronze, ledger = self.table("bronze"), self.table("landed_files")
        last = ledger.version()
        noted = next((c.metrics["bronze_version"] for v in range(last, -1, -1) for c in ledger.commits(v, v - 1) if "bronze_version" in c.metrics), -1)
        new = bronze.commits(after=noted)
        if new or last < 0:
            rows = [(f, c.version) for c in new for f in c.metrics.get("files", [])]
            ledger.append(self.spark.createDataFrame(rows, LANDED), operation="NOTE", metrics={"bronze_version": new[-1].version if new else -1})
            if len(ledger.files()) > NOTES:
                ledger.optimize()
        return ledger

    def told(self, layer: str, began: float, batch_id: str, now: datetime, rows_in: int, rows_out: int, inputs: list[str], output: str, **more) -> None:
        """A row of pipeline_metrics, one of lineage_events and a line of the log, from figures that a job has already."""
        record_lineage(self.table("lineage_events"), layer, batch_id, inputs, self.table(output), now)
        row = metrics.record(self.table("pipeline_metrics"), layer, rows_in, rows_out, round(time.monotonic() - began, 3), batch_id, now=now, **more)
        LOG.info("%s done", layer, extra=row)

    # -- Silver -----------------------------------------------------------------

    def watermark(self, pipeline: str = "silver") -> datetime | None:
        """The stored watermark; None only where none was stored. A failed read is an error, not a first run."""
        state = self.table("watermarks")
        if not state.exists():
            return None
        rows = state.read().filter(F.col("pipeline_name") == pipeline).select(F.col("last_processed_event_time").cast("string")).collect()
        return datetime.fromisoformat(rows[0][0]) if rows and rows[0][0] else None

    def advance(self, to: str | None, batch_id: str, now: datetime, pipeline: str = "silver") -> None:
        """Move the watermark forward, never back; without a new time it stays."""
        if to is None:
            return
        state = self.table("watermarks")
        new = self.spark.createDataFrame([(pipeline, None, now, batch_id)], WATERMARK).withColumn("last_processed_event_time", F.lit(to).cast("timestamp"))
        if state.exists():
            new = state.read().unionByName(new).groupBy("pipeline_name").agg(
                F.max("last_processed_event_time").alias("last_processed_event_time"), F.max("updated_at").alias("updated_at"), F.max_by("last_batch_id", "updated_at").alias("last_batch_id")
            )
        state.overwrite(new)

    def refine(self, now: datetime, lookback: timedelta = timedelta(days=3), backfill: tuple[str, str] | None = None, batch_id: str | None = None, whole_last_day: bool = False) -> dict:
        """Bronze to Silver: filter, parse, key, merge, verify, and only then move the watermark.

        A run that dies after the merge is repaired by running again: the keys are there already. A
        backfill leaves the watermark alone.
        """
        began, batch_id = time.monotonic(), batch_id or uuid.uuid4().hex[:8]
        bronze = self.table("bronze").read()
        if backfill:
            rows = cleaning.in_range(bronze, *backfill, whole_last_day=whole_last_day)
        else:
            rows = cleaning.since_watermark(bronze, self.watermark(), lookback, "event_date")
        return self.merge(rows, now, batch_id, not backfill, began)

    def merge(self, rows: DataFrame, now: datetime, batch_id: str | None = None, advance: bool = True, began: float | None = None) -> dict:
        """Bronze rows to Silver: filter, parse, key, merge, verify, and only then move the watermark. Rows that are there already insert nothing."""
        began, batch_id, silver = began or time.monotonic(), batch_id or uuid.uuid4().hex[:8], self.table("silver")
        at = F.lit(now.isoformat(sep=" ")).cast("timestamp")
        counts = cleaning.drop_counts(rows, at).first().asDict()
        if not counts["rows_out"]:
            return counts | {"inserted": 0, "batch_id": batch_id}
        clean = cleaning.with_event_key(cleaning.parse_category(cleaning.apply_business_rules(rows, at)))
        batch = clean.withColumn("merged_at", F.lit(now)).persist()
        try:
            commit = silver.merge_insert(batch, ["event_key"], ["event_date"], bounded_by="event_date")
            inserted = commit.metrics["num_inserted"] if commit else 0
            figures = self._verified(commit, batch) if commit else {}
            if any(os.environ.get(v, "").lower() in ("1", "true", "yes") for v in CRASH):
                raise RuntimeError("crash asked for after the merge")
            newest = batch.agg(F.max("event_time").cast("string")).first()[0]
            if advance:
                self.advance(newest, batch_id, now)
        finally:
            batch.unpersist()
        nulls = 100 * (counts["rows_in"] - counts["rows_out"]) / counts["rows_in"]
        lag = int((now - datetime.fromisoformat(newest)).total_seconds())
        self.told("silver", began, batch_id, now, counts["rows_in"], inserted, [f"bronze@{self.table('bronze').version()}"], "silver", null_rate_pct=round(nulls, 4), watermark_lag_sec=lag, duplicate_rate_pct=figures.get("duplicate_rate_pct", 0.0))
        return counts | {"inserted": inserted, "batch_id": batch_id}

    def _verified(self, commit, batch: DataFrame) -> dict:
        """What a merge has written, counted by its keys: each once, and each of the batch. Also the share of the batch's rows that were no new keys."""
        written = self.table("silver").added(commit.version, commit.version - 1)
        keys = written.select("event_key").groupBy("event_key").agg(F.count("*").alias("n"))
        told = keys.join(batch.select("event_key").distinct().withColumn("asked", F.lit(1)), "event_key", "left").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count("asked").alias("asked")).first()
        if not told["rows"] == told["keys"] == told["asked"] == commit.metrics["num_inserted"]:
            raise RuntimeError(f"the commit holds {told['rows']} rows of {told['keys']} keys, {told['asked']} of them of the batch, and tells of {commit.metrics['num_inserted']}")
        n = batch.count()
        return {"duplicate_rate_pct": round(100 * (n - told["keys"]) / n, 4)}

    # -- Gold -------------------------------------------------------------------

    def star(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """fact_events, fact_purchases and the product history, from Silver.

        Enriched events are stored once for each version of Silver and read by all that build on them. Users
        and products with a large share of the events are found by a sketch and sliced by time.
        """
        silver, stored = self.table("silver"), self.table("int_events_enriched")
        version = silver.version()
        if not stored.exists() or stored.commits(after=stored.version() - 1)[-1].metrics.get("silver_version") != version:
            e = cleaning.keep_latest(silver.read(version), ["event_key"], ["ingested_at", "source_file"])
            users = heat.hot_keys(silver.read(version), "user_id", least=self.hot_rows)
            stored.overwrite(joins.enrich(sessions.sessionize(e, slice_seconds=SLICE, hot=users), cleaning.latest_products(e)), metrics={"silver_version": version})
        full = stored.read()
        hot = heat.hot_keys(full, "product_id", least=self.hot_rows)
        history = dimensions.product_history(full, SLICE, hot)
        events = facts.fact_events(full, dimensions.date_dimension(self.spark), dimensions.customer_dimension(full), history, slice_seconds=SLICE, hot=hot)
        return events, facts.fact_purchases(events), history

    def materialise(self, model, df: DataFrame) -> DataFrame:
        """For the registry: views by name, tables as new snapshots, incremental models by the days they hold."""
        if model.kind == "view":
            df.createOrReplaceTempView(model.name)
            return df
        table = self.table(model.name)
        if model.kind == "incremental" and table.exists():
            table.replace_keys(df, ["date"])
        else:
            table.overwrite(df)
        return table.read()

    def reconcile(self) -> DataFrame:
        """Rows and revenue from layer to layer: raw against Bronze by all of its files, Bronze against Silver, Silver against facts and mart."""
        bronze, silver = self.table("bronze"), self.table("silver")
        n = F.count("*")
        events, purchases, _ = self.star()
        landed = bronze.read()
        pairs = [
            reconcile.Pair("raw_vs_bronze", raw.rows_of(self.spark, landed.select("source_file")).agg(F.sum("n")), landed.agg(n), at_least=True),
            reconcile.Pair("bronze_vs_silver", landed.agg(n), silver.read().agg(n), at_least=True),
            reconcile.Pair("silver_vs_fact_events", silver.read().agg(n), events.agg(n)),
            reconcile.Pair("silver_purchases_vs_facts", silver.read().filter("event_type = 'purchase'").agg(n), purchases.agg(n)),
        ]
        if self.table("mart_daily_summary").exists():
            pairs.append(reconcile.Pair("revenue_facts_vs_mart", purchases.agg(F.round(F.sum("revenue"), 2)), self.table("mart_daily_summary").read().agg(F.round(F.sum("total_revenue"), 2))))
        return reconcile.compare(self.spark, pairs)

    def daily(self) -> Daily:
        return Daily(*[self.table(n) for n in ("silver", "product_days", "mart_daily_summary", "mart_pending", "mart_state")], least=self.hot_rows)

    def rebuild_daily(self, now: datetime, dates: list[str] | None = None, full: bool = False) -> int:
        """Bring the daily mart up to Silver's last commit (see ``daily``); the given days are counted anew besides. Returns the rows that were written."""
        began = time.monotonic()
        done = self.daily().rebuild(now, dates, full)
        if done is None:
            return 0
        self.told("gold", began, uuid.uuid4().hex[:8], now, done[1], done[0], [f"{n}@{self.table(n).version()}" for n in ("silver", "product_days")], "mart_daily_summary", watermark_lag_sec=self._lag(now))
        return done[0]

    def _lag(self, now: datetime) -> int:
        """Seconds from the stored watermark to now; 0 without one."""
        last = self.watermark()
        return int((now - last).total_seconds()) if last else 0
