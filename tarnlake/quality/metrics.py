"""Run metrics, structured logs and audit rows."""

from __future__ import annotations

import json
import logging
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.table import Table

SCHEMA = "batch_id string, run_timestamp timestamp, layer string, input_rows long, output_rows long, quarantined_rows long, duplicate_rate_pct double, null_rate_pct double, duration_sec double, throughput_rows_sec double, watermark_lag_sec long, status string"


def record(table: Table, layer: str, input_rows: int, output_rows: int, duration_sec: float, batch_id: str | None = None, quarantined_rows: int = 0, duplicate_rate_pct: float = 0.0, null_rate_pct: float = 0.0, watermark_lag_sec: int = 0, status: str = "SUCCESS", now: datetime | None = None, folder: str | None = None) -> dict:
    """Append a row of metrics, and write it as JSON too where a folder is given. Throughput is output rows a second, or the rows themselves for no time."""
    now = now or datetime.now(UTC)
    batch_id = batch_id or uuid.uuid4().hex[:8]
    speed = round(output_rows / duration_sec, 2) if duration_sec > 0 else float(output_rows)
    row = (batch_id, now, layer, input_rows, output_rows, quarantined_rows, duplicate_rate_pct, null_rate_pct, float(duration_sec), speed, watermark_lag_sec, status)
    table.append(table.spark.createDataFrame([row], SCHEMA))
    told = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], row, strict=True))
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / f"metrics_{batch_id}.json").write_text(json.dumps(told, indent=2, default=str))
    return told


def observed(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has their count once they were used; no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def json_logs(level: int = logging.INFO, stream=None) -> logging.Handler:
    """The engine's log as JSON lines, on standard error unless a stream is given; a second call replaces the first's handler."""
    log = logging.getLogger("tarnlake")
    for old in [h for h in log.handlers if isinstance(h.formatter, JsonFormatter)]:
        log.removeHandler(old)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonFormatter())
    log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False
    return handler


class JsonFormatter(logging.Formatter):
    """One JSON object a line, with all that was passed as ``extra``."""

    _OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        body = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "event": record.getMessage()}
        return json.dumps(body | {k: v for k, v in record.__dict__.items() if k not in self._OWN}, default=str)
