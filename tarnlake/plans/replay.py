"""Replays: a plan that can be shown first, its steps, and an audit row."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from .lake import Lake

MODES = {"backfill": ("silver", "gold"), "reprocess": ("silver", "gold"), "rebuild_silver": ("silver",), "rebuild_gold": ("gold",)}
SCHEMA = "replay_id string, requested_at timestamp, requested_by string, mode string, start_date string, end_date string, rows_read long, rows_inserted long, duration_sec double, status string, silver_step string, gold_step string"
SKIPPED = "SKIPPED_NOT_REQUIRED"


def status_of(silver: str, gold: str) -> str:
    """FAILED if a step failed, SUCCESS if all required steps ran, else PARTIAL."""
    steps = {silver, gold}
    if "FAILED" in steps:
        return "FAILED"
    return "SUCCESS" if silver == gold == "SUCCESS" else "PARTIAL"


def days_between(start: str, end: str) -> list[str]:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return [(a + timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]


def replay(lake: Lake, mode: str = "backfill", start: str | None = None, end: str | None = None, requested_by: str = "unknown", dry_run: bool = False, now: datetime | None = None, folder: str | None = None) -> dict:
    """Merge a range of days again and rebuild their marts; the watermark is never touched.

    backfill merges what Silver lacks; reprocess also rebuilds all marts; rebuild_silver and
    rebuild_gold do one of the steps.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if (start is None) != (end is None):
        raise ValueError("give both ends of the range or none")
    now = now or datetime.now(UTC).replace(tzinfo=None)
    plan = {"replay_id": uuid.uuid4().hex[:8], "mode": mode, "start_date": start, "end_date": end, "steps": list(MODES[mode]), "watermark_isolated": True}
    if dry_run:
        return plan | {"status": "DRY_RUN"}
    began, silver, gold, read, inserted = datetime.now(UTC), SKIPPED, SKIPPED, 0, 0
    span = (start or "2019-01-01", end or now.date().isoformat())
    if "silver" in MODES[mode]:
        try:
            done = lake.refine(now, backfill=span, whole_last_day=True)
            silver, read, inserted = "SUCCESS", done["rows_in"], done["inserted"]
        except Exception as e:
            silver, plan["error"] = "FAILED", str(e)[:500]
    if "gold" in MODES[mode] and silver != "FAILED":
        try:
            lake.rebuild_daily(now, None if start is None or mode == "reprocess" else days_between(start, end), full=start is None or mode == "reprocess")
            gold = "SUCCESS"
        except Exception as e:
            gold, plan["error"] = "FAILED", str(e)[:500]
    seconds = (datetime.now(UTC) - began).total_seconds()
    out = plan | {"silver_step": silver, "gold_step": gold, "status": status_of(silver, gold), "rows_read": read, "rows_inserted": inserted, "duration_sec": seconds}
    row = (plan["replay_id"], now, requested_by, mode, start or "ALL", end or "ALL", read, inserted, seconds, out["status"], silver, gold)
    lake.table("replay_audit").append(lake.spark.createDataFrame([row], SCHEMA))
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / f"replay_{plan['replay_id']}.json").write_text(json.dumps(out, indent=2, default=str))
    return out
