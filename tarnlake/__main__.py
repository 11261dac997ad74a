"""Command line: landing, refining, marts, replay, contracts, quality gates and table history."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime, timedelta

from .plans import replay as replays
from .plans.lake import Lake
from .plans.models import build
from .quality import alerts, checks, contracts, metrics, reconcile
from .session import session
from .sources import raw
from .sources.table import Table
from .streaming import landing


#: Names the address that failures are posted to; without it, or where it fails, they go to the table ``alerts``.
WEBHOOK = "TARNLAKE_WEBHOOK"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnlake", description=__doc__)
    p.add_argument("--master")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark setting, such as an object store's endpoint")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        s = sub.add_parser(name)
        for a in positional:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", **v)

    command("ingest", "raw", file={"action": "append", "required": True}, date={})
    command("land", "root", "path", batch_id={})
    command("stream", "root", "path", marts={"action": "store_true", "help": "bring Silver and the daily mart up to date too"})
    command("refine", "root", lookback_days={"type": int, "default": 3}, start_date={}, end_date={}, whole_last_day={"action": "store_true"})
    command("marts", "root", full={"action": "store_true"})
    command("replay", "root", mode={"choices": sorted(replays.MODES), "default": "backfill"}, start_date={}, end_date={}, requested_by={"default": "unknown"}, dry_run={"action": "store_true"}, audit={})
    command("contract-diff", "old", "new")
    command("contract-validate", "data", "contract", strict={"action": "store_true"}, quarantine={})
    command("raw-checks", "folder", max_age_days={"type": int, "default": 30}, min_bytes={"type": int, "default": 100_000})
    command("contract-register", "root", "contract", status={"default": "COMPATIBLE"}, validation={"default": "UNVALIDATED"})
    command("contract-list", "root", dataset={}, active_only={"action": "store_true"})
    command("gate", "root", report={}, raw={"help": "folder of raw files, checked too"}, max_age_days={"type": int, "default": 30}, min_bytes={"type": int, "default": 100_000})
    command("run", "root", select={"action": "append", "default": []}, retries={"type": int, "default": 3}, wait={"type": float, "default": 120.0})
    command("test", "root", select={"action": "append", "default": []})
    command("ls", "root", select={"action": "append", "default": []})
    command("vacuum", "table", keep_versions={"type": int, "default": 10})
    command("reconcile", "root", audit={})
    command("history", "table")
    command("show", "table", version={"type": int}, limit={"type": int, "default": 20})
    command("optimize", "table", zorder={"action": "append", "default": []}, files={"type": int, "default": 8})
    return p


def raw_suite(lake: Lake, folder: str, now: datetime, max_age_days: int = 30, min_bytes: int = 100_000):
    """The structural checks of a raw folder as checks of a gate."""
    told = [(x["check"], folder, None if x["value"] is None or isinstance(x["value"], str) else float(x["value"]), "pass" if x["passed"] else "fail") for x in raw.structural_checks(lake.spark, folder, now, max_age_days, min_bytes)]
    return lake.spark.createDataFrame(told, "metric string, columns string, value double, outcome string")


def gate_suites(lake: Lake, now: str) -> dict:
    """The suites of Bronze and Silver: their columns, then their metrics."""
    columns = [f.name for f in raw.EVENT_SCHEMA]
    c = checks.Check
    required = [c("missing_count", [x], fail="> 0") for x in ("event_time", "product_id", "user_id", "price")]
    bronze = [*required, c("missing_count", ["brand"]), c("missing_count", ["category_code"]), c("row_count", fail="<= 0"), c("duplicate_percent", ["event_time", "user_id", "product_id", "event_type"], fail=">= 50", warn="> 10"), c("freshness_days", ["ingested_at"], fail="> 30", warn="> 7")]
    silver = [c("duplicate_count", ["event_key"], fail="> 0"), c("min", ["price"], fail="< 0"), c("missing_count", ["user_session"], fail="> 0"), c("missing_count", ["category_l1"], warn="> 0"), c("row_count", fail="<= 0")]
    return {"bronze_schema": lambda: checks.schema_suite(lake.table("bronze").read(), [*columns, "ingested_at", "source_file", "batch_id"]), "silver_schema": lambda: checks.schema_suite(lake.table("silver").read(), [*columns, "event_key", "category_l1"]), "bronze": lambda: checks.run(lake.table("bronze").read(), bronze, now), "silver": lambda: checks.run(lake.table("silver").read(), silver, now)}


def models_command(lake: Lake, a: argparse.Namespace) -> int:
    """Build, test or list the models over Silver that selectors name; all without any."""
    registry = build(lake.table("silver").read())
    names = registry.select(*a.select) if a.select else registry.order()
    if a.command == "ls":
        print(json.dumps(names))
        return 0
    failed = []
    hook = os.environ.get(WEBHOOK)
    alert = alerts.in_turn(*([alerts.webhook(hook)] if hook else []), alerts.to_table(lake.table("alerts")))

    def told(name: str, error: Exception) -> None:
        failed.append({"model": name, "error": str(error)[:500], "alerted": alert(name, error)})

    try:
        built = registry.run(names, lake.materialise, getattr(a, "retries", 0), getattr(a, "wait", 0.0), told)
    except Exception:
        print(json.dumps({"failed": failed}, indent=2))
        return 1
    tests = registry.test({n: built[n] for n in names}) if a.command == "test" else []
    print(json.dumps({"models": names, "tests": tests}, indent=2))
    return int(any(t["violations"] for t in tests))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "contract-diff":
        out = contracts.diff(contracts.load(a.old), contracts.load(a.new))
        print(json.dumps(out, indent=2))
        return int(out["overall_status"] == "BREAKING")
    metrics.json_logs()
    spark = session(master=a.master, **{k.replace(".", "__"): v for k, v in (x.split("=", 1) for x in a.conf)})
    now = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    if a.command == "ingest":
        print(raw.ingest(spark, a.file, a.raw, a.date))
        return 0
    if a.command == "contract-validate":
        contract = contracts.load(a.contract)
        out = contracts.validate_csv(spark, a.data, contract, a.strict, now)
        if not out["valid"] and a.quarantine:
            out["quarantine"] = contracts.quarantine(spark, a.data, out["violations"], a.quarantine)
        print(json.dumps(out, indent=2))
        return int(not out["valid"])
    if a.command == "raw-checks":
        out = raw.structural_checks(spark, a.folder, now, a.max_age_days, a.min_bytes)
        print(json.dumps(out, indent=2, default=str))
        return int(not all(x["passed"] for x in out))
    if a.command in ("history", "show", "optimize", "vacuum"):
        t = Table(spark, a.table)
        if a.command == "vacuum":
            print(json.dumps({"deleted": t.vacuum(a.keep_versions)}))
            return 0
        if a.command == "optimize":
            t.optimize(a.zorder or None, a.files)
        (t.read(a.version).limit(a.limit) if a.command == "show" else t.history()).show(a.limit if a.command == "show" else 1000, truncate=False)
        return 0
    lake = Lake(spark, a.root)
    if a.command == "gate":
        suites = {"raw": lambda: raw_suite(lake, a.raw, now, a.max_age_days, a.min_bytes)} if a.raw else {}
        code, out = checks.gate(suites | gate_suites(lake, now.isoformat(sep=" ")), a.report)
        print(json.dumps(out, indent=2, default=str))
        return code
    if a.command == "contract-register":
        contracts.register(lake.table("contract_registry"), contracts.load(a.contract), a.status, a.validation, now)
    if a.command in ("contract-register", "contract-list"):
        listed = contracts.listing(lake.table("contract_registry"), getattr(a, "dataset", None), getattr(a, "active_only", False))
        print(json.dumps([r.asDict() for r in listed.collect()], indent=2, default=str))
        return 0
    if a.command in ("run", "test", "ls"):
        return models_command(lake, a)
    if a.command == "reconcile":
        results = lake.reconcile()
        reconcile.record(lake.table("reconciliation_results"), results, now, a.audit)
        results.show(truncate=False)
        return reconcile.exit_code(results)
    if a.command == "land":
        out = lake.land(a.path, now, a.batch_id)
    elif a.command == "stream":
        out = landing.land(lake, a.path, now)
        if a.marts and lake.table("bronze").exists():
            out["merged"] = landing.marts(lake, landing.bronze_stream(lake), now)
    elif a.command == "refine":
        out = lake.refine(now, timedelta(days=a.lookback_days), (a.start_date, a.end_date) if a.start_date and a.end_date else None, whole_last_day=a.whole_last_day)
    elif a.command == "marts":
        out = {"rows": lake.rebuild_daily(now, full=a.full)}
    else:
        out = replays.replay(lake, a.mode, a.start_date, a.end_date, a.requested_by, a.dry_run, now, a.audit)
    print(json.dumps(out, indent=2, default=str))
    return int(out.get("status") == "FAILED")


if __name__ == "__main__":
    sys.exit(main())
