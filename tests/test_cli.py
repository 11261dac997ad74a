import json
from datetime import datetime

from tarnlake.__main__ import main
from tarnlake.operators import cleaning
from tarnlake.plans.lake import Lake
from tarnlake.plans.models import build
from tarnlake.sources.adapter import clickstream
from test_lake import csv, event


def test_the_whole_way(spark, tmp_path, capsys):
    root = str(tmp_path / "lake")
    src = csv(tmp_path / "a.csv", [event(1), event(2, kind="purchase"), event(3, price="x")])
    assert main(["ingest", str(tmp_path / "raw"), "--file", src, "--date", "2024-01-05"]) == 0
    assert main(["raw-checks", str(tmp_path / "raw"), "--min-bytes", "10"]) == 0
    assert main(["land", root, str(tmp_path / "raw")]) == 0
    assert main(["refine", root]) == 0
    assert main(["marts", root]) == 0
    assert main(["gate", root, "--report", str(tmp_path / "gate.json")]) == 0
    assert main(["reconcile", root, "--audit", str(tmp_path / "audit")]) == 0
    assert main(["replay", root, "--start-date", "2024-01-01", "--end-date", "2024-01-03", "--dry-run"]) == 0
    assert main(["history", f"{root}/silver"]) == 0 and main(["show", f"{root}/silver", "--version", "0"]) == 0
    assert main(["optimize", f"{root}/silver", "--zorder", "user_id", "--files", "2"]) == 0
    assert {"bronze", "silver", "gold"} <= {json.loads(x)["layer"] for x in capsys.readouterr().err.splitlines() if x.startswith("{")}
    assert main(["stream", f"{root}2", str(tmp_path / "raw"), "--marts"]) == 0
    assert json.loads(capsys.readouterr().out) == {"rows": 3, "valid": 2, "quarantined": 1, "merged": 2}
    (tmp_path / "v1.json").write_text(json.dumps({"columns": {"a": {"type": "long"}}}))
    (tmp_path / "v2.json").write_text(json.dumps({"columns": {}}))
    assert main(["contract-diff", str(tmp_path / "v1.json"), str(tmp_path / "v2.json")]) == 1
    assert main(["contract-validate", src, str(tmp_path / "v1.json")]) == 0


def test_bad_rows_fail_the_gate(spark, tmp_path):
    from tarnlake.__main__ import gate_suites
    from tarnlake.quality import checks

    lake = Lake(spark, str(tmp_path / "lake"))
    csv(tmp_path / "raw" / "a.csv", [event(1), event(1), event(2)])
    lake.land(str(tmp_path / "raw"), datetime(2024, 1, 3))
    lake.refine(datetime(2024, 1, 3))
    silver = lake.table("silver")
    silver.append(silver.read().limit(1))  # a key twice
    code, out = checks.gate(gate_suites(lake, "2024-01-03 00:00:00"))
    assert code == 1 and out["failed"] == ["silver"]


def test_models_materialise(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    r = build(clickstream(spark, "/root/testdata/sf0.001").limit(200))
    for _ in range(2):
        built = r.run(r.select("+mart_daily_summary"), materialise=lake.materialise, retries=0)
    assert built["mart_daily_summary"].count() == built["mart_daily_summary"].select("date", "category_l1").distinct().count()
    assert lake.table("dim_product").exists() and not lake.table("stg_events").exists()
    assert cleaning.duplicate_rate(built["fact_events"], "event_key").first()["duplicate_rate_pct"] == 0
