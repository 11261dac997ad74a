"""Models with their dependencies: selection, ordered runs with retries, and lineage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    kind: str = "table"
    tests: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass
class Registry:
    models: dict[str, Model] = field(default_factory=dict)
    exposures: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def model(self, name: str, layer: str, needs: tuple[str, ...] = (), kind: str = "table", tests: tuple = ()):
        def add(f):
            self.models[name] = Model(name, layer, f, needs, kind, tests)
            return f

        return add

    def order(self) -> list[str]:
        """Models after all they need; a cycle or an unknown name is an error."""
        done: list[str] = []
        left = dict(self.models)
        for m in left.values():
            if lost := [n for n in m.needs if n not in self.models]:
                raise ValueError(f"{m.name} needs unknown models: {', '.join(lost)}")
        while left:
            ready = sorted(n for n, m in left.items() if all(d in done for d in m.needs))
            if not ready:
                raise ValueError(f"cycle among {', '.join(sorted(left))}")
            done += ready
            for n in ready:
                del left[n]
        return done

    def upstream(self, name: str) -> set[str]:
        out = {name}
        for n in self.models[name].needs:
            out |= self.upstream(n)
        return out

    def downstream(self, name: str) -> set[str]:
        return {n for n in self.models if name in self.upstream(n)}

    def select(self, *selectors: str) -> list[str]:
        """``name``, ``+name`` with all it needs, ``name+`` with all that need it, ``layer:x``, ``exposure:x`` and ``+exposure:x``; in order."""
        chosen: set[str] = set()
        for s in selectors:
            up, down = s.startswith("+"), s.endswith("+")
            core = s.strip("+")
            if core.startswith("layer:"):
                names = {n for n, m in self.models.items() if m.layer == core[6:]}
            elif core.startswith("exposure:"):
                names = set(self.exposures[core[9:]])
            elif core in self.models:
                names = {core}
            else:
                raise ValueError(f"nothing is named {core}")
            if not names:
                raise ValueError(f"{s} selects nothing")
            for n in names:
                chosen |= {n} | (self.upstream(n) if up else set()) | (self.downstream(n) if down else set())
        return [n for n in self.order() if n in chosen]

    def run(self, names: list[str] | None = None, materialise: Callable[[Model, DataFrame], DataFrame] | None = None, retries: int = 3, wait: float = 120.0, on_failure: Callable[[str, Exception], None] | None = None, sleep: Callable = time.sleep) -> dict[str, DataFrame]:
        """Build models in order, each from what it needs (built, too, if it is not selected). Failures are tried again after growing waits, then reported and raised."""
        built: dict[str, DataFrame] = {}

        def make(name: str) -> DataFrame:
            if name not in built:
                m = self.models[name]
                inputs = [make(n) for n in m.needs]
                for i in range(retries + 1):
                    try:
                        df = m.build(*inputs)
                        built[name] = materialise(m, df) if materialise and m.kind != "view" else df
                        break
                    except Exception as e:
                        if i == retries:
                            if on_failure:
                                on_failure(name, e)
                            raise
                        sleep(wait * 2**i)
            return built[name]

        for n in names or self.order():
            make(n)
        return built

    def test(self, built: dict[str, DataFrame]) -> list[dict]:
        """Each model's tests: a test passes if it returns no rows."""
        return [{"model": n, "test": i, "violations": t(df).count()} for n, df in built.items() for i, t in enumerate(self.models[n].tests)]

    def graph(self) -> dict:
        """Nodes, links between known nodes, and the models of each layer."""
        nodes = [{"id": n, "layer": m.layer, "kind": m.kind} for n, m in sorted(self.models.items())]
        links = [{"source": d, "target": n} for n, m in sorted(self.models.items()) for d in m.needs]
        nodes += [{"id": e, "layer": "exposure", "kind": "exposure"} for e in sorted(self.exposures)]
        links += [{"source": m, "target": e} for e, ms in sorted(self.exposures.items()) for m in ms]
        known = {x["id"] for x in nodes}
        links = [x for x in links if x["source"] in known and x["target"] in known]
        layers: dict[str, int] = {}
        for x in nodes:
            layers[x["layer"]] = layers.get(x["layer"], 0) + 1
        return {"nodes": nodes, "links": links, "layers": layers}


def from_manifest(path: str) -> dict:
    """Nodes and links of a build manifest in JSON (``nodes`` and ``sources``, each with ``depends_on.nodes``); links to unknown nodes are dropped."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    every = told.get("sources", {}) | {k: v for k, v in told.get("nodes", {}).items() if v.get("resource_type") != "test"} | told.get("exposures", {})
    nodes = [{"id": k, "name": v.get("name", k), "kind": v.get("resource_type", "source")} for k, v in sorted(every.items())]
    links = [{"source": d, "target": k} for k, v in sorted(every.items()) for d in v.get("depends_on", {}).get("nodes", []) if d in every]
    return {"nodes": nodes, "links": links}


LINEAGE = "run_id string, job string, event_type string, event_time timestamp, inputs array<string>, output string, output_version int, fields array<struct<name: string, type: string>>"


def record_lineage(table, job: str, run_id: str, inputs: list[str], output, now: datetime, kind: str = "COMPLETE") -> None:
    """A row for what a job has read and which version of a table it wrote, with that version's columns; inputs are paths or ``table@version``."""
    version = output.version()
    fields = [(f.name, f.dataType.simpleString()) for f in output.schema(version)] if version >= 0 else []
    table.append(table.spark.createDataFrame([(run_id, job, kind, now, inputs, output.path.rsplit("/", 1)[-1], version, fields)], LINEAGE))


def lineage_event(job: str, inputs: list[DataFrame], output: DataFrame, name: str, kind: str = "COMPLETE", sink: str | None = None, now: datetime | None = None) -> dict:
    """A run event with all files that the inputs read and the schemas of both sides, appended as a JSON line where a sink is given."""

    def dataset(df: DataFrame, label: str) -> dict:
        return {"name": label, "fields": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]}

    event = {
        "eventType": kind, "eventTime": (now or datetime.now(UTC)).isoformat(), "run": {"runId": str(uuid.uuid4())}, "job": {"name": job},
        "inputs": [dataset(df, ",".join(sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})) or "memory") | {"files": sorted(df.inputFiles())} for df in inputs], "outputs": [dataset(output, name)],
    }
    if sink:
        with open(sink, "a", encoding="utf-8") as f:
            f.write(json.dumps(event) + "\n")
    return event
