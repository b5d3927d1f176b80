"""Checks as plug-ins: what each needs, whether it can run, and running them in order of dependence."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table

BUDGETS = ("QUICK", "STANDARD", "DEEP")


@dataclass(frozen=True)
class Mode:
    name: str
    needs: tuple[str, ...] = ()
    degraded: bool = False
    budget: str = "QUICK"


@dataclass(frozen=True)
class Check:
    """A detector: capabilities, modes from best to worst, and ``run(context) -> Frames`` with lazy DataFrames."""

    id: str
    layer: str
    run: Callable[[Context], Frames]
    required: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    modes: tuple[Mode, ...] = (Mode("default"),)
    supports: dict[str, str] = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    budget: str = "QUICK"
    precondition: Callable[[Context], str | None] = lambda context: None


@dataclass
class Frames:
    """What a check found; frames that it does not fill are None."""

    findings: DataFrame | None = None
    flags: DataFrame | None = None
    metrics: dict[str, object] = field(default_factory=dict)
    abstained: str | None = None


@dataclass
class Context:
    spark: SparkSession
    roles: dict[str, DataFrame]
    capabilities: frozenset[str]
    withheld: frozenset[str] = frozenset()
    budget: str = "STANDARD"
    params: dict[str, dict] = field(default_factory=dict)
    upstream: dict[str, Frames] = field(default_factory=dict)
    mode: str | None = None


@dataclass(frozen=True)
class Planned:
    check: Check
    availability: str
    mode: str | None = None
    reasons: tuple[str, ...] = ()

    @property
    def runnable(self) -> bool:
        return self.availability in ("READY", "DEGRADED")


def capabilities(samples: DataFrame, prefix: str = "dataset") -> frozenset[str]:
    """What one aggregate row says that the samples can support."""
    has = lambda c: c in samples.columns
    n = F.count("*")
    tests = {f"{prefix}.rows": n > 0}
    if has("label"):
        tests[f"{prefix}.labels"] = (F.count("label") >= 20) & (2 * F.count("label") >= n) & (F.count_distinct("label") >= 2)
    if has("contributor"):
        tests[f"{prefix}.contributors"] = F.count_distinct(F.nullif("contributor", F.lit(""))) >= 2
    for c in ("timestamp", "boxes", "embedding", "digest"):
        if has(c):
            tests[f"{prefix}.{c}"] = F.count(c) > 0
    row = samples.agg(*(t.alias(k) for k, t in tests.items())).first()
    return frozenset(k for k in tests if row[k])


def negotiate(check: Check, context: Context) -> Planned:
    """Capabilities first, then preconditions, then budget, then the first mode that can run."""
    has = context.capabilities - context.withheld
    missing = [c for c in check.required if c not in has] + [" or ".join(g) for g in check.any_of if not has.intersection(g)]
    if missing:
        kind = "withheld" if context.withheld.intersection(check.required) else "not present"
        return Planned(check, "UNAVAILABLE", None, (f"{kind}: {', '.join(missing)}",))
    if reason := check.precondition(context):
        return Planned(check, "UNAVAILABLE", None, (reason,))
    allowed = BUDGETS.index(context.budget)
    if BUDGETS.index(check.budget) > allowed:
        return Planned(check, "BUDGET_EXCLUDED", None, (f"needs budget {check.budget}",))
    passed = []
    for mode in check.modes:
        if lacking := [c for c in mode.needs if c not in has]:
            passed.append(f"mode {mode.name} needs {', '.join(lacking)}")
        elif BUDGETS.index(mode.budget) > allowed:
            passed.append(f"mode {mode.name} needs budget {mode.budget}")
        else:
            return Planned(check, "DEGRADED" if mode.degraded else "READY", mode.name, tuple(passed) if mode.degraded else ())
    return Planned(check, "BUDGET_EXCLUDED" if all("budget" in p for p in passed) else "UNAVAILABLE", None, tuple(passed))


def build_plan(checks: list[Check], context: Context) -> list[Planned]:
    """One entry for every check, dependencies first; a check whose dependency cannot run cannot either."""
    by_id = {c.id: c for c in checks}
    order = TopologicalSorter({c.id: c.depends_on for c in checks}).static_order()
    out: dict[str, Planned] = {}
    for name in order:
        p = negotiate(by_id[name], context)
        blocked = [d for d in by_id[name].depends_on if not out[d].runnable]
        if p.runnable and blocked:
            kind = "BUDGET_EXCLUDED" if all(out[d].availability == "BUDGET_EXCLUDED" for d in blocked) else "UNAVAILABLE"
            p = Planned(p.check, kind, None, (f"depends on {', '.join(blocked)}",))
        out[name] = p
    return list(out.values())


def _written(found: Frames) -> Frames:
    """``found`` with its frames computed, so that what fails in them fails here."""
    return replace(found, findings=found.findings if found.findings is None else shared_table(found.findings), flags=found.flags if found.flags is None else shared_table(found.flags))


def execute(plan: list[Planned], context: Context) -> tuple[list[dict], dict[str, Frames]]:
    """Run what can run. An exception, also one that comes up only while rows are computed, is that check's ERROR and its
    dependants', and nobody else's: each check's frames are written before the next one runs."""
    states: dict[str, str] = {}
    log, frames = [], {}
    for p in plan:
        name, began, reason = p.check.id, time.monotonic(), "; ".join(p.reasons)
        bad = [d for d in p.check.depends_on if states.get(d) == "ERROR"]
        idle = [d for d in p.check.depends_on if states.get(d) in ("ABSTAINED", "NOT_RUN")]
        if not p.runnable:
            states[name] = "NOT_RUN"
        elif bad or idle:
            states[name], reason = ("ERROR", f"failed before it: {', '.join(bad)}") if bad else ("ABSTAINED", f"no result before it: {', '.join(idle)}")
        else:
            try:
                own = Context(context.spark, context.roles, context.capabilities, context.withheld, context.budget, context.params, frames, p.mode)
                frames[name] = _written(p.check.run(own))
                states[name] = "ABSTAINED" if frames[name].abstained else "COMPLETED_DEGRADED" if p.availability == "DEGRADED" else "COMPLETED"
                reason = frames[name].abstained or reason
            except Exception as e:  # a check's failure is a result of the scan
                states[name], reason = "ERROR", f"{type(e).__name__}: {e}"[:800]
        log.append({"detector_id": name, "layer": p.check.layer, "state": states[name], "mode": p.mode, "reason": reason, "runtime_ms": (time.monotonic() - began) * 1000})
    return log, frames


def scan(checks: list[Check], context: Context) -> tuple[list[dict], DataFrame | None, DataFrame | None]:
    """(execution log, findings, flags) of all checks, the frames lazily joined by name."""
    log, frames = execute(build_plan(checks, context), context)

    def union(parts):
        parts = [p for p in parts if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    return log, union(f.findings for f in frames.values()), union(f.flags for f in frames.values())
