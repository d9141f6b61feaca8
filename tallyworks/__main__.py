"""``python -m tallyworks TASK``: the engine's tasks from a command line.

A store is a folder; a folder of agent modules, each with ``make()``, says what a tick dispatches to.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from .operators import telemetry
from .plans import catalog
from .session import session
from .sources import files, golden, readers
from .sources.writers import Store
from .streaming import tick as cycle


def _tick(spark, a) -> int:
    """one refresh of a store: --agents, --manifest, --dry-run, --live, --max-spend, --limit, --export"""
    limits = cycle.Limits(dry_run=a.dry_run, live=a.live, max_spend=a.max_spend, items=a.limit)
    manifest = readers.read_manifest(spark, a.manifest) if a.manifest else None
    done = cycle.tick(Store(spark, a.store), cycle.Registry().discover(a.agents), a.export, limits, manifest)
    print(json.dumps(done, sort_keys=True))
    return 2 if "refused" in done else 0


def _agents(spark, a) -> int:
    """the agents of a folder in their order, and modules that couldn't be used"""
    found = cycle.Registry().discover(a.agents)
    print("\n".join([x.name for x in found.in_order()] + [f"! {p}" for p in found.problems]))
    return 1 if found.problems else 0


def _queries(spark, a) -> int:
    """names of all queries; those without SQL are marked"""
    own, known = catalog.queries(), catalog.oracle_sql()
    print("\n".join(n if n in known else f"{n} *" for n in sorted(own)))
    return 0


def _run(spark, a) -> int:
    """one query over a folder of tables: --query, --data"""
    catalog.queries()[a.query](spark, a.data).show(a.limit or 20, truncate=False)
    return 0


def _counts(spark, a) -> int:
    """rows of every table of a store"""
    print(json.dumps(Store(spark, a.store).counts(), sort_keys=True))
    return 0


def _export(spark, a) -> int:
    """every table of a store as Parquet and CSV: --export"""
    print("\n".join(Store(spark, a.store).export(a.export)))
    return 0


def _migrate(spark, a) -> int:
    """columns that older versions of a store's tables lack"""
    print(json.dumps(Store(spark, a.store).migrate(), sort_keys=True))
    return 0


def _vacuum(spark, a) -> int:
    """all but the last two versions of a store's tables go"""
    Store(spark, a.store).vacuum()
    return 0


def _cost(spark, a) -> int:
    """what the runs of a store would cost at list price"""
    for r in telemetry.spent(Store(spark, a.store).read("agent_runs")).orderBy("model").collect():
        print(f"{r.model}: {r.calls} calls, {r.input_tokens or 0:,} in, {r.output_tokens or 0:,} out, ${r.cost_usd or 0:.4f}")
    return 0


def _golden(spark, a) -> int:
    """golden cases over a store's awards: --cases"""
    results, code = golden.run_cases(Store(spark, a.store).read("awards"), golden.load_cases(spark, a.cases))
    for name, r in results.items():
        print(f"{name}: {r['passed']} passed, {r['failed']} failed, {r['blocked']} blocked")
    return code


def _promote_skills(spark, a) -> int:
    """a rule tried on the golden cases, added to a skills file if it does good: --rule, --skills, --cases, --agents, --store, --apply"""
    agent = cycle.Registry().discover(a.agents).agents["extract"]
    cases = golden.load_cases(spark, a.cases)
    documents = Store(spark, a.store).read("announcements").where(F.col("announcement_id").isin([c["announcement_id"] for c in cases]))
    verdict, wrong = golden.promote(spark, cases, lambda skills: agent.with_skills(skills).run(documents), a.skills, files.read_text(spark, a.rule), a.apply)
    print("\n".join([verdict, *(f"{k}: {w}" for k, w in sorted(wrong.items()))]))
    return golden.VERDICTS[verdict]


def _selftest(spark, a) -> int:
    """a store made, ticked without agents and counted in a new folder"""
    store = Store(spark, a.store)
    done = cycle.tick(store, cycle.Registry())
    return 0 if done["changes"] == {} and set(store.counts().values()) == {0} else 1


TASKS: dict[str, Callable] = {
    f.__name__[1:].replace("_", "-"): f for f in (_tick, _agents, _queries, _run, _counts, _export, _migrate, _vacuum, _cost, _golden, _promote_skills, _selftest)
}


def main(argv: list[str]) -> int:
    help_text = "\n".join(f"  {n:14} {f.__doc__}" for n, f in TASKS.items())
    p = argparse.ArgumentParser("tallyworks", epilog=f"tasks:\n{help_text}", formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("task", choices=TASKS)
    for name in ("store", "agents", "manifest", "export", "data", "query", "cases", "rule", "skills"):
        p.add_argument(f"--{name}")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--live", action="store_true")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--max-spend", type=float)
    p.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    return TASKS[a.task](None if a.task in ("agents", "queries") else session(), a)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
