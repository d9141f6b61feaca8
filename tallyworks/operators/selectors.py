"""Expectations on rows: selectors compiled to columns, checks, and the gate between two rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(df: DataFrame, field: str, want: object) -> Column:
    """One field of a selector: a value, or {"in", "not", "contains", "startswith", "is_null"}. Booleans never equal numbers; "not" is true of null."""
    if field not in df.columns:
        raise ValueError(f"no column {field}")
    c, kind = F.col(field), df.schema[field].dataType.simpleString()

    def same(v: object) -> Column:
        if v is None:
            return c.isNull()
        if isinstance(v, bool) != (kind == "boolean"):
            return F.lit(False)
        if isinstance(v, str) != (kind in ("string", "date", "timestamp")):
            return F.lit(False)
        return F.coalesce(c == F.lit(v), F.lit(False))

    if not isinstance(want, dict):
        return same(want)
    out = F.lit(True)
    for op, v in want.items():
        if op == "in":
            some = F.lit(False)
            for x in v:
                some = some | same(x)
            out = out & some
        elif op == "not":
            out = out & ~same(v)
        elif op == "contains":
            out = out & F.coalesce(c.cast("string").contains(v), F.lit(False))
        elif op == "startswith":
            out = out & F.coalesce(c.cast("string").startswith(v), F.lit(False))
        elif op == "is_null":
            out = out & (c.isNull() if v else c.isNotNull())
        else:
            raise ValueError(f"unknown operator {op}")
    return out


def select(df: DataFrame, selector: dict) -> DataFrame:
    for field, want in selector.items():
        df = df.where(condition(df, field, want))
    return df


def run_check(df: DataFrame, check: dict) -> str | None:
    """What is wrong, or None. Kinds: "row" (exactly one, as expected), "count", "absent"."""
    rows = select(df, check["select"])
    if check["kind"] in ("count", "absent"):
        n, want = rows.count(), check.get("expect", 0) if check["kind"] == "count" else 0
        return None if n == want else f"{n} rows, not {want}"
    n = rows.limit(2).count()
    if n != 1:
        return f"{'several' if n else 'no'} rows match"
    wrong = [f for f, v in check["expect"].items() if not rows.where(condition(rows, f, v)).count()]
    return f"differs in {', '.join(wrong)}" if wrong else None


def run_cases_once(df: DataFrame, cases: list[dict], document: str = "announcement_id") -> dict[str, dict[str, str | None]]:
    """What is wrong, or None, of every check of every case, by case and check id: one conditional aggregation over the cases' documents.

    A check becomes a count of the rows it selects and, for "row", a count for each field it expects; one that can't be compiled is
    "blocked: ..." and leaves the others alone.
    """
    found: dict[str, dict[str, str | None]] = {c["case_id"]: {} for c in cases}
    counts: list[Column] = []
    plans = []

    def counted(c: Column) -> int:
        counts.append(F.count_if(c).alias(f"n{len(counts)}"))
        return len(counts) - 1

    for case in cases:
        own = F.coalesce(F.col(document) == case[document], F.lit(False))
        for check in case["checks"]:
            try:
                rows = own
                for field, want in check["select"].items():
                    rows = rows & condition(df, field, want)
                fields = {f: rows & condition(df, f, v) for f, v in check["expect"].items()} if check["kind"] == "row" else {}
            except Exception as e:  # noqa: BLE001  whatever stops a check blocks it
                found[case["case_id"]][check["id"]] = f"blocked: {e}"
                continue
            plans.append((case["case_id"], check, counted(rows), {f: counted(c) for f, c in fields.items()}))
    if not counts:
        return found
    got = df.where(F.col(document).isin([c[document] for c in cases])).agg(*counts).first()
    for case_id, check, n, fields in plans:
        if check["kind"] == "row":
            wrong = [f for f, k in fields.items() if not got[k]]
            told = f"{'several' if got[n] else 'no'} rows match" if got[n] != 1 else f"differs in {', '.join(wrong)}" if wrong else None
        else:
            want = check.get("expect", 0) if check["kind"] == "count" else 0
            told = None if got[n] == want else f"{got[n]} rows, not {want}"
        found[case_id][check["id"]] = told
    return found


def tally(found: dict[str, str | None]) -> dict[str, int]:
    """Passed, failed and blocked checks of a case."""
    blocked = sum(1 for w in found.values() if w and w.startswith("blocked: "))
    passed = sum(1 for w in found.values() if not w)
    return {"passed": passed, "failed": len(found) - passed - blocked, "blocked": blocked}


def run_case(df: DataFrame, case: dict) -> dict[str, int]:
    """Passed, failed and blocked checks; one that can't be run is blocked, not passed."""
    out = {"passed": 0, "failed": 0, "blocked": 0}
    for check in case["checks"]:
        try:
            out["failed" if run_check(df, check) else "passed"] += 1
        except Exception:  # noqa: BLE001  whatever stops a check blocks it
            out["blocked"] += 1
    return out


def exit_code(results: list[dict[str, int]]) -> int:
    """1 if a check failed, else 2 if one was blocked, else 0."""
    return 1 if any(r["failed"] for r in results) else 2 if any(r["blocked"] for r in results) else 0


def gate(now: dict[str, int], candidate: dict[str, int]) -> str:
    """REFUSE if anything is blocked, REJECT if fewer pass, UNPROVEN if as many, else PROMOTE."""
    if candidate["blocked"]:
        return "REFUSE"
    if candidate["passed"] < now["passed"]:
        return "REJECT"
    return "UNPROVEN" if candidate["passed"] == now["passed"] else "PROMOTE"
