"""Golden cases: expectations on documents, the prose they quote, and running them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selectors
from ..operators.oracle import MissingAnswers
from .files import exists, read_text, write_text
from .html import body_text
from .readers import whole_files

REQUIRED = ["case_id", "announcement_id", "announced_date", "source", "title", "why", "verified_against", "checks"]
KINDS = ["row", "count", "absent"]


def load_cases(spark: SparkSession, folder: str) -> list[dict]:
    """The cases of a folder of JSON files, by case_id; one that lacks a field or has an unknown kind of check is an error. They are few and go to the driver."""
    cases = [json.loads(r.value) for r in whole_files(spark, f"{folder}/*.json").collect()]
    for case in cases:
        if gone := [f for f in REQUIRED if not case.get(f)]:
            raise ValueError(f"{case.get('case_id', 'a case')} lacks {', '.join(gone)}")
        if odd := [c["id"] for c in case["checks"] if c.get("kind") not in KINDS]:
            raise ValueError(f"{case['case_id']}: unknown kind of check in {', '.join(odd)}")
    return sorted(cases, key=lambda c: c["case_id"])


def resolve_bodies(spark: SparkSession, articles: str, snapshots: str) -> DataFrame:
    """announcement_id, prose, digest, source, drifted: the page's own prose if it is there, else the snapshot; drifted where both are and differ."""

    def files(folder: str, kind: str, name: str) -> DataFrame:
        if not exists(spark, folder):
            return spark.createDataFrame([], f"announcement_id string, {name} string")
        return whole_files(spark, f"{folder}/*.{kind}").select(F.regexp_extract("path", rf"([^/]+)\.{kind}$", 1).alias("announcement_id"), F.col("value").alias(name))

    live = body_text(files(articles, "html", "html"))
    j = live.join(files(snapshots, "txt", "snapshot"), "announcement_id", "full")
    prose = F.coalesce("prose", "snapshot")
    return j.select("announcement_id", prose.alias("prose"), F.sha2(prose, 256).alias("digest"), F.when(F.col("prose").isNotNull(), "html").otherwise("snapshot").alias("source"), F.coalesce(F.col("prose") != F.col("snapshot"), F.lit(False)).alias("drifted"))


def run_cases(awards: DataFrame, cases: list[dict]) -> tuple[dict[str, dict[str, int]], int]:
    """Results by case over the awards of its document, in one scan, and the exit code."""
    results = {c: selectors.tally(w) for c, w in selectors.run_cases_once(awards, cases).items()}
    return results, selectors.exit_code(list(results.values()))


#: Exit codes of the gate's verdicts: a rule that isn't proven to do good does no harm; one that can't be scored is no pass.
VERDICTS = {"PROMOTE": 0, "UNPROVEN": 0, "REJECT": 1, "REFUSE": 2}


def try_rule(cases: list[dict], awards: Callable[[str], DataFrame], skills: str, rule: str) -> tuple[str, dict[str, str]]:
    """The gate's verdict on adding ``rule`` to ``skills``, and what the candidate gets wrong, by "case/check".

    ``awards`` extracts the cases' documents under given skills; both sides run it. A side without answers to score, because they were
    never asked for under these skills, is refused.
    """
    told: list[dict[str, str | None]] = []
    for text in (skills, f"{skills.rstrip()}\n\n{rule.strip()}\n".lstrip()):
        try:
            found = selectors.run_cases_once(awards(text), cases)
        except MissingAnswers as e:
            return "REFUSE", {"*": f"blocked: {e}"}
        told.append({f"{c}/{k}": w for c, checks in found.items() for k, w in checks.items()})
    now, candidate = map(selectors.tally, told)
    verdict = "REFUSE" if now["blocked"] else selectors.gate(now, candidate)
    return verdict, {k: w for k, w in told[1].items() if w}


def promote(spark: SparkSession, cases: list[dict], awards: Callable[[str], DataFrame], skills_path: str, rule: str, apply: bool = False) -> tuple[str, dict[str, str]]:
    """``try_rule`` on a skills file; with ``apply`` a promoted rule is added to it. The file is written for nothing less."""
    skills = read_text(spark, skills_path) if exists(spark, skills_path) else ""
    verdict, wrong = try_rule(cases, awards, skills, rule)
    if apply and verdict == "PROMOTE":
        write_text(spark, skills_path, f"{skills.rstrip()}\n\n{rule.strip()}\n".lstrip())
    return verdict, wrong
