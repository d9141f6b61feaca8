"""The refresh cycle: survey and load, price, dispatch, aggregate, diff, export. Idempotent: ids are derived and writes are upserts.

A tick is a batch run; ``stream`` runs one per micro-batch of a file source. Oracles are injected pure functions from
DataFrames to DataFrames; there is no network. Rows of a dispatch are written once and read from there, so an oracle is
asked once for each of its items, whatever is counted or recorded afterwards.
"""

from __future__ import annotations

import contextlib
import importlib.util
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, values
from ..operators import changes, entities, events, scoring, telemetry
from ..operators import oracle as oracles
from ..registry import KEYS, columns, conform, table_for
from ..sources.readers import manifest_rows, read_fact_map
from ..sources.store import Store
from ..sources.writers import write_fact_map
from . import upkeep

STAGES = ["extract", "resolve", "score"]
_TABLE = {"extract": "awards", "resolve": "entities", "score": "materiality"}


class Agent(Protocol):
    """What a stage offers: its queue, and its rows for that queue.

    Optional: ``key`` (the queue's id column), ``oracle`` (a ``CachedOracle`` that ``run`` asks), ``free`` (asking again costs nothing), ``chunk_size``
    (items persisted together), ``chars`` (a column that a call's price grows with) and ``model``, ``second`` (rows of a second oracle for
    unsure ones), ``after_write`` (called with the store and the queue), ``skills_path``.
    """

    name: str

    def detect(self, store: Store) -> DataFrame: ...

    def run(self, items: DataFrame) -> DataFrame: ...


@dataclass
class Registry:
    """Agents by name; the first of a name stays, broken ones are reported."""

    agents: dict[str, Agent] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def add(self, make: Callable[[], Agent]) -> None:
        try:
            agent = make()
        except Exception as e:  # noqa: BLE001  one broken agent mustn't stop the others
            self.problems.append(f"{getattr(make, '__name__', make)}: {e}")
            return
        if not all(hasattr(agent, x) for x in ("name", "detect", "run")):
            self.problems.append(f"{agent!r} lacks part of the protocol")
        elif agent.name in self.agents:
            self.problems.append(f"{agent.name}: already registered")
        else:
            self.agents[agent.name] = agent

    def discover(self, folder: str) -> Registry:
        """Adds what ``make()`` of each module in a folder gives, by file name; names that begin with "_" are left out."""
        for path in sorted(Path(folder).glob("[!_]*.py")):

            def make(path: Path = path) -> Agent:
                spec = importlib.util.spec_from_file_location(f"agent_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                return module.make()

            make.__name__ = path.stem
            self.add(make)
        return self

    def in_order(self) -> list[Agent]:
        place = {n: k for k, n in enumerate(STAGES)}
        return sorted(self.agents.values(), key=lambda a: (place.get(a.name, len(STAGES)), a.name))


class Tripwire:
    """An oracle that must not be asked."""

    def __call__(self, *_: object) -> DataFrame:
        raise AssertionError("the oracle was asked")


class Extract:
    name, key, chars = "extract", "announcement_id", "body_chars"

    def __init__(self, answers: Callable[[DataFrame], DataFrame], oracle: oracles.CachedOracle | None = None):
        self.answers, self.oracle = answers, oracle

    @classmethod
    def asking(cls, oracle: oracles.CachedOracle) -> Extract:
        """Documents' payloads are the oracle's outputs, kept by content address."""

        def answers(items: DataFrame) -> DataFrame:
            got = oracle(items).withColumns({"payload": F.col("output"), "skills_version": F.lit(None).cast("string"), "extracted_at": F.current_timestamp()})
            return got.select("announcement_id", "announced_date", "payload", "model", "cache_key", "skills_version", "extracted_at")

        return cls(answers, oracle)

    def detect(self, store: Store) -> DataFrame:
        return store.read("announcements").where("extraction_status = 'pending'")

    def run(self, items: DataFrame) -> DataFrame:
        return events.postprocess(self.answers(items))

    def after_write(self, store: Store, items: DataFrame) -> None:
        """Documents with a row are extracted, those without failed."""
        got = store.read("awards").select("announcement_id").distinct()
        status = items.select("announcement_id").join(got.withColumn("hit", F.lit(True)), "announcement_id", "left").select("announcement_id", F.when(F.col("hit"), "extracted").otherwise("failed").alias("status"))
        store.mark_statuses(status)


class Resolve:
    name, key = "resolve", "contractor_raw"

    def __init__(self, aliases: DataFrame, answers: Callable[[DataFrame], DataFrame] | None = None, second: Callable[[DataFrame], DataFrame] | None = None, facts: str | None = None):
        """``facts``: the path of a fact map, looked up before all else and given what was newly resolved."""
        self.aliases, self.answers, self.facts = aliases, answers, facts
        self.second = second and (lambda items: entities.coerce(second(items)))

    def detect(self, store: Store) -> DataFrame:
        known = store.read("entities")
        names = store.read("awards").select("contractor_raw").where("contractor_raw IS NOT NULL").distinct()
        return names.join(known.where("confidence >= 0.7").select("contractor_raw"), "contractor_raw", "left_anti")

    def run(self, items: DataFrame) -> DataFrame:
        if self.facts:
            known = entities.known_records(items, self._map(items))
            return known.unionByName(self._matched(items.join(known.select("contractor_raw"), "contractor_raw", "left_anti")))
        return self._matched(items)

    def _map(self, near: DataFrame) -> DataFrame:
        return entities.load_fact_map(read_fact_map(near.sparkSession, self.facts))

    def after_write(self, store: Store, items: DataFrame) -> None:
        """New companies of this queue join the fact map; placeholders and names under review don't."""
        if not self.facts:
            return
        held = self._map(items)
        review = store.read("review_queue").where("agent = 'resolve' AND NOT coalesce(resolved, false)")
        kept = entities.to_persist(store.read_keys("entities", items), held, review)
        fields = [c for c in columns("entities") if c not in ("contractor_raw", "resolved_at")]
        new = kept.select("key", F.to_json(F.struct(*fields)).alias("record"), "confidence", F.array("contractor_raw").alias("raw_variants"))
        if not new.isEmpty():
            write_fact_map(held.select(new.columns).unionByName(new), self.facts)

    def _matched(self, items: DataFrame) -> DataFrame:
        matched = entities.match_aliases(items, self.aliases)
        rows = entities.alias_records(matched)
        if self.answers is None:
            return rows
        rest = matched.where("method IS NULL").select(F.col("raw").alias("contractor_raw"))
        return rows.unionByName(entities.coerce(self.answers(rest)))


class Score:
    name, key = "score", "award_uid"

    def __init__(self, known: Callable[[], DataFrame], answers: Callable[[DataFrame], DataFrame] | None = None, second: Callable[[DataFrame], DataFrame] | None = None):
        self.known, self.answers = known, answers
        self.second = second and (lambda items: self._rows(scoring.coerce(second(items))))

    def detect(self, store: Store) -> DataFrame:
        return store.read("awards").join(store.read("materiality").select("award_uid"), "award_uid", "left_anti")

    def run(self, items: DataFrame) -> DataFrame:
        filtered = scoring.prefilter(items, self.known())
        rows = filtered.where("rule IS NOT NULL").select("award_uid", "score", "tier", F.concat(F.lit("Routine: "), "rule").alias("rationale"), F.to_json("drivers").alias("drivers"))
        if self.answers is not None:
            asked = items.join(filtered.where("rule IS NULL").select("award_uid"), "award_uid", "left_semi")
            rows = rows.withColumn("confidence", F.lit(1.0)).unionByName(scoring.coerce(self.answers(asked)))
        return self._rows(rows)

    @staticmethod
    def _rows(rows: DataFrame) -> DataFrame:
        """Contract rows, with the confidence that decides on a second opinion."""
        return conform(rows.withColumn("confidence", F.col("confidence") if "confidence" in rows.columns else F.lit(1.0)), "materiality", "confidence")


@dataclass
class Limits:
    """What a tick may do: nothing but look (dry_run), spend up to so many dollars on live oracles, take so many items per stage."""

    dry_run: bool = False
    live: bool = False
    has_key: bool = True
    max_spend: float | None = None
    items: int | None = None


def queue_of(agent: Agent, store: Store, limits: Limits) -> DataFrame:
    """An agent's queue, or the first items of it in the order of their ids."""
    queue = agent.detect(store)
    return queue.orderBy(agent.key).limit(limits.items) if limits.items is not None and hasattr(agent, "key") else queue


def estimate(agent: Agent, queue: DataFrame) -> DataFrame:
    """agent, calls, input_tokens, output_tokens, cost_usd expected of a queue; 400 characters an item where the agent names no column."""
    chars = F.coalesce(F.col(agent.chars), F.lit(0)) if hasattr(agent, "chars") else F.lit(400)
    tin, tout = values.estimated_tokens(chars)
    cost = values.price(F.lit(getattr(agent, "model", "small")), F.col("tin"), F.col("tout"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    each = queue.select(tin.alias("tin"), tout.alias("tout"))
    return each.agg(F.lit(agent.name).alias("agent"), F.count("*").alias("calls"), total("tin").alias("input_tokens"), total("tout").alias("output_tokens"), F.round(total(cost), 6).cast("double").alias("cost_usd"))


def refusal(projected: float, limits: Limits) -> str | None:
    """Why live oracles may not be asked, if so."""
    if not limits.live:
        return None
    if limits.max_spend is not None and projected > limits.max_spend:
        return f"projected ${projected:.4f} is above the cap of ${limits.max_spend:.2f}"
    return None if limits.has_key else "no key for live oracles"


def dispatch(agent: Agent, queue: DataFrame, store: Store, tick_id: str, live: bool = False) -> dict[str, int]:
    """Rows of a queue, chunk by chunk: written, unsure ones asked again, still unsure ones queued for review, all recorded.

    A ``CachedOracle`` of the agent (``oracle``) isolates the rows it fails on by itself; they go to quarantine, and its calls and tokens
    into the run records. An agent that raises as a whole is asked again for each half of its items, if that costs nothing, until the
    faulty ones stand alone; else its items are recorded as failed. Both stay in the queue. What Spark or the store raises ends the tick.
    """
    out = {"written": 0, "failed": 0, "escalated": 0, "review": 0}
    table = _TABLE.get(agent.name, "awards")
    size = getattr(agent, "chunk_size", None)
    oracle = getattr(agent, "oracle", None)
    queue = store.stage(queue, tick_id)
    ranks: list[DataFrame] = []

    def ranked() -> DataFrame:
        """Each key of the queue and its place in their order."""
        if not ranks:
            ranks.append(store.stage(scoring.cumulative(queue.select(F.col(agent.key).alias("__k")).distinct().withColumn("n", F.lit(1)), "__k", "n").select("__k", "below"), tick_id))
        return ranks[0]

    def part(low: int, high: int) -> DataFrame:
        return queue.join(ranked().where((F.col("below") >= low) & (F.col("below") < high)), queue[agent.key] == F.col("__k"), "left_semi")

    def asked(items: DataFrame) -> DataFrame:
        """The agent's rows, with escalated and review: all that an oracle has a say in."""
        rows = store.stage(agent.run(items), tick_id)
        confidence = telemetry.confidence_column(rows.columns)
        if not (getattr(agent, "second", None) and confidence):  # staged rows with two constants: still read, never asked again
            return rows.withColumns({"escalated": F.lit(False), "review": F.lit(False)})
        key = key_of(rows)
        unsure = rows.where(values.needs_escalation(F.col(confidence)))
        again = store.stage(agent.second(items.join(unsure.select(key), key, "left_semi")), tick_id)
        return store.stage(scoring.escalate(rows, again, key), tick_id)

    def key_of(rows: DataFrame) -> str:
        return KEYS[table_for([c for c in rows.columns if c not in ("confidence", "escalated", "review") or (c == "confidence" and table == "entities")]) or table]

    def persist(rows: DataFrame) -> None:
        key, confidence = key_of(rows), telemetry.confidence_column(rows.columns)
        flagged = rows.where("review")
        if confidence and not flagged.isEmpty():
            out["review"] += store.upsert("review_queue", scoring.review_rows(flagged.drop("review"), agent.name, key, F.lit("low confidence")).withColumn("flagged_at", F.current_timestamp()))
        name = next((t for t in (table_for([c for c in rows.columns if c in columns(table)]), table) if t), table)
        out["written"] += store.upsert(name, rows, staged=True)
        model = telemetry.model_column(columns(name))
        told = rows.select(
            F.col(key).cast("string").alias("item_key"),
            F.coalesce(F.col(model), F.lit(getattr(agent, "model", "deterministic"))).alias("model") if model else F.lit("deterministic").alias("model"),
            (F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")).alias("confidence"),
            "escalated",
        )
        out["escalated"] += told.where("escalated").count()
        (calls, used_in, used_out), failures = oracle.take() if oracle else ((int(live), 0, 0), [])
        runs = telemetry.record(told, tick_id, agent.name, used_in, used_out, calls).drop("escalated").join(told.select("item_key", "escalated"), "item_key")
        store.upsert("agent_runs", runs.withColumn("started_at", F.current_timestamp()))
        for rows_and_errors in failures:
            failed(rows_and_errors, F.col("error"), calls)

    def failed(items: DataFrame, error: Column, calls: int) -> None:
        rows = store.stage(items.select(F.col(agent.key).cast("string").alias("item_key"), error.alias("error")).dropDuplicates(["item_key"]), tick_id)
        if rows.isEmpty():
            return
        told = rows.select("item_key", F.lit(getattr(agent, "model", "deterministic")).alias("model"), F.lit(None).cast("double").alias("confidence"))
        runs = telemetry.record(told, tick_id, agent.name, 0, 0, calls).drop("error").join(rows, "item_key").withColumns({"outcome": F.lit("failed"), "started_at": F.current_timestamp()})
        out["failed"] += store.upsert("agent_runs", runs)
        item_id = keys.uid(F.lit(agent.name), F.col("item_key"))
        store.upsert("quarantine", rows.select(item_id.alias("item_id"), F.lit(tick_id).alias("tick_id"), F.lit(agent.name).alias("agent"), "item_key", "error", F.current_timestamp().alias("flagged_at")))

    if size:
        last = ranked().agg(F.max("below")).first()[0]
        work = [(k, k + size) for k in range(0, (0 if last is None else last) + 1, size)][::-1]
    else:
        work = [(0, None)]
    while work:
        low, high = work.pop()
        items = queue if high is None else part(low, high)
        try:
            rows = asked(items)
        except Exception as e:
            if not oracles.faulty(e):
                raise
            high = ranked().count() if high is None else high
            if live or not getattr(agent, "free", True) or high - low <= 1:
                failed(items, F.lit(str(e)[:200]), int(live))
            else:
                middle = (low + high) // 2
                work += [(middle, high), (low, middle)]
        else:
            persist(rows)
    if hasattr(agent, "after_write"):
        agent.after_write(store, queue)
    return out


def tick(store: Store, registry: Registry, export: str | None = None, limits: Limits | None = None, manifest: DataFrame | None = None, feed: DataFrame | None = None, tick_id: str | None = None) -> dict:
    """One refresh: what was queued, written, failed, escalated, sent to review, projected, and the histogram of changes.

    Later stages see what earlier ones wrote; the diff is against the tables as they stood before anything was loaded. ``manifest``
    and ``feed`` are surveyed and the manifest's rows loaded first. A dry run counts queues and prices them, and writes nothing else.
    Marks, contracts and changes follow from the buckets that moved; tables staged on the way go with the tick, however it ends.
    """
    limits = limits or Limits()
    tick_id = tick_id or uuid.uuid4().hex[:12]
    try:
        return _tick(store, registry, export, limits, manifest, feed, tick_id)
    finally:
        store.unstage(tick_id)


def _tick(store: Store, registry: Registry, export: str | None, limits: Limits, manifest: DataFrame | None, feed: DataFrame | None, tick_id: str) -> dict:
    store.create()
    before = store.numbers("announcements", "awards", "materiality")
    done: dict = {"tick_id": tick_id}
    if manifest is not None:
        found = changes.survey(store.read("announcements"), manifest, feed if feed is not None else manifest)
        done |= {f"survey_{r.state}": r["count"] for r in found.groupBy("state").count().collect()}
        if not limits.dry_run:
            store.upsert("announcements", manifest_rows(manifest, store.read_keys("announcements", manifest)))
    with oracles.Guard() if limits.dry_run else contextlib.nullcontext():
        costs = [(agent, estimate(agent, queue_of(agent, store, limits)).first()) for agent in registry.in_order()]
    done["projected_usd"] = round(sum(c.cost_usd for _, c in costs), 6)
    done |= {f"queued_{agent.name}": c.calls for agent, c in costs}
    if limits.dry_run:
        return done
    if why := refusal(done["projected_usd"], limits):
        return done | {"refused": why}
    for agent in registry.in_order():
        queue = queue_of(agent, store, limits)  # again, as earlier stages may have fed it
        if not queue.isEmpty():
            done |= {f"{k}_{agent.name}": v for k, v in dispatch(agent, queue, store, tick_id, limits.live).items()}
    upkeep.keep_contracts(store)
    found = store.stage(upkeep.changes_since(store, before, tick_id).withColumn("detected_at", F.current_timestamp()), tick_id)
    done["changes"] = {r.change_type: r.n for r in changes.by_kind(found).collect()}
    if done["changes"]:
        store.upsert("changes", found, staged=True)
    if export:
        store.export(export)
    return done


def stream(spark: SparkSession, manifests: str, checkpoint: str, schema: str, load: Callable[[DataFrame], DataFrame], store: Store, registry: Registry, every: str | None = None) -> object:
    """A tick for each micro-batch of manifest files, once over what is there or, with ``every`` ("3 seconds"), polling for new files.

    Repeats of a batch converge, as every write is keyed.
    """

    def one(batch: DataFrame, number: int) -> None:
        tick(store, registry, manifest=store.stage(load(batch), f"batch-{number}"), tick_id=f"batch-{number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return spark.readStream.schema(schema).json(manifests).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()

