"""Oracles: injected functions from rows to answers. Each distinct request is asked once, failures stay with the rows that caused them, tokens are accounted.

A request's address is a hash of all that decides its answer (model, system, prompt, schema, token limit). What an address
has an answer for isn't asked; equal requests of one run are asked once and share the tokens. Batches run in the executors;
one that fails is halved there until the faulty rows stand alone, so one job finds them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys

REQUEST = ["model", "system", "prompt", "schema", "max_tokens"]


class MissingAnswers(LookupError):
    """Requests without a stored answer, where none may be asked."""


def faulty(e: Exception) -> bool:
    """Whether an oracle raised this, rather than Spark, the disk or the memory."""
    if isinstance(e, MissingAnswers):
        return False
    if isinstance(e, (AnalysisException, PythonException)):
        return True
    told = str(e)
    if isinstance(e, PySparkException) or type(e).__name__.startswith("Py4J"):
        return "PythonException" in told or "USER_RAISED_EXCEPTION" in told
    return not isinstance(e, (OSError, MemoryError))


def isolate(rows: list[dict], answer: Callable[[list[dict]], list[dict]]) -> Iterator[tuple[dict, dict | None, str | None]]:
    """(row, answer, error) of each row, in order: a batch that fails, or isn't answered row by row, is halved."""
    try:
        got = answer(rows)
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} answers to {len(rows)} rows")
    except Exception as e:  # noqa: BLE001  whatever an injected function raises
        if len(rows) == 1:
            yield rows[0], None, f"{type(e).__name__}: {e}"[:200]
            return
        middle = len(rows) // 2
        yield from isolate(rows[:middle], answer)
        yield from isolate(rows[middle:], answer)
    else:
        yield from ((r, a, None) for r, a in zip(rows, got, strict=True))


def ask_isolated(rows: DataFrame, answer: Callable[[list[dict]], list[dict]], key: str, schema: str, batch_size: int = 20) -> DataFrame:
    """key, the fields of ``schema``, error: null fields and an error for rows that ``answer`` fails on."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}, error string"
    struct = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                got = isolate(batch.slice(k, batch_size).to_pylist(), answer)
                yield pa.RecordBatch.from_pylist([{**(a or {}), key: r[key], "error": e} for r, a, e in got], schema=arrow)

    return rows.mapInArrow(run, struct)


class Guard:
    """While it is entered no ``CachedOracle`` asks anybody: one that would is stopped and counted. For runs that must cost nothing."""

    entered: list[Guard] = []

    def __init__(self) -> None:
        self.fired = 0

    def __enter__(self) -> Guard:
        Guard.entered.append(self)
        return self

    def __exit__(self, *exc: object) -> None:
        Guard.entered.remove(self)


def stubbed(outputs: dict[str, str], by: str = "prompt", tokens: tuple[int, int] = (0, 0)) -> Callable[[list[dict]], list[dict]]:
    """An oracle with fixed outputs by one field of a request; it fails on any other."""
    return lambda rows: [{"output": outputs[r[by]], "input_tokens": tokens[0], "output_tokens": tokens[1]} for r in rows]


@dataclass
class CachedOracle:
    """Answers of a store's ``answers`` table, and of ``answer`` for what it lacks.

    ``request`` adds the columns of REQUEST to the items; ``answer`` maps such rows to dicts of output, input_tokens, output_tokens.
    """

    store: object
    answer: Callable[[list[dict]], list[dict]]
    request: Callable[[DataFrame], DataFrame]
    live: bool = True
    label: str = "oracle"
    batch_size: int = 20
    owner: str = "oracle"
    used: list[int] = field(default_factory=lambda: [0, 0, 0])
    failures: list[DataFrame] = field(default_factory=list)

    def __call__(self, items: DataFrame) -> DataFrame:
        """The items that have an answer, with cache_key, output, cache_hit, input_tokens and output_tokens (their share of a call, rounded down)."""
        if Guard.entered:
            Guard.entered[-1].fired += 1
            raise AssertionError(f"{self.label} was asked where nothing may be spent")
        store = self.store
        address = keys.cache_key(*[F.col(c) for c in REQUEST])
        asked = store.stage(self.request(items).withColumn("cache_key", address), self.owner)
        known = store.stage(store.read_keys("answers", asked), self.owner)
        missing = asked.join(known, "cache_key", "left_anti").dropDuplicates(["cache_key"]).select("cache_key", *REQUEST)
        if not self.live and (n := missing.count()):
            raise MissingAnswers(f"{self.label}: no stored answer for {n} request(s)")
        got = store.stage(ask_isolated(missing, self.answer, "cache_key", "output string, input_tokens long, output_tokens long", self.batch_size), self.owner)
        good = got.where("error IS NULL").drop("error")
        models = asked.select("cache_key", "model").dropDuplicates(["cache_key"])
        store.upsert("answers", good.join(models, "cache_key").withColumns({"label": F.lit(self.label), "created_at": F.current_timestamp()}))
        total = good.agg(F.count("*"), F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).first()
        self.used = [a + b for a, b in zip(self.used, total, strict=True)]
        self.failures.append(asked.join(got.where("error IS NOT NULL").select("cache_key", "error"), "cache_key"))
        sharing = F.count("*").over(Window.partitionBy("cache_key"))
        share = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / sharing).cast("long").alias(c)
        answers = known.select("cache_key", "output", F.lit(True).alias("cache_hit"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
        answers = answers.unionByName(good.select("cache_key", "output", F.lit(False).alias("cache_hit"), "input_tokens", "output_tokens"))
        both = asked.join(answers, "cache_key")
        return both.select(*items.columns, *[c for c in ("model", "cache_key") if c not in items.columns], "output", "cache_hit", share("input_tokens"), share("output_tokens"))

    def take(self) -> tuple[list[int], list[DataFrame]]:
        """[calls, input tokens, output tokens] and failed items since the last time."""
        used, failures = self.used, self.failures
        self.used, self.failures = [0, 0, 0], []
        return used, failures
