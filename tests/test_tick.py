"""The refresh cycle over hand-made documents, with counting oracles."""

import json

import pytest
from pyspark.sql import functions as F

from tallyworks.__main__ import main
from tallyworks.operators import entities, events, oracle, telemetry
from tallyworks.sources import readers
from tallyworks.sources.store import Store
from tallyworks.streaming import tick as cycle

MANIFEST = "announcement_id string, announced_date string, title string, url string, body_chars bigint, provenance struct<url:string,fetched_at:string,http_status:int,sha256:string,n_bytes:bigint>"


def manifest(spark, *ids):
    return spark.createDataFrame([(i, f"2026-01-0{i}", f"Contracts for Jan. {i}, 2026", None, 1000, ("http://x.example.com/" + i, "2026-01-09 00:00:00", 200, "s", 10)) for i in ids], MANIFEST)


def award(name, number, amount, action="new_award", base=None):
    return {"contractor_raw": name, "contract_number": number, "amount_usd": amount, "action_type": action, "base_contract_number": base, "extraction_confidence": 0.9, "service_branch": "NAVY"}


@pytest.fixture
def world(spark, tmp_path):
    """A store, answers by document that a test may change, and how often each oracle was asked for what."""
    asked = spark.sparkContext.accumulator(0)
    answers = {"1": [award("Acme Corp.", "W1", 30_000_000), award("Zed LLC", "W2", 900_000_000)], "2": [award("Acme Corp.", "W9", "60,000,000", "modification", "W1")]}

    def extract(items):
        payload = F.udf(lambda i: (asked.add(1), json.dumps({"awards": answers.get(i, [])}))[1])
        none = F.lit(None).cast("string")
        return items.select("announcement_id", "announced_date", payload.asNondeterministic()("announcement_id").alias("payload"), F.lit("small").alias("model"), none.alias("cache_key"), none.alias("skills_version"), F.current_timestamp().alias("extracted_at"))

    def score(items):
        n = F.when(F.col("contractor_raw").startswith("Zed"), "85").otherwise("50")
        return items.select("award_uid", n.alias("score"), F.when(n == "85", "alert").otherwise("notable").alias("tier"), F.lit("big").alias("rationale"), F.lit('["size"]').alias("drivers"), F.lit("0.6").alias("confidence"))

    def second(items):
        return items.select("award_uid", F.lit("90").alias("score"), F.lit("alert").alias("tier"), F.lit("again").alias("rationale"), F.lit('["size"]').alias("drivers"), F.when(F.col("contractor_raw").startswith("Zed"), "0.95").otherwise("0.5").alias("confidence"))

    aliases = entities.alias_index(spark.createDataFrame([(0, "ACM", "Acme", "")], "row int, ticker string, company string, aliases string"))
    store = Store(spark, f"file://{tmp_path}/store", 2)
    registry = cycle.Registry()
    registry.add(lambda: cycle.Score(lambda: store.read("entities"), score, second))
    registry.add(lambda: cycle.Extract(extract))
    registry.add(lambda: cycle.Resolve(aliases))
    return store, registry, answers, asked


def test_two_ticks_find_all_changes_and_a_third_none(spark, world):
    store, registry, answers, asked = world
    dry = cycle.tick(store, registry, limits=cycle.Limits(dry_run=True), manifest=manifest(spark, "1"))
    assert dry["survey_unloaded"] == 1 and not store.read("announcements").count() and asked.value == 0
    one = cycle.tick(store, registry, manifest=manifest(spark, "1"), tick_id="t1")
    assert one["changes"] == {"new_announcement": 1, "new_award": 2} and asked.value == 1
    assert (one["written_extract"], one["written_resolve"], one["written_score"]) == (2, 1, 2)
    scores = {r.rationale: r.score for r in store.read("materiality").collect()}
    assert scores["again"] == 90 and one["escalated_score"] == 2 and one["review_score"] == 1
    assert {(r.agent, r.reason) for r in store.read("review_queue").collect()} == {("score", "low confidence")}
    runs = store.read("agent_runs").collect()
    assert len(runs) == 5 and {r.tick_id for r in runs} == {"t1"} and all(r.cache_hit for r in runs)
    # the next document modifies a known contract; meanwhile an amount and a score were corrected
    store.upsert("awards", store.read("awards").where("contract_number = 'W2'").withColumn("amount_usd", F.lit(950_000_000)))
    before = {t: store.read(t) for t in ("awards", "materiality")}
    two = cycle.tick(store, registry, manifest=manifest(spark, "1", "2"), tick_id="t2")
    assert two["changes"] == {"new_announcement": 1, "new_award": 1, "modification_on_tracked": 1} and asked.value == 2
    contract = store.read("contracts").where("ticker = 'ACM'").first()
    assert (contract.n_events, contract.total_actioned_usd, contract.history_complete) == (2, 90_000_000, True)
    three = cycle.tick(store, registry, manifest=manifest(spark, "1", "2"), tick_id="t3")
    assert three["changes"] == {} and asked.value == 2
    assert before["awards"].count() == 2  # versions stay as they were read
    assert {r.change_type for r in store.read("changes").collect()} == {"new_announcement", "new_award", "modification_on_tracked"}


def test_amounts_and_scores_that_move_within_a_tick(spark, world):
    store, registry, _, _ = world
    cycle.tick(store, registry, manifest=manifest(spark, "1"))

    class Correct:
        name, key = "zz_correct", "award_uid"

        def detect(self, store):
            return store.read("awards").where("amount_usd = 900000000")

        def run(self, items):
            return items.withColumn("amount_usd", F.lit(1_000_000_000))

    class Rescore(cycle.Score):
        name = "score"

        def __init__(self):
            super().__init__(lambda: store.read("entities"))
            self.second = None

        def detect(self, store):
            return store.read("awards").where("contract_number = 'W2'")

        def run(self, items):
            return self._rows(items.select("award_uid", F.lit(71).alias("score"), F.lit("alert").alias("tier"), F.lit("r").alias("rationale"), F.lit("[]").alias("drivers")))

    other = cycle.Registry()
    other.add(Correct)
    other.add(Rescore)
    assert cycle.tick(store, other)["changes"] == {"amount_changed": 1, "rescored": 1}
    assert store.read("changes").where("change_type = 'amount_changed'").first().new_value == "$1.0B"


def test_spending_is_refused(spark, world):
    store, registry, _, asked = world
    rows = manifest(spark, "1")
    assert "above the cap" in cycle.tick(store, registry, limits=cycle.Limits(live=True, max_spend=0.0), manifest=rows)["refused"]
    assert "no key" in cycle.tick(store, registry, limits=cycle.Limits(live=True, has_key=False), manifest=rows)["refused"]
    assert asked.value == 0 and not store.read("awards").count()


def test_limits_chunks_and_failures(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 2)
    store.create()
    store.upsert("entities", spark.createDataFrame([(f"n{k}", 0.1) for k in range(7)], "contractor_raw string, confidence double"))

    class Sure:
        name, key, chunk_size = "resolve", "contractor_raw", 2

        def detect(self, store):
            return store.read("entities").where("confidence < 0.7")

        def run(self, items):
            names = [r.contractor_raw for r in items.collect()]
            if "n3" in names:
                raise RuntimeError("bad item")
            return items.withColumn("confidence", F.lit(0.8))

    registry = cycle.Registry()
    registry.add(Sure)
    assert cycle.tick(store, registry, limits=cycle.Limits(items=2))["written_resolve"] == 2
    done = cycle.tick(store, registry)
    assert (done["written_resolve"], done["failed_resolve"]) == (4, 1)  # n2, tried alone, is written
    live = cycle.tick(store, registry, limits=cycle.Limits(live=True))
    assert (live["written_resolve"], live["failed_resolve"]) == (0, 1)
    bad = store.read("agent_runs").where("outcome = 'failed'").collect()
    assert {(r.item_key, r.error) for r in bad} == {("n3", "bad item")} and len(bad) == 2


def asking(spark, store, outputs, seen):
    """An oracle over documents that counts whom it was asked for; equal titles make equal requests."""

    def answer(rows):
        bad = [r["prompt"] for r in rows if r["prompt"].startswith("bad")]
        if bad:
            raise ValueError(f"can't read {bad[0]}")
        for r in rows:
            seen.add(1)
        return [{"output": json.dumps({"awards": outputs.get(r["prompt"], [])}), "input_tokens": 100, "output_tokens": 11} for r in rows]

    def request(items):
        return items.withColumns({"model": F.lit("small"), "system": F.lit("s"), "prompt": F.col("title"), "schema": F.lit("{}"), "max_tokens": F.lit(9)})

    return oracle.CachedOracle(store, answer, request)


def test_usage_is_found_again_and_answers_are_kept(spark, tmp_path):
    store, seen = Store(spark, f"file://{tmp_path}/store", 2), spark.sparkContext.accumulator(0)
    outputs = {"one": [award("Acme Corp.", "W1", 5), award("Bolt", "W2", 6)], "two": [award("Cray", "W3", 7)]}
    rows = spark.createDataFrame([(f"d{k}", "2026-01-01", t, "http://x", 10, ("u", "2026-01-09 00:00:00", 200, "s", 1)) for k, t in enumerate(["one", "one", "two", "bad one"])], MANIFEST)
    registry = cycle.Registry()
    registry.add(lambda: cycle.Extract.asking(asking(spark, store, outputs, seen)))
    done = cycle.tick(store, registry, manifest=rows, tick_id="t1")
    assert seen.value == 2 and done["written_extract"] == 5 and done["failed_extract"] == 1  # d0 and d1 ask the same
    runs = store.read("agent_runs").collect()
    fine = [r for r in runs if r.outcome == "ok"]
    assert len(fine) == 5 and {(r.input_tokens, r.output_tokens, r.cache_hit) for r in fine} == {(40, 4, False)}  # 200 and 22 tokens, rounded down
    total = telemetry.spent(store.read("agent_runs")).where("model = 'small'").first()
    assert (total.input_tokens, total.output_tokens) == (200, 20) and total.cost_usd >= 0
    assert [(r.item_key, r.error) for r in store.read("quarantine").collect()] == [("d3", "ValueError: can't read bad one")]
    assert {(r.announcement_id, r.extraction_status) for r in store.read("announcements").collect()} == {("d0", "extracted"), ("d1", "extracted"), ("d2", "extracted"), ("d3", "failed")}
    assert store.read("answers").count() == 2
    # asked again, all comes from the store, and nothing is spent
    store.mark_status(store.read("announcements").where("extraction_status = 'extracted'"), "pending")
    again = asking(spark, store, outputs, seen)
    again.live = False
    other = cycle.Registry()
    other.add(lambda: cycle.Extract.asking(again))
    cycle.tick(store, other, tick_id="t2")
    assert seen.value == 2 and {(r.input_tokens, r.cache_hit) for r in store.read("agent_runs").where("tick_id = 't2'").collect()} == {(0, True)}
    with pytest.raises(oracle.MissingAnswers):
        again(spark.createDataFrame([("x", "never asked")], "announcement_id string, title string"))
    assert not list((tmp_path / "store" / "_staged").glob("t*"))


def test_faulty_rows_are_found_in_one_job(spark):
    calls = spark.sparkContext.accumulator(0)

    def answer(rows):
        calls.add(1)
        if any(r["id"] in (17, 5000, 9999) for r in rows):
            raise KeyError("odd row")
        return [{"double": 2 * r["id"]} for r in rows]

    rows = oracle.ask_isolated(spark.range(10_000), answer, "id", "double long", 100).collect()
    assert sorted(r.id for r in rows if r.error) == [17, 5000, 9999] and {r.error for r in rows if r.error} == {"KeyError: 'odd row'"}
    assert len(rows) == 10_000 and all(r.double == 2 * r.id for r in rows if not r.error)
    assert calls.value <= 110 + 3 * 2 * 8
    assert [e for *_, e in oracle.isolate([{}, {}], lambda rows: [])] == ["ValueError: 0 answers to 1 rows"] * 2


def test_failures_that_are_no_oracles_end_the_tick(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 2)
    store.create()
    store.upsert("entities", spark.createDataFrame([("n1", 0.1)], "contractor_raw string, confidence double"))

    class Full:
        name, key = "resolve", "contractor_raw"

        def detect(self, store):
            return store.read("entities")

        def run(self, items):
            raise OSError("no space left on device")

    registry = cycle.Registry()
    registry.add(Full)
    with pytest.raises(OSError, match="no space"):
        cycle.tick(store, registry, tick_id="t1")
    assert store.counts()["agent_runs"] == 0 and not (tmp_path / "store" / "_staged" / "t1").exists()
    assert [oracle.faulty(e) for e in (RuntimeError("x"), MemoryError(), OSError())] == [True, False, False]


def test_two_ticks_at_once(spark, tmp_path):
    import threading

    root, errors = f"file://{tmp_path}/store", []
    Store(spark, root, 2).create()

    def one(k):
        try:
            store = Store(spark, root, 2)
            registry = cycle.Registry()
            outputs = {f"t{k}": [award("Acme Corp.", "W1", k), award(f"Only {k}", f"V{k}", k)]}
            registry.add(lambda: cycle.Extract.asking(asking(spark, store, outputs, spark.sparkContext.accumulator(0))))
            rows = spark.createDataFrame([(f"d{k}", "2026-01-01", f"t{k}", "http://x", 10, ("u", "2026-01-09 00:00:00", 200, "s", 1))], MANIFEST)
            cycle.tick(store, registry, manifest=rows, tick_id=f"t{k}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    store = Store(spark, root, 2)
    cycle.tick(store, cycle.Registry())  # settles contracts that both touched
    assert store.counts()["awards"] == 4 and store.read("agent_runs").where("outcome = 'ok'").count() >= 4
    want = events.prepare(store.read("awards"))
    assert sorted(map(tuple, store.read("contracts").collect()), key=str) == sorted(map(tuple, events.build_contracts(want, store.read("entities")).collect()), key=str)


def test_resolved_names_join_the_fact_map(spark, tmp_path):
    store, facts = Store(spark, f"file://{tmp_path}/store", 2), f"file://{tmp_path}/facts"
    store.create()
    store.upsert("awards", spark.createDataFrame([("a", "Acme Corp."), ("b", "Nobody LLC")], "award_uid string, contractor_raw string"))
    aliases = entities.alias_index(spark.createDataFrame([(0, "ACM", "Acme", "")], "row int, ticker string, company string, aliases string"))
    none = entities.alias_index(spark.createDataFrame([], "row int, ticker string, company string, aliases string"))
    registry = cycle.Registry()
    registry.add(lambda: cycle.Resolve(aliases, facts=facts))
    cycle.tick(store, registry)
    held = entities.load_fact_map(readers.read_fact_map(spark, facts)).collect()
    assert [(r.key, r.raw_variants) for r in held] == [("acme", ["Acme Corp."])]
    # another spelling is resolved by the map alone
    store.upsert("awards", spark.createDataFrame([("c", "ACME, Inc.")], "award_uid string, contractor_raw string"))
    other = cycle.Registry()
    other.add(lambda: cycle.Resolve(none, facts=facts))
    cycle.tick(store, other)
    assert {(r.contractor_raw, r.ticker) for r in store.read("entities").collect()} == {("Acme Corp.", "ACM"), ("ACME, Inc.", "ACM")}
    assert entities.load_fact_map(readers.read_fact_map(spark, facts)).count() == 1


def test_agents_of_a_folder(spark, tmp_path, capsys):
    good = "class A:\n    name = {!r}\n    key = 'contractor_raw'\n    def detect(self, store): return store.read('entities').limit(0)\n    def run(self, items): return items\ndef make(): return A()\n"
    for name, body in (("b", good.format("zeta")), ("a", good.format("score")), ("c", good.format("extract")), ("d", good.format("zeta")), ("e", "1/0"), ("f", "def make(): return 3"), ("_g", "1/0")):
        (tmp_path / f"{name}.py").write_text(body)
    found = cycle.Registry().discover(str(tmp_path))
    assert [a.name for a in found.in_order()] == ["extract", "score", "zeta"] and len(found.problems) == 3
    assert main(["agents", "--agents", str(tmp_path)]) == 1
    assert capsys.readouterr().out.split("\n")[:3] == ["extract", "score", "zeta"]
    with pytest.raises(AssertionError):
        cycle.Tripwire()()


def test_stream_of_manifests(spark, world, tmp_path):
    store, registry, _, asked = world
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"announcement_id": "1", "announced_date": "2026-01-01", "title": "t", "provenance": {"url": "u", "http_status": 200}}
    (folder / "a.json").write_text(json.dumps(row) + "\n")
    for _ in range(2):
        cycle.stream(spark, f"file://{folder}", f"file://{tmp_path}/check", MANIFEST, lambda b: b, store, registry).awaitTermination()
    assert asked.value == 1 and store.read("awards").count() == 2
    looks = []
    assert readers.watch(spark, [f"file://{folder}/*"], lambda: looks or (looks.append(1), (folder / "b.json").write_text("x")), 0.01, 3) == 2


def test_tasks(spark, tmp_path, capsys):
    store = f"file://{tmp_path}/store"
    assert main(["selftest", "--store", store]) == 0
    assert main(["tick", "--store", store, "--agents", str(tmp_path)]) == 0
    assert main(["counts", "--store", store]) == 0 and '"awards": 0' in capsys.readouterr().out
    assert main(["cost", "--store", store]) == 0 and main(["queries"]) == 0 and main(["migrate", "--store", store]) == 0 and main(["vacuum", "--store", store]) == 0
    assert main(["export", "--store", store, "--export", f"file://{tmp_path}/out"]) == 0
    assert readers.export_views(spark, f"file://{tmp_path}/out")
