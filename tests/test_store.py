"""The keyed store: what an upsert touches, commits of several writers, upkeep and changes from version differences."""

import hashlib
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import changes, events
from tallyworks.operators.tables import upsert
from tallyworks.registry import KEYS, conform
from tallyworks.sources import files
from tallyworks.sources.store import Conflict, Store
from tallyworks.streaming import upkeep


def new_store(spark, tmp_path, buckets=8):
    store = Store(spark, f"file://{tmp_path}/store", buckets)
    store.create()
    return store


def entities(spark, rows):
    return spark.createDataFrame(rows, "contractor_raw string, ticker string, confidence double")


def bytes_of(tmp_path, table):
    return {str(p.relative_to(tmp_path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(tmp_path, "store", table, "data").rglob("*.parquet")}


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_an_upsert_touches_only_its_buckets(spark, tmp_path):
    store = new_store(spark, tmp_path)
    rows = entities(spark, [(f"n{k}", "T", k / 100) for k in range(60)])
    store.upsert("entities", rows)
    first, files_before = store.manifest("entities"), bytes_of(tmp_path, "entities")
    patch = entities(spark, [("n3", "X", 0.5), ("n4", None, 0.1), ("new", "N", 1.0), ("n3", "W", 0.7)]).withColumn("at", F.monotonically_increasing_id())
    assert store.upsert("entities", patch, "at") == 3
    second = store.manifest("entities")
    moved = {b for b in range(8) if first.buckets.get(b) != second.buckets.get(b)}
    assert moved <= set(store.buckets_of("entities", patch, "contractor_raw", second)) and len(moved) <= 3
    after = bytes_of(tmp_path, "entities")
    assert all(after[f] == h for f, h in files_before.items())  # folders never change
    assert second.buckets.keys() - moved and all(second.buckets[b]["paths"] == first.buckets[b]["paths"] for b in second.buckets.keys() - moved)
    want = upsert(conform(rows, "entities"), conform(patch, "entities", "at"), KEYS["entities"], "at")
    assert content(store.read("entities")) == content(want)
    assert content(store.read("entities", -2)) == content(conform(rows, "entities"))
    assert store.counts()["entities"] == 61
    # the same rows again make no version; another number of buckets no difference
    store.upsert("entities", patch, "at")
    assert store.manifest("entities") == second
    store.rebucket("entities", 3)
    assert content(store.read("entities")) == content(want) and set(store.manifest("entities").buckets) == {0, 1, 2}
    found = store.read_keys("entities", spark.createDataFrame([("n3",), ("zz",)], "contractor_raw string"))
    assert [(r.contractor_raw, r.ticker) for r in found.collect()] == [("n3", "W")]


def test_new_keys_are_added_and_folders_merged(spark, tmp_path):
    store = new_store(spark, tmp_path, 2)
    for k in range(10):
        before = store.manifest("entities")
        store.upsert("entities", entities(spark, [(f"n{k}-{j}", "T", j / 10) for j in range(6)]))
        after = store.manifest("entities")
        assert all(len(e["paths"]) <= 8 for e in after.buckets.values())
        for b, e in after.buckets.items():
            o = before.buckets.get(b, {"paths": [], "rows": 0})
            assert e["rows"] > o["rows"] and (e["paths"][:-1] == o["paths"] or len(o["paths"]) == 8)
    whole = content(store.read("entities"))
    assert len(whole) == 60 == store.counts()["entities"]
    digests = {b: e["digest"] for b, e in store.manifest("entities").buckets.items()}
    store.write("entities", store.read("entities"))  # the same rows: nothing moves
    assert {b: e["digest"] for b, e in store.manifest("entities").buckets.items()} == digests and content(store.read("entities")) == whole


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = new_store(spark, tmp_path)
    store.upsert("entities", entities(spark, [("a", "A", 0.5)]))
    before = store.manifest("entities")
    monkeypatch.setattr("tallyworks.sources.store.put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        store.upsert("entities", entities(spark, [("a", "B", 0.9), ("b", "B", 0.9)]))
    monkeypatch.undo()
    assert store.manifest("entities") == before and [r.ticker for r in store.read("entities").collect()] == ["A"]
    store.upsert("entities", entities(spark, [("a", "C", 0.9)]))
    store.vacuum(1, grace_seconds=0)
    assert [r.ticker for r in store.read("entities").collect()] == ["C"] and len({f.split("/")[3] for f in bytes_of(tmp_path, "entities")}) == 1


def test_writers_at_once_all_land(spark, tmp_path):
    store = new_store(spark, tmp_path, 4)
    store.upsert("entities", entities(spark, [(f"n{k}", "T", 0.0) for k in range(12)]))
    errors = []

    def work(w):
        try:
            own = Store(spark, store.root, 4)
            for k in range(3):
                own.upsert("entities", entities(spark, [(f"w{w}-{k}", "T", 1.0), (f"n{w * 3 + k}", f"W{w}", 1.0)]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    rows = {r.contractor_raw: r.ticker for r in store.read("entities").collect()}
    assert rows == {**{f"n{k}": f"W{k // 3}" if k < 9 else "T" for k in range(12)}, **{f"w{w}-{k}": "T" for w in range(3) for k in range(3)}}


def test_a_conflict_is_worked_again_and_bounded(spark, tmp_path):
    store, other = new_store(spark, tmp_path, 1), Store(spark, f"file://{tmp_path}/store", 1)
    store.upsert("entities", entities(spark, [("a", "A", 0.5)]))
    tries = []

    def meddle(times):
        def make(old):
            tries.append(1)
            if len(tries) <= times:
                other.upsert("entities", entities(spark, [(f"m{len(tries)}", "M", times / 100)]))
            return upsert(old, conform(entities(spark, [("a", "B", 0.9)]), "entities").withColumn("p", F.lit(1)), "contractor_raw", "p")

        return make

    store.rewrite("entities", lambda _: [0], meddle(2))
    assert len(tries) == 3
    assert {r.contractor_raw: r.ticker for r in store.read("entities").collect()} == {"a": "B", "m1": "M", "m2": "M"}
    tries.clear()
    with pytest.raises(Conflict):
        store.rewrite("entities", lambda _: [0], meddle(99), attempts=3)
    assert len(tries) == 3


def test_one_file_one_winner(spark, tmp_path):
    path, won = f"file://{tmp_path}/x/1.json", []
    threads = [threading.Thread(target=lambda k=k: files.put_if_absent(spark, path, f"{k}" * 1000) and won.append(k)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and files.read_text(spark, path) == f"{won[0]}" * 1000
    assert files.child_names(spark, f"file://{tmp_path}/x") == ["1.json"]
    calls = []
    assert files.with_retry(lambda: calls.append(1) or (len(calls) < 3 and files.read_text(spark, f"file://{tmp_path}/none")), wait=0.01, errors=("FileNotFound",)) is False
    with pytest.raises(ValueError):
        files.with_retry(lambda: calls.append(1) or int("x"), wait=0.01)
    assert len(calls) == 4


AWARDS = "award_uid string, announced_date string, contractor_raw string, contract_number string, base_contract_number string, action_type string, modification_number string, amount_usd long, cumulative_face_value_usd long, announcement_id string"


def history(rng, n):
    """Rows of a random history: late and re-keyed rows, duplicates, rows without a contract."""
    def row(k):
        number = rng.choice([None, "W1", "W2", "W3", "W4-X", "w5", f"Z{rng.randrange(30)}"])
        return (f"a{k}", rng.choice([None, "2026-01-01", "2026-01-02", "2026-02-01"]), rng.choice(["Acme", "Bolt", "Cray", None]), number, rng.choice([None, None, "W1", "W9"]),
                rng.choice(["new_award", "modification", "option_exercise", None]), rng.choice([None, "P1"]), rng.choice([None, 5, 5, 7_000_000]), rng.choice([None, 9]), "d1")
    return [row(rng.randrange(60)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_upkeep_equals_the_full_recompute(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = new_store(spark, tmp_path, 3)
    for turn in range(5):
        rows = {r[0]: r for r in history(rng, (40, 6, 3, 0, 5)[turn])}
        if rows:
            store.upsert("awards", spark.createDataFrame(list(rows.values()), AWARDS))
        if turn in (0, 2, 3):
            store.upsert("entities", entities(spark, [("Acme", rng.choice("ABC"), 0.9), ("Bolt", "BLT", 0.9)]))
        if turn == 4:  # rows can also go
            store.write("awards", store.read("awards").where("award_uid NOT LIKE '%7'"))
        done = upkeep.keep_contracts(store)
        assert ("rebuilt" in done) == (turn == 0)
        awards = conform(store.read("awards"), "awards")
        want = events.prepare(awards.drop("contract_uid", "is_creating_event", "duplicate_of")).select(awards.columns)
        assert content(awards) == content(want)
        assert content(store.read("contracts")) == content(events.build_contracts(want, store.read("entities")))
        assert content(store.read("contract_events")) == content(want.where("contract_uid IS NOT NULL"))
        assert upkeep.keep_contracts(store) == {"touched": 0}


def test_upkeep_leaves_other_contracts_unread(spark, tmp_path):
    store = new_store(spark, tmp_path, 16)
    rows = [(f"a{k}", "2026-01-01", "Acme", f"W{k}", None, "new_award", None, k, None, "d") for k in range(120)]
    store.upsert("awards", spark.createDataFrame(rows, AWARDS))
    upkeep.keep_contracts(store)
    before = {t: store.manifest(t) for t in ("contracts", "contract_events", "awards")}
    store.upsert("awards", spark.createDataFrame([("b1", "2025-12-31", "Acme", "W7", None, "new_award", None, 3, None, "d")], AWARDS))
    read = []
    plain = store.frame
    store.frame = lambda table, version, buckets=None: read.append((table, buckets if buckets is None else sorted(buckets))) or plain(table, version, buckets)
    assert upkeep.keep_contracts(store) == {"touched": 1, "marked": 2}  # the new creator and the one before it
    assert all(len(b) == 1 for t, b in read if t in ("contracts", "contract_events"))
    for t in ("contracts", "contract_events"):
        after = store.manifest(t)
        assert sum(after.buckets[b] != before[t].buckets.get(b) for b in after.buckets) == 1


def test_changes_of_differing_buckets_equal_the_full_comparison(spark, tmp_path):
    rng = random.Random(4)
    store = new_store(spark, tmp_path, 8)
    tables = ("announcements", "awards", "entities", "materiality")
    score = lambda rows: spark.createDataFrame([(a, rng.randrange(100), rng.choice(["alert", "routine"])) for a in rows], "award_uid string, score int, tier string")
    store.upsert("announcements", spark.createDataFrame([(f"d{k}",) for k in range(20)], "announcement_id string"))
    store.upsert("awards", spark.createDataFrame(list({r[0]: r for r in history(rng, 60)}.values()), AWARDS))
    store.upsert("entities", entities(spark, [("Acme", "A", 0.9)]))
    store.upsert("materiality", score([f"a{k}" for k in range(0, 60, 2)]))
    upkeep.keep_contracts(store)
    for turn in range(1, 2):
        numbers, before = store.numbers(*tables), {t: store.read(t) for t in tables}
        store.upsert("announcements", spark.createDataFrame([(f"d{k}",) for k in range(turn * 3, 22 + turn)], "announcement_id string"))
        more = {r[0]: r for r in history(rng, 9)} | {f"n{turn}": (f"n{turn}", "2026-03-01", "Acme", "W1", None, "modification", "P1", 4, None, "d2")}
        store.upsert("awards", spark.createDataFrame(list(more.values()), AWARDS))
        store.upsert("materiality", score(["a2", "a3", "a4"]))
        upkeep.keep_contracts(store)
        after = {t: store.read(t) for t in (*tables, "contracts")}
        want = changes.detect_changes(before, after).join(store.read("changes").select("change_id"), "change_id", "left_anti")
        old = changes.detect_changes({**before, "awards": after["awards"], "announcements": after["announcements"], "materiality": after["materiality"]}, after)
        got = upkeep.changes_since(store, numbers)
        fresh = {r.award_uid for r in store.changed_keys("awards", numbers["awards"]).select(F.col("key").alias("award_uid")).collect()}
        # modifications that were there before are found again by the full comparison only; they are recorded from the first turn on
        assert content(got) == content(want.where(F.col("change_type") != "modification_on_tracked").unionByName(want.where(F.col("award_uid").isin(*fresh) & (F.col("change_type") == "modification_on_tracked"))))
        assert {r.change_type for r in got.collect()} >= {"new_announcement", "new_award", "modification_on_tracked", "rescored"}
        store.upsert("changes", got.unionByName(old).dropDuplicates(["change_id"]))
        store.unstage("changes")
    # only buckets that differ are read
    numbers = store.numbers(*tables)
    store.upsert("materiality", score(["a5"]))
    sides = store.differing("materiality", numbers["materiality"])
    assert [len({f.rsplit("/", 2)[1] for f in df.inputFiles()}) for df in sides] == [1, 1]
    assert all(not df.inputFiles() for df in store.differing("awards", numbers["awards"]))
