"""Document states as a stream with timers."""

import json
import random

import pytest

from tallyworks.sources.store import Store
from tallyworks.streaming import states


def test_the_machine():
    step = lambda events: __import__("functools").reduce(lambda s, e: states.after_event(*s, e, 2), events, (None, 0))
    assert step(["listed"]) == ("pending", 0) and step(["failed"]) == ("retry", 1) and step(["listed", "extracted", "failed", "listed"]) == ("extracted", 0)
    assert step(["listed", "failed", "failed"]) == ("retry", 1)  # told twice before its turn
    assert states.after_event("pending", 1, "failed", 2) == ("failed", 2) and states.after_event("failed", 2, "listed", 2) == ("failed", 2)
    assert states.after_event("retry", 1, "extracted", 2) == ("extracted", 1) and states.after_event("pending", 0, "odd", 2) == ("pending", 0)
    rng = random.Random(1)
    for _ in range(200):  # repeats change nothing
        events = [rng.choice(["listed", "extracted", "failed"]) for _ in range(5)]
        assert step(events) == step([e for e in events for _ in range(2)])


def test_a_late_failure_is_tried_once_again(spark, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/store", 2), tmp_path / "in"
    store.create()
    folder.mkdir()
    store.upsert("announcements", spark.createDataFrame([(k, "pending") for k in "abcd"], "announcement_id string, extraction_status string"))

    def run(name=None, rows=()):
        if name:
            (folder / f"{name}.json").write_text("".join(json.dumps({"announcement_id": i, "event": e, "at": f"2026-01-01T{at}:00Z"}) + "\n" for i, e, at in rows))
        states.follow(spark, f"file://{folder}", f"file://{tmp_path}/check", store).awaitTermination()
        held = {r.announcement_id: (r.state, r.attempts) for r in store.read("document_states").collect()}
        status = {r.announcement_id: r.extraction_status for r in store.read("announcements").collect()}
        return held, status

    held, status = run("1", [("a", "listed", "10:00"), ("b", "listed", "10:00"), ("a", "failed", "10:05"), ("b", "extracted", "10:06"), ("c", "failed", "10:07")])
    assert held == {"a": ("retry", 1), "b": ("extracted", 0), "c": ("retry", 1)}
    assert status == {"a": "failed", "b": "extracted", "c": "failed", "d": "pending"}
    before = store.numbers("document_states", "announcements")
    assert run() == (held, status) and store.numbers("document_states", "announcements") == before  # a restart changes nothing
    held, _ = run("2", [("c", "extracted", "10:30"), ("d", "listed", "12:00")])
    held, status = run("3", [("d", "listed", "12:01")])  # the watermark is past the hour now
    assert held == {"a": ("pending", 1), "b": ("extracted", 0), "c": ("extracted", 1), "d": ("pending", 0)} and status["a"] == "pending"
    held, status = run("4", [("a", "failed", "12:30"), ("c", "failed", "12:31")])
    assert held["a"] == ("failed", 2) and held["c"] == ("extracted", 1) and status["a"] == "failed"
    held, _ = run("5", [("d", "extracted", "20:00")])
    assert run("6", [("d", "extracted", "20:01")])[0] == {**held, "d": ("extracted", 0)} and held["a"] == ("failed", 2)  # no third time


@pytest.mark.parametrize("event", ["listed", "failed"])
def test_rows_without_id_or_time_are_left_out(spark, tmp_path, event):
    store, folder = Store(spark, f"file://{tmp_path}/store", 1), tmp_path / "in"
    store.create()
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"event": event, "at": "2026-01-01T10:00:00Z"}) + "\n" + json.dumps({"announcement_id": "x", "event": event}) + "\n")
    states.follow(spark, f"file://{folder}", f"file://{tmp_path}/check", store).awaitTermination()
    assert store.read("document_states").count() == 0
