"""What follows from changed rows, and from them alone: marks and contracts of touched keys, and the change feed.

Everything starts from two manifests: buckets that differ are read, rows in them compared, and the
contracts of those rows, before and after, are computed anew. ``contract_events`` holds the award rows
once more, placed by contract, so the other rows of a touched contract are found without a scan.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, events
from ..registry import columns, empty
from ..sources.files import exists
from ..sources.store import Store

MARKS = ["contract_uid", "is_creating_event", "duplicate_of"]


def _known(store: Store, table: str, number: int | None) -> bool:
    """Whether a version can still be compared with."""
    return number is not None and (number == 0 or exists(store.spark, f"{store.root}/{table}/manifests/{number:08d}.json"))


def _sides(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(changed.where(F.col(s).isNotNull()).select(f"{s}.*") for s in ("old", "new"))


def rebuild_contracts(store: Store) -> dict[str, int]:
    """All marks and contracts anew: for a store without upkeep so far, or whose last version is gone."""
    entities = store.manifest("entities")
    start = store.manifest("awards")
    owner = f"upkeep-{uuid.uuid4().hex}"
    rows = store.stage(events.prepare(store.frame("awards", start)), owner)
    store.write("awards", rows)
    store.write("contracts", events.build_contracts(rows, store.frame("entities", entities)))
    store.write("contract_events", rows.where("contract_uid IS NOT NULL"), {"awards": _reached(store, start.number), "entities": entities.number})
    store.unstage(owner)
    return {"rebuilt": 1}


def _reached(store: Store, start: int) -> int:
    """The version of awards that this upkeep has dealt with: its own if nobody wrote between, else the one it started from."""
    return start + (store.own.get("awards") == start + 1)


def keep_contracts(store: Store) -> dict[str, int]:
    """Marks of awards, and contracts, for the contracts that rows changed since the last upkeep belong or belonged to.

    Late creators, re-keyed and deleted rows and new tickers are covered; the result is what ``prepare`` and ``build_contracts`` make
    of the whole tables. Contracts that nothing touches are neither read nor written (their buckets' neighbours are). Stopped half-way,
    it starts again from the same version.
    """
    upto = store.manifest("contract_events").upto
    if not all(_known(store, t, upto.get(t)) for t in ("awards", "entities")):
        return rebuild_contracts(store)
    if not any(store.moved(t, upto[t]) for t in ("awards", "entities")):
        return {"touched": 0}
    start, entities = store.numbers("awards")["awards"], store.numbers("entities")["entities"]
    owner = f"upkeep-{uuid.uuid4().hex}"
    changed = store.stage(store.changed_keys("awards", upto["awards"]), owner)
    old, new = _sides(changed)
    stamped = events.stamp(new)
    retold = store.changed_keys("entities", upto["entities"]).where(~F.col("old.ticker").eqNullSafe(F.col("new.ticker"))).select(F.col("key").alias("contractor_raw"))
    uids = [old.select("contract_uid"), stamped.select("contract_uid")]
    retold = store.stage(retold, owner)
    if not retold.isEmpty():  # contracts by the name of their contractor: two columns of them are read
        uids.append(store.read("contracts").join(retold, "contractor_raw", "left_semi").select("contract_uid"))
    touched = store.stage(reduce(DataFrame.unionByName, uids).where("contract_uid IS NOT NULL").distinct(), owner)
    n = touched.count()
    if not n and changed.isEmpty():
        store.rewrite("contract_events", lambda _: [], lambda rows: rows, {"awards": start, "entities": entities})
        store.unstage(owner)
        return {"touched": 0}
    ids = changed.select(F.col("key").alias("award_uid"))
    held = store.read_keys("contract_events", touched).join(ids, "award_uid", "left_anti")
    rows = store.stage(events.prepare(held.unionByName(stamped)), owner)
    # marks as they stand in awards
    stand = held.unionByName(new).select("award_uid", *[F.col(c).alias(f"was_{c}") for c in MARKS])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in MARKS])
    moved = rows.join(stand, "award_uid").where(differs).select(columns("awards"))
    marked = store.upsert("awards", store.stage(moved, owner), staged=True)
    attached = rows.where("contract_uid IS NOT NULL")
    names = attached.select("contractor_raw").distinct()
    built = store.stage(events.build_contracts(attached, store.read_keys("entities", names)), owner)
    store.replace_rows("contracts", touched, built)
    gone = old.select("award_uid", "contract_uid").where("contract_uid IS NOT NULL")
    store.replace_rows("contract_events", gone, attached, {"awards": _reached(store, start), "entities": entities})
    store.unstage(owner)
    return {"touched": n, "marked": marked}


def changes_since(store: Store, before: dict[str, int], owner: str = "changes") -> DataFrame:
    """All five kinds of change between earlier versions (by table) and now, less those recorded already; only what differs is compared."""
    if not any(store.moved(t, n) for t, n in before.items()):
        return empty(store.spark, "changes")
    pairs = {t: _sides(store.stage(store.changed_keys(t, before[t]), owner)) for t in ("announcements", "awards", "materiality")}
    old, new = ({t: p[k] for t, p in pairs.items()} for k in (0, 1))
    ids = store.stage(new["awards"].select("award_uid").unionByName(new["materiality"].select("award_uid")).distinct(), owner)
    awards = store.read_keys("awards", ids)
    about = changes.about(awards, store.read_keys("entities", awards.select("contractor_raw")), store.read_keys("materiality", ids))
    contracts = store.read_keys("contracts", new["awards"].select("contract_uid").where("contract_uid IS NOT NULL"))
    found = store.stage(changes.detect_changes(old, {**new, "contracts": contracts}, about), owner)
    return found.join(store.read_keys("changes", found).select("change_id"), "change_id", "left_anti")
