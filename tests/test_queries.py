import pytest

from tallyworks.plans import catalog

from .conftest import SF

MAY_BE_EMPTY = {"prose_scan", "name_scan", "usage_spikes"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(name, same):
    assert same(catalog.queries()[name], catalog.oracle_sql()[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, SF).count() or name in MAY_BE_EMPTY


def test_content_batches_follow_the_rule(spark):
    import hashlib

    from tallyworks.operators.scoring import content_batches

    ids = [f"{i:016x}" for i in range(900)]

    def batches(names):
        df = spark.createDataFrame([(i,) for i in names], "award_uid string")
        got = {}
        for r in content_batches(df).collect():
            got.setdefault(r.batch, []).append(r.award_uid)
        return sorted(tuple(sorted(v)) for v in got.values())

    want, now = [], []
    for i in sorted(ids):
        now.append(i)
        if len(now) >= 20 or len(now) >= 14 and int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 20 == 0:
            want.append(tuple(now))
            now = []
    want += [tuple(now)] if now else []
    assert batches(ids) == want
    assert len(set(batches([*ids, "0000000000000abc"])) - set(want)) <= 2
