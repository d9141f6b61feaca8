import pytest
from pyspark.sql import functions as F

from tallyworks import registry
from tallyworks.functions import text, values
from tallyworks.operators import oracle, selectors, tables
from tallyworks.sources import html, writers


def _one(spark, column, schema, *vals):
    return [r[0] for r in spark.createDataFrame([(v,) for v in vals], f"x {schema}").select(column).collect()]


def test_printed_dollars_round_as_python_does(spark):
    amounts = [0, 999, 1050, 1_150_000, 1_250_000, 1_950_000_000, 2_250_000_000, 999_950, 123_456_789_012, -1_500_000, None]

    def want(v):
        if v is None:
            return "-"
        for cut, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(v) >= cut:
                return f"${v / cut:,.1f}{unit}"
        return f"${v:,.0f}"

    assert _one(spark, values.usd(F.col("x")), "long", *amounts) == [want(v) for v in amounts]


def test_names(spark):
    got = _one(spark, text.normalize_name(F.col("x")), "string", "The Boeing Co.,*", "A & B, L.L.C.", "Co.", "", None)
    assert got == ["boeing", "a and b", "co", "", ""]
    assert _one(spark, text.display_name(F.col("x")), "string", "Action Manufacturing Co.,*") == ["Action Manufacturing"]


def test_coercion(spark):
    assert _one(spark, values.store_int(F.col("x")), "string", "$1,234.9", "", "x", "true") == [1234, None, None, 1]
    assert _one(spark, values.model_int(F.col("x")), "string", "2.5", "about $3,000", None) == [2, 3000, None]
    assert _one(spark, values.store_bool(F.col("x")), "string", "Yes", "no", "", None) == [True, False, None, None]
    assert _one(spark, values.as_list(F.col("x")), "string", '["a"]', "b", None) == [["a"], ["b"], []]


def test_selector_not_is_true_of_null(spark):
    df = spark.createDataFrame([("a", True), (None, False)], "s string, b boolean")
    assert selectors.select(df, {"s": {"not": "a"}}).count() == 1
    assert selectors.select(df, {"b": 1}).count() == 0


def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2)], "k string, v int, p int")
    assert sorted(map(tuple, tables.upsert(old, new, "k", "p").collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_prose_rows_carry_the_header(spark):
    prose = "NAVY\nAcme Corp., Dayton, Ohio, is awarded a $1.5 million modification (P00002) to a contract.\nARMY\nBolt LLC,* Reno, Nevada, was awarded a $2,000 contract. 3 bids were received."
    rows = html.scan_lines(spark.createDataFrame([("1", prose)], "announcement_id string, prose string")).orderBy("amount_usd").collect()
    assert [(r.service_branch, r.contractor_raw, r.amount_usd, r.action_type) for r in rows] == [("ARMY", "Bolt LLC", 2000, "new_award"), ("NAVY", "Acme Corp.", 1_500_000, "modification")]
    assert (rows[0].bids_received, rows[0].small_business, rows[1].modification_number) == (3, True, "P00002")


def test_body_and_references(spark):
    page = '<script>x</script><div class="a body"><p>A &amp; B</p>  <p>C</p></div></div>rest'
    got = html.body_text(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert [r.prose for r in got] == ["A & B\nC", ""]


def test_store_upserts_and_conforms(spark, tmp_path):
    store = writers.Store(spark, f"file://{tmp_path}")
    store.create()
    store.upsert("entities", spark.createDataFrame([("a", "0.5", "x"), ("b", "bad", "y")], "contractor_raw string, confidence string, other string"))
    store.upsert("entities", spark.createDataFrame([("a", 0.9)], "contractor_raw string, confidence double"))
    assert sorted((r.contractor_raw, r.confidence) for r in store.read("entities").collect()) == [("a", 0.9), ("b", None)]
    assert store.read("entities").columns == registry.columns("entities")


def test_casefold_as_python(spark):
    words = ["Straße AG", "ΣΊΣΥΦΟΣ", "ﬁnal Oﬀer", "ſecond", "K9", "ABC def", "ŉ ǰ ẞ", "", None, "İstanbul", "Ꭰꭰ"]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    got = [r.f for r in rows.select("k", text.casefold(F.col("w")).alias("f")).orderBy("k").collect()]
    assert got == [w and w.casefold() for w in words]
    named = rows.select("k", text.normalize_name(F.col("w")).alias("n"), text.cell_text(F.col("w")).alias("c")).orderBy("k").collect()
    assert [named[k].n for k in (0, 2, 3)] == ["strasse ag", "final offer", "second"]
    cells = spark.createDataFrame([("—",), (" ",), (None,), ("ACM ",)], "t string").select(text.cell_text(F.col("t")).alias("c"))
    assert [r.c for r in cells.collect()] == ["", "", "", "ACM"]


def test_nothing_is_asked_under_guard_and_stubs_answer(spark):
    asked = oracle.CachedOracle(None, oracle.stubbed({}), lambda items: items)
    with oracle.Guard() as guard, pytest.raises(AssertionError, match="nothing may be spent"):
        asked(spark.range(1))
    assert guard.fired == 1 and not oracle.Guard.entered
    answer = oracle.stubbed({"p": "{}"}, tokens=(3, 1))
    assert [(e, a) for _, a, e in oracle.isolate([{"prompt": "p"}, {"prompt": "q"}], answer)] == [(None, {"output": "{}", "input_tokens": 3, "output_tokens": 1}), ("KeyError: 'q'", None)]
