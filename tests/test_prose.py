import duckdb

from tallyworks.plans import catalog
from tallyworks.sources import html

from .conftest import SF

PAGES = [
    '<div>x</div><DIV class="a body">one</div> </div><div class="body">two</div></div>',
    '<div class="body"></div></div>rest',
    '<p>no such part</p>$1 \\ ',
    '<div class="somebody"><p>outside</p></div></div>',
    'a\n<div\nclass="body b">two\nlines</div>\n</div>\nrest',
    '<style>p</style><div id="1"><div class="x body">in</div>one</div>',
    "",
]


def test_prose_is_the_first_body(spark):
    rows = html.body_text(spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")).orderBy("page_id").collect()
    assert [r.prose for r in rows] == ["one", "", "no such part\n$1 \\", "outside", "two\nlines", "in\none", ""]


CUT = ["token = &quot", "&quotx", "&copy", "&middot 2", "&lt;&#39;&nbsp;", "&AMP;&QUOT;", "&amp", "&am", "&amp;quot;", "&amp;amp;", "&ampx", "$1 \\ &copy; &middot; &quot;", "x\rARMY y", "x\x85NAVY y", "x\u2028MARINE y", "x\r\nARMY y", "x\n  NAVY y", "x \u2029", "x\n\x85", None, ""]


def test_html_prose_of_cut_references_equals_its_sql(spark, tmp_path):
    """A reference cut by the end of a title stays as it is there."""
    rows = [(k, "u", x) for k, x in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["html_prose"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["html_prose"](spark, str(tmp_path)).select("page_id", "url", "prose").collect())) == want
    assert [p for _, _, p in want][:2] == ["token = &quot", "&quotx"]


def test_body_text_decodes_cut_references(spark):
    rows = html.body_text(spark.createDataFrame([(0, "token = &quot"), (1, "&lt;&#39;")], "page_id int, html string")).orderBy("page_id").collect()
    assert [r.prose for r in rows] == ['token = "', "<'"]


def test_long_patterns_are_matched_once(spark):
    """The body's pattern was matched to see whether it is there and again to cut it out, that of dollars up to six times a line."""
    plan = catalog.queries()["prose_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\bbody\\b") == 1


def test_amounts_of_lines(spark):
    said = ["a $1.5 billion", "a $2,000", "$ none", "a $3 million and $4", "$, odd"]
    docs = spark.createDataFrame([(str(k), f"Acme Corp., Dayton, was awarded {x} contract.") for k, x in enumerate(said)], "announcement_id string, prose string")
    got = html.scan_lines(docs).orderBy("announcement_id").collect()
    assert [r.amount_usd for r in got] == [1_500_000_000, 2000, None, 3_000_000, None]
