"""Readers, writers, golden cases and driver-side rules on hand-made files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyworks import registry
from tallyworks.operators import entities, events, oracle, quality, scoring, selectors, tables, telemetry
from tallyworks.sources import golden, html, readers, writers

from .test_tick import MANIFEST


def url(path):
    return f"file://{path}"


def test_manifests(spark, tmp_path):
    assert readers.read_manifest(spark, url(tmp_path / "none.json")).count() == 0
    rows = [{"announcement_id": "1", "announced_date": "2026-01-02", "title": "t", "body_chars": 5, "provenance": {"url": "u", "fetched_at": "2026-01-03T00:00:00Z", "http_status": 200, "sha256": "x", "n_bytes": 7}}, {"announcement_id": "2", "url": "v"}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    manifest = readers.read_manifest(spark, url(tmp_path / "m.json"))
    known = spark.createDataFrame([("1", "extracted")], "announcement_id string, extraction_status string")
    got = {r.announcement_id: (r.url, r.http_status, r.n_bytes, r.extraction_status, str(r.announced_date)) for r in readers.manifest_rows(manifest, known).collect()}
    assert got == {"1": ("u", 200, 7, "extracted", "2026-01-02"), "2": ("v", None, None, "pending", "None")}
    assert [r.title for r in readers.manifest_entry(manifest, "1").collect()] == ["t"] and not readers.manifest_entry(manifest, "3").collect()
    with pytest.raises(Exception, match="without announcement_id"):
        readers.manifest_rows(spark.createDataFrame([(None,) * 6], MANIFEST), known).collect()


def test_feeds_and_listings(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><lastBuildDate> Mon, 1 Jan </lastBuildDate><link>/Article/12/</link><link>/Article/12</link><link>/Article/7/x</link></rss>")
    ids, stamp, status = readers.poll_feed(spark, url(tmp_path / "feed.xml"))
    assert ({r.announcement_id for r in ids.collect()}, stamp, status) == ({"12", "7"}, "Mon, 1 Jan", "ok")
    ids, stamp, status = readers.poll_feed(spark, url(tmp_path / "gone.xml"))
    assert not ids.collect() and stamp is None and status.startswith("error")
    tag = '<a article-id="{}" content-type-name="Contracts" article-title="{}" article-url="u{}">'
    pages = spark.createDataFrame([(1, tag.format(5, "Contracts for Jan. 5, 2026", 1)), (2, tag.format(5, "Contracts for Jan. 6, 2026", 2) + tag.format(8, "Contracts for Feb. 1, 2026", 3))], "page int, html string")
    assert [(r.announcement_id, r.url) for r in readers.collect_pages(pages).collect()] == [("8", "u3"), ("5", "u1")]


def test_files_and_first_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é\n")
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.value, r.sha256, r.n_bytes) for r in readers.whole_files(spark, url(tmp_path)).collect()}
    assert got == {"a.txt": ("é\n", hashlib.sha256("é\n".encode()).hexdigest(), 3)}
    assert readers.first_path(spark, [url(tmp_path / "x"), url(tmp_path / "b.txt"), url(tmp_path / "a.txt")]) == url(tmp_path / "b.txt")
    assert readers.first_path(spark, [url(tmp_path / "x")]) is None
    assert readers.fingerprint(spark, [url(tmp_path / "nothing*")]) == "none"
    shown = spark.createDataFrame([(" ", None, "c"), (None, " b ", "c"), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in shown.select(readers.document_text("x", "y", "z")).collect()] == ["c", "b", None]


def test_alias_tables_and_fact_maps(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,company,aliases\nacm,Acme Corp.,acme works;\n,Nameless,\nZED,Zed,acme works\n")
    rows = readers.read_aliases(spark, url(tmp_path / "u.csv"))
    assert [(r.ticker, r.aliases) for r in rows.orderBy("row").collect()] == [("acm", "acme works;"), (None, None), ("ZED", "acme works")]
    assert {(r.key, r.ticker, r.company_level) for r in entities.alias_index(rows).collect()} == {("acme", "ACM", True), ("acme works", "ACM", False), ("zed", "ZED", True)}
    (tmp_path / "map.json").write_text(json.dumps({"Acme Corp.": {"confidence": 0.4, "raw_variants": ["b"]}, "ACME, Inc.": {"confidence": 0.9, "raw_variants": ["a", "b"]}, "*": {}}))
    got = entities.load_fact_map(readers.read_fact_map(spark, url(tmp_path / "map.json"))).collect()
    assert [(r.key, r.confidence, r.raw_variants, json.loads(r.record)["confidence"]) for r in got] == [("acme", 0.9, ["a", "b"], 0.9)]
    (tmp_path / "bad.json").write_text("{")
    assert not readers.read_fact_map(spark, url(tmp_path / "bad.json")).count() and not readers.read_fact_map(spark, url(tmp_path / "none.json")).count()
    for k in ("b", "a"):
        writers.write_fact_map(spark.createDataFrame([(k, 1), ("0", 2)], "key string, v int"), url(tmp_path / "out"))
    assert [r.name for r in readers.read_fact_map(spark, url(tmp_path / "out")).orderBy("name").collect()] == ["0", "a"]


def test_caches(spark, tmp_path):
    folder = tmp_path / "llm"
    folder.mkdir()
    record = {"label": "x", "model": "small", "created_at": "t", "key_inputs": {"system": "s", "prompt": "p", "schema": "{}", "max_tokens": 9}, "usage": {"input_tokens": 10, "output_tokens": 4}, "output": "yes"}
    (folder / "k1.json").write_text(json.dumps(record))
    (folder / "k2.json").write_text(json.dumps({**record, "model": "large", "usage": {"input_tokens": 1, "output_tokens": 1}}))
    (folder / "k3.json").write_text("{broken")
    cache = readers.read_cache(spark, url(folder))
    assert tuple(readers.cache_stats(cache).first()) == (2, 11, 5)
    assert {tuple(r) for r in readers.cache_usage(cache).collect()} == {("small", 1, 10, 4), ("large", 1, 1, 1)}
    asked = spark.createDataFrame([("k1",), ("k9",)], "cache_key string")
    assert [r.cache_key for r in readers.misses(asked, cache).collect()] == ["k9"]
    assert {(r.cache_key, r.output) for r in readers.answered(asked, cache, live=True).collect()} == {("k1", "yes"), ("k9", None)}
    with pytest.raises(Exception, match="no cached answer for k9"):
        readers.answered(asked, cache).collect()
    assert not readers.cache_stats(spark.createDataFrame([], cache.schema)).first().input_tokens
    writers.write_cache(cache.select("cache_key", "output"), url(tmp_path / "out"))
    writers.write_cache(cache.select("cache_key", "output"), url(tmp_path / "out"))
    assert spark.read.parquet(url(tmp_path / "out")).count() == 4


def test_transcripts(spark):
    use = {"input_tokens": 5, "output_tokens": 2}
    lines = [{"type": "agent", "name": "Ann"}, {"type": "x", "message": {"id": "m1", "model": "small", "usage": use}}, "{bad", {"message": {"id": "m1", "model": "small", "usage": use}}, {"name": "Bob", "message": {"id": "m2", "model": "<synthetic>", "usage": use}}, {"message": {"id": "m3", "model": "large", "usage": {**use, "cache_read_input_tokens": 7}}}]
    df = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "position int, value string")
    turns = readers.transcript_turns(df)
    assert sorted((r.id, r.position, r.name, r.cache_read) for r in turns.collect()) == [("m1", 1, "Ann", 0), ("m3", 5, "Bob", 7)]
    assert telemetry.reuse(turns).first().reuse == round(7 / 17, 6)
    text = writers.transcript_markdown(spark.createDataFrame([(1, None, "key sk-" + "a" * 30)], "position int, name string, text string")).first()
    assert text.block == "**?**\n\nkey sk-REDACTED"


def test_tables_of_exports(spark, tmp_path):
    store = writers.Store(spark, url(tmp_path / "s"))
    store.create()
    store.upsert("awards", spark.createDataFrame([("a", 5)], "award_uid string, amount_usd long"))
    assert set(store.export(url(tmp_path / "out"))) == {f"{t}.parquet" for t in registry.TABLES} | {f"{t}.csv" for t in writers.CSV_TABLES}
    df, state = readers.load_table(spark, "awards", [url(tmp_path / "no"), url(tmp_path / "out")])
    assert state == "found" and [(r.award_uid, r.amount_usd) for r in df.collect()] == [("a", 5)]
    assert readers.load_table(spark, "awards", [url(tmp_path / "no")])[1] == "missing"
    (tmp_path / "bad" / "awards.parquet").mkdir(parents=True)
    assert readers.load_table(spark, "awards", [url(tmp_path / "bad")])[1].startswith("error")
    assert "award_uid" in (next((tmp_path / "out" / "awards.csv").glob("part*"))).read_text()
    store.adopt("entities", spark.createDataFrame([("n",)], "contractor_raw string"))
    assert "ticker" in store.migrate()["entities"] and store.migrate() == {}
    with pytest.raises(Exception, match="null award_uid"):
        store.upsert("awards", spark.createDataFrame([(None, 1)], "award_uid string, amount_usd long"))
    assert store.read("awards").count() == 1  # a failed write changes nothing
    assert [(r.contractor_raw, r.ticker) for r in store.read("entities").collect()] == [("n", None)]
    folders = lambda: len(list((tmp_path / "s" / "awards" / "data").iterdir()))
    store.upsert("awards", spark.createDataFrame([("a", 6)], "award_uid string, amount_usd long"))
    store.vacuum(1)
    assert folders() > 1  # young folders may be a writer's at work
    store.vacuum(1, grace_seconds=0)
    assert [r.amount_usd for r in store.read("awards").collect()] == [6] and len(store._versions("awards")) == 1 and folders() == 1


def test_activity_log(spark, tmp_path):
    log = url(tmp_path / "log")
    writers.append_log(spark, log, "ann", ["one", "two"])
    writers.append_log(spark, log, "bob", ["x"], "spawn")
    lines = [r.value for r in spark.read.text(log).collect()]
    assert sorted(x.split("` ")[-1] for x in lines) == ["# Activity log", "one", "started: x", "two"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(lines))], "at int, line string")
    assert tables.tail(rows, "line", "at", 2).count() == 2


def test_golden_cases(spark, tmp_path):
    base = {"announcement_id": "1", "announced_date": "2026-01-01", "source": "s", "title": "t", "why": "w", "verified_against": "v"}
    checks = [{"id": "a", "kind": "row", "select": {"contractor_raw": "Acme"}, "expect": {"amount_usd": 5, "small_business": True}}, {"id": "b", "kind": "count", "select": {"amount_usd": {"in": [5, 6]}}, "expect": 2}, {"id": "c", "kind": "absent", "select": {"contractor_raw": {"startswith": "Z", "contains": "q"}}}]
    (tmp_path / "b.json").write_text(json.dumps({**base, "case_id": "b", "checks": checks}))
    (tmp_path / "a.json").write_text(json.dumps({**base, "case_id": "a", "checks": [{"id": "d", "kind": "row", "select": {"nope": 1}, "expect": {}}]}))
    cases = golden.load_cases(spark, url(tmp_path))
    awards = spark.createDataFrame([("1", "Acme", 5, True), ("1", "Bolt", 6, None), ("2", "Acme", 5, True)], "announcement_id string, contractor_raw string, amount_usd long, small_business boolean")
    assert golden.run_cases(awards, cases) == ({"a": {"passed": 0, "failed": 0, "blocked": 1}, "b": {"passed": 3, "failed": 0, "blocked": 0}}, 2)
    assert golden.run_cases(awards.withColumn("amount_usd", F.lit(7)), cases)[1] == 1 and golden.run_cases(awards, cases[1:])[1] == 0
    (tmp_path / "c.json").write_text(json.dumps({**base, "case_id": "c", "checks": []}))
    with pytest.raises(ValueError, match="c lacks checks"):
        golden.load_cases(spark, url(tmp_path))


POOL = {"case_id": "pool", "announcement_id": "d", "announced_date": "2026-01-01", "source": "s", "title": "t", "why": "w", "verified_against": "v", "checks": [
    {"id": "one", "kind": "row", "select": {"contractor_raw": "Acme"}, "expect": {"amount_usd": 600, "cumulative_face_value_usd": None, "is_multi_award": True}},
    {"id": "all", "kind": "count", "select": {"action_type": "multi_award_pool"}, "expect": 3},
    {"id": "none", "kind": "absent", "select": {"contractor_raw": {"contains": "Zed"}}},
]}


def pool(spark):
    rows = [("a1", "d", "Acme", 600, None, True, "multi_award_pool"), ("a2", "d", "Bolt", 600, None, True, "multi_award_pool"), ("a3", "d", "Cray", 600, None, True, "multi_award_pool"), ("a4", "e", "Acme", 5, None, False, "new_award")]
    return spark.createDataFrame(rows, "award_uid string, announcement_id string, contractor_raw string, amount_usd long, cumulative_face_value_usd long, is_multi_award boolean, action_type string")


def test_all_checks_in_one_scan_equal_each_by_itself(spark):
    broken = {**POOL, "case_id": "broken", "checks": [{"id": "x", "kind": "row", "select": {"nope": 1}, "expect": {}}, {"id": "y", "kind": "count", "select": {"amount_usd": {"like": 1}}, "expect": 1}, {"id": "z", "kind": "row", "select": {"is_multi_award": 1}, "expect": {}}]}
    other = {**POOL, "case_id": "other", "announcement_id": "e"}
    for rule in (lambda df: df, events.divide_pools, events.cumulate_pools, events.collapse_pools):
        awards = rule(pool(spark))
        found = selectors.run_cases_once(awards, [POOL, broken, other])
        for case in (POOL, broken, other):
            assert selectors.tally(found[case["case_id"]]) == selectors.run_case(awards.where(F.col("announcement_id") == case["announcement_id"]), case)
        for check in POOL["checks"]:
            assert found["pool"][check["id"]] == selectors.run_check(awards.where("announcement_id = 'd'"), check)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("golden", "one scan")
    try:
        assert golden.run_cases(pool(spark), [POOL]) == ({"pool": {"passed": 3, "failed": 0, "blocked": 0}}, 0)
        assert len(jobs.getJobIdsForGroup("golden")) <= 2  # the scan, and its final stage where adaptive execution parts them
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rules_are_run_before_they_are_promoted(spark, tmp_path):
    """The wrong rules are run on the cases' documents and rejected; one that mends is promoted, once it is asked for."""
    good, skills = pool(spark), url(tmp_path / "skills.md")
    effects = {"divide": events.divide_pools, "cumulate": events.cumulate_pools, "collapse": events.collapse_pools, "harmless": lambda df: df}

    def awards(text):
        if "unasked" in text:
            raise oracle.MissingAnswers("no stored answer")
        out = good
        for word, effect in effects.items():
            out = effect(out) if word in text else out
        return out

    for rule in ("divide", "cumulate", "collapse"):
        verdict, wrong = golden.promote(spark, [POOL], awards, skills, rule, apply=True)
        assert verdict == "REJECT" and wrong and set(wrong) <= {"pool/one", "pool/all"}
    assert golden.promote(spark, [POOL], awards, skills, "harmless", apply=True) == ("UNPROVEN", {})
    assert golden.promote(spark, [POOL], awards, skills, "unasked", apply=True)[0] == "REFUSE" and not (tmp_path / "skills.md").exists()
    (tmp_path / "skills.md").write_text("divide\n")  # skills that are wrong today
    mend = lambda text: good if "mend" in text else awards(text)
    assert golden.promote(spark, [POOL], mend, skills, "mend")[0] == "PROMOTE" and (tmp_path / "skills.md").read_text() == "divide\n"
    assert golden.promote(spark, [POOL], mend, skills, "mend", apply=True) == ("PROMOTE", {}) and (tmp_path / "skills.md").read_text() == "divide\n\nmend\n"
    assert golden.VERDICTS == {"PROMOTE": 0, "UNPROVEN": 0, "REJECT": 1, "REFUSE": 2}


def test_prose_of_cases(spark, tmp_path):
    pages, snaps = tmp_path / "articles", tmp_path / "prose"
    for d in (pages, snaps):
        d.mkdir()
    (pages / "1.html").write_text('<div class="body"><p>A &amp; B</p></div></div>')
    (pages / "2.html").write_text('<div class="body"><p>New</p></div></div>')
    for i, t in (("1", "A & B"), ("2", "Old"), ("3", "Kept")):
        (snaps / f"{i}.txt").write_text(t)
    got = sorted((r.announcement_id, r.prose, r.source, r.drifted) for r in golden.resolve_bodies(spark, url(pages), url(snaps)).collect())
    assert got == [("1", "A & B", "html", False), ("2", "New", "html", True), ("3", "Kept", "snapshot", False)]
    assert golden.resolve_bodies(spark, url(tmp_path / "no"), url(snaps)).where("digest = sha2(prose, 256)").count() == 3


def test_selectors_and_the_gate(spark):
    df = spark.createDataFrame([("ab", 1, True, 0.5), ("b", 2, False, None), (None, None, None, 1.0)], "s string, n long, b boolean, d double")
    n = lambda sel: selectors.select(df, sel).count()
    assert [n({"s": "ab"}), n({"s": None}), n({"n": {"in": [1, 3]}}), n({"s": {"contains": "b"}}), n({"s": {"startswith": "b"}}), n({"s": {"is_null": True}}), n({"s": {"is_null": False}}), n({"n": {"not": 1}})] == [1, 1, 1, 2, 1, 1, 2, 2]
    assert [n({"b": True}), n({"n": True}), n({"b": 1}), n({"n": "1"}), n({"d": 0.5}), n({})] == [1, 0, 0, 0, 1, 3]
    for bad in ({"x": 1}, {"s": {"like": "a"}}):
        with pytest.raises(ValueError):
            n(bad)
    assert selectors.run_check(df, {"kind": "row", "select": {"s": {"contains": "b"}}, "expect": {}}) == "several rows match"
    assert selectors.run_check(df, {"kind": "row", "select": {"s": "z"}, "expect": {}}) == "no rows match"
    assert selectors.run_check(df, {"kind": "row", "select": {"s": "b"}, "expect": {"n": 3, "b": False}}) == "differs in n"
    score = lambda p, b=0: {"passed": p, "failed": 0, "blocked": b}
    assert [selectors.gate(score(3), score(*x)) for x in ((3, 1), (2,), (3,), (4,))] == ["REFUSE", "REJECT", "UNPROVEN", "PROMOTE"]


def test_the_contract(spark):
    assert registry.table_for(["award_uid", "score"]) == "materiality" and registry.table_for(["award_uid", "amount_usd"]) == "awards" and registry.table_for(["nope"]) is None
    assert registry.primary_key("changes") == "change_id" and len(registry.model_fields("awards")) == 22 and len(registry.columns("awards")) == 32
    assert len(registry.all_ddl()) == 8 and registry.ddl("materiality").startswith("CREATE TABLE IF NOT EXISTS materiality (award_uid STRING")
    schema = registry.extraction_schema()
    item = schema["properties"]["awards"]["items"]
    assert schema["required"] == ["awards", "document_notes"] and item["required"] == registry.model_fields("awards") and not item["additionalProperties"]
    assert registry.json_schema("materiality")["properties"]["tier"]["enum"] == registry.TIERS
    unions = [f for f, p in item["properties"].items() if "anyOf" in p or isinstance(p.get("type"), list)]
    assert len(unions) == 14 and json.loads(registry.json_schema_text("awards")) == item
    with pytest.raises(ValueError, match="missing columns: b"):
        registry.require(spark.range(1).select(F.col("id").alias("a")), ["a", "b"])
    assert registry.missing_columns(spark.range(1).select(F.col("id").alias("award_uid")), "materiality") == registry.columns("materiality")[1:]
    assert (telemetry.confidence_column(["a", "extraction_confidence"]), telemetry.model_column(["scorer_model"]), telemetry.model_column(["x"])) == ("extraction_confidence", "scorer_model", None)


def test_names_by_place_and_by_name(spark):
    asked = spark.createDataFrame([(0, 0, "Acme Corp."), (0, 1, "Bolt"), (1, 0, "Acme Inc."), (1, 1, "Zed"), (1, 2, "Bolt")], "batch int, pos int, name string")
    answers = spark.createDataFrame([(0, 0, "x", "i0"), (0, 1, None, "i1"), (1, 0, "bolt llc", "i2"), (1, 1, "other", "i3")], "batch int, pos int, normalized_name string, item string")
    got = {(r.batch, r.pos): (r.name, r.item) for r in entities.align(answers, asked).collect()}
    assert got == {(0, 0): ("Acme Corp.", "i0"), (0, 1): ("Bolt", "i1"), (1, 2): ("Bolt", "i2"), (1, 0): ("Acme Inc.", "i3")}
    made = spark.createDataFrame([("Acme, Inc.",)], "x string").select(entities.placeholder(spark, F.col("x")).alias("p")).first().p
    assert (made.normalized_name, made.relationship, made.confidence) == ("Acme", "unknown", 0.0)


def test_rows_of_payloads(spark):
    names = spark.createDataFrame([(0, 0, "Acme Corp."), (0, 1, "Bolt")], "batch int, pos int, name string")
    payload = {"entities": [{"normalized_name": "Acme", "ticker": "acm", "relationship": "direct", "confidence": 0.9}, {"normalized_name": "Bolt", "relationship": "private", "confidence": "0.8"}]}
    got = entities.from_payloads(spark.createDataFrame([(0, json.dumps(payload)), (1, "{broken")], "batch int, payload string"), names).collect()
    assert {(r.contractor_raw, r.ticker, r.relationship, r.confidence) for r in got} == {("Acme Corp.", "ACM", "direct", 0.9), ("Bolt", None, "private", 0.8)}
    asked = spark.createDataFrame([(0, 0, "a1"), (0, 1, "a2")], "batch int, pos int, award_uid string")
    scored = scoring.from_payloads(spark.createDataFrame([(0, '{"scores": [{"score": 88, "tier": "alert", "confidence": 0.95, "drivers": ["x"]}]}')], "batch int, payload string"), asked).collect()
    assert {(r.award_uid, r.score, r.tier, r.confidence) for r in scored} == {("a1", 88, "alert", 0.95), ("a2", 0, "routine", 0.3)}
    causes = quality.from_payloads(spark.createDataFrame([(0, '{"diagnoses": [{"code": "A", "cause": "x", "confidence": 0.4}, {"code": "A", "cause": "schema_gap", "confidence": 0.9}]}')], "batch int, payload string"))
    assert [tuple(r) for r in quality.merge_causes(spark.createDataFrame([("A",), ("B",)], "code string"), causes).orderBy("code").collect()] == [("A", "schema_gap", 0.9, True), ("B", None, None, True)]


def test_oracles_findings_and_membership(spark):
    got = scoring.ask(spark.createDataFrame([(i,) for i in range(45)], "n int").coalesce(1), lambda rows: [{"n": r["n"], "size": len(rows)} for r in rows], "n int, size int", 20).collect()
    assert sorted({r["size"] for r in got}) == [5, 20] and len(got) == 45
    found = spark.createDataFrame([("A", "error", 4, ["x", "y"])], "code string, severity string, n long, sample array<string>")
    assert quality.report(found).split("\n")[4] == "| A | error | 4 | x, y |"
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [df.where(tables.any_of("s", v)).count() for v in (["a"], [])] == [1, 3]
    answers = spark.createDataFrame([("d", "2026-01-01", json.dumps({"awards": [{"contractor_raw": " "}, {"contractor_raw": "Bolt*", "contract_number": "N1", "amount_usd": "$1,200.5", "is_idiq": "yes"}, {"contractor_raw": "Bolt*", "contract_number": "N1"}]}))], "announcement_id string, announced_date string, payload string")
    none = F.lit(None).cast("string")
    rows = events.postprocess(answers.select("*", none.alias("model"), none.alias("cache_key"), none.alias("skills_version"), F.lit(None).cast("timestamp").alias("extracted_at"))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert {(r.award_uid, r.amount_usd, r.is_idiq, r.small_business) for r in rows} == {(sha("d|N1|bolt*"), 1200, True, True), (sha("d|#1|bolt*"), None, None, True)}
    assert html.scan_names(spark.createDataFrame([(1, None)], "page_id int, html string")).count() == 0
