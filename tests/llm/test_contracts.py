"""The ten queries on hand-made and small tables against brute force."""

import gzip
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import bitsliced_topk, divergence_rules, line_windows, minhash, packing, page_text, piece_codec, quality_fm, queries, repeat_windows, warc

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, band string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", None) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["the", "and", "wave", "Örtchen", "stone", "it's", "river", "x#", "blue", "seven"]
    passage = " ".join(rng.choice(words) + str(k) for k in range(60))
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "A b"), (5, "a B"), (6, passage), (7, f"start {passage} end"), (8, "same line\nsame line\nsame line\n" * 4), (9, "é" * 3000)]
    for i in range(10, 60):
        base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(20, 80))]
        out.append((i, " ".join(base)))
        if i % 3 == 0:
            base[rng.randrange(len(base))] = "changed"
            out.append((100 + i, " ".join(base)))
        if i % 7 == 0:
            out.append((200 + i, " ".join(base) + "\n" + passage[:120]))
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, same):
    assert same(queries.queries()[name], queries.oracle_sql()[name])


def test_near_duplicates(spark, texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i, _ in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, texts), 2, 80).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_blocks_alone_find_the_links(spark, texts, monkeypatch):
    want = sorted(minhash.near_duplicates(table(spark, texts), 2).collect())
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert sorted(minhash.near_duplicates(table(spark, texts), 2).collect()) == want


def windows_by_force(rows):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row; rows without an id neither remove nor lose."""
    data = sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    first, want = {}, []
    for i, b in data:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in [*data, *((None, (t or "").encode()) for i, t in rows if i is None)]:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((str(i), len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_BYTES": 3000}, {"CHUNK_BYTES": 3000, "HOT": 2, "ROUTE_RUNS": 20}, {"CHUNK_BYTES": 2000, "BUCKET_RUNS": 100, "LARGE": 150, "SPLIT": 4}, {"CHUNK_BYTES": 900, "LARGE": 40, "SPLIT": 3, "LEVELS": 2, "SLICE": 60}])
def test_repeated_windows(spark, texts, sizes, monkeypatch):
    for name, v in sizes.items():
        monkeypatch.setattr(repeat_windows, name, v)
    header = "This text begins as very many others do, by words that all of them share; "
    rng = random.Random(1)
    rows = [*texts, *((1000 + k, header + " ".join(str(rng.randrange(40)) for _ in range(30))) for k in range(60)), (None, header * 2), (None, header * 2), (1001, header), (1001, header), (3000, texts[6][1] * 3)]
    docs = table(spark, rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_windows.measure(docs).collect())
    want = windows_by_force(rows)
    assert got == want
    assert any(v[2] for v in want)


def test_rule_counts(spark, texts):
    docs = table(spark, texts)
    for r in divergence_rules.judge(docs, divergence_rules.references(docs)).collect():
        t = dict(texts)[r.doc_id] or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_pieces_as_the_library(spark, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_codec.round_trip(table(spark, texts), path).collect():
        ids = sp.encode(dict(texts)[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_packing_is_whole_and_gapless(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    bins, pieces = {}, {}
    for r in packing.pack_documents(table(spark, texts), path).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(pieces[i]) == [(k, 4096 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cut)]
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(bins) <= -(-total // 4096) + 1


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality_fm(spark, sf).collect() if r.held_out and good.get(r.doc_id) is not None]
    right = sum((r.score >= 0.5) == (good[r.doc_id] == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.85


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert not quality_fm.score(none, quality_fm.train(none, labels)).collect()
    assert not minhash.near_duplicates(none).collect()
    assert not repeat_windows.measure(none).collect()
    assert not line_windows.remove_repeats(none).collect()
    assert not divergence_rules.judge(none, divergence_rules.references(none)).collect()
    assert not packing.pack_documents(none, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert not page_text.extract(pages).collect()


def test_page_text_cases(spark):
    page = "<html><head><style>p{}</style></head><body><nav>Menu</nav><article><h1>T &amp; t</h1><p>First  one.</p><script>var a;</script><p>Second.</p></article><footer>End</footer></body></html>"
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.extract(spark.createDataFrame([(1, "http://a.example.com/x", page), (2, None, None), (3, "", "")], "page_id long, url string, html string")).collect()}
    assert got == {1: ("T & t\nFirst one.\nSecond.", 24), 2: ("", 0), 3: ("", 0)}


def extracted(spark, rows):
    return {r.page_id: r.text.split("\n") for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def paragraphs(k, n=3):
    return [f"Paragraph {j} of story {k}: " + " ".join(hashlib.md5(f"{k} {j} {i}".encode()).hexdigest() for i in range(4)) for j in range(n)]


def page(lines, box="<article>{}</article>"):
    return "<body>" + box.format("".join(f"<p>{x}</p>" for x in lines)) + "</body>"


def test_template_lines_go_but_those_of_articles_stay(spark):
    frame, plain = ["You are here", "Read more"], "<div>{}</div>"
    rows = [(k, f"http://a.example.com/n/{k}", page([frame[0], *paragraphs(k), frame[1]], "<article>{}</article>" if k < 4 else plain)) for k in range(8)]
    rows.append((8, "http://b.example.com/n/8", page([*frame, *paragraphs(8)])))  # alone on its host
    quote = "A sentence quoted by one page only"
    rows += [(k, f"http://c.example.com/n/{k}", page([*paragraphs(k), *([quote] if k < 11 else [])])) for k in (9, 10, 11)]
    got = extracted(spark, rows)
    assert all(got[k] == paragraphs(k) for k in range(4, 8))
    assert all(got[k] == [frame[0], *paragraphs(k), frame[1]] for k in range(4))
    assert got[8] == [*frame, *paragraphs(8)]
    assert got[10] == [*paragraphs(10), quote]  # 11 doesn't share it


def test_main_loses_what_both_sides_share_but_not_its_articles(spark):
    frame = ["You are here", "Read more"]
    box = "<main><p>You are here</p><article>{}</article><p>Read more</p></main>"
    got = extracted(spark, [(k, f"http://a.example.com/n/{k}", page(["By Jane Doe", *paragraphs(k)], box)) for k in range(4)])
    assert all(got[k] == ["By Jane Doe", *paragraphs(k)] for k in range(4))
    assert extracted(spark, [(1, "http://a.example.com/1", page(paragraphs(1), box))]) == {1: [frame[0], *paragraphs(1), frame[1]]}


def test_lines_that_articles_share_stay(spark):
    got = extracted(spark, [(k, f"http://a.example.com/n/{k}", page(["By Jane Doe", *paragraphs(k)])) for k in range(3)])
    assert all(got[k] == ["By Jane Doe", *paragraphs(k)] for k in range(3))


@pytest.mark.parametrize("box", ['<article class="post category-social">{}</article>', '<article class="post-12 tag-sponsored">{}</article>', '<section id="banner-story">{}</section>', '<div class="social-history">{}</div>',
    '<article class="comments" id="sidebar">{}</article>', '<div role="main" class="ad">{}</div>', '<main id="menu">{}</main>', '<article><div class="login-story">{}</div></article>', '<div class="category-social-3"><article>{}</article></div>'])
def test_class_words_drop_no_content(box):
    lines, marks = page_text.content(page(paragraphs(1), box))
    assert page_text.chosen(lines, marks) == paragraphs(1)


@pytest.mark.parametrize("name", ["ad", "ads-top", "sidebar-2", "site-footer", "cookie-notice", "newsletter_signup", "share-buttons", "nav links"])
def test_names_of_boilerplate(name):
    assert page_text.content(f'<div class="{name}"><p>Chrome</p></div><p>Text</p>') == (["Text"], "o")


def test_teaser_article_is_not_the_text(spark):
    teaser = "<article><h2>Another story</h2></article>"
    got = extracted(spark, [(1, "http://a.example.com/1", f"<body>{teaser}" + page(paragraphs(1), "<div>{}</div>")), (2, "http://b.example.com/2", "<body><div>A short remark</div>" + page(paragraphs(2)))])
    assert got == {1: ["Another story", *paragraphs(1)], 2: paragraphs(2)}


@pytest.mark.parametrize("box", ["<form>{}</form>", '<div id="top">{}</div>', '<div class="side-by-side">{}</div>', '<div class="widget">{}</div>', '<div class="ad">Buy{}', "<head><title>T</title><body>{}</body>"])
@pytest.mark.parametrize("mark", ["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', '<div role="article">{}</div>', '<article id="top">{}</article>'])
def test_content_below_boilerplate_opens(box, mark):
    lines, marks = page_text.content(page(paragraphs(1), box.replace("{}", "<p>Chrome</p>" + mark) if "body" not in box else box.format(mark)))
    assert page_text.chosen(lines, marks) == paragraphs(1)


@pytest.mark.parametrize("box", ["<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", '<div class="comments">{}</div>', "<div hidden>{}</div>"])
def test_articles_in_other_parts_stay_out(box):
    lines, marks = page_text.content(page(["Remark"], box.replace("{}", "<article>{}</article>")) + page(paragraphs(1)))
    assert lines == paragraphs(1)


def test_copies_are_not_compared(spark):
    menu = ["Home", "About us", "Contact"]
    body = [*menu, *paragraphs(0, 5)]
    rows = [(k, f"http://a.example.com/n/5?page={k}", page(body, "<div>{}</div>")) for k in range(3)]  # same path
    rows += [(3, "http://a.example.com/n/6", page(body, "<div>{}</div>")), (4, "http://a.example.com/n/7", page([*body[:-1], "Changed"], "<div>{}</div>"))]
    rows += [(5, "http://a.example.com/x", page([*menu, *paragraphs(5)], "<div>{}</div>"))]
    got = extracted(spark, rows)
    assert [got[k] for k in range(4)] == [paragraphs(0, 5)] * 4
    assert got[4] == [*paragraphs(0, 5)[:-1], "Changed"]
    assert got[5] == paragraphs(5)


@pytest.mark.parametrize("n", [1, 5, 23])
def test_neighbours_by_brute_force(spark, n):
    rng = random.Random(3)
    rows = []
    for k in range(160):
        story = rng.choice([k, k, 1000, 1001])  # two groups of copies
        host, path = rng.choice(["a", "b", "b", "b", "c"]), rng.choice([f"/{rng.choice('xyz')}/{k}", "/same"])
        lines = [f"Menu of {host}", *paragraphs(story), *(["Only here"] if k % 3 else [])]
        rows.append((k, f"http://{host}.example.com{path}?{k}", page(lines, "<article>{}</article>" if k % 2 else "<div>{}</div>")) if k % 20 else (k, f"http://{host}.example.com{path}?{k}", None))
    at = {k: (*page_text._where(u), *page_text.content(h or "")) for k, u, h in rows}

    def nearest(k, others):
        return next((at[j] for j in others if at[j][0] == at[k][0] and at[j][1] != at[k][1] and at[j][2] and not page_text.near_copies(tuple(map(page_text._line_key, at[k][2])), tuple(map(page_text._line_key, at[j][2])))), None)

    got = {}
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        got = extracted(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(at, key=lambda k: at[k][:2])  # the order within a path doesn't matter
    for i, k in enumerate(order):
        _, path, lines, marks = at[k]
        sides = [x for x in (nearest(k, order[:i][::-1]), nearest(k, order[i + 1 :])) if x]
        sides.sort(key=lambda x: -page_text._common(path, x[1]))
        gone = page_text.template_lines(lines, marks, *[x[2] for x in sides], *[None] * (2 - len(sides)))
        left = [j for j in range(len(lines)) if j not in gone]
        assert got[k] == (page_text.chosen([lines[j] for j in left], "".join(marks[j] for j in left)) or [""])


def test_rules_of_many_languages_and_control_bytes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{lang}{rng.randrange(30)}" for _ in range(90)) + " \x005 \x00abc \x01x", lang, "s", 0, "x", None) for i in range(40) for lang in [f"l{i % 8}"]]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(divergence_rules.judge(docs, divergence_rules.references(docs)).collect())
    refs = divergence_rules.references(docs)[0]
    for lang in {r[2] for r in rows}:
        text = [r[1] for r in rows if r[2] == lang]
        assert refs["=" + lang][0].tolist() == sum(divergence_rules.CLASSES[c] for t in text for c in t.encode()).tolist()
        assert refs["=" + lang][2].sum() == sum(len(t.split(" ")) for t in text) and b"\x01x" in refs["=" + lang][1] and b"\x00abc" in refs["=" + lang][1]
    monkeypatch.setattr(divergence_rules, "MAX_LANGS", 3)
    assert sorted(divergence_rules.judge(docs, divergence_rules.references(docs)).collect()) == want


def top_by_force(rows, every, k=5):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in good]
    out = []
    for own in sorted({i for i, _ in good if i % every == 0}):
        q = [math.floor(Fraction(x) * 256) for x in min(v for i, v in good if i == own)]
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in whole if i != own)[:k]
        out += [(own, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("block_rows, group_rows", [(16384, 64), (40, 3), (7, 1)])
def test_top_rows_by_brute_force(spark, block_rows, group_rows):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(6)]) for i in range(200)]
    rows += [(i, rows[i % 7][1]) for i in range(200, 240)]  # ties
    rows += [(5, rows[9][1]), (10, rows[3][1]), (None, [1.0] * 6), (300, None), (301, [None] * 6), (302, [float("nan")] * 6), (310, [float("inf")] * 6), (320, [1.0, 2.0]), (330, [])]
    rows += [(400, [1e15, 1.0, 0.0, 0.0, 0.0, 0.0]), (401, [-1e300] * 6), (410, [1e300, -1e300, 1.0, 0.0, 3.5, 0.0]), (411, [1e15 + 1] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, block string")
    got = sorted(map(tuple, bitsliced_topk.top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows, group_rows).collect()))
    assert got == top_by_force(rows, 10)


def test_top_rows_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert not bitsliced_topk.top_k(empty, F.col("vec_id") % 50 == 0).collect()
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert not bitsliced_topk.top_k(one, F.col("vec_id") % 50 == 0).collect()


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a">"' * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<span><p></p>" * 50_000, "<script>" + "</script" * 100_000, "<p>x" + "<" * 1_000_000, '<a title="' + "b" * 1_000_000], ids=range(7))
def test_a_page_takes_linear_time(page):
    begin = time.process_time()
    page_text.blocks(page)
    assert time.process_time() - begin < 5


@pytest.mark.parametrize("page, text", [("<p>a < b</p><p>c", ["a < b", "c"]), ('<p title="x > y">a</p>', ["a"]), ("<p title='x>a</p><p>b</p>", ["a", "b"]), ("<p>a<!-- <p>b</p>", ["a"]), ("<p>a</p><div", ["a", "<div"]), ("<!doctype html><p>a<script>if (x < 1) '<p>';</script>b", ["ab"])])
def test_tags_and_text(page, text):
    assert [t for t, _ in page_text.blocks(page)] == text


def warc_bytes(kind, body, length=None, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a.example.com/", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)) if length is None else length, **fields}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\nX-Odd\r\n\r\n<p>\xff\x00\r\n\r\n WARC/1.0 </p>"
    info = warc_bytes("warcinfo", b"software: x", **{"Content-Type": "application/warc-fields"})
    revisit = warc_bytes("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n")
    big = warc_bytes("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"a\r\n\r\nW" * 300_000)
    records = [info, warc_bytes("response", page), revisit, warc_bytes("response", page, "many"), warc_bytes("response", b"HTTP/1.1 abc\r\n\r\n"), big, warc_bytes("response", page, "5000")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "packed" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "broken" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, [*records[:5], bytes(random.Random(1).randbytes(300_000))]))[:-2000])
    want = [("warcinfo", None, b"software: x", {}, True), ("response", 200, page.partition(b"\r\n\r\n")[2], {"etag": '"x"'}, True), ("revisit", 304, b"", {}, True), ("response", 200, page.partition(b"\r\n\r\n")[2], {"etag": '"x"'}, True), ("response", None, b"", {}, True), ("response", 200, b"a\r\n\r\nW" * 300_000, {}, True)]
    for folder in ("plain", "packed"):
        got = [(r.kind, r.status, bytes(r.payload), r.headers, r.whole) for r in warc.read_warc(spark, f"file://{tmp_path}/{folder}").collect()]
        assert got[:3] == want[:3] and got[4:6] == want[4:6]
        assert got[3][2].startswith(want[3][2]) and got[3][4]  # no length: the body as it is
        assert not got[6][4] and got[6][2].startswith(want[1][2])
    assert warc.read_warc(spark, f"file://{tmp_path}/broken").count() >= 4


def test_revisits_by_hand(spark):
    rows = [
        (1, "http://a.example.com/x", 10, "response", 200, {"ETag": '"1"', "Cache-Control": "a", "X": "old"}, "d1"),
        (2, "http://a.example.com/x", 10, "revisit", 304, {"etag": 'W/"1"', "Connection": "X", "X": "new", "Age": "5"}, None),
        (3, "HTTP://www.A.example.com:80/x/?utm_source=q#f", 11, "revisit", 304, {"Cache-Control": "b"}, None),
        (4, "http://a.example.com/x", 12, "response", 404, {"ETag": '"2"'}, "d4"),
        (5, "http://a.example.com/x", 13, "revisit", 304, {"ETag": '"2"'}, None),
        (6, None, 13, "revisit", 304, None, None), (7, "", 13, "revisit", 304, None, None), (8, "http://b.example.com/", 1, "revisit", 304, {}, None),
        (9, "http://a.example.com/x", None, "revisit", 304, {}, None), (2, "http://a.example.com/x", 10, "revisit", 304, {"etag": 'W/"1"', "Connection": "X", "X": "new", "Age": "5"}, None),
    ]
    schema = "record_id long, url string, captured long, kind string, status int, headers map<string,string>, digest string"
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema)).withColumn("headers", warc.header_lines(F.col("headers"))).select("record_id", "source_id", "outcome", "headers", "digest").collect()
    same = (2, 1, "resolved", 'age: 5\ncache-control: a\netag: W/"1"\nx: old', "d1")
    want = [same, same, (3, 1, "unverified", 'cache-control: b\netag: "1"\nx: old', "d1"), (5, None, "mismatch", None, None)] + [(k, None, "missing", None, None) for k in (6, 7, 8, 9)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert not warc.resolve_revisits(spark.createDataFrame([], schema)).collect()


def test_normalisation_as_the_library():
    import sentencepiece

    rng = random.Random(6)
    letters = ["a", "B", " ", "  ", "\t", "①", "ＡＢ", "　", "ｶﾞ", "é", "e\u0301", "ﬁ", "½", "한", "\u200b", "\x01", "😀", "İ", "ß", "Ⅷ"]
    texts = ["", " ", "  a  "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.NormalizerSpec()
        spec.ParseFromString(lib.serialized_normalizer_spec())
        chars = piece_codec.CharMap(spec.precompiled_charsmap)
        assert bool(chars.units) == (rule != "identity")
        for t in texts:
            want, places = lib.normalize(t, with_offsets=True)
            norm, align = piece_codec.normalize(t.encode(), chars, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
            assert norm.decode() == want
            at = [len(t[:k].encode()) for k in range(len(t) + 1)]  # the library counts characters here
            starts = [k for k in range(len(norm)) if norm[k] & 0xC0 != 0x80]
            assert [int(align[k]) for k in starts] == [at[p] for p in places[: len(starts)]]


def test_spans_as_the_library(spark, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.codec(path)
    for r in piece_codec.encode_documents(table(spark, texts), path).collect():
        text = dict(texts)[r.doc_id] or ""
        pieces = sp.encode(text, out_type="proto").pieces
        assert (r.begins, r.ends) == ([p.begin for p in pieces], [p.end for p in pieces])
        for mark in (True, False):
            assert piece_codec.normalize(text.encode(), codec.chars, mark, False)[1].tolist() == piece_codec.identity_alignment(text.encode(), mark and bool(text)).tolist()


def test_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    rows = [(rng.integers(0, 50, n), rng.normal(size=n)) for n in (1, 2, 9)]
    starts = np.cumsum([0, 1, 2])
    got = quality_fm.margin(model, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
    for z, (i, x) in zip(got, rows, strict=True):
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(z - (0.3 + model["w"][i] @ x + pairs)) < 1e-9


def test_features_of_a_text():
    idx, val = quality_fm.features(b"A b  a\nc", 8)
    words = {zlib.crc32(w) % quality_fm.DIM: n for w, n in ((b"a", 2), (b"b", 1), (b"c", 1))}
    size = math.sqrt(sum((1 + math.log(n)) ** 2 for n in words.values()))
    assert {int(i): round(float(x), 9) for i, x in zip(idx, val, strict=True) if i < quality_fm.DIM} == {i: round((1 + math.log(n)) / size, 9) for i, n in words.items()}
    assert len(idx) == 3 + quality_fm.STATS + 1  # a bin of each statistic, and of n_chars
    assert set(val[3:]) == {0.5}
    assert [len(quality_fm.features(b"", n)[0]) for n in (None, 0)] == [quality_fm.STATS + 1] * 2


def test_quality_of_odd_rows(spark, texts):
    good, bad = "calm clear words of a good story told well " * 6, "buy now $$$ ### click " * 12
    docs = table(spark, [*((i, (good if i % 2 else bad) + str(i)) for i in range(400)), *((0, bad + "0") for _ in range(50)), *((1000 + i, t) for i, t in texts), (None, good)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_fm.score(docs, quality_fm.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all((r.score > 0.7) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 400)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    kept = quality_fm.keep_good(docs, quality_fm.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    alone = quality_fm.score(docs, quality_fm.train(docs, labels.where("quality = 1"))).collect()
    assert {round(r.score, 3) for r in alone} == {1.0}


def jsd(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    h = lambda a: -sum(x * math.log2(x) for x in a if x)
    return math.sqrt(max(0, h([(x + y) / 2 for x, y in zip(p, q, strict=True)]) - (h(p) + h(q)) / 2))


def test_rules_by_brute_force(spark, texts):
    rows = [(i, t, lang) for lang in ("en", "*", "", None) for i, t in texts if (i + len(lang or "x")) % 3] + [(7, "x " * 30000 + "end", "en"), (7, "x " * 30000 + "end", "en")]
    docs = spark.createDataFrame([(i, t, g, "s", 0, "x", None) for i, t, g in rows], SCHEMA)
    edge = ".,;:!?'\"()-"

    def words(t):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return [w for w in (x.strip(edge) for x in WORD.findall(lower)) if w]

    def classes(t):
        out = [0] * 8
        for c in t or "":
            groups = ["a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9", c in "\t\n\x0b\x0c\r ", c in edge, c in "#*$%&|<>", ord(c) < 128, True]
            out[groups.index(True)] += 1
        return out

    want = []
    for lang in ("en", "*", "", None):
        own = [t for _, t, g in rows if g == lang]
        count = Counter(w for t in own for w in words(t))
        top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:64]]
        ref_words = [count[w] for w in top] + [sum(count.values()) - sum(count[w] for w in top)]
        ref_chars = [sum(x) for x in zip(*map(classes, own), strict=True)]
        for i, t, g in rows:
            if g == lang:
                n, text = len(WORD.findall(t or "")), t or ""
                c = Counter(words(text))
                mine = [c[w] for w in top] + [sum(c.values()) - sum(c[w] for w in top)]
                far = len(text) >= 100 and jsd(classes(text), ref_chars) > 0.30 or n >= 50 and sum(mine) and jsd(mine, ref_words) > 0.44
                want.append((i, n, far))
    got = divergence_rules.judge(docs, divergence_rules.references(docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in got if not r.base_failed) == sorted((i, n, not far) for i, n, far in want if (i, n) in {(r.doc_id, r.n_words) for r in got if not r.base_failed})
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue pink black white brown grey")
    docs = table(spark, [(5, a), (5, b), (2, a), (5, b), (9, b + " nine"), (7, c), (None, c), (None, None), (8, ""), (3, c.upper())])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2, 80).collect()), key=str)
    assert got == sorted([(5, 2, False)] * 3 + [(2, 2, True), (9, 2, False), (7, 3, False), (3, 3, True), (8, 8, True), (None, None, True), (None, None, True)], key=str)


CLASHING = "id digest hit starts lines left rest gone chunk own kept shard level node band __id __digest __starts __own __lines __kept __gone __chunk __had_word had_word n_lines n_removed held_out a.b".split()


def clashing(spark, texts):
    """Documents with columns that operators use inside."""
    names = [*SCHEMA.replace("node string, band string", "").split()[:-1:2], *CLASHING]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c} of {i}" for c in CLASHING)) for i, t in texts]
    kinds = ["long", "string", "string", "string", "long", *["string"] * len(CLASHING)]
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True)))


def unchanged(frame):
    rows = frame.collect()
    assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING if c in frame.columns)
    return {r["doc_id"]: r["text"] for r in rows}


def test_clashing_names_come_back_unchanged(spark, texts):
    docs = clashing(spark, texts)
    plain = docs.select("doc_id", "text", "n_chars")
    for remove in (lambda d: line_windows.remove_repeats(d, counts=False), minhash.keep_first, repeat_windows.remove_repeats):
        got = remove(docs)
        assert got.columns == docs.columns
        assert unchanged(got) == {r.doc_id: r.text for r in remove(plain).collect()}
    counted = line_windows.remove_repeats(docs)
    assert counted.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    assert unchanged(counted.drop("n_lines", "n_removed"))
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in counted.collect()} == {r.doc_id: (r.n_lines, r.n_removed) for r in line_windows.remove_repeats(plain).collect()}
    model = quality_fm.train(plain, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int"))
    good = quality_fm.keep_good(docs, model, 0.3)
    assert unchanged(good) == {r.doc_id: dict(texts)[r.doc_id] for r in quality_fm.score(plain, model, 0.3).where("predicted = 1").collect()}


def test_operators_read_past_clashing_names(spark, texts):
    docs, plain = clashing(spark, texts), table(spark, texts)
    path = queries.tokenizer_path("word_bpe_49k.json")
    for make in (lambda d: minhash.near_duplicates(d, 2), repeat_windows.measure, lambda d: packing.pieces(d, path), lambda d: piece_codec.round_trip(d, queries.tokenizer_path("piece_bpe_32k.model")), lambda d: divergence_rules.judge(d, divergence_rules.references(d))):
        assert sorted(make(docs).collect(), key=str) == sorted(make(plain).collect(), key=str)


def test_lines_of_odd_rows(spark):
    x = "a one\nb two\nc three"
    docs = table(spark, [(1, x), (1, x), (2, f"{x}\nd\nb two\nc three\nd"), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n"), (None, f"p\n{x}\nq"), (7, "z\n" * 5000)])
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_windows.remove_repeats(docs).collect()}
    # of 5000 lines "z" the windows from the second on repeat the first; the last window holds the empty end
    assert got == {(None, 5, 0, f"p\n{x}\nq"), (1, 3, 3, ""), (2, 7, 6, "d"), (3, 0, 0, None), (4, 1, 0, ""), (5, 5, 0, "\n\n\n\n"), (6, 4, 0, "\n\n\n"), (7, 5001, 4999, "z\n")}


def test_packing_of_repeated_and_long_rows(spark, texts):
    rows = [(1, "word")] * 300 + [(2, "long text " * 9000), (None, "x"), (3, None)]
    path = queries.tokenizer_path("word_bpe_49k.json")
    cut = packing.pieces(table(spark, rows), path)
    for shard in (8192, 20):
        got = packing.pack(packing.materialize(cut), 310, shard_pieces=shard).collect()
        assert len(got) == 300 + 2 + len([r for r in got if r.doc_id == 2])
        assert sum(r.length for r in got if r.doc_id == 2) == 18001
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([n for _, n in sorted(parts)], initial=0))[:-1]
            assert sum(n for _, n in parts) <= 4096
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 100  # equal rows spread over the shards


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_by_brute_force(seed):
    rng, capacity = random.Random(seed), 50
    sizes = [rng.randrange(1, capacity + 1) for _ in range(300)]
    gaps, place = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        best = None
        for gap in sorted({g for g in gaps if g >= s}) + [capacity]:
            after = Counter(gaps)
            if gap < capacity:
                after[gap] -= 1
            after[gap - s] += 1
            key = sum(n * n for g, n in after.items() if 0 < g < capacity)
            if best is None or key < best[0]:
                best = key, gap
        if best[1] < capacity:
            gaps.remove(best[1])
        gaps.append(best[1] - s)
        place[i] = capacity - best[1]
    bins, offsets = packing.pack_lengths(np.array(sizes), capacity)
    assert offsets.tolist() == [place[i] for i in range(len(sizes))]
    assert len(set(bins.tolist())) == len(gaps)


@pytest.mark.parametrize("segment", [repeat_windows.SEGMENT, 700, 128])
def test_windows_of_texts_above_a_segment_are_covered_once(segment, monkeypatch):
    monkeypatch.setattr(repeat_windows, "SEGMENT", segment)
    rng = random.Random(segment)
    length = 2 * segment + 1234
    texts = [bytes(rng.choice(b"abc \n") for _ in range(length)), b"", b"x" * 49, b"y" * 50, bytes(rng.randrange(256) for _ in range(segment + 3)), b"z" * (segment + 100)]
    r = repeat_windows.runs(texts)
    for t, text in enumerate(texts):
        own = np.flatnonzero(r["text"] == t)
        spans = sorted(zip(r["first"][own].tolist(), r["count"][own].tolist(), strict=True))
        at = 0
        for first, count in spans:
            assert first == at and count > 0
            at += count
        assert at == max(0, len(text) - 49)


@pytest.mark.parametrize("row_runs", [repeat_windows.ROW_RUNS, 7])
def test_rows_of_packed_runs_do_not_grow_with_chunks(row_runs, monkeypatch):
    monkeypatch.setattr(repeat_windows, "ROW_RUNS", row_runs)
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts[20] = texts[10] + texts[11]
    docs, chunks, buckets = [-(2**63), *rng.sample(range(-5000, 2**62), 298), 2**63 - 1], [k * 7919 % 10**9 for k in range(300)], 50
    docs[20], chunks[20] = docs[10] - 1, chunks[10]
    r = repeat_windows.runs(texts)
    batch = pa.table({"chunk": pa.array(chunks, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "text": pa.array(texts, pa.binary())}).to_batches()
    packed = pa.Table.from_batches(list(repeat_windows._send_runs(buckets)(iter(batch))))
    least = {}
    for t, anchor, key in zip(r["text"].tolist(), r["anchor"].tolist(), r["key"].tolist(), strict=True):
        run = ((anchor >> 32) % buckets, chunks[t], anchor % 2**40, key % 2**56)
        least[run] = min(docs[t], least.get(run, docs[t]))
    got = {}
    for i in range(packed.num_rows):
        for doc, key, anchor, chunk in zip(*(x.tolist() for x in repeat_windows._unpack(packed.slice(i, 1))), strict=True):
            got[packed.column("bucket")[i].as_py(), chunk, anchor, key] = doc
    assert got == least
    assert packed.num_rows <= buckets + len(got) // row_runs


def test_masks_of_a_task_are_a_row_for_each_chunk():
    one = lambda chunk, look: repeat_windows._answer_table([(chunk, np.array([look], "<u8").tobytes(), b"", b"", np.array([look + 1], "<u8").tobytes(), 0)])
    (out,) = repeat_windows._by_chunk(iter([one(1, 5), one(2, 6), one(1, 7)]))
    assert [(r["chunk"], np.frombuffer(r["look"], "<u8").tolist(), np.frombuffer(r["mask"], "<u8").tolist()) for r in out.to_pylist()] == [(1, [5, 7], [6, 8]), (2, [6], [7])]


def test_codec_of_an_empty_table_and_a_long_text(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert piece_codec.round_trip(table(spark, []), path).collect() == []
    import sentencepiece

    text = "Wave  and stone, Örtchen 12 " * 40_000
    got = piece_codec.round_trip(table(spark, [(1, text), (2, None)]), path).collect()
    ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(text, num_threads=1)
    assert [r.n_tokens for r in sorted(got)] == [len(ids), 0]
    assert sorted(got)[0].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_copies_are_removed_whole(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(180_000))
    assert len(long) > repeat_windows.SEGMENT
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeat_windows.measure(table(spark, [(1, long), (2, "a head " + long + " a tail")])).collect()}
    assert got[1] == (len(long), 0, 0) and got[2] == (len(long) + 14, len(long), 1)
