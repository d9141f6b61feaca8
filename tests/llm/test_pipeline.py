"""The pipeline against brute force, stage after stage."""

import random
import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyworks.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_lines(docs):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            window = "\n".join(lines[k : k + 3])
            if WORD.search(window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
    return out


def first_of_copies(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs.items() if (w := WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))}
    root = {i: i for i in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def without_passages(docs):
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in sorted(docs.items())}
    for i, b in data.items():
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in data.items():
        gone = set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        out[i] = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore") if docs[i] is not None else None
    return out


def worded(before, after):
    return {i: t for i, t in after.items() if WORD.search(t or "") or not WORD.search(before[i] or "")}


def test_run_by_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = ["the", "and", "wave", "Stone", "river", "it's", "blue", "Örtchen", "seven", "cloud"]

    def line(n=14):
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    base = ["\n".join(line() for _ in range(rng.randrange(1, 7))) for _ in range(30)]
    texts = [*base, *base[:12], *base[:3], base[3] + "\n\n\n\n", None, "", " \n\n\n ", base[20].split("\n")[0][:70], "new words, then " + base[21].split("\n")[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.concat(F.lit(f"{c} of "), "doc_id") for c in ("__had_word", "had_word", "__id", "starts", "rest", "gone", "chunk", "n_lines", "n_removed", "shard")}
    docs = docs.withColumns(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # the classifier has tests of its own; here all documents pass it
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality classifier", lambda spark, docs, sf_dir: docs), *corpus_pipeline.STAGES[1:]])
    want = dict(enumerate(texts))
    steps = []
    for step in (without_lines, first_of_copies, without_passages):
        want = worded(want, step(want))
        steps.append(want)
    for (_, stage), expected in zip(corpus_pipeline.STAGES[1:4], steps, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert all(r[c] == f"{c} of {r.doc_id}" for r in docs.collect() for c in extra)
        assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t or "")) for i, t in expected.items()}
    tok = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
    copies = [i for i in range(30, 45) if texts[i].count("\n") >= 2]
    assert copies and not set(copies) & set(got)
    assert {46, 47, 48} <= set(got)  # without words on input
