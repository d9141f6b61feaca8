"""Quality rules: distribution divergence from a language's own histograms.

Base measures first (words, symbols, repeated lines, repeated 8-word windows).
Then two histograms of the text, of character classes and of the language's
commonest words, are held against references summed over *all* documents of the
same ``lang`` by the Jensen-Shannon distance (base 2, square root of the
divergence). A text goes when a distance exceeds its limit; a histogram is only
tested on texts of a minimum length, as short texts scatter.

Defined results: a null text has no words and fails the base rule, as an empty one
does; a null ``lang`` is a language of its own; the references of the ``MAX_LANGS``
largest languages (by characters) go to every task, those of all others meet their texts by a
join; a language that the references lack has no distances; repeated rows count as
often as they occur; ties among common words go to the smaller word; empty table,
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_rows, materialize, utf8

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
COMMON, MAX_LANGS = 64, 1000
CHAR_LIMIT, CHAR_MIN = 0.30, 100  # the tails of good and poor labelled texts part here at sf0.1
WORD_LIMIT, WORD_MIN = 0.44, 50
#: Character classes by byte: a-z, A-Z, 0-9, white space, punctuation, the contract's symbols, other ASCII, first bytes of non-ASCII characters. Continuation bytes have no class.
CLASSES = np.zeros((256, 8), np.int64)
CLASSES[:128, 6] = 1
for _k, _cs in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:!?'\"()-", b"#*$%&|<>")):
    CLASSES[list(_cs)] = 0
    CLASSES[list(_cs), _k] = 1
CLASSES[0xC0:, 7] = 1
_EDGE = b".,;:!?'\"()-"


def repeated_words(texts: list[list[bytes]]) -> list[int]:
    """For each word list, the words inside windows of 8 that occur at least twice in it. Exact: window ids come from ranking pairs, not from hashes."""
    lens = np.array([len(t) for t in texts])
    if not lens.sum():
        return [0] * len(texts)
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    code = np.fromiter((ids[w] for t in texts for w in t), np.int64, int(lens.sum()))
    owner = np.repeat(np.arange(len(texts)), lens)
    width = 1
    while width < WINDOW:
        n = len(code) - width
        if n <= 0:
            return [0] * len(texts)
        code = np.unique(code[:n] * (int(code.max()) + 1) + code[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    n = len(code)
    inside = owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n]
    pair = code * len(texts) + owner[:n]
    at = np.flatnonzero(inside)
    _, inv, count = np.unique(pair[at], return_inverse=True, return_counts=True)
    hits = at[count[inv] > 1]
    delta = np.zeros(len(owner) + 1, np.int64)
    np.add.at(delta, hits, 1)
    np.add.at(delta, hits + WINDOW, -1)
    return np.bincount(owner, np.cumsum(delta)[:-1] > 0, len(texts)).astype(int).tolist()


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance in base 2, 0 to 1, of two histograms of counts."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def _lang() -> Column:
    """Key of a text's language: null is one of its own, unlike any string."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def _common_form(word: bytes) -> bytes:
    return word.strip(_EDGE)


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def _reference(chars: list, words: list, whole: int) -> Reference:
    """From rows (class, n) and (rank, word, n), and the count of all words."""
    c = np.zeros(8, np.int64)
    for k, n in chars:
        c[k] = n
    ws = sorted(words)
    n = [x[2] for x in ws]
    return c, {bytes(x[1]): k for k, x in enumerate(ws)}, np.array([*n, whole - sum(n)], np.int64)


def references(docs: DataFrame) -> tuple[dict[str, Reference], DataFrame | None]:
    """Per language: character-class counts, common words with their places, their counts with the rest last. A table has the languages beyond MAX_LANGS.

    Counts cover every word of every document; each task sums what it reads, Spark the rest. What reaches the driver
    is at most MAX_LANGS x (COMMON + 9) rows.
    """
    spark = docs.sparkSession
    schema = "lang string, class int, word binary, n long"  # class is null in rows of words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(8, np.int64))

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(lang, None, w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, k, b"", int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
            words.clear()
            chars.clear()
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], names=["lang", "class", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = words[lang]
                c.update(map(_common_form, text.lower().split()))
                chars[lang] += np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES
            if sum(map(len, words.values())) > 150_000:
                yield from flush()
        yield from flush()

    src = docs.select(_lang().alias("lang"), utf8().alias("text"))
    counted = materialize(map_batches(src, count, schema).groupBy("lang", "class", "word").agg(F.sum("n").alias("n")))
    is_char = F.col("class").isNotNull()
    is_word = ~is_char & (F.length("word") > 0)
    langs = counted.where(is_char).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS + 1)
    kept = [r.lang for r in langs.collect()]
    more, kept = len(kept) > MAX_LANGS, kept[:MAX_LANGS]
    few = F.broadcast(spark.createDataFrame([(x,) for x in kept], "lang string"))  # at most MAX_LANGS names

    def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        top = rows.where(is_word).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON)
        return rows.where(is_char).select("lang", "class", "n"), top.select("lang", "rank", "word", "n"), rows.where(is_word).groupBy("lang").agg(F.sum("n").alias("whole"))

    chars: dict = {x: [] for x in kept}
    words: dict = defaultdict(list)
    own, top, sums = parts(counted.join(few, "lang", "left_semi"))
    for r in own.collect():
        chars[r.lang].append((r["class"], r.n))
    for r in top.collect():
        words[r.lang].append((r.rank, r.word, r.n))
    whole = {r.lang: r.whole for r in sums.collect()}
    out = {x: _reference(chars[x], words[x], whole.get(x, 0)) for x in kept}
    if not more:
        return out, None
    own, top, sums = parts(counted.join(few, "lang", "left_anti"))
    rest = own.groupBy("lang").agg(F.collect_list(F.struct("class", "n")).alias("chars"))
    rest = rest.join(top.groupBy("lang").agg(F.collect_list(F.struct("rank", "word", "n")).alias("words")), "lang", "left").join(sums, "lang", "left")
    return out, materialize(rest)


def judge(docs: DataFrame, refs: tuple[dict[str, Reference], DataFrame | None]) -> DataFrame:
    """Base measures, base_failed and kept of every row."""
    largest, rest = refs
    shared = docs.sparkSession.sparkContext.broadcast(largest)  # bounded: see references()

    def run(b: dict) -> dict:
        refs = shared.value
        words = [t.split() for t in b["text"]]
        out: dict = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "char_jsd", "word_jsd", "base_failed", "kept")}
        repeats = repeated_words(words)
        if "chars" in b:
            refs = {lang: _reference([tuple(x.values()) for x in c], [tuple(x.values()) for x in w or ()], n or 0) for lang, c, w, n in zip(b["lang"], b["chars"], b["words"], b["whole"], strict=True) if c}
        for lang, text, ws, rep in zip(b["lang"], b["text"], words, repeats, strict=True):
            byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            hist = byte @ CLASSES
            lines = [x for x in text.split(b"\n") if x.strip()]
            n, white = len(ws), int(hist[3])
            failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT * n
            own_refs = refs.get(lang)
            points = int(byte.sum() - byte[0x80:0xC0].sum())
            cj = wj = None
            if own_refs and points >= CHAR_MIN:
                cj = jensen_shannon(hist, own_refs[0])
            if own_refs and n >= WORD_MIN:
                _, place, common = own_refs
                own = np.zeros(len(common))
                for w, k in Counter(map(_common_form, text.lower().split())).items():
                    if w:
                        own[place.get(w, -1)] += k
                wj = jensen_shannon(own, common)
            for k, v in (("n_words", n), ("word_chars", points - white), ("n_symbols", int(hist[5])), ("n_dup_lines", len(lines) - len(set(lines))), ("char_jsd", cj), ("word_jsd", wj), ("base_failed", failed), ("kept", not failed and (cj is None or cj <= CHAR_LIMIT) and (wj is None or wj <= WORD_LIMIT))):
                out[k].append(v)
        return {"doc_id": b["doc_id"], "n_repeat_words": repeats, **out}

    src = docs.select("doc_id", _lang().alias("lang"), utf8().alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_jsd double, word_jsd double"
    if rest is None:
        return map_rows(src, run, schema)
    few = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in largest], "lang string"))
    return map_rows(src.join(few, "lang", "left_semi").select(src.columns), run, schema).unionByName(map_rows(src.join(few, "lang", "left_anti").join(rest, "lang", "left"), run, schema))
