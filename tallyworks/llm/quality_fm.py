"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
the pairwise term by the sum-of-squares identity, so a text costs time linear in
its distinct features. Features come from the text and ``n_chars`` alone.

Fitting takes at most ``sample_rows`` labelled rows (those whose label is not
held out, smallest xxhash64(doc_id) first; of rows that share a doc_id the one of the
smallest text); every text is scored.

Defined results: a null or empty text has only its structure features and gets a
score like any other; a null ``n_chars`` is a feature of its own; rows repeated or
with equal texts get equal scores; an empty table gives an empty table; without
usable labels of both classes the score is the share of label 1 (0.5 without
any). Columns besides doc_id, text and n_chars are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_batches, map_rows, packed, unpacked, utf8

DIM, FACTORS, SAMPLE_ROWS = 1 << 15, 8, 6000
STATS = 12
BINS = 16
META0 = DIM + STATS * BINS
SIZE = META0 + 2 * BINS
_BYTES = np.zeros((256, 6))
_BYTES[ord("A") : ord("Z") + 1, 0] = 1
_BYTES[ord("0") : ord("9") + 1, 1] = 1
_BYTES[[ord(c) for c in "#*$%&|<>"], 2] = 1
_BYTES[[ord(c) for c in ".,;:!?'\"()-"], 3] = 1
_BYTES[[9, 10, 11, 12, 13, 32], 4] = 1
_BYTES[0xC0:, 5] = 1


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words scaled to length one, one bin of each statistic."""
    words = text.lower().split()
    n = len(words)
    counts: Counter = Counter()
    for w, c in Counter(words).items():
        counts[zlib.crc32(w) % DIM] += c
    idx = np.fromiter(counts.keys(), np.int64, len(counts))
    val = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if n:
        val /= np.sqrt((val * val).sum())
    size = max(1, len(text))
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTES
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, n)
    stats = [
        np.log2(1 + n), size / m, 15 * len(counts) / m, 15 * (len(lines) - len(set(lines))) / max(1, len(lines)), np.log2(1 + n / max(1, len(lines))) * 1.5,
        *(np.sqrt(share / size) * 15), np.log2(1 + max(Counter(words).values(), default=0) * 1000 / m),
    ]
    extra = [DIM + k * BINS + min(BINS - 1, int(x)) for k, x in enumerate(stats)]
    extra.append(META0 + (BINS if n_chars is None or n_chars < 0 else min(BINS - 1, int(np.log2(1 + n_chars)))))
    return np.concatenate([idx, np.array(extra, np.int64)]), np.concatenate([val, np.full(len(extra), 0.5)])


def margin(model: dict, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Margins of rows laid end to end; every row has features, so no segment is empty."""
    vx = model["v"][idx] * val[:, None]
    s = np.add.reduceat(vx, starts)
    q = np.add.reduceat((vx * vx).sum(1), starts)
    return model["w0"] + np.add.reduceat(model["w"][idx] * val, starts) + 0.5 * ((s * s).sum(1) - q)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, seed: int = 7) -> dict:
    """AdaGrad on the logistic loss, in small batches of a fixed order."""
    rng = np.random.default_rng(seed)
    p = float(y.mean()) if len(y) else 0.5
    model = {"w0": 0.0, "w": np.zeros(SIZE), "v": rng.normal(0, 0.05, (SIZE, FACTORS))}
    if not 0 < p < 1:
        model["v"][:] = 0
        model["w0"] = float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
        return model
    model["w0"] = float(np.log(p / (1 - p)))
    gw, gv, g0, lr, l2 = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6, 0.1, 2e-5
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 32):
            part = order[k : k + 32]
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            lens = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            vx = model["v"][idx] * val[:, None]
            s = np.add.reduceat(vx, starts)
            z = model["w0"] + np.add.reduceat(model["w"][idx] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            gr = np.repeat(g, lens)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, gr * val, len(uniq)) + l2 * model["w"][uniq]
            dv_each = (gr * val)[:, None] * (np.repeat(s, lens, axis=0) - vx)
            dv = np.stack([np.bincount(inv, dv_each[:, f], len(uniq)) for f in range(FACTORS)], 1) + l2 * model["v"][uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            g0 += g.sum() ** 2
            model["w"][uniq] -= lr * dw / np.sqrt(gw[uniq])
            model["v"][uniq] -= 0.5 * lr * dv / np.sqrt(gv[uniq])
            model["w0"] -= float(lr * g.sum() / np.sqrt(g0))
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fits on at most ``sample_rows`` labelled rows that are not held out; their features, not their texts, reach the driver."""
    picked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .join(docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = picked.select("doc_id", "quality").collect()
    if not rows:
        return fit([], np.zeros(0))
    spark = docs.sparkSession
    ids = spark.createDataFrame([tuple(r) for r in rows], picked.schema)
    # bounded by sample_rows ids, so it may be sent to all executors; one row of each id, so no more come back
    sample = docs.select("doc_id", utf8().alias("text"), "n_chars").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")

    def featurize(b: dict) -> dict:
        fs = [features(t, n) for t, n in zip(b["text"], b["n_chars"], strict=True)]
        return {"doc_id": b["doc_id"], "quality": b["quality"], "idx": [f[0].astype("<i4").tobytes() for f in fs], "val": [f[1].astype("<f4").tobytes() for f in fs]}

    got = map_rows(sample, featurize, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, quality int, idx binary, val binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.idx, r.val))
    data = [(np.frombuffer(r.idx, "<i4").astype(np.int64), np.frombuffer(r.val, "<f4").astype(np.float64)) for r in got]
    return fit(data, np.array([r.quality for r in got], float))


def _scorer(spark: SparkSession, model: dict) -> Callable[[list[bytes], list[int | None]], np.ndarray]:
    """Scores of a batch. The model is SIZE x (FACTORS + 1) floats whatever the input, so it is broadcast."""
    shared = spark.sparkContext.broadcast({"w0": model["w0"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)})

    def scores(texts: list[bytes], n_chars: list[int | None]) -> np.ndarray:
        fs = [features(t, n) for t, n in zip(texts, n_chars, strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in fs])[:-1]]).astype(np.int64)
        z = margin(shared.value, np.concatenate([f[0] for f in fs]), np.concatenate([f[1] for f in fs]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(np.float64)))

    return scores


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scores = _scorer(docs.sparkSession, model)

    def run(b: dict) -> dict:
        s = scores(b["text"], b["n_chars"])
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

    src = docs.select("doc_id", held_out().alias("held_out"), utf8().alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return map_rows(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold."""
    scores = _scorer(docs.sparkSession, model)
    slim = packed(docs, "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = scores([(t or "").encode() for t in batch.column(0).to_pylist()], batch.column(1).to_pylist())
                yield batch.filter(pa.array(s >= threshold))

    left = map_batches(slim, run, slim.schema)
    return left.select(unpacked(left, docs.columns, "text", "n_chars"))
