"""Target-distribution importance resampling by external sort-count.

Words are maximal runs of ``0-9``, ``a-z`` (A-Z lower-cased) and bytes from 0x80 on; features are
runs of 1 to ``grams`` consecutive words, joined by one space; a feature's bucket is its crc32
modulo ``buckets``. Each text becomes a packed little-endian uint16 stream, and the streams are
written once to the shared folder. A batch of that table is one packed stream with the documents'
offsets beside it (Arrow's own layout of a binary column). Counts come from sorting a batch's
stream and run-length encoding it; a task adds up its runs and hands on one row a bucket, so at
most ``buckets`` rows a task are shuffled. Gains, one integer a bucket, are then gathered over the
same streams and summed between the offsets by ``np.add.reduceat``.

Drawing is Gumbel top-k: a score is the weight plus a noise that depends on the id alone, and the
highest scores are drawn. Places come from range partitions, sorted each by itself, plus the
partitions' sizes, so no task sees all rows.

Defined results: a null or empty text has no features and weight 0; documents of fewer than
``min_words`` words are never drawn; repeated rows count, score and are drawn as often as they
occur; of rows equal in score and doc_id the one of smaller weight, then fewer features comes
first; a null doc_id scores as an empty id and comes before others; an empty table of documents
gives an empty result, an empty target gives every unseen bucket the same gain. Other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import default_parallelism, map_batches, map_rows, materialize, utf8

BUCKETS, GRAMS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def stream_of(text: bytes, buckets: int = BUCKETS, grams: int = GRAMS) -> tuple[int, bytes]:
    """The number of words, and the buckets of all features as packed uint16."""
    words = _WORDS.findall(text.lower())
    runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, grams + 1))]
    crc = np.fromiter(map(zlib.crc32, itertools.chain(*runs)), np.uint32, sum(map(len, runs)))
    return len(words), (crc % np.uint32(buckets)).astype("<u2").tobytes()


def streams(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """key, n_words, stream of every row."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")

    def run(b: dict) -> dict:
        n, packed = zip(*(stream_of(t, buckets, grams) for t in b["text"]), strict=True)
        return {key: b[key], "n_words": n, "stream": packed}

    return map_rows(docs.select(key, utf8().alias("text")), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, stream binary")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch's stream and the offsets of its documents, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 2
    whole = np.frombuffer(data, "<u2", count=int(at[-1])) if data is not None and len(at) else np.zeros(0, "<u2")
    return whole[at[0] :], at - at[0]


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a stream and how often each occurs, by sorting."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                values, lengths = run_lengths(_packed(batch.column(0))[0])
                total[values] += lengths
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(packed.select("stream"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of add-one shares), a bucket each."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = [float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(packed: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight; ``gain`` (at most 65536 numbers) goes out with the code."""
    kind = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream, at = _packed(batch.column(2))
            n = np.diff(at).astype(np.int64)
            weight = np.zeros(len(n), np.int64)
            if len(stream):  # between equal offsets reduceat gives an element, not 0, so documents without features stay out
                weight[n > 0] = np.add.reduceat(gain[stream], at[:-1][n > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=[key, "n_words", "n_features", "weight"])

    return map_batches(packed.select(key, "n_words", "stream"), run, f"{key} {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel number) from the first 32 bits of sha256("seed:key")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_places(rows: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """``rows`` with ``place``, 1 for the first in ``order``: range partitions, then the sizes of those before."""
    cut = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    low = (1 << 33) - 1  # a row's number in its partition is in the low 33 bits
    cut = materialize(cut.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("nth")))
    sizes = {r.part: r["count"] for r in cut.groupBy("part").count().collect()}  # one row a partition
    before = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    base = rows.sparkSession.createDataFrame([(p, before[p]) for p in sizes], "part int, before long")
    return cut.join(F.broadcast(base), "part").withColumn("place", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every row of ``docs``."""
    packed = materialize(streams(docs.select("doc_id", "text"), "doc_id", buckets, grams))
    raw = counts(packed, buckets)
    wanted = counts(streams(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id", buckets, grams), buckets)
    scored = materialize(weights(packed, gains(raw, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").asc(), F.col("n_features").asc()]
    placed = with_places(able, order, default_parallelism(docs.sparkSession))
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


#: crc32 of the distinct words by the table-driven rule, byte by byte.
ORACLE = """
WITH crc_table AS (SELECT list(c ORDER BY n) AS t FROM (
      SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT row_id, word, count(*) AS n FROM (SELECT row_id, unnest(words) AS word FROM d) GROUP BY 1, 2),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY 1),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucketed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM hexed, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN bucketed USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN bucketed USING (word) GROUP BY 1),
tot AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS big_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS big_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT row_id, sum(n * gain) AS weight FROM dw JOIN bucketed USING (word) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (row_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS BIGINT) AS rank FROM r
"""
