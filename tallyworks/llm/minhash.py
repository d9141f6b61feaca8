"""MinHash near-duplicates: many universal hash minima, bands, signature check, full-set check, components.

A text's set is its distinct ``width``-word shingles (words lower-cased in A-Z; with
fewer words the whole sequence as one). Texts with the same words are one class and
travel as one. BANDS x ROWS minima of (a x + b) >> 32 give a class its bands; classes
that share a band may be linked. Links need 100 |A n B| >= percent |A u B| on the full
sets of 64-bit shingle hashes; a pair whose signatures agree too little, five standard
deviations below the limit, isn't looked at.

Who is linked to whom inside a band matters only for components, so bands are settled,
not expanded into pairs: in a few rounds each class is held against one pivot of a band
it shares with another component; bands still split after that are compared in blocks of
sets of like size, across components only, signatures first, then full sets, and yield
links alone. A link at the limit shares no band with
probability (1 - 0.8^ROWS)^BANDS, 3 in a million.

Defined results: empty, wordless and null texts have no shingles and are linked with
nothing; rows that share a doc_id are one document, linked by any of its texts; a row without doc_id has no
component and is kept; exact copies and repeated rows share their smallest doc_id; empty
table, empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, map_groups, map_rows, materialize, packed, unpacked, utf8
from .components import components, grown

BANDS, ROWS, WIDTH, PERCENT = 32, 5, 5, 80
MIN_AGREE = 0.64
PIVOT_ROUNDS, BLOCK, BLOCK_BYTES = 3, 2048, 16 << 20
_U = np.uint64


class _WordHashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 65_536:
            self[word] = h
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, n)
    w = min(width, n)
    out = h[: n - w + 1].copy()
    for j in range(1, w):
        out *= _U(0x9E3779B97F4A7C15)
        out += h[j : n - w + 1 + j]
    return np.unique(_mix(out + _U(w)))


@functools.lru_cache(maxsize=4)
def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 2**64, count, dtype=_U) | _U(1), rng.integers(0, 2**64, count, dtype=_U)


def minima(items: np.ndarray, count: int) -> np.ndarray:
    """Smallest (a x + b) >> 32 of each of ``count`` universal hash functions."""
    a, b = _universal(count)
    out = np.full(count, 2**64 - 1, _U)
    for k in range(0, len(items), 512):
        part = a[:, None] * items[None, k : k + 512]
        part += b[:, None]
        np.minimum(out, part.min(1), out=out)
    return out >> _U(32)


def band_hashes(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for j in range(rows):
        out = _mix(out ^ (mins.reshape(bands, rows)[:, j] * _U(0xD6E8FEB86659FD93)))
    return out.view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(b: dict) -> dict:
        out: dict = {k: [] for k in ("digest", "n_shingles", "bands", "sig")}
        for text in b["text"]:
            words = text.lower().split()
            s = shingles(words, width)
            m = minima(s, BANDS * ROWS) if len(s) else None
            for k, v in (("digest", hashlib.md5(b" ".join(words)).digest() if words else None), ("n_shingles", len(s)), ("bands", band_hashes(m, BANDS, ROWS) if len(s) else None), ("sig", (m & _U(255)).astype(np.uint8).tobytes() if len(s) else None)):
                out[k].append(v)
        return {"doc_id": b["doc_id"], **out}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, "doc_id long, digest binary, n_shingles long, bands array<long>, sig binary")


def _agree(sig: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree enough."""
    least = int(MIN_AGREE * BANDS * ROWS)
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(b: dict) -> dict:
        x, y = (np.frombuffer(b"".join(b[k]), np.uint8).reshape(-1, BANDS * ROWS) for k in ("sa", "sb"))
        ok = np.flatnonzero((x == y).sum(1) >= least)
        return {"a": [b["a"][i] for i in ok], "b": [b["b"][i] for i in ok]}

    return map_rows(both, run, "a long, b long")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[at] == small).sum())
    return 100 * same >= percent * (len(p) + len(q) - same)


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), "b")

    def run(b: dict) -> dict:
        ok = [i for i, (x, y) in enumerate(zip(b["sa"], b["sb"], strict=True)) if _similar(np.frombuffer(x, _U), np.frombuffer(y, _U), percent)]
        return {"a": [b["a"][i] for i in ok], "b": [b["b"][i] for i in ok]}

    return map_rows(both, run, "a long, b long")


def _blocks(split: DataFrame, sig: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within split bands, by size and, where many members or bytes remain, by pairs of blocks.

    Sets whose sizes part too much can't be similar: a level holds the sizes up to 100 / percent times its smallest, and a slot
    compares a level with itself and with the one below. A first pass compares signatures and tells which members of a block have a
    partner there; full sets travel for those alone, and the second pass confirms inside the block: no pair leaves it but a link. A pair
    belongs to the first band it shares, and components that a link has joined are not compared further in that block.
    """
    level = F.floor(F.log(F.col("bytes") / 8) / math.log(100 / percent * 1.000001))  # a little wide, so that rounding loses nothing
    sized = sets.withColumn("bytes", F.length("items").cast("long"))
    keyed = split.join(sized.select("node", "bytes"), "node").withColumn("level", level).withColumn("slot", F.explode(F.array("level", F.col("level") + 1)))
    keyed = keyed.withColumn("upper", F.col("level") == F.col("slot")).drop("level")
    sizes = keyed.groupBy("band", "slot").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("chunks"), F.min("comp").alias("one"), F.max("comp").alias("two"), F.max("upper").alias("any")).where("one < two AND any").select("band", "slot", "chunks")
    keyed = keyed.join(sizes, ["band", "slot"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other", "chunks")
    block = ["band", "slot", "lo", "hi"]

    def pairs(group: pa.Table, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a block worth a look, some rows at a time."""
        node, chunk, size = (group.column(c).to_numpy() for c in ("node", "chunk", "bytes"))
        upper = np.array(group.column("upper").to_pylist(), bool)
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        band, across = group.column("band")[0].as_py(), group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        for k in range(0, len(node), 64):
            near = (comp[k : k + 64, None] != comp[None, :]) & (node[k : k + 64, None] > node[None, :]) & (upper[k : k + 64, None] | upper[None, :])
            near &= 100 * np.minimum(size[k : k + 64, None], size[None, :]) >= percent * np.maximum(size[k : k + 64, None], size[None, :])
            if across:
                near &= chunk[k : k + 64, None] != chunk[None, :]
            i, j = np.nonzero(near)
            i += k
            for c in range(0, len(i), 65536):
                x, y = i[c : c + 65536], j[c : c + 65536]
                near = (sigs[x] == sigs[y]).sum(1) >= int(MIN_AGREE * BANDS * ROWS)
                x, y = x[near], y[near]
                first = bands[x, (bands[x] == bands[y]).argmax(1)] == band
                yield x[first], y[first]

    def partners(group: pa.Table) -> pa.Table | None:
        hit = np.zeros(group.num_rows, bool)
        for x, y in pairs(group, group.column("comp").to_numpy()):
            hit[x] = hit[y] = True
        return group.filter(pa.array(hit)) if hit.any() else None

    def confirm(group: pa.Table) -> pa.Table | None:
        node = group.column("node").to_numpy()
        comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
        items = [np.frombuffer(x, _U) for x in group.column("items").to_pylist()]
        links = []
        for x, y in pairs(group, comp):
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                if comp[p] != comp[q] and _similar(items[p], items[q], percent):
                    comp[comp == comp[p]] = comp[q]
                    links.append((node[p], node[q]))
        return pa.table({"a": [x for x, _ in links], "b": [y for _, y in links]}) if links else None

    signed = keyed.join(sig, "node")
    asked = materialize(map_groups(signed, block, partners, signed.schema))
    return map_groups(asked.join(sized, ["node", "bytes"]), block, confirm, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    every = materialize(_signatures(docs, width))
    # one row per class, so groups of copies end here; no aggregate stands on the joins below, so that Spark may split their hot bands
    reps = materialize(every.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    classes = reps.select("digest", "node")
    bands = reps.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    members = materialize(bands.join(shared, "band"))
    nodes = members.select("node").distinct()
    sig = materialize(reps.select("node", "sig", "bands").join(nodes, "node", "left_semi"))

    def full(b: dict) -> dict:
        return {"node": b["node"], "items": [shingles(t.lower().split(), width).tobytes() for t in b["text"]]}

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), utf8().alias("text")).join(nodes, "node", "left_semi")
    sets = materialize(map_rows(texts, full, "node long, items binary").distinct())
    several = every.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    own = every.select("doc_id", "digest").join(several, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = materialize(components(own.distinct()))

    def joined() -> DataFrame:
        """Members of bands that still hold more than one component, with their components."""
        now = members.join(comp, "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp"))
        open_bands = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
        return now.join(open_bands, "band")

    for k in range(PIVOT_ROUNDS + 1):
        split = materialize(joined())
        if split.isEmpty():
            drop_scratch(split)
            break
        if k < PIVOT_ROUNDS:
            order = F.xxhash64("node", F.lit(k)) if k else F.col("node")
            pivots = split.groupBy("band").agg(F.min(F.struct(order.alias("o"), "node", "comp")).alias("p"))
            tried = split.join(pivots, "band").where("comp <> p.comp").groupBy("node").agg(F.min("p").alias("p")).select(F.col("node").alias("a"), F.col("p.node").alias("b"))
            new = materialize(_confirm(sets, _agree(sig, tried), percent).distinct())
        else:
            new = materialize(_blocks(split, sig, sets, percent))
        drop_scratch(split)
        before, comp = comp, materialize(grown(comp, new))
        drop_scratch(before)
        drop_scratch(new)
    for table in (members, sig, sets):
        drop_scratch(table)
    roots = classes.join(comp, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = every.select("doc_id", "digest", "n_shingles").join(roots, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; of rows that share a doc_id, all."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    left = packed(docs, "doc_id").join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
    return left.select(unpacked(left, docs.columns, "doc_id"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
             ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END AS items FROM w),
s AS (SELECT DISTINCT doc_id, unnest(items) AS item FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""
