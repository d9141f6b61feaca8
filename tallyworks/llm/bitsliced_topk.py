"""Exact top-k by inner product on a bit-sliced index.

Vectors become integers, floor(256 x). Rows are dealt into blocks of at most about
``BLOCK_ROWS``; a block keeps, for each attribute, one bitmap over its rows per bit of
(value - smallest value). A query's scores are never computed row by row: each of its
components, in signed binary digits, adds the attribute's slices, shifted, to a sum
that is itself a stack of bitmaps (carry-save adders, then a half adder per slice); a
negative digit adds the slices' complement, the constant left over is known. Rows are
then selected from the most significant slice downward; what is left at the boundary
has one score, and the smaller ids win. Scores of the selected rows are read off the
slices.

Queries, in groups, meet every block: pairs of (group, block), an equi-join on the
block, each side a packed row. Blocks are repeated for several groups only as far as
tasks need.

Vectors with a component of WIDE (2^44) or more in size would need slices without end;
they are kept apart, in packed blocks like the others', and scored exactly by whole
numbers of any length: as queries against all rows, as candidates for all queries.

Defined results: vectors that are null or hold a null, a NaN or an infinity take no
part, as do null ids; a missing component counts as 0; rows that repeat an id are
candidates one by one; a query answers for the smallest vector under its id and never
meets rows of its own id; ties go to the smaller id; scores are ranked exactly and, where
a long can't hold them, printed as the nearest long; fewer candidates than k, fewer rows;
empty table, empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parallelism, map_rows

BLOCK_ROWS, GROUP_ROWS = 16384, 64
WIDE, WIDE_ROWS = 2.0**44, 512
FOUND = "query_id long, vec_id long, score long, key binary"


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, q (the integers), x (the components), wide: of the vectors that take part. q is null in wide ones."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    wide = F.exists("x", lambda v: F.abs(v) >= WIDE)
    return rows.withColumn("wide", wide).withColumn("q", F.when(~F.col("wide"), F.transform("x", lambda v: F.floor(v * 256).cast("long"))))


def exact_int(x: float) -> int:
    """floor(256 x) of any finite x."""
    n, d = float(x).as_integer_ratio()
    return 256 * n // d


def sort_key(score: int) -> bytes:
    """Bytes in the order of whole numbers of any length."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - c for c in raw)


def _long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _matrix(lists: list, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def slice_block(ids: np.ndarray, values: np.ndarray) -> dict:
    """The index of a block: ids in order, per attribute the smallest value, bitmaps [attribute, bit, word]."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(0)
    rest = values - low
    bits = max(1, int(rest.max()).bit_length())
    words = -(-len(ids) // 64)
    planes = np.zeros((values.shape[1], bits, words * 8), np.uint8)
    for j in range(bits):
        got = np.packbits((rest >> j & 1).astype(np.uint8).T, axis=1, bitorder="little")
        planes[:, j, : got.shape[1]] = got
    return {"ids": ids, "low": low, "bits": bits, "planes": planes.view(np.uint64)}


def signed_digits(x: int) -> list[tuple[int, bool]]:
    """Non-adjacent form of x: (place, is negative)."""
    out, place = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((place, d < 0))
            x -= d
        x >>= 1
        place += 1
    return out


def add_slices(query: np.ndarray, both: np.ndarray, bits: int) -> tuple[list[np.ndarray], int]:
    """Slices of sum_d q_d (v_d - low_d) + constant, and that constant. both: the planes, then their complements, as [2 x attribute x bit, word]."""
    dims = len(both) // (2 * bits)
    at: dict[int, list[np.ndarray]] = {}
    constant = 0
    for d, x in enumerate(query.tolist()):
        for place, negative in signed_digits(x):
            first = ((dims if negative else 0) + d) * bits
            constant += (1 << place) * ((1 << bits) - 1) if negative else 0
            for j in range(bits):
                at.setdefault(place + j, []).append(first + j)
    slices: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    weight, top = 0, max(at, default=-1)
    while weight <= top or carried:
        stack = both[at[weight]] if weight in at else np.zeros((0, both.shape[1]), np.uint64)
        if carried:
            stack = np.concatenate([stack, *carried])
        carried = []
        while len(stack) > 2:
            t = len(stack) // 3
            a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
            x = a ^ b
            carried.append((a & b) | (x & c))
            stack = np.concatenate([x ^ c, stack[3 * t :]])
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        slices.append(stack[0] if len(stack) else np.zeros(both.shape[1], np.uint64))
        weight += 1
    return slices, constant


def select_top(slices: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Bit positions of the k rows of highest sum among the candidates, the lowest positions of those that tie."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, edge = np.zeros_like(candidates), candidates
    if count(edge) > k:
        for s in reversed(slices):
            high = edge & s
            n = count(sure | high)
            if n >= k:
                edge = high
                if n == k:
                    break
            else:
                sure, edge = sure | high, edge & ~s
    bits = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    first = bits(sure)
    return np.concatenate([first, bits(edge)[: k - len(first)]])


def block_top(block: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """query_id, vec_id, score of each query's k best rows of the block."""
    ids, bits = block["ids"], block["bits"]
    flat = block["planes"].reshape(-1, block["planes"].shape[2])
    both = np.concatenate([flat, ~flat])
    there = np.zeros(both.shape[1] * 64, np.uint8)
    there[: len(ids)] = 1
    out: tuple[list, list, list] = ([], [], [])
    for own, q in zip(query_ids.tolist(), queries, strict=True):
        mask = there.copy()
        mask[np.searchsorted(ids, own) : np.searchsorted(ids, own, "right")] = 0
        slices, constant = add_slices(q, both, bits)
        base = sum(a * b for a, b in zip(q.tolist(), block["low"].tolist(), strict=True)) - constant
        for p in select_top(slices, np.packbits(mask, bitorder="little").view(np.uint64), k).tolist():
            total = base + sum(((int(s[p >> 6]) >> (p & 63)) & 1) << w for w, s in enumerate(slices))
            out[0].append(own)
            out[1].append(int(ids[p]))
            out[2].append(total)
    return out


def _exact_top(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, key: each query's k best rows of every block of candidates, by whole numbers."""

    def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // size))
        packed = rows.groupBy(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).alias(name))
        return packed.agg(F.collect_list(F.struct("vec_id", "x")).alias(f"{name}_rows")), n

    asked, _ = blocks(queries, GROUP_ROWS, "part")
    held, n = blocks(candidates, WIDE_ROWS, "block")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(held, "block")

    def run(b: dict) -> dict:
        out: dict = {"query_id": [], "vec_id": [], "score": [], "key": []}
        for part, block in zip(b["part_rows"], b["block_rows"], strict=True):
            rows = [(r["vec_id"], [exact_int(x) for x in r["x"]]) for r in block]
            for q in part:
                own = [exact_int(x) for x in q["x"]]
                scored = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), i) for i, v in rows if i != q["vec_id"])[:k]
                for less, i in scored:
                    for name, v in zip(out, (q["vec_id"], i, _long(-less), sort_key(-less)), strict=True):
                        out[name].append(v)
        return out

    return map_rows(pairs.select("part_rows", "block_rows"), run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all rows but its own."""
    every_row = quantized(vectors)
    rows = every_row.where("NOT wide")
    # the smallest vector of an id, wide or not, is asked
    queries = every_row.where(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "wide", "q")).alias("r")).select("vec_id", "r.*")
    asked = queries.where("NOT wide").select("vec_id", "q")
    facts = every_row.agg(F.count_if(~F.col("wide")).alias("n"), F.max(F.size("x")).alias("dims"), F.count_if(is_query).alias("asked"), F.count_if("wide").alias("wide")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts.asked or not facts.dims:
        return vectors.sparkSession.createDataFrame([], schema)
    exact = None
    if facts.wide:
        of_all = _exact_top(queries, every_row.where("wide"), k)
        exact = of_all.unionByName(_exact_top(queries.where("wide"), rows, k))
    dims, n_blocks, n_groups = facts.dims, max(1, -(-facts.n // block_rows)), -(-facts.asked // group_rows)
    repeats = max(1, min(n_groups, -(-2 * default_parallelism(vectors.sparkSession) // n_blocks)))

    def build(group: pa.Table) -> pa.Table:
        b = slice_block(group.column("vec_id").to_numpy(), _matrix(group.column("q").to_pylist(), dims))
        cols = (pa.array([group.column("block")[0].as_py()]), *(pa.array([x], pa.binary()) for x in (b["ids"].tobytes(), b["low"].tobytes(), b["planes"].tobytes())), pa.array([b["bits"]]))
        return pa.table(cols, names=["block", "ids", "low", "planes", "bits"])

    def bundle(group: pa.Table) -> pa.Table:
        order = group.sort_by("vec_id")
        cols = (pa.array([group.column("part")[0].as_py()]), pa.array([order.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([_matrix(order.column("q").to_pylist(), dims).tobytes()], pa.binary()))
        return pa.table(cols, names=["part", "query_ids", "queries"])

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block").applyInArrow(build, "block long, ids binary, low binary, planes binary, bits long")
    groups = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_groups))).groupBy("part").applyInArrow(bundle, "part long, query_ids binary, queries binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = groups.withColumn("repeat", F.pmod("part", F.lit(repeats))).withColumn("block", every(n_blocks)).join(blocks.withColumn("repeat", every(repeats)), ["block", "repeat"])

    def run(b: dict) -> dict:
        out: dict = {"query_id": [], "vec_id": [], "score": [], "key": []}
        for ids, low, planes, bits, qi, qv in zip(b["ids"], b["low"], b["planes"], b["bits"], b["query_ids"], b["queries"], strict=True):
            block = {"ids": np.frombuffer(ids, np.int64), "low": np.frombuffer(low, np.int64), "bits": bits, "planes": np.frombuffer(planes, np.uint64).reshape(dims, bits, -1)}
            who, which, scores = block_top(block, np.frombuffer(qi, np.int64), np.frombuffer(qv, np.int64).reshape(-1, dims), k)
            for name, values in zip(out, (who, which, map(_long, scores), map(sort_key, scores)), strict=True):
                out[name] += values
        return out

    found = map_rows(pairs.select("ids", "low", "planes", "bits", "query_ids", "queries"), run, FOUND)
    found = found if exact is None else found.unionByName(exact)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
