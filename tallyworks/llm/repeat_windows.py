"""Suffix-array dedup: bytes covered by a 50-byte string of a document with a smaller id.

Suffixes are ordered only through their first 50 bytes, most significant digit first;
suffixes equal that far are the repeated windows. A suffix's leading digit is its
*anchor*: the smallest hashed 16-byte string within its first 50 bytes, with the place
where it starts. Equal windows have equal anchors at equal places, so

1. windows next to each other with one anchor are one run; a run's digest covers all its
   bytes. Every chunk of documents sends (anchor, digest, smallest document) of its
   distinct runs to the anchor's bucket. Runs of many chunks travel in one row, so that
   rows grow with the runs and not with chunks times buckets;
2. a bucket, sorted, answers the chunks: the smallest document of a digest, where another
   chunk has a smaller one; and, where an anchor has several digests, asks the chunk of
   each digest's smallest document for the run's bytes;
3. those windows are radix sorted: by anchor and place, then 8 bytes at a time through
   byte 50, groups of one dropping out after each pass. Equal groups give each window's
   smallest document, and the answer goes back to the chunk;
4. each chunk marks its windows, merges the marked bytes and cuts them out.

Groups never gather in one task: a run or window counts once per chunk however many
documents hold it. A bucket of more than LARGE runs is dealt again, 64-fold, by anchor,
and its commonest anchors by anchor and digest. Of such anchors, and of others with more
than HOT digests, no task has all runs: their windows are dealt by the windows' own bytes
instead of by the anchor. How a run is dealt never changes a result. Texts move once, to
their chunks.

Digests are 64-bit, compared among runs of one 40-bit anchor.

Defined results: a null text is empty; texts shorter than the window lose nothing; rows
that share a doc_id don't remove from each other; a row without doc_id neither removes
nor loses; empty table, empty result. Matches never cross documents.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_group_streams, map_groups, materialize, packed, trim, unpacked, utf8

WINDOW, GRAM = 50, 16
SPAN = WINDOW - GRAM + 1
CHUNK_BYTES, BUCKET_RUNS, LARGE, ROUTE_RUNS, HOT = 4 << 20, 1_000_000, 4_000_000, 25_000, 4096
SPLIT, LEVELS, HELD_RUNS = 64, 5, 800_000
ROW_RUNS, ROWS, HELD_HITS = 16_384, 32, 1_000_000  # packed runs in a row, rows dealt again together, windows answered together
SLICE = 1_000_000  # windows looked at together
SEGMENT = 1 << 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_B, _B_INV):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    n = len(buf) - 7
    out = np.empty(n, _U)
    for k in range(8):
        m = (n - k + 7) // 8
        if m > 0:
            out[k::8] = buf[k : k + 8 * m].view("<u8")
    return out


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, over all texts: text, first (window's start in the text), count, lead (anchor's place minus first), anchor, key."""
    found: dict[str, list] = {k: [] for k in ("text", "first", "count", "lead", "anchor", "key")}
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for k, v in _runs(batch).items():
            found[k].append(v)
        batch.clear()
        size = 0

    for t, text in enumerate(texts):
        for at in range(0, max(0, len(text) - WINDOW + 1), SEGMENT):
            part = text[at : at + SEGMENT + WINDOW - 1]
            if size + len(part) > SEGMENT + WINDOW:
                flush()
            batch.append((t, at, part))
            size += len(part)
    if batch:
        flush()
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _runs(parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    if not parts:
        return {}
    buf = np.frombuffer(b"".join(p for _, _, p in parts) + bytes(64), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in parts])
    n = int(ends[-1])
    g = _eights(buf)[: n + 48]
    x = g[:-8] * _U(0xD6E8FEB86659FD93)
    y = g[8:] * _U(0xA0761D6478BD642F)
    y ^= y >> _U(32)
    x ^= x >> _U(29)
    x += y
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(31)  # the 16 bytes from each place on, hashed
    low = (x & _U(0xFFFFFFFFFF000000)) | np.arange(len(x), dtype=_U)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: -(SPAN - width)], low[SPAN - width :])
    at = (low[:n] & _U(0xFFFFFF)).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), [len(p) for _, _, p in parts])
    valid = np.arange(n) + WINDOW <= ends[part]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    ok = valid[first]
    first, count = first[ok], count[ok]
    up, down = _powers(SEGMENT + WINDOW + 64 + 1)
    z = g[:n] * _U(0xC4CEB9FE1A85EC53)
    z ^= z >> _U(32)
    z *= up[:n]
    total = np.zeros(n + 1, _U)
    np.cumsum(z, out=total[1:])
    lead = at[first] - first
    key = (total[first + count + WINDOW - 8] - total[first]) * down[first]
    key ^= key >> _U(32)
    key = (key + (count * 64 + lead).astype(_U)) * _U(0xD6E8FEB86659FD93)
    key ^= key >> _U(32)
    owner, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    begin = np.concatenate([[0], ends[:-1]])
    who = part[first]
    return {"text": owner[who], "first": first - begin[who] + offset[who], "count": count, "lead": lead, "anchor": x[at[first]], "key": key}


_KEY56, _ANCHOR40 = _U((1 << 56) - 1), _U((1 << 40) - 1)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that like bytes lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _look(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    return ((anchor & _U(255)) << _U(56)) | (key & _KEY56)


def _heads(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows change."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ranked(doc: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each document and chunk among all, and both by rank."""
    order = np.lexsort((chunk, doc))
    head = _heads(doc[order], chunk[order])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(doc))))
    return rank, doc[order[head]], chunk[order[head]]


def _pack(bucket: np.ndarray, rank: np.ndarray, docs: np.ndarray, chunks: np.ndarray, anchor: np.ndarray, key: np.ndarray, base: int = 0) -> pa.Table:
    """Rows of a bucket's runs, in the order of their documents, which a row tells once: by differences, with the chunk and the number of runs."""
    order = np.argsort((bucket.astype(_U) << _U(40)) | rank.astype(_U), kind="stable")
    bucket, rank, anchor, key = bucket[order], rank[order], anchor[order], key[order]
    head = _heads(bucket)
    part = (np.arange(len(bucket)) - np.repeat(head, np.diff(np.append(head, len(bucket))))) // ROW_RUNS
    cut = np.append(_heads(bucket, part), len(bucket))
    head = _heads(bucket, part, rank)
    count = np.diff(np.append(head, len(bucket))).astype(_U)
    doc, chunk = docs[rank[head]].astype(_U), chunks[rank[head]].astype(_U)
    at = np.searchsorted(head, cut)
    rows = [
        (base + int(bucket[a]), _planes(np.diff(doc[c:d], prepend=_U(0)), 8), _planes(chunk[c:d], 4), _planes(count[c:d], 4), _planes(anchor[a:b], 5), _planes(key[a:b], 7))
        for a, b, c, d in zip(cut, cut[1:], at, at[1:], strict=False)
    ]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])


def _send_runs(buckets: int):
    """Step 1: packed distinct runs of each chunk, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            chunk, doc, anchor, key = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3, 4))
            text = np.concatenate([h[2] + n for h, n in zip(held, itertools.accumulate((len(h[0]) for h in held), initial=0), strict=False)])
            held.clear()
            rank, docs, chunks = _ranked(doc, chunk)
            rank = rank[text]
            bucket = (anchor >> _U(32)).astype(np.int64) % buckets
            mixed = ((anchor * _U(_B)) ^ key) + chunks[rank].astype(_U) * _U(0xA0761D6478BD642F)
            order = np.argsort((bucket.astype(_U) << _U(40)) | (mixed >> _U(24)), kind="stable")
            bucket, rank, anchor, key = bucket[order], rank[order], anchor[order] & _ANCHOR40, key[order] & _KEY56
            head = _heads(bucket, chunks[rank], anchor, key)
            rank = np.minimum.reduceat(rank, head)  # of one chunk, the least rank is the smallest document
            yield from _pack(bucket[head], rank, docs, chunks, anchor[head], key[head]).to_batches()

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            r = runs(batch.column(2).to_pylist())
            if len(r["text"]):
                held.append((chunk, doc, r["text"], r["anchor"], r["key"]))
                n += len(r["text"])
            if n > HELD_RUNS:
                yield from flush()
                n = 0
        yield from flush()

    return run


PACKED = "bucket long, docs binary, chunks binary, counts binary, anchors binary, keys binary"
ANSWER = "chunk long, look binary, low binary, need binary, mask binary, asked long"


def _unpack(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, key, anchor, chunk of packed runs."""
    docs, keys, anchors, chunks = [], [], [], []
    for d, c, n, a, k in zip(*(group.column(x).to_pylist() for x in ("docs", "chunks", "counts", "anchors", "keys")), strict=True):
        count = _unplanes(n, 4).astype(np.int64)
        docs.append(np.repeat(np.cumsum(_unplanes(d, 8)).astype(np.int64), count))
        chunks.append(np.repeat(_unplanes(c, 4).astype(np.int64), count))
        anchors.append(_unplanes(a, 5))
        keys.append(_unplanes(k, 7))
    return tuple(np.concatenate(x) for x in (docs, keys, anchors, chunks))


def _answer_table(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in ANSWER.split(", ")]
    return pa.table(dict(zip(names, (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4, pa.int64()), strict=True)), strict=True)))


def _answer(group: pa.Table, hot: bool = False) -> pa.Table | None:
    """Step 2: a bucket's answers and requests, per chunk. hot: other buckets hold more runs of these anchors."""
    doc, key, anchor, chunk = _unpack(group)
    order = np.lexsort((doc, key, anchor))
    doc, key, anchor, chunk = doc[order], key[order], anchor[order], chunk[order]
    head = _heads(anchor, key)
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(doc))))
    low = doc[head]
    top = _heads(anchor[head])
    kinds = np.repeat(np.diff(np.append(top, len(head))), np.diff(np.append(top, len(head))))  # digests of the anchor
    owner = np.zeros(len(doc), bool)
    owner[head] = hot | (kinds > 1)
    need = np.where(owner, np.where(hot | (kinds[of] > HOT), 2, 1), 0)
    sel = np.flatnonzero(owner | (low[of] < doc))
    if not len(sel):
        return None
    sel = sel[np.argsort(chunk[sel], kind="stable")]
    look, cut = _look(anchor[sel], key[sel]), np.append(_heads(chunk[sel]), len(sel))
    return _answer_table([(int(chunk[sel[a]]), look[a:b].tobytes(), low[of[sel[a:b]]].tobytes(), need[sel[a:b]].astype(np.uint8).tobytes(), b"", int((need[sel[a:b]] > 0).sum())) for a, b in itertools.pairwise(cut)])


def _deal_again(group: pa.Table, bucket: int, common: np.ndarray, seed: int) -> Iterator[pa.Table]:
    """Runs of a large bucket, packed for SPLIT smaller ones: by anchor, those of ``common`` anchors, in odd buckets, by anchor and digest."""
    for i in range(0, group.num_rows, ROWS):
        doc, key, anchor, chunk = _unpack(group.slice(i, ROWS))
        hot = np.isin(anchor, common) | bool(bucket & 1)
        mixed = (anchor ^ np.where(hot, key, _U(0))) * _U(_B) + _U(seed)
        mixed ^= mixed >> _U(29)
        to = ((mixed * _U(0xD6E8FEB86659FD93)) >> _U(40)).astype(np.int64) % SPLIT * 2 + hot
        yield _pack(to, *_ranked(doc, chunk), anchor, key, 2 * SPLIT * (bucket >> 1))


def _settle(level: int):
    """Answers of buckets that fit; of others their runs, dealt again. Odd buckets hold runs of hot anchors."""

    def wide(table: pa.Table) -> pa.Table:
        have = set(table.column_names)
        fields = [(f.split()[0], pa.int64() if f.endswith("long") else pa.binary()) for f in f"{PACKED}, {ANSWER}".split(", ")]
        return pa.table({n: table.column(n) if n in have else pa.nulls(table.num_rows, t) for n, t in dict(fields).items()})

    def run(key: tuple, pieces: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held, runs = [], 0
        for piece in pieces:
            held.append(piece)
            runs += pc.sum(pc.binary_length(piece.column("anchors"))).as_py() // 5
            if runs > LARGE and level < LEVELS:
                break
        else:
            if (out := _answer(pa.concat_tables(held), bool(key[0] & 1))) is not None:
                yield wide(out)
            return
        # the runs seen so far tell which anchors are common; all runs of the bucket then go the same way
        anchors, n = np.unique(np.concatenate([_unpack(x)[2] for x in held]), return_counts=True)
        common = anchors[n > LARGE // SPLIT]
        for piece in itertools.chain(held, pieces):
            for out in _deal_again(piece, int(key[0]), common, level):
                yield wide(out)

    return run


def _gather(answers: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in answers.column(column).to_pylist()), kind)


def _chunk_runs(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], dict[str, np.ndarray], np.ndarray]:
    """Texts of a chunk and their runs; documents without an id have none."""
    ids = docs.column("doc_id").cast(pa.int64())
    there = np.array(ids.is_valid())
    doc = np.array(ids.fill_null(0))
    texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
    r = runs([t if ok else b"" for t, ok in zip(texts, there, strict=True)])
    return doc, there, texts, r, _look(r["anchor"], r["key"]) if len(r["text"]) else np.zeros(0, _U)


REQUEST = "route long, chunk long, look long, window int, lead int, doc long, anchor long, bytes binary, done boolean"


def _send_bytes(routes: int):
    """Step 3, first half: the bytes of requested runs; windows of hot anchors one by one, once per chunk."""

    names = [f.split()[0] for f in REQUEST.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())

    def table(*cols) -> pa.Table:
        return pa.table({n: pa.array(c, t) if not isinstance(c, pa.Array) else c for n, c, t in zip(names, cols, types, strict=True)})

    def one_by_one(bodies: list[bytes], chunk: int, look: np.ndarray, lead: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> pa.Table:
        """The windows of runs in the order of their documents; a window that an earlier one equals is done."""
        lens = np.array([len(b) for b in bodies])
        count = lens - (WINDOW - 1)
        run = np.repeat(np.arange(len(lens)), count)
        k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        buf = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
        starts = (np.cumsum(lens) - lens)[run] + k
        eights = _eights(buf)
        route = np.zeros(len(starts), _U)
        for at in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            route = (route ^ eights[starts + at]) * _U(0xD6E8FEB86659FD93)
            route ^= route >> _U(32)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[starts])
        _, first, same = np.unique(rows.view(f"V{WINDOW}").ravel(), return_index=True, return_inverse=True)
        done = doc[run[first[same]]] < doc[run]
        ends = np.concatenate([[0], np.cumsum(np.where(done, 0, WINDOW))]).astype(np.int32)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(done), [None, pa.py_buffer(ends), pa.py_buffer(rows[~done].tobytes())])
        return table((route % _U(routes)).astype(np.int64), np.full(len(run), chunk), look[run], k, lead[run] - k, doc[run], anchor[run], raw, done)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = [table(*[[]] * len(names))]
        if docs.num_rows and answers.num_rows:
            doc, _, texts, r, look = _chunk_runs(docs)
            asked, need, low = (_gather(answers, c, k) for c, k in (("look", "<u8"), ("need", np.uint8), ("low", np.int64)))
            wanted = need > 0
            asked, need, low = asked[wanted], need[wanted], low[wanted]
            order = np.argsort(asked)
            asked, need, low = asked[order], need[order], low[order]
            if len(asked) and len(look):
                at = np.minimum(np.searchsorted(asked, look), len(asked) - 1)
                hit = np.flatnonzero((asked[at] == look) & (doc[r["text"]] == low[at]))
                hit = hit[np.unique(look[hit], return_index=True)[1]]
                hit = hit[np.argsort(doc[r["text"][hit]], kind="stable")]
                chunk = docs.column("chunk")[0].as_py()
                anchor, own, name, lead = ((r["anchor"] & _ANCHOR40).astype(np.int64), doc[r["text"]], look.view(np.int64), r["lead"])
                body = lambda i: texts[r["text"][i]][r["first"][i] : r["first"][i] + r["count"][i] + WINDOW - 1]
                whole, each = hit[need[at[hit]] == 1], hit[need[at[hit]] == 2]
                out.append(table(anchor[whole] % routes, np.full(len(whole), chunk), name[whole], np.zeros(len(whole)), lead[whole], own[whole], anchor[whole], [body(i) for i in whole.tolist()], np.zeros(len(whole), bool)))
                for k in range(0, len(each), max(1, SLICE // SPAN)):
                    e = each[k : k + max(1, SLICE // SPAN)]
                    out.append(one_by_one([body(i) for i in e.tolist()], chunk, name[e], lead[e], own[e], anchor[e]))
        trim()
        return pa.concat_tables(out)

    return run


def radix_groups(buf: np.ndarray, starts: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are not alone, in order, and the group of each: MSD passes over ``lead`` (the digit known before), then 8 bytes at a time."""
    eights = _eights(np.concatenate([buf, np.zeros(8, np.uint8)]))
    rest, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for step in range(-1, WINDOW // 8 + 1):
        digit = lead[rest] if step < 0 else eights[starts[rest] + min(8 * step, WINDOW - 8)]
        order = np.lexsort((digit, group))
        rest, group, digit = rest[order], group[order], digit[order]
        head = _heads(group, digit)
        size = np.diff(np.append(head, len(rest)))
        group = np.repeat(np.arange(len(head)), size)
        many = np.repeat(size > 1, size)
        rest, group = rest[many], group[many]
        if not len(rest):
            break
    return rest, group


def _by_chunk(answers: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The masks of a task's routes in one row for each chunk: else rows grow with routes times chunks."""
    held: dict[int, tuple[list[bytes], list[bytes]]] = {}

    def rows() -> pa.Table:
        out = _answer_table([(chunk, b"".join(looks), b"", b"", b"".join(masks), 0) for chunk, (looks, masks) in held.items()])
        held.clear()
        return out

    hits = 0
    for table in answers:
        for chunk, look, mask in zip(*(table.column(c).to_pylist() for c in ("chunk", "look", "mask")), strict=True):
            looks, masks = held.setdefault(chunk, ([], []))
            looks.append(look)
            masks.append(mask)
            hits += len(look) // 8
        if hits > HELD_HITS:
            yield rows()
            hits = 0
    if held:
        yield rows()


def _resolve(group: pa.Table) -> pa.Table | None:
    """Step 3, second half: windows a smaller document holds, as a mask per run."""
    done = group.filter(group.column("done"))
    live = group.filter(pc.invert(group.column("done")))
    masks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    col = lambda t, c: t.column(c).to_numpy()
    if done.num_rows:
        masks.append((col(done, "chunk"), col(done, "look"), _U(1) << col(done, "window").astype(_U)))
    if live.num_rows:
        bodies = live.column("bytes").to_pylist()
        lens = np.array([len(b) for b in bodies])
        count = lens - (WINDOW - 1)
        run = np.repeat(np.arange(len(lens)), count)
        k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.cumsum(lens) - lens)[run] + k
        lead = col(live, "anchor")[run] * 64 + (col(live, "lead")[run] - k)
        rest, same = radix_groups(np.frombuffer(b"".join(bodies), np.uint8), starts, lead)
        if len(rest):
            doc = col(live, "doc")[run[rest]]
            head = _heads(same)
            low = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(doc))))
            hit = rest[doc > low]
            masks.append((col(live, "chunk")[run[hit]], col(live, "look")[run[hit]], _U(1) << (k[hit] + col(live, "window")[run[hit]]).astype(_U)))
    if not masks:
        return None
    chunk, look, bit = (np.concatenate(x) for x in zip(*masks, strict=True))
    if not len(chunk):
        return None
    order = np.lexsort((look, chunk))
    chunk, look, bit = chunk[order], look[order], bit[order]
    head = _heads(chunk, look)
    bit, chunk, look = np.bitwise_or.reduceat(bit, head), chunk[head], look[head]
    cut = np.append(_heads(chunk), len(chunk))
    return _answer_table([(int(chunk[a]), look[a:b].tobytes(), b"", b"", bit[a:b].tobytes(), 0) for a, b in itertools.pairwise(cut)])


def covered_bytes(docs: pa.Table, answers: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Step 4: a chunk's texts, their bounds when laid end to end, and which bytes are covered."""
    doc, _, texts, r, look = _chunk_runs(docs)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    delta = np.zeros(int(bounds[-1]) + 1, np.int32)
    if len(look):
        own = doc[r["text"]]
        order = np.argsort(look, kind="stable")
        head = _heads(look[order])
        low = np.empty(len(look), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(own[order], head), np.diff(np.append(head, len(look))))
        told, mask = (answers.filter(pc.greater(pc.binary_length(answers.column(c)), 0)) for c in ("low", "mask"))
        if told.num_rows:
            name, least = _gather(told, "look", "<u8"), _gather(told, "low", np.int64)
            o = np.argsort(name)
            name, least = name[o], least[o]
            head = _heads(name)
            name, least = name[head], np.minimum.reduceat(least, head)
            at = np.minimum(np.searchsorted(name, look), len(name) - 1)
            low = np.where(name[at] == look, np.minimum(low, least[at]), low)
        base = bounds[r["text"]] + r["first"]
        gone = own > low
        delta += np.bincount(base[gone], minlength=len(delta)).astype(np.int32)
        delta -= np.bincount(base[gone] + r["count"][gone] + WINDOW - 1, minlength=len(delta)).astype(np.int32)
        if mask.num_rows:
            name, bit = _gather(mask, "look", "<u8"), _gather(mask, "mask", "<u8")
            o = np.argsort(name)
            name, bit = name[o], bit[o]
            head = _heads(name)
            name, bit = name[head], np.bitwise_or.reduceat(bit, head)
            at = np.minimum(np.searchsorted(name, look), len(name) - 1)
            some = np.flatnonzero((name[at] == look) & ~gone)
            for k in range(SPAN):
                w = base[some[(bit[at[some]] >> _U(k)) & _U(1) == 1]] + k
                np.add.at(delta, w, 1)
                np.add.at(delta, w + WINDOW, -1)
    return texts, bounds, np.cumsum(delta[:-1]) > 0


def _plan(docs: DataFrame, finish, schema) -> DataFrame:
    """The four steps; ``finish`` makes the rows of a chunk from its documents and their covered bytes."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = max(1, -(-size // (BUCKET_RUNS * SPAN // 2)))
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.octet_length("text"))  # rows without id lose nothing wherever they are
    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", spread), F.lit(chunks)))
    rest = map_batches(placed.where("doc_id IS NOT NULL").select("chunk", F.col("doc_id").cast("long").alias("doc_id"), utf8()), _send_runs(buckets), PACKED)
    rest = rest.withColumn("bucket", F.col("bucket") * 2)
    answers = []
    for level in range(LEVELS + 1):
        settled = materialize(map_group_streams(rest, ["bucket"], _settle(level), f"{PACKED}, {ANSWER}"))
        answers.append(settled.where("look IS NOT NULL").select(*[f.split()[0] for f in ANSWER.split(", ")]))
        rest = settled.where("bucket IS NOT NULL").select(*[f.split()[0] for f in PACKED.split(", ")])
        if rest.isEmpty():
            break
    first = functools.reduce(DataFrame.unionByName, answers)
    asked = first.agg(F.sum("asked").alias("n")).first().n or 0
    routes = max(1, -(-asked // ROUTE_RUNS))
    by_chunk = placed.groupBy("chunk")
    requests = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_send_bytes(routes), REQUEST)
    second = map_groups(requests, ["route"], _resolve, ANSWER, _by_chunk)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = finish(docs, *covered_bytes(docs, answers))
        trim()
        return out

    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(run, schema)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    arrow = to_arrow_schema(schema)

    def finish(rows: pa.Table, texts: list[bytes], bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        if len(gone):
            inner = bounds[:-1][bounds[:-1] < len(gone)]
            starts[inner] = gone[inner]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts))
        whole = np.frombuffer(b"".join(texts), np.uint8)
        kept = [hashlib.sha256(texts[i] if total[b] == total[a] else whole[a:b][~gone[a:b]].tobytes()).hexdigest() for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        cols = [rows.column("doc_id").combine_chunks(), np.diff(bounds), np.diff(total[bounds]), np.diff(spans[bounds]), kept]
        return pa.table([pa.array(c, f.type) if isinstance(c, (list, np.ndarray)) else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return _plan(docs.select("doc_id", "text"), finish, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with covered bytes cut out of ``text``; what is left of a character cut in two goes as well."""
    slim = packed(docs, "doc_id", "text")
    columns = slim.columns

    def finish(rows: pa.Table, texts: list[bytes], bounds: np.ndarray, gone: np.ndarray) -> pa.Table:
        whole = np.frombuffer(b"".join(texts), np.uint8)
        valid = rows.column("text").is_valid().to_pylist()
        text = [whole[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if ok else None for a, b, ok in zip(bounds, bounds[1:], valid, strict=False)]
        at = columns.index("text")
        return rows.select(columns).set_column(at, "text", pa.array(text, rows.schema.field("text").type))

    out = _plan(slim, finish, slim.schema)
    return out.select(unpacked(out, docs.columns, "doc_id", "text"))
