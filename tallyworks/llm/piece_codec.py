"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix lookups in the model's compiled character map
(a double-array trie with the replacement strings behind it); each normalised byte
keeps the offset of the source byte it came from. Every piece, a run of normalised
bytes, is thereby projected to a span of original bytes. Bytes of a character spelled
in byte pieces: all but the last have an empty span at its start.

Ids are the library's own. Where the model's pieces never run across a word mark
inside them and the map is empty, merges stay within a marked word, and a bounded
table keeps the ids of words met before.

Defined results: a null text is an empty one, without ids, decoding to ""; repeated
rows give equal results; an empty table gives an empty one; texts have any length.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KEPT_WORDS = 400_000
MARK = "▁".encode()


class CharMap:
    """The compiled map: 4 bytes of trie size, the trie's units, then zero-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        shift = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = shift(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or (units[node] & 0x800000FF) != text[k]:
                break
            unit = units[node]
            node ^= shift(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


def _char_len(text: bytes, at: int) -> int:
    """Bytes of the well-formed UTF-8 character at ``at``; 0 if there is none."""
    n = 1 if text[at] < 0x80 else 2 if text[at] >> 5 == 6 else 3 if text[at] >> 4 == 14 else 4 if text[at] >> 3 == 30 else 0
    try:
        text[at : at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n if len(text[at : at + n]) == n else 0


def normalize(text: bytes, chars: CharMap, prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, white space as marks, and the source offset of each; the array's last entry is for the end.

    prefix: a mark goes before the text; squeeze: white space at the ends goes, and runs of it become one.
    """
    parts: list[tuple[bytes, int]] = []
    at, end = 0, len(text)

    def step(at: int) -> tuple[int, bytes]:
        if (m := chars.longest(text, at)) is not None:
            return m
        n = _char_len(text, at)
        return (n, text[at : at + n]) if n else (1, "�".encode())

    if squeeze:
        while at < end and (m := step(at))[1] == b" ":
            at += m[0]
        if at == end:
            return b"", np.zeros(1, np.int32)
    if not end:
        return b"", np.zeros(1, np.int32)
    if prefix:
        parts.append((MARK, at))
    spaced = squeeze
    while at < end:
        n, new = step(at)
        while squeeze and spaced and new[:1] == b" ":
            new = new[1:]
        if new:
            parts += [(MARK if c == b" " else c, at) for c in (new[k : k + 1] for k in range(len(new)))]
            spaced = new[-1:] == b" "
        at += n
    stop = end
    while squeeze and parts and parts[-1][0] == MARK:
        stop = parts.pop()[1]
    out = b"".join(p for p, _ in parts)
    return out, np.append(np.repeat([a for _, a in parts], [len(p) for p, _ in parts]), stop).astype(np.int32)


def identity_alignment(text: bytes, prefix: bool) -> np.ndarray:
    """What ``normalize`` gives for an empty map without squeezing, for well-formed text, by whole-array steps."""
    if not text:
        return np.zeros(1, np.int32)
    b = np.frombuffer(text, np.uint8)
    start = np.where((b & 0xC0) == 0x80, 0, np.arange(len(b), dtype=np.int32))
    np.maximum.accumulate(start, out=start)
    start = np.repeat(start, np.where(b == 32, 3, 1)) if b" " in text else start
    return np.concatenate([np.zeros(3 * prefix, np.int32), start, np.array([len(b)], np.int32)])


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces or any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with suffix marks, raw spaces or user-defined pieces are not supported")
        self.chars = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.plain = not self.chars.units and not self.squeeze
        self.unk = self.sp.unk_id()
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.by_word = self.plain and self.prefix and not any(MARK.decode() in p.piece.lstrip(MARK.decode()) for p in proto.pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.met = bytearray(1 << 22)

    @staticmethod
    def _both(ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u2" if max(ids, default=0) < 65536 else "<u4").astype("<u4").tobytes(), ",".join(map(str, ids)).encode()

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids, as little-endian uint32 and as decimals, of a word whose first mark the library adds."""
        both = self._both(self.sp.encode(word) if word else [self.sp.piece_to_id(MARK.decode())])  # "": a last space
        spot = hash(word) % len(self.met)
        if self.met[spot] and len(self.known) < KEPT_WORDS:
            self.known[word] = both
        self.met[spot] = 1
        return both

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """Ids, and the same as decimals joined by commas."""
        if not text:
            return np.zeros(0, np.uint32), b""
        if not self.by_word:
            ids, csv = self._both(self.sp.encode(text))
            return np.frombuffer(ids, "<u4"), csv
        flat = text.replace("▁", " ") if "▁" in text else text
        words = flat.split(" ")
        if "" in words:  # runs of spaces belong to the word behind them
            words = [w[1:] for w in re.findall(r" +[^ ]*", " " + flat)]
        known, fresh = self.known, self._word
        got = [known.get(w) or fresh(w) for w in words]
        return np.frombuffer(b"".join([g[0] for g in got]), "<u4"), b",".join([g[1] for g in got if g[1]])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in ``text`` of every piece."""
        raw = text.encode()
        if self.plain:
            align = identity_alignment(raw, self.prefix)
        else:
            align = normalize(raw, self.chars, self.prefix, self.squeeze)[1]
        if self.unk in ids:  # an unknown piece's width isn't in the table
            widths = self.widths[ids].copy()
            norm = normalize(raw, self.chars, self.prefix, self.squeeze)[0]
            at = 0
            for k, p in enumerate(self.sp.encode(text, out_type=str)):
                widths[k] = len(p.encode()) if norm.startswith(p.encode(), at) else widths[k]
                at += widths[k]
        else:
            widths = self.widths[ids]
        ends = np.cumsum(widths)
        return align[ends - widths], align[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist()) if len(ids) else ""


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins, ends: the spans are of bytes of the UTF-8 text."""

    def run(b: dict) -> dict:
        c = codec(path)
        out: dict = {"doc_id": b["doc_id"], "ids": [], "begins": [], "ends": []}
        for text in b["text"]:
            ids = c.encode(text)[0]
            begins, ends = c.spans(text, ids)
            for k, v in (("ids", ids), ("begins", begins), ("ends", ends)):
                out[k].append(v.astype(np.int32))
        return out

    return map_rows(_texts(docs), run, f"doc_id {_id(docs)}, ids array<int>, begins array<int>, ends array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes, and gives digests of both and of the spans.

    n_bytes, covered_bytes: of the text, and of the union of the spans; spans_crc32: of begins then ends as little-endian int32.
    """

    def run(b: dict) -> dict:
        c = codec(path)
        out: dict = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "covered_bytes", "spans_crc32")}
        for text in b["text"]:
            ids, csv = c.encode(text)
            begins, ends = c.spans(text, ids)
            decoded = c.decode(ids)
            row = (len(ids), hashlib.sha256(csv).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), len(text.encode()), int((ends - begins).sum()), zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(begins.astype("<i4").tobytes())))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": b["doc_id"], **out}

    return map_rows(_texts(docs), run, f"doc_id {_id(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long, spans_crc32 long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _id(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
