"""Token counts by a finite-state transducer compiled from a tokenizer's merges.

What is compiled. A word's byte-pair encoding is right if and only if each two neighbouring tokens
are what the merges make of the two alone, and among the tokens that could end a prefix of a word
exactly one fits the token before it. So a prefix is known well enough by the suffixes of it that a
token may begin with, each with the token that ends before it and the tokens counted since: finitely
many states, as tokens are short. A transition reads one byte and is annotated with the change of the
count (it may be 0 or negative: a longer token may replace several). The last byte of a word is a
symbol of its own, so a state also holds what the count changes by if the word ends there. Round this
automaton lies one for the tokenizer's word pattern; white space leads back to its start state. States are made when a text first needs them and
kept in a dense table of bounded size, which starts anew when full.

How it runs. The texts of a batch are cut into chunks, and all chunks run in step, one table
look-up a byte. Each chunk runs from the start state, then from every state that its left
neighbour may end in, until both runs meet; that gives the chunk's map from entry states to exit
states and counts. The maps compose by a prefix scan: pointers from (chunk, entry) to (next chunk,
exit) are doubled until they span the texts.

For tokenizers files of byte-level BPE with word ends and the pattern of ``word_bpe_49k.json``; any
other file is refused. Character classes, lower case and composition are asked of the library, one
character at a time, and texts that aren't composed are composed by it. Special strings count one each.

Defined results: a null or empty text has 0 bytes and 0 tokens; bytes that aren't UTF-8 count as
replacement characters; rows are counted each by itself, so repeated rows and ids stay; an empty table
gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

LIMIT = 2048
CHUNK, GROUP_SYMBOLS, MOST_STATES, KEPT_PAIRS = 256, 1 << 19, 300_000, 200_000
#: The word pattern that the outer automaton is written for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Symbols: ASCII bytes, then the other bytes once for letters, once for numbers, once for the rest, then a special string.
SPECIAL = 512
IDLE, LETTERS, DIGIT, MARKS, APOSTROPHE, HALF, WHOLE = range(7)
OUTSIDE = (IDLE, (), 0)
_END = "Ā"
_BITS, _ZERO = 7, 64  # of a table entry, the low bits are the count's change + 64


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: printable ones themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Tokens as strings, one character a byte, those that end a word with ``_END``."""

    def __init__(self, merges: list):
        letters, suffix = byte_letters(), "</w>"

        def plain(token: str) -> str:
            body = token.removesuffix(suffix)
            return "".join(chr(letters[c]) for c in body) + (_END if body != token else "")

        pairs = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in merges]
        self.rank = {p: k for k, p in reversed(list(enumerate(pairs)))}
        bases = [chr(b) + e for b in range(256) for e in ("", _END)]
        self.tokens = {*bases, *(a + b for a, b in pairs)}
        #: What a token may go on from: proper prefixes, in whole bytes.
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t.removesuffix(_END)))}
        self.fits: dict[tuple[str, str], bool] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """The merges' result: the best-ranked pair first, the leftmost of equals."""
        parts, none = list(symbols), len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the two, side by side, stay what they are."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            body = right.removesuffix(_END)
            symbols = [*left, *body[:-1], body[-1] + right[len(body) :]]
            found = self.fits[left, right] = self.encode(symbols) == [left, right]
        return found

    #: Inside a word: (suffix, token before it, tokens since), the empty suffix first; None is the word's start.
    FIRST = (("", None, 0),)

    def step(self, state: tuple, byte: str, last: bool) -> tuple[tuple, int]:
        """The state after one more byte, and the change of the count."""
        symbol = byte + _END if last else byte
        for suffix, before, since in reversed(state):  # exactly one fits, mostly a long one
            token = suffix + symbol
            if token in self.tokens and (before is None or self.neighbours(before, token)):
                change = 1 - since
                on = () if last else tuple((s + byte, b, n + change) for s, b, n in state if s + byte in self.prefixes)
                return (("", token, 0), *on), change
        raise AssertionError(f"no token ends at {byte!r}")


class Alphabet:
    """Texts as arrays of symbols."""

    def __init__(self, tok: object):
        from tokenizers import normalizers

        self.tok, self.compose = tok, normalizers.NFC()
        specials = sorted((t.content for t in tok.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in specials)) if specials else None
        self.place = np.full(0x110000, -1, np.int32)  # of a character's symbols in the pool
        self.start, self.size, self.pool = [], [], []
        self.learn(range(128))
        self.ascii = np.array([self.pool[self.start[k]] for k in range(128)], np.uint16)

    def kind(self, char: str) -> int:
        """What the pattern takes a character for."""
        cut = self.tok.pre_tokenizer.pre_tokenize_str
        n = len(cut(f"!{char}!"))
        return {1: OTHER, 2: SPACE}.get(n) if n < 3 else LETTER if len(cut(f"a{char}")) == 1 else NUMBER

    def symbols_of(self, char: str) -> list[int]:
        out = []
        for c in self.tok.normalizer.normalize_str(f"!{char}!")[1:-1]:
            kind = self.kind(c)
            own = [32] if kind == SPACE else list(c.encode())
            out += own if own[0] < 128 else [b + 128 * (kind - LETTER) for b in own]
        return out

    def learn(self, chars: object) -> None:
        for c in chars:
            self.place[c] = len(self.start)
            own = self.symbols_of(chr(c))
            self.start.append(len(self.pool))
            self.size.append(len(own))
            self.pool += own
        self.tables = np.array(self.start), np.array(self.size), np.array(self.pool, np.uint16)

    def plain(self, text: bytes) -> np.ndarray:
        if text.isascii():
            return self.ascii[np.frombuffer(text, np.uint8)]
        s = text.decode("utf-8", "replace")
        if not unicodedata.is_normalized("NFC", s):
            s = self.compose.normalize_str(s)
        chars = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        at = self.place[chars]
        if (at < 0).any():
            self.learn(np.unique(chars[at < 0]).tolist())
            at = self.place[chars]
        start, size, pool = self.tables
        n = size[at]
        ends = np.cumsum(n)
        return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)]

    def symbols(self, text: bytes) -> np.ndarray:
        """The symbols of a text, special strings as one each, and a space that ends its last word."""
        spans = [m.span() for m in self.specials.finditer(text)] if self.specials and b"<" in text else []
        parts, at = [], 0
        for a, b in spans:
            parts += [self.plain(text[at:a]), np.array([SPECIAL], np.uint16)]
            at = b
        return np.concatenate([*parts, self.plain(text[at:]), np.array([32], np.uint16)])


class Transducer:
    """The compiled tokenizer: a table of (next state, change of the count), filled as texts need it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or split.get("pattern", {}).get("Regex") != PATTERN or not split.get("invert"):
            raise ValueError(f"{path}: no byte-level BPE with word ends and the pattern that is compiled here")
        self.alphabet, self.merges = Alphabet(Tokenizer.from_file(path)), Merges(model["merges"])
        self.clear()

    def clear(self) -> None:
        """State 0 is the start; a state is (mode, state inside the word, what the count changes by if the word ends here)."""
        self.ids, self.states, self.words = {OUTSIDE: 0}, [OUTSIDE], {}
        self.column, self.used = np.full(SPECIAL + 1, -1, np.int64), 0
        self.table = np.full((1024, 128), -1, np.int32)

    @functools.cached_property
    def kinds(self) -> list[int]:
        return [self.alphabet.kind(chr(c)) for c in range(128)]

    def _parts(self, symbol: int) -> tuple[int, str]:
        if symbol in (SPECIAL, 32):
            return SPACE, ""
        if symbol >= 128:
            return LETTER + (symbol - 128) // 128, chr(128 + symbol % 128)
        return self.kinds[symbol], chr(symbol)

    def _read(self, mode: int, word: tuple, byte: str) -> tuple[tuple, int]:
        """The state after one more byte of a word, taken for not the last one, and the change of the count."""
        inner, n = self.merges.step(word, byte, False)
        return (mode, self.words.setdefault(inner, inner), self.merges.step(word, byte, True)[1] - n), n

    def _begin(self, symbol: int) -> tuple[tuple, int]:
        """The state after the first byte of a word, or after none."""
        kind, byte = self._parts(symbol)
        if kind == SPACE:
            return OUTSIDE, int(symbol == SPECIAL)
        return self._read(APOSTROPHE if byte == "'" else {LETTER: LETTERS, NUMBER: DIGIT, OTHER: MARKS}[kind], Merges.FIRST, byte)

    def transition(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        mode, word, at_end = state
        if mode == IDLE:
            return self._begin(symbol)
        kind, new = self._parts(symbol)
        if mode == HALF:  # an apostrophe and r, v or l (kept in at_end): a contraction only if its second letter comes
            (_, mark, ends), _ = self._read(APOSTROPHE, Merges.FIRST, "'")
            if at_end + new in ("re", "ve", "ll"):
                (_, word, _), a = self._read(WHOLE, mark, at_end)
                after, b = self._read(WHOLE, word, new)
                return after, a + b
            alone, a = self._read(LETTERS, Merges.FIRST, at_end)
            after, b = self.transition(alone, symbol)
            return after, ends + a + b
        if mode == APOSTROPHE and new in ("r", "v", "l"):
            return (HALF, (), new), 0
        if mode == LETTERS and kind == LETTER or mode == MARKS and kind == OTHER or mode == DIGIT and kind == NUMBER and "\x80" <= new < "\xc0":
            return self._read(mode, word, new)
        if mode == APOSTROPHE and (kind == OTHER or new in ("s", "t", "m", "d")):
            return self._read(MARKS if kind == OTHER else WHOLE, word, new)
        after, n = self._begin(symbol)
        return after, n + at_end

    def _fill(self, states: np.ndarray, columns: np.ndarray) -> None:
        for s, c in {*zip(states.tolist(), columns.tolist(), strict=True)}:
            to, change = self.transition(self.states[s], self.symbol_of[c])
            k = self.ids.setdefault(to, len(self.states))
            if k == len(self.states):
                self.states.append(to)
                if k == len(self.table):
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[s, c] = k << _BITS | change + _ZERO

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as columns of the table; those never met before get one."""
        out = self.column[symbols]
        if (out < 0).any():
            for s in np.unique(symbols[out < 0]).tolist():
                self.column[s], self.used = self.used, self.used + 1
            while self.used > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.symbol_of = np.argsort(np.where(self.column < 0, SPECIAL + 1, self.column), kind="stable").tolist()
            out = self.column[symbols]
        return out

    def _look(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.table[states, columns]
        if len(x) and x.min() < 0:
            missing = x < 0
            self._fill(states[missing], columns[missing])
            x = self.table[states, columns]
        return x >> _BITS, (x & (1 << _BITS) - 1) - _ZERO

    def from_start(self, columns: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk, entered in state 0. All chunks run in step, the longest first."""
        order = np.argsort(-size, kind="stable")
        at, left = begin[order], size[order]
        states, count = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -k, "left"))  # chunks longer than k
            states[:m], change = self._look(states[:m], columns[at[:m] + k])
            count[:m] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return states[back], count[back]

    def from_entries(self, columns: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same, entered in other states; a run ends where it meets the one from the start state, whose end is known."""
        exits, count = known[0].copy(), known[1].copy()
        live, own, base = np.arange(len(begin)), entry.astype(np.int32), np.zeros(len(begin), np.int32)
        ahead = np.zeros(len(begin), np.int64)
        k = 0
        while len(live):
            at = columns[begin[live] + k]
            own, a = self._look(own, at)
            base, b = self._look(base, at)
            ahead[live] += a - b
            k += 1
            met, over = own == base, size[live] == k
            exits[live[over]] = own[over]
            stay = ~(met | over)
            live, own, base = live[stay], own[stay], base[stay]
        return exits, count + ahead

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > MOST_STATES:
            self.clear()
        symbols = [self.alphabet.symbols(t) for t in texts]
        lengths = np.array([len(s) for s in symbols])
        columns = self.columns(np.concatenate(symbols))
        # chunks, text by text
        per_text = -(-lengths // CHUNK)
        first = np.cumsum(per_text) - per_text
        nth = np.arange(per_text.sum()) - np.repeat(first, per_text)
        begin = np.repeat(np.cumsum(lengths) - lengths, per_text) + nth * CHUNK
        size = np.minimum(CHUNK, np.repeat(lengths, per_text) - nth * CHUNK)
        ends = np.zeros(len(begin), bool)
        ends[first + per_text - 1] = True

        # the maps, as pairs of chunk and entry state with exit state and count
        known = self.from_start(columns, begin, size)
        chunk, entry, exits, count = np.arange(len(begin)), np.zeros(len(begin), np.int64), *known
        keys = chunk << 32
        new = slice(None)
        while True:
            goes = ~ends[chunk[new]]
            wanted = np.unique((chunk[new][goes] + 1 << 32) | exits[new][goes])
            wanted = wanted[~np.isin(wanted, keys)]
            if not len(wanted):
                break
            c, e = wanted >> 32, wanted & (1 << 32) - 1
            x, n = self.from_entries(columns, begin[c], size[c], e, (known[0][c], known[1][c]))
            new = slice(len(keys), None)
            chunk, entry, exits, count, keys = (np.concatenate(p) for p in ((chunk, c), (entry, e), (exits, x), (count, n), (keys, wanted)))

        # their composition: pointers to the next chunk's pair, doubled
        order = np.argsort(keys)
        stop = len(keys)
        to = np.full(stop + 1, stop)
        goes = ~ends[chunk]
        to[:-1][goes] = order[np.searchsorted(keys[order], (chunk[goes] + 1 << 32) | exits[goes])]
        total = np.append(count, 0)
        for _ in range(int(per_text.max(initial=1)).bit_length()):
            total = total + total[to]
            to = to[to]
        return total[first]


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about GROUP_SYMBOLS bytes; a longer text is alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > GROUP_SYMBOLS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(1).to_pylist()
                n = np.concatenate([transducer(path).counts(g) for g in _groups(texts)])
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", utf8().alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
