"""Importance resampling, conversation repair and token counts against brute force and the library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyworks.llm import conversation_repair, importance_resampling, queries, token_counts

from .test_contracts import table

TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")


# resampling


def features(text, grams=1):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def resampled_by_force(docs, target, buckets, grams, min_words, percent):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x, grams)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, own = features(text, grams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in (zlib.crc32(f) % buckets for f in own))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = percent * len(able) // 100
    out = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if r[4] < min_words]
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets, grams, min_words, percent", [(10_000, 1, 20, 10), (7, 2, 3, 50), (65_536, 3, 0, 100)])
def test_resampling_by_force(spark, buckets, grams, min_words, percent):
    rng = random.Random(buckets)
    words = ["Ash", "ash", "birch", "Örtchen", "x1", "2", "elm-oak", "中文", "the", "a'b", "\x00", "#"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs += [(3, docs[3][1]), (3, "ash " * 30), (None, "elm " * 25), (100, None), (101, ""), (102, "word " * 40_000)]
    target = ["ash birch elm", None, "", "中文 x1 " * 9]
    frame = table(spark, docs).withColumnsRenamed({"node": "stream", "band": "part", "n_chars": "rank", "lang": "nth", "source": "weight"})
    aims = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = importance_resampling.resample(frame, aims, buckets, grams, min_words, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_force(docs, target, buckets, grams, min_words, percent)


def test_resampling_of_empty_tables(spark):
    none, some = table(spark, []), table(spark, [(1, "a b " * 20), (2, "c")])
    assert importance_resampling.resample(none, some).collect() == []
    assert sorted(map(tuple, importance_resampling.resample(some, none).collect())) == resampled_by_force([(1, "a b " * 20), (2, "c")], [], 10_000, 1, 20, 10)


@pytest.mark.parametrize("n", [0, 1, 5, 4000])
def test_run_lengths(n):
    stream = np.random.default_rng(n).integers(0, 50, n).astype("<u2")
    values, lengths = importance_resampling.run_lengths(stream)
    assert dict(zip(values.tolist(), lengths.tolist(), strict=True)) == Counter(stream.tolist())


# conversations

GRAMMAR = re.compile("(s?(ua)+)?")
CONVERSATIONS = "conv_id long, turn long, role string, text string, copies string, fault string"


def cheapest_by_force(rows):
    """Every sequence of edits that costs no more than deleting all, tried against the grammar."""
    best = None
    stack = [(0, "", "", 0, ())]
    while stack:
        cost, audit, roles, i, out = stack.pop()
        if cost > 4 * len(rows):
            continue
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        stack += [(cost + 3, audit + "I", roles + r[0], i, (*out, f"{r}:")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            stack.append((cost + 4, audit + "D", roles, i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                stack.append((cost + more, audit + "K", roles + (role[:1] or "-"), i + 1, (*out, f"{role}:{text}")))
                stack += [(cost + more + 3, audit + "R", roles + r[0], i + 1, (*out, f"{r}:{text}")) for r in ("user", "assistant")]
    return best


def damaged_by_force(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired_by_force(rows):
    found = {}
    for conv, own in damaged_by_force(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = Counter(f for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, out = cheapest_by_force(marked)
        found[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut off", " \n", "", None, "Ends! \n", "twice.", "é."]
    rows = []
    for conv in range(n):
        for _ in range(rng.randrange(1, 5)):
            rows.append((conv, rng.choice([None, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]), rng.choice(texts)))
    return [*rows, (None, 1, "user", "A."), (None, None, "assistant", "B.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], CONVERSATIONS)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("segment", [256, 2])
def test_repair_by_force(spark, seed, segment, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = conversations(seed)
    got = conversation_repair.digests(conversation_repair.damage(frame(spark, rows))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == repaired_by_force(rows)
    assert len(got) == len({r[0] for r in rows})


def test_long_conversation_in_segments(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(200)}.") for k in range(1500)]
    monkeypatch.setattr(conversation_repair, "SEGMENT", 10_000)
    whole = conversation_repair.digests(frame(spark, rows).drop("copies")).collect()
    monkeypatch.setattr(conversation_repair, "SEGMENT", 17)
    assert conversation_repair.digests(frame(spark, rows).drop("copies")).collect() == whole
    assert len(whole[0].audit) >= 1500


def test_repaired_rows(spark):
    rows = conversations(3)
    damaged = conversation_repair.damage(frame(spark, rows))
    want = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(damaged).collect()}
    out = {c: [] for c in want}
    for r in sorted(conversation_repair.repair(damaged).collect(), key=lambda r: r.place):
        assert r.place == len(out[r.conv_id])
        out[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in out.items()} == want


def test_conversations_of_nothing(spark):
    assert conversation_repair.digests(conversation_repair.damage(frame(spark, []))).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = conversation_repair.digests(conversation_repair.damage(frame(spark, [(5, dropped, "user", "A.")]))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# token counts


@pytest.fixture(scope="module")
def compiled():
    return token_counts.Transducer(TOKENIZER)


def by_library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def counted(compiled, texts):
    return [n for g in token_counts._groups([t.encode() for t in texts]) for n in compiled.counts(g).tolist()]


PARTS = """' ' s t r e v l m d a n i o h g 1 2 ½ ٣ é İ ß Σ ς 中 文 ह ि न 😀 👍🏽 ! ? ... - _ <|endoftext|> <|startoftext|> <|ENDOFTEXT|> < # ﬁ 각 ᄀ ᅡ A Z the ing tion""".split()
PARTS += [" ", "  ", "\n", " ", "　", "\x00", "\x85", "​", "é", "̸", "�"]


@pytest.mark.parametrize("chunk", [256, 5, 1])
def test_counts_as_the_library(compiled, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for letters in ("aab", "etaoinsr", "!?.", "0123456789abcdef") for _ in range(60)]
    texts += [c * k for c in ("a", "ha", "!", "é") for k in range(0, 120, 7)]
    assert counted(compiled, texts) == by_library(texts)


def test_counts_of_long_texts(compiled):
    rng = random.Random(3)
    texts = ["x" * 300_000, " ".join(rng.choice(PARTS) * 3 for _ in range(200_000)), "".join(rng.choice("abcde") for _ in range(40_000)), ""]
    assert len(texts[1].encode()) > 2 * token_counts.GROUP_SYMBOLS
    assert counted(compiled, texts) == by_library(texts)


def test_table_starts_anew_when_full(compiled, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "GROUP_SYMBOLS", 200)
    texts = [f"{w} {k} again" for k, w in enumerate(["river", "stone", "wave", "Örtchen"] * 20)]
    assert counted(compiled, texts) == by_library(texts)


def test_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, " \n"), (None, "one two"), (3, "one two"), (3, "one two"), (4, "word " * 3000)]
    docs = table(spark, rows).withColumnsRenamed({"node": "n_tokens", "band": "n_bytes", "lang": "over_limit"})
    got = token_counts.count_tokens(docs, TOKENIZER).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 2, 0, False), (None, 7, 2, False), (3, 7, 2, False), (3, 7, 2, False), (4, 15000, 3000, True)], key=str)
    assert token_counts.count_tokens(table(spark, []), TOKENIZER).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="no byte-level BPE"):
        token_counts.Transducer(queries.tokenizer_path("byte_bpe_50k.json"))
