"""Suffix sorting and the removal of repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from meetflow.llm import suffix


def by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_like(seed):
    """Shared passages of all lengths round the limit, repeats inside a text, runs of one letter, copies, bytes of many kinds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé\0ÿ ") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(40))[:n] for n in (30, 39, 40, 41, 60, 90)]
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            p, at = rng.choice(passages), rng.randint(0, len(t))
            t = t[:at] + p + t[at:]
        texts.append(t)
    texts += ["a" * 39, "a" * 40, "b" * 300, "ab" * 100, "abc" * 90 + "x" * 45, texts[0], texts[0], texts[1] + "!", None, None, "", " " * 41]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("seed,group", [(1, 1 << 14), (2, 4), (3, 1)])
def test_repeats(spark, seed, group):
    """With groups that fit, and with groups split until blocks are whole windows and dealt out in parts."""
    rows = rows_like(seed)
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, _text string, n_bytes int").repartition(5)
    got = suffix.remove_repeats(d, length=40, gram=8, group=max(group, 2))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, 40)


def test_repeats_of_table(spark, sf, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, suffix.remove_repeats(d).collect()), key=str)
    assert got == by_hand([tuple(r) for r in d.collect()], 200) and any(r[2] for r in got)
    assert suffix.remove_repeats(empty).count() == 0


def test_two_stage_sort():
    """All suffixes of random texts of few letters, in the order of their first bytes, and their common prefixes."""
    rng = random.Random(9)
    for _ in range(200):
        texts = [bytes(rng.choice(b"aab\0") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        raw = b"\0".join(texts) + b"\0"
        t = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        t[ends] = 0
        wanted = np.flatnonzero(t > 0)
        if rng.random() < 0.5:
            wanted = wanted[[rng.random() < 0.4 for _ in wanted]]
        stop = [int(ends[np.searchsorted(ends, i)]) for i in range(len(t))]
        order = suffix.two_stage_sort(t, raw, wanted, 20)
        keys = [raw[i : min(i + 20, stop[i])] for i in order]
        assert sorted(order) == sorted(wanted) and keys == sorted(keys)
        inside = [i for i in order if stop[i] - i >= 20]
        common = suffix.common_prefixes(np.frombuffer(raw, np.uint8), np.array(inside, np.int64), 20)
        for a, b, n in zip(inside, inside[1:], common):
            want = next((k for k in range(20) if raw[a + k] != raw[b + k]), 20)
            assert n == want


def test_anchors_meet():
    """Equal windows have the same anchor at the same distance, whatever surrounds them."""
    rng = random.Random(2)
    find = suffix.Anchors(40, 8)
    for _ in range(50):
        p = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) + p + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(3)]
        off = np.cumsum([0, *map(len, texts)])
        a = find(np.frombuffer(b"".join(texts), np.uint8), off)
        seen, windows = collections.defaultdict(set), 0
        for d, first, last, at, h in zip(a.doc, a.first, a.last, a.at, a.hash):
            for w in range(first, last + 1):
                assert w <= at <= w + 32 and off[d] <= w and w + 40 <= off[d + 1]
                seen[b"".join(texts)[w : w + 40]].add((at - w, h))
                windows += 1
        assert windows == sum(len(t) - 39 for t in texts) and all(len(s) == 1 for s in seen.values())
