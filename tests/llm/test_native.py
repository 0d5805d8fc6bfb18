"""Sharding, mixing and chat formatting against plain Python."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meetflow.llm.chat import collapse_and_render
from meetflow.llm.mixing import mix_documents, mix_sources, quality_weight, word_count
from meetflow.llm.sharding import balanced_shards, shard_documents


def test_shards(docs, empty):
    rows = balanced_shards(docs, 7).collect()
    assert len(rows) == docs.count()
    source = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert source == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    total, by = sum(r["size"] for r in rows), collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for k, part in by.items():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    longest = max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in by.get(k, [])) - total / 7) <= longest + total / 700 for k in range(7))
    assert balanced_shards(empty, 7).count() == 0


def shards_of(d, n):
    rows, by, groups = balanced_shards(d, n).collect(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r)
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    assert len(rows) == d.count() and all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())
    return groups, [sum(r["size"] for r in by.get(k, [])) for k in range(n)]


def test_shards_keep_groups_whole(spark):
    d = spark.createDataFrame([(i, f"text {i // 3} " * 5) for i in range(3000)], "doc_id long, text string").repartition(7)
    groups, sizes = shards_of(d, 5)
    assert all(len(s) == 1 for s in groups.values()) and max(sizes) - min(sizes) <= sum(sizes) / 500
    # groups of all sizes up to a shard, and one that fills half of all shards; ids repeat or lack
    rng = random.Random(4)
    texts = [t for k in range(40) for t in [f"group {k} " * rng.randint(1, 9)] * rng.randint(1, 60)] + ["hot " * 8] * 3000 + [None] * 30
    d = spark.createDataFrame([(i % 50 if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    groups, sizes = shards_of(d, 8)
    parted = [g for g, s in groups.items() if len(s) > 1]
    whole = collections.Counter(t for t in texts if t != "hot " * 8)
    largest = max(n * (len(t or "") + 16) for t, n in whole.items())
    assert parted == [(48, zlib.crc32(b"hot " * 8))] and all(abs(s - sum(sizes) / 8) <= largest / 2 for s in sizes)


def test_shards_of_few_large_texts(spark):
    """Texts of up to most of a shard: no shard is further from the mean than cuts at the nearest borders would leave it."""
    from meetflow.llm.sharding import choose_cuts

    rng = random.Random(9)
    texts = [f"{k} " + "x" * int(rng.paretovariate(0.9) * 40) for k in range(300)]
    texts = [t[:6000] for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups, sizes = shards_of(d, 12)
    mean, largest = sum(sizes) / 12, max(len(t) for t in texts) + 16
    assert largest <= mean and all(len(s) == 1 for s in groups.values())
    assert max(sizes) <= mean + largest / 2 and min(sizes) >= mean - largest / 2
    # all borders known: no other choice of cuts has a smaller sum
    step = [rng.randint(1, 9) for _ in range(9)]
    borders = {sum(step[:k]): k for k in range(10)}
    total = sum(step)
    cuts = [b for b, _ in choose_cuts(borders, {k: sorted(borders) for k in (1, 2)}, total, 3)]
    cost = lambda at: sum(((b - a) * 3 / total - 1) ** 4 for a, b in zip(at, at[1:]))
    assert cost([*cuts, total]) == pytest.approx(min(cost([0, a, b, total]) for a in borders for b in borders if a <= b))


def test_shards_of_one_group_and_of_one_row(spark):
    d = spark.createDataFrame([(i % 3, "same text") for i in range(1000)], "doc_id long, text string").repartition(4)
    assert shards_of(d, 8)[1] == [125 * 25] * 8
    assert sorted(shards_of(d.limit(1), 8)[1]) == [0] * 7 + [25]


def test_shard_documents(spark):
    """All columns come back with a place; rows without an id or with one that repeats have their own."""
    rows = [(None if i % 2 else 7, f"t {i // 2}", i, i) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard int, _row long").repartition(3)
    out = shard_documents(d, 4)
    assert sorted(out.columns) == ["_row", "doc_id", "shard", "slot", "text"]
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["text"], r["_row"]) for r in got) == sorted((i is None, t, n) for i, t, _, n in rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((r["shard"], r["slot"]) for r in balanced_shards(d, 4).collect())
    assert len({(r["shard"], r["slot"]) for r in got}) == 100


def fill(sizes, weights, share, cap):
    """Targets by sharing again and again what is cut off."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + unit * w[s] >= cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] += unit * w[s]
            break
        for s in full:
            target[s] = cap * sizes[s]
        open_ -= full
        left = share * sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_mix(docs, empty):
    how = dict(size=word_count(F.col("text")), quality=quality_weight(F.col("text")))
    rows = mix_sources(docs, **how).collect()
    assert len(rows) == docs.count()
    again = mix_sources(docs.repartition(5), **how).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split(" ")) if False else len([w for w in (r["text"] or "").split() if w])
    want = fill(sizes, (5, 2, 1), 1.5, 2.0)
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mix_sources(empty, **how).count() == 0
    copies = collections.Counter(r["doc_id"] for r in mix_documents(docs, **how).collect())
    times = collections.Counter()
    for r in rows:
        times[r["doc_id"]] += r["times"]
    assert copies == +times
    assert mix_documents(docs, **how).columns == docs.columns


@pytest.mark.parametrize("ids", [list(range(200)), [i if i % 2 else None for i in range(200)], [7 if i % 2 else i for i in range(200)], [None] * 200])
@pytest.mark.parametrize("same", [False, True])
def test_mix_of_tied_ids(spark, ids, same):
    """One word a row, target 150 %: 300 rows whatever ids repeat or lack, also of rows equal in all columns; maps pass."""
    how = dict(size=word_count(F.col("text")), quality=quality_weight(F.col("text")))
    d = spark.createDataFrame([(i, "a" if same else f"w{k}", "s", {"k": 0 if same else k}) for k, i in enumerate(ids)], "doc_id long, text string, source string, m map<string,int>").repartition(3)
    out = mix_documents(d, **how).collect()
    assert len(out) == 300 and set(out[0].asDict()) == set(d.columns)
    counts = collections.Counter((r["doc_id"], r["text"]) for r in out)
    times = collections.Counter()
    for r in mix_sources(d, **how).collect():
        times[r["doc_id"]] += r["times"]
    by_id = collections.Counter()
    for (i, _), n in counts.items():
        by_id[i] += n
    assert by_id == +times and (same or set(counts.values()) <= {1, 2})


def test_quality_prefers_prose(spark):
    d = spark.createDataFrame([("plain words here",), ("### 12345 $$$",), ("",), (None,)], "t string")
    q = [r[0] for r in d.select(quality_weight(F.col("t"))).collect()]
    assert q[0] == 1.0 and q[1] < 0.3 and q[2] == q[3] == 1.0


def test_chat(spark):
    turns = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "x"], 4: ["a", "b", "c"], 5: ["a"], 6: [None, "b"], 7: ["", "b"], 8: ["z"], None: ["q", "r"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, "extra") for c, ts in turns.items() for t, x in enumerate(ts)] + [(9, 0, None, "n", "extra"), (9, 0, None, "n", "extra")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _c string").repartition(3)
    out = {r["conv_id"]: r for r in collapse_and_render(d).collect()}
    assert set(out) == {2, 3, 6, 7, 8, 9, None}
    assert out[2]["text"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert out[9]["n_turns"] == 2 and out[9]["text"].startswith("<|unknown|>")
    assert collapse_and_render(d.where("false")).count() == 0


def test_chat_random(spark):
    import random

    rng = random.Random(1)
    convs = {c: [rng.choice("ab") for _ in range(rng.randint(1, 6))] for c in range(200)}
    rows = [(c, t, "user", x) for c, ts in convs.items() for t, x in enumerate(ts)]
    got = {r["conv_id"] for r in collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    first = {}
    for c, ts in convs.items():
        first.setdefault(tuple(ts), c)
    want = {c for ts, c in first.items() if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in first)}
    assert got == want
