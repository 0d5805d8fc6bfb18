"""Near-duplicate operators, decontamination and span dedup against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from meetflow.llm import decontam, embed, minhash
from meetflow.llm.decontam import contaminated, decontaminate
from meetflow.llm.graph import components
from meetflow.llm.minhash import keep_one, near_duplicates
from meetflow.llm.spans import cut_spans, repeated_spans
from meetflow.llm.text import pieces

from .conftest import DOCS, WORDS, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(want[v])
    assert all(len(s) == 1 for s in groups.values()) and len(groups) == len({want[v] for v in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    rows = docs.collect()
    sets = {r["doc_id"]: shingles(r["text"], n) for r in rows if r["doc_id"] is not None}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(ids, pairs)
    got = near_duplicates(docs, shingle=n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == want[0] and not r["kept"]  # a copy of document 0
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    kept = keep_one(docs, shingle=n)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == docs.columns


def test_near_duplicates_in_parts(docs, monkeypatch):
    """The same when buckets and clusters are cut into small blocks."""
    whole = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=2).collect()}
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 2)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 2)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=2).collect()} == whole


def test_large_cluster_against_brute_force(spark, monkeypatch):
    """A chain of near texts (few near the hub) and a group of near copies, in blocks of three."""
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 3)
    rng = random.Random(41)
    texts, w = [], prose(rng, 60).split()
    for _ in range(24):
        texts.append(" ".join(w))
        w = w[:]
        for k in rng.sample(range(60), 2):
            w[k] = rng.choice(WORDS)
    base = prose(rng, 80).split()
    texts += [" ".join(base[:k] + [rng.choice(WORDS)] + base[k + 1 :]) for k in range(0, 80, 3)]
    texts += [prose(rng, 40) for _ in range(10)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles(t, 2) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(range(len(sets)), pairs)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(d, shingle=2).collect()} == want
    assert max(list(want.values()).count(x) for x in set(want.values())) > 10


def test_keep_one_by_row(spark):
    """Null and repeated ids: a row is judged by its own text, and one row of each group stays."""
    rng = random.Random(21)
    t = [prose(rng, 60) for _ in range(8)]
    rows = [(1, t[0]), (None, t[0]), (None, t[1]), (None, t[2])]  # a copy without an id, and unrelated rows without one
    rows += [(2, t[0]), (2, t[3])]  # an id with a copy and a text of its own
    rows += [(3, t[4]), (3, t[4]), (None, t[5]), (None, t[5] + " end"), (5, t[6]), (4, t[6] + " end")]  # copies that share an id or lack one
    rows += [(None, None), (None, ""), (6, None), (6, None)]
    d = spark.createDataFrame([(i, x, "en", "s", k, "clash", 0.0) for k, (i, x) in enumerate(rows)], DOCS).repartition(3)
    kept = keep_one(d)
    assert kept.columns == d.columns
    got = sorted(r["n_chars"] for r in kept.collect())
    assert [k for k in got if k not in (6, 7, 8, 9)] == [0, 2, 3, 5, 11, 12, 13, 14, 15]
    assert len({6, 7} & set(got)) == 1 and len({8, 9} & set(got)) == 1


@pytest.mark.parametrize("n", range(1, 14))
def test_short_items_with_substitutions(n):
    """Whole items of up to 13 tokens: every allowed choice of changed tokens is found, one more is not."""
    item, fill = [f"w{i}" for i in range(n)], ["x", "y", "z"] * 3
    index = decontam.Index(["i"], [" ".join(item)])
    allowed = max(k for k in range(n + 1) if 5 * (n - k) >= 4 * n)
    for k in range(allowed + 2):
        texts = [" ".join(fill + ["other" if i in gone else w for i, w in enumerate(item)] + fill) for gone in combinations(range(n), min(k, n))]
        for _, _, buf, off in pieces(pa.array(texts)):
            found = {x[0] for x in index.search(decontam.alnum_words()(buf, off))}
            assert found == (set(range(len(texts))) if k <= allowed else set())


def test_spans_tail_sentence(spark):
    """A shared passage of a 30-word and a 20-word sentence goes whole, though what follows it differs."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    passage = say(30) + " " + say(20)
    texts = [f"{say(40)} {passage} {say(40)}" for _ in range(3)]
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in repeated_spans(d).collect()}
    at = {i: texts[i].index(passage) for i in (1, 2)}
    assert {i: (x[0][0], x[-1][1]) for i, x in got.items()} == {i: (a, a + len(passage)) for i, a in at.items()}


def test_spans_of_short_sentences(spark):
    """Two equal sentences of 11 words in two documents; one of them alone, or fewer words, is no run."""
    both = "It rained over the hills. Nobody saw the riders leave town."
    texts = [f"One more thing here. {both} Then it stopped.", f"Something else began. {both} It went on.", "It rained over the hills. But not today at all.", "Yes. No. Perhaps.", "Yes. No. Never."]
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in repeated_spans(d).collect()}
    a = texts[1].index(both)
    assert got == {1: [(a, a + len(both))]}


def test_spans_random(spark):
    """Short texts over few sentences against every run."""
    rng = random.Random(31)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 26]))) + rng.choice([".", "!", "\n"]) for _ in range(12)]
    texts = {i: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for i in range(60)}
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in texts.items()], DOCS).repartition(4)
    ink = lambda i, places: {k for k in places if not texts[i][k].isspace()}
    got = {r["doc_id"]: ink(r["doc_id"], (x for s, e in zip(r["starts"], r["ends"]) for x in range(s, e))) for r in repeated_spans(d).collect()}
    assert got == {i: ink(i, x) for i, x in brute_spans(texts).items()}


def test_decontamination_of_a_common_line(monkeypatch):
    """A line that all items and documents share, looked at a few seeds at a time, finds what one look finds."""
    rng = random.Random(17)
    line = prose(rng, 20)
    index = decontam.Index(list(range(30)), [f"{prose(rng, 10)} {line} {prose(rng, 10)}" for _ in range(30)])
    texts = [f"{prose(rng, 30)} {line} {prose(rng, 9)}" for _ in range(5)] + [prose(rng, 50)]
    (_, _, buf, off), = pieces(pa.array(texts))
    w = decontam.alnum_words()(buf, off)
    whole = sorted(index.search(w))
    assert {x[0] for x in whole} == index.hit_documents(w) == set(range(5)) and len({x[:2] for x in whole}) == 150
    monkeypatch.setattr(decontam, "HITS", 7)
    assert sorted(index.search(w)) == whole and index.hit_documents(w) == set(range(5))


def test_ids_of_one_name(spark):
    rng = random.Random(3)
    item = prose(rng, 30)
    d = spark.createDataFrame([(1, item)], "id long, text string")
    assert contaminated(d, d, id_col="id", item_id="id").columns[:2] == ["id", "benchmark_id"]


def test_near_duplicates_empty(empty):
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 16))
    x[50:90] = x[rng.integers(0, 12, 40)] + rng.normal(scale=0.12, size=(40, 16))
    x[90:100] = x[3]
    rows = [(i * 2, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [0.0] * 15, 1), (905, [], 1)]
    rows += [(906, [1e30] * 16, 1), (907, [2e-30] * 16, 1), (910, [1.0, 2.0], 1), (911, [2.0, 4.1], 1), rows[5], (None, rows[6][1], 1)]
    return rows


@pytest.mark.parametrize("part", [8192, 20])
def test_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(embed, "PART_ROWS", part)
    rows = vectors()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    usable = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.abs(v).max() if usable(v) else None for _, v, _ in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
    n = [sum(near(u, v) for j, v in enumerate(unit) if j != i) for i, u in enumerate(unit)]
    ids = [r[0] for r in rows]
    comp = union_find(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(unit[i], unit[j])])
    least = {}
    for i, c in comp.items():
        if ids[i] is not None:
            least[c] = min(least.get(c, 10**9), ids[i])
    want = sorted((ids[i] is None, ids[i] or 0, n[i], least.get(comp[i], ids[i])) for i in range(len(rows)))
    got = embed.near_vectors(d, least=0.9).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_vectors_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed.near_vectors(d).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    items = [prose(rng, 30) for _ in range(5)] + [None, "", "tiny item", "..."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    host = lambda x: prose(rng, 60) + "\n" + x + " " + prose(rng, 50)
    w = items[1].split()
    for k in (5, 14, 22):
        w[k] = "substituted"
    half = " ".join(items[2].split()[:15])
    few = " ".join(items[3].split()[:9])
    texts = {1: host(items[0].upper()), 2: host(" ".join(w)), 3: host(half), 4: host(few), 5: prose(rng, 300), 6: None, 7: "", 8: host(items[0].replace(" ", ", ")), 9: "a tiny item, indeed"}
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in texts.items()] + [(1, texts[1], "en", "s", None, "x", 0.0)], DOCS).repartition(2)
    for block in (4_000_000, 20):  # one pass, and several
        got = {(r["doc_id"], r["item_id"]): r for r in contaminated(d, bench, block_tokens=block).collect()}
        assert set(got) == {(1, 0), (2, 1), (3, 2), (8, 0), (9, 7)}
        assert got[1, 0]["matched"] == 30 and got[2, 1]["matched"] == 27
        r = got[3, 2]
        assert texts[3][r["start"] : r["end"]].lower().startswith(half[:20])
        kept = decontaminate(d, bench, block_tokens=block)
        assert sorted(x["doc_id"] for x in kept.collect()) == [4, 5, 6, 7] and kept.columns == d.columns
    assert contaminated(empty, bench).count() == 0 and contaminated(d, bench.where("false")).count() == 0
    assert decontaminate(d, bench.where("false")).count() == d.count()


def brute_spans(texts, sentences=2, least=8, long=25):
    """Every run of ``sentences`` or more with ``least`` words or more, and every long sentence; all but the first of equal ones are cut."""
    runs = {}
    for i in sorted(texts):
        spans = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i] or ""):
            spans.append((m.start(), m.end(), texts[i][m.start() : m.end()].lower()))
        begins = [k for k in range(len(spans)) if k == 0 or spans[k - 1][2][-1] in ".!?" or "\n" in texts[i][spans[k - 1][1] : spans[k][0]]] + [len(spans)]
        for x in range(len(begins) - 1):
            for y in range(x + 1, len(begins)):
                a, e = begins[x], begins[y]
                if (y - x >= sentences and e - a >= least) or (y - x == 1 and e - a >= long):
                    runs.setdefault(tuple(s[2] for s in spans[a:e]), []).append((i, spans[a][0], spans[e - 1][1]))
    cut = {}
    for places in runs.values():
        for i, s, e in places[1:]:
            cut.setdefault(i, set()).update(range(s, e))
    return cut


def test_spans(spark, docs, empty):
    rng = random.Random(4)
    passage = ". ".join(prose(rng, 18).rstrip(".") for _ in range(4)) + "."
    texts = {i: prose(rng, 60).rstrip(".") + ". " + (passage + " " if i % 3 == 0 else "") + prose(rng, 40) for i in range(12)}
    texts |= {20: passage + "\n" + passage, 21: None, 22: "", 23: "é ü. " * 40, 24: "short line."}
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in [*texts.items(), (None, passage + "\n" + passage)]], DOCS).repartition(3)
    want = brute_spans(texts)
    spans = repeated_spans(d)
    got = {r["doc_id"]: set(x for s, e in zip(r["starts"], r["ends"]) for x in range(s, e)) for r in spans.collect()}
    assert {i: {k for k in x if not texts[i][k].isspace()} for i, x in got.items()} == {i: {k for k in x if not texts[i][k].isspace()} for i, x in want.items()}
    assert {3, 6, 9, 20, 23} <= set(got) and not {0, 1, 2, 21, 22, 24} & set(got)
    clean = {r["doc_id"]: r["text"] for r in cut_spans(d, spans).collect()}
    assert clean.pop(None) == passage + "\n" + passage
    for i, t in texts.items():
        assert clean[i] == (t and "".join(c for k, c in enumerate(t) if k not in got.get(i, ())))
    assert repeated_spans(empty).count() == 0
    assert WORDS
