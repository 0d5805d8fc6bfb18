"""Toxicity, language model and secret scans."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meetflow.llm import credentials, decontam, ngram, toxicity
from meetflow.llm.queries import fold
from meetflow.llm.text import Words, ngrams, pieces

from .conftest import DOCS, prose


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_match_the_pattern():
    texts = ["Hello  World", "", None, "é ü\tX\ny\x0b z", " lead trail ", "\x85 "]
    w = Words()
    (_, _, buf, off), = pieces(pa.array(texts))
    w(buf, off)
    got = [[bytes(buf[w.start[k] : w.end[k]]).decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [low(x) for d in got for x in d]
    assert len(set(w.hash.tolist())) == len(set(flat))
    h, at = ngrams(w.hash, w.first, 2)
    assert [(flat[a], flat[a + 1]) for a in at] == [p for d in got for p in zip(map(low, d), list(map(low, d))[1:])]


def test_pieces_split_and_join():
    texts = ["ab cd " * 50, "x", None, "y z" * 40]
    one = [h for _, _, b, o in pieces(pa.array(texts)) for h in Words()(b, o).hash.tolist()]
    many = [h for _, _, b, o in pieces(pa.array(texts), 64) for h in Words()(b, o).hash.tolist()]
    assert one == many


def test_toxicity_learns_words_and_stems(spark, empty):
    rng = random.Random(7)
    bad = ["idiotic", "scumbag", "gruzztor", "gruzzling", "gruzzos"]

    def text(toxic):
        w = prose(rng, rng.randint(20, 150)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), "en", "s", None, "x", 0.0) for i in range(400)] + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (None, "x y", None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    params = toxicity.fit(d, labels, allowed=lambda i: fold(i, 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, params, keep=["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held])
    assert right > 0.9 and got[900] == got[901] < 0.5
    kept = toxicity.reject(d, params)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5} and kept.columns == d.columns
    assert toxicity.score(empty, params, keep=["doc_id"]).count() == 0
    again = toxicity.fit(d, labels, allowed=lambda i: fold(i, 5) != 0)
    assert all(np.array_equal(params[k], again[k]) for k in params)


def test_long_texts(spark):
    """A text of several pieces: words at its very end count, and windows in small chunks give what one chunk gives."""
    rng = random.Random(19)
    body = prose(rng, 250_000)
    assert len(body) > 1_200_000
    p = toxicity.initial(np.random.default_rng(1)) | {"none": np.array([-4.0])}
    column = pa.array([body, "short one", body + " zzz qqq www"])
    whole = toxicity.score_column(column, p, Words())
    old, toxicity.CHUNK = toxicity.CHUNK, 100
    try:
        assert np.allclose(whole, toxicity.score_column(column, p, Words()), atol=1e-6)
    finally:
        toxicity.CHUNK = old
    d = spark.createDataFrame([(1, body + " AKIA" + "Q7" * 10), (2, body), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in credentials.secrets(d).collect()}
    assert got[1]["n_access"] == 1 and got[1]["spans"] == f"access:{len(body) + 1}:{len(body) + 25}" and got[2]["spans"] == got[3]["spans"] == ""
    item = " ".join(body.split()[-40:-5])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {(r["doc_id"], r["matched"]) for r in decontam.contaminated(d, bench).collect()} == {(1, 35), (2, 35)}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    params = toxicity.fit(docs, none, allowed=lambda i: fold(i, 5) != 0)
    assert {r["score"] for r in toxicity.score(docs, params, keep=["doc_id"]).collect()} == {0.5}


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(rng).items()}
    x = rng.normal(size=(9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    x[-1] = 0
    ids = rng.integers(0, 9, (5, toxicity.SPAN))
    w = rng.normal(size=5)
    g = toxicity.gradients(x, ids, p, lambda z: w)
    for name, i in [("Uf", (1, 2)), ("Ub", (3, 20)), ("Wf", (0, 5)), ("bb", (17,)), ("att", (4,)), ("out", (9,))]:
        q = {k: v.copy() for k, v in p.items()}
        q[name][i] += 1e-3
        r = {k: v.copy() for k, v in p.items()}
        r[name][i] -= 1e-3
        slope = (w @ toxicity.logits(x, ids, q) - w @ toxicity.logits(x, ids, r)) / 2e-3
        assert g[name][i] == pytest.approx(slope, rel=0.03, abs=2e-3)


def brute_scores(texts, train):
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for i, t in texts.items()}
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for i in train for p in zip(["<s>", *tok[i]], tok[i]) for p in [((0, p[0]) if p[0] != "<s>" else (1, ""), p[1])])
    follow, cont, total = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
    for (a, b), k in pairs.items():
        follow[a][min(k, 3)] += 1
        cont[b] += 1
        total[a] += k

    def discounts(counts):
        t = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        return ngram.discounts(t)

    d2, d1, m = discounts(pairs.values()), discounts(cont.values()), len(pairs)
    rest = sum(d1[min(x, 3)] for x in cont.values()) / m if m else 1.0

    def p(a, w):
        lower = (max(cont[w] - d1[min(cont[w], 3)], 0) / m if m else 0) + rest / (v + 1)
        if not total[a]:
            return lower
        k, f = pairs[a, w], follow[a]
        return max(k - d2[min(k, 3)], 0) / total[a] + sum(d2[j] * f[j] for j in (1, 2, 3)) / total[a] * lower

    out = {}
    for i, ws in tok.items():
        before = [(1, ""), *((0, w) for w in ws[:-1])]
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), sum(math.log10(p(a, w)) for a, w in zip(before, ws)))
    vocabulary = [p((0, next(iter(tok[train[0]]))), w) for w in c] if train else []
    return out, sum(vocabulary) + (p((0, next(iter(tok[train[0]]))), "\0unseen") if train else 0)


@pytest.mark.parametrize("bucket", [2_500_000, 300])
def test_ngram(spark, docs, bucket):
    rows = [r for r in docs.dropDuplicates(["doc_id"]).collect()]
    texts = {r["doc_id"]: r["text"] for r in rows}
    d = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, score string").repartition(3)
    train = [i for i in texts if i is not None and i % 4]
    want, one = brute_scores(texts, train)
    model = ngram.train(d.where("doc_id % 4 <> 0"), bucket_tokens=bucket)
    got = ngram.score(d, model, keep=["doc_id"]).collect()
    assert one == pytest.approx(1) and len(got) == len(texts)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], model.n) == w[:3]
        assert r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])


def test_ngram_without_training(spark, empty):
    model = ngram.train(empty)
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in ngram.score(d, model, keep=["doc_id"]).orderBy("doc_id").collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert ngram.score(empty, model, keep=["doc_id"]).count() == 0


ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, empty):
    rng = random.Random(11)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "é token=\"short\" ü PassWord : 'longenough1'", "AKIAshort AKIA" + key(16, "ABC234") + "x", "ſecret=abcdefghij toKen==abcdefgh", "\0api-key=abcdefgh api_key: abcdefghi"]
    for _ in range(60):
        texts.append(prose(rng, 10) + f' é token = "{key(40, "0123456789abcdef")}" AKIA{key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")} ' + prose(rng, 30) + " " + "".join(rng.choice(["worthy", "talk", "native", "ness", "ing", "un", "der"]) for _ in range(7)))
    planted = key(24, "0123456789abcdef")
    texts.append("an odd one " + planted + " here")
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None, None, None)], DOCS).repartition(3)
    got = credentials.secrets(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[3 if r["doc_id"] is None else r["doc_id"]]
        base = base_spans(t)
        text = ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, x, _ in base) for k in range(3))
        assert set(text.split(",")) <= set(r["spans"].split(",")) if text else True
        extra = [s for s in r["spans"].split(",") if s.startswith("format")]
        assert bool(extra) == (r["doc_id"] == len(texts) - 1), (t, extra)
    assert credentials.secrets(empty).count() == 0


def test_secrets_glued_and_short(spark):
    """Credentials of a learned format behind a prefix, before a suffix, beside a base span, and of 8 to 15 characters."""
    rng = random.Random(13)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    hexa, tight, plain = "0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzGHJKLMN"
    texts = [prose(rng, 40) + f" token={key(10, tight)} and " + key(32, hexa) + " " + " ".join(key(rng.randint(8, 20), plain) for _ in range(5)) for _ in range(80)]
    long, short = key(24, hexa), key(10, tight)
    planted = [("client_id=", long, ""), ("path/", long, ""), ("", long, ".file"), ("", short, ""), ("auth=", short, ""), ("AKIA" + key(16, "ABC234") + "/", long, "")]
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in enumerate(texts + [f"é see {a}{b}{c} here" for a, b, c in planted])], DOCS).repartition(3)
    got = {r["doc_id"]: r["spans"] for r in credentials.secrets(d).collect()}
    for i, (a, b, _) in enumerate(planted):
        at = len("é see " + a)
        assert f"format:{at}:{at + len(b)}" in got[len(texts) + i].split(","), (planted[i], got[len(texts) + i])
    assert not any("format" in got[i] for i in range(len(texts)))


def test_secret_scores(spark):
    """Every span has its log odds, base spans too; what each learned format finds of planted credentials, and what else."""
    rng = random.Random(23)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = [lambda: key(40, hexa), lambda: "AKIA" + key(16, upper), lambda: "secret=" + key(32, mixed)]
    word = lambda: "".join(rng.choice(["wor", "thy", "tal", "kin", "na", "tive", "ness", "ing", "un", "der", "sol", "ace"]) for _ in range(rng.randint(3, 7)))
    texts = [" ".join(word() for _ in range(60)) + " " + kinds[i % 3]() + " " + prose(rng, 20) for i in range(240)]
    planted = [key(28, hexa) for _ in range(30)] + [key(36, mixed) for _ in range(30)]
    texts += [prose(rng, 30) + " " + x + " " + prose(rng, 30) for x in planted]
    d = spark.createDataFrame([(i, t, "en", "s", None, "x", 0.0) for i, t in enumerate(texts)], DOCS).repartition(3)
    right, wrong, odds = [0, 0], 0, []
    for r in credentials.secrets(d).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert len(spans) == len(r["log_odds"]) and all(math.isfinite(x) for x in r["log_odds"])
        odds += r["log_odds"]
        for k, a, b in spans:
            if k == "format":
                hit = r["doc_id"] >= 240 and texts[r["doc_id"]][int(a) : int(b)] == planted[r["doc_id"] - 240]
                right[r["doc_id"] >= 270] += hit
                wrong += not hit
    assert min(right) >= 24 and wrong <= 5 and np.mean(np.array(odds) > 10) > 0.9, (right, wrong)


def test_secret_background_of_all_candidates(spark, monkeypatch):
    """Background and threshold come from every different candidate, of which there are more than 4,000."""
    rng = random.Random(12)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = ["AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(30)] + [key(rng.randint(16, 24), "ghijklmnopqrstu+") for _ in range(6000)]
    d = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    monkeypatch.setattr(credentials, "BINS", 8)
    monkeypatch.setattr(credentials, "FEW", 20)
    got = credentials.fit(d)
    S, n = len(credentials.CLASSES), np.full((len(credentials.CLASSES) + 1,) * 2, 0.1)
    others = {c for t in texts[30:] for c in [t]}
    for t in others:
        row = [S, *credentials.SYMBOL[list(t.encode())], S]
        np.add.at(n, (row[:-1], row[1:]), 1)
    n /= n.sum(axis=1, keepdims=True)
    assert np.allclose(got["background"]["p"], np.log(n[:, :S])) and np.allclose(got["background"]["stop"], np.log(n[:, S]))
    scores = spark.createDataFrame([(float(x),) for x in [5.0] * 300 + [rng.gauss(0, 9) for _ in range(700)]], "score double")
    values = [r["score"] for r in scores.collect()]
    for q in (0, 0.3, 0.77, 0.9999, 1):
        assert credentials.quantile(scores, q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_automaton_is_a_distribution():
    strings = ["ab", "abab", "ababab", "ab12"] * 20
    m = credentials.learn_automaton(strings)
    total = np.exp(m["p"]).sum(axis=1) + np.exp(m["stop"])
    assert np.allclose(total, 1, atol=0.05)
    one = credentials.likelihood(m, ["abab"])[0]
    assert one > credentials.likelihood(m, ["zzzz"])[0] + 5
    assert credentials.likelihood(m, []).shape == (0,)
    both = credentials.likelihood(m, ["abab", "ab", "abababab"])
    assert both[0] == pytest.approx(one) and both[1] == pytest.approx(credentials.likelihood(m, ["ab"])[0])
