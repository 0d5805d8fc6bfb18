"""Cross-tokenizer alignment and the filter audit against plain Python."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from meetflow.llm import align
from meetflow.llm.audit import audit

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Special tokens as text, blanks in runs, marks of other scripts, long words, what the piece model's own space sign would change.
ODD = ["<|endoftext|> and <s> </s> <unk>", "a  b\n\n\tc     " + " " * 300 + "d", "naïve 東京 🙂🙂 ‍ ✓ é", "x" * 700, "ab" * 900, "under▁score", "0x00 <0x41>", "don't can't I'll", "  nbsp", "- " * 400, "=" * 333, "\x00\x01"]


def tokens(tok, model, text):
    letters = align.byte_of_letter()
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    ab = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    bb = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(model.id_to_piece, b))]
    whole = b" " + text.encode()
    return ((a, ab), (b, bb)) if b"".join(ab) == whole == b"".join(bb) else (([], []), ([], []))


def by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    out, count = [], collections.Counter()
    for i, text in rows:
        (a, ab), (b, bb) = tokens(tok, model, text) if text else (([], []), ([], []))
        ea, eb = list(itertools.accumulate(map(len, ab))), list(itertools.accumulate(map(len, bb)))
        common, links, groups = sorted(set(ea) & set(eb)), [], []
        for lo, hi in zip([0, *common], common):
            groups.append(",".join(str(x) for x, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb) if lo < e <= hi))
        sa, sb = [0, *ea], [0, *eb]
        k0 = 0
        for x in range(len(a)):
            while k0 < len(b) and sb[k0 + 1] <= sa[x]:
                k0 += 1
            k = k0
            while k < len(b) and sb[k] < ea[x]:
                links.append((a[x], b[k]))
                k += 1
        count.update(links)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, na, nb, ng, len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), s) for i, na, nb, ng, k, s in out), key=str)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 50])
def test_alignment(spark, docs, empty, monkeypatch, frequent):
    """All columns equal counting by hand, with nearly all pairs broadcast and with nearly all shuffled."""
    monkeypatch.setattr(align, "FREQUENT", frequent)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, ODD[0])], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(odd)
    got = sorted(map(tuple, align.alignment(d, A, B).collect()), key=str)
    assert got == by_hand([tuple(r) for r in d.collect()])
    assert sum(r[1] == 0 for r in got) == 3 and align.alignment(empty, A, B).count() == 0  # null, empty, the piece model's sign
    assert align.alignment(docs, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, align.alignment(d, A, B).collect()), key=str) == by_hand([tuple(r) for r in d.collect()])


def audit_by_hand(rows, labels):
    text = lambda t: t or ""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[text(t)] = min(first.get(text(t), i), i)
    docs = []
    for i, t, lang in rows:
        t = text(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, removed_by = [], collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            own = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                here = [d for d in own if f in d[1] and not d[1] & set(order[:k])]
                removed_by[part, f] += len(here)
                out.append((part, order, k + 1, sum(not d[1] & set(order[: k + 1]) for d in own), len(here), sum(f in d[1] and bool(d[1] & set(order[:k])) for d in own),
                            sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark, docs, empty):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"], rng.choice(["en", "de", None, ""])) for r in docs.collect()]
    rows += [(2000 + i, rng.choice(["SHOUT " * 120, "a b # c", "w%d " * 3, " ".join(map(str, range(150))), " ".join(map(str, range(150)))[::-1] + " &", None, "", "\x0b\x0c x y"]), rng.choice(["en", "xx"])) for i in range(80)]
    rows += [rows[-1], rows[-1], (None, rows[0][1], "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (-7, 1, 1)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    assert sorted(map(tuple, audit(d, marks).collect())) == audit_by_hand(rows, labels)
    assert audit(empty, marks).count() == 0
    assert audit(d, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
