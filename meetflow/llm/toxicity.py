"""Toxicity by a bidirectional GRU with attention pooling, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U64, Words, pieces

#: Words a window, words between the starts of two windows.
SPAN, STRIDE = 32, 16
#: Windows scored at once, whatever the length of the text.
CHUNK = 8192
WORD_BITS, CHAR_BITS, WORD_DIM, CHAR_DIM, HIDDEN = 15, 15, 6, 6, 8
GATES = 3 * HIDDEN


def char_grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 4-byte gram of each word (with a blank before it), and where each word's grams begin."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(start - 1 - at[:-1], size) + np.arange(at[-1])
    text = lower[buf[np.maximum(flat, 0)]].astype(np.uint32)
    text[at[:-1]] = 32
    count = np.maximum(size - 3, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    pos = np.repeat(at[:-1] - begin[:-1], count) + np.arange(begin[-1])
    gram = text[pos] | text[pos + 1] << np.uint32(8) | text[pos + 2] << np.uint32(16) | text[pos + 3] << np.uint32(24)
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS), begin


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window and its document; windows overlap and cover every word."""
    n = np.diff(first)
    per = np.where(n > 0, np.maximum(1, -(-(n - (SPAN - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), per)
    begin = np.concatenate([[0], np.cumsum(per)])[:-1]
    return first[doc] + (np.arange(len(doc)) - begin[doc]) * STRIDE, doc


class Piece:
    """The distinct words of a piece and its windows over them; pad is the word after the last."""

    def __init__(self, words: Words, buf: np.ndarray, off: np.ndarray) -> None:
        w = words(buf, off)
        distinct, index, code = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (distinct & U64((1 << WORD_BITS) - 1)).astype(np.int64)
        self.gram, self.begin = char_grams(buf, w.start[index], w.end[index], w.lower)
        self.start, self.doc = window_starts(w.first)
        self.code = np.append(code, np.full(SPAN, len(distinct))).astype(np.int32)
        self.stop, self.docs = w.first[self.doc + 1], len(off) - 1

    def windows(self, pick) -> np.ndarray:
        """The words of some windows; pad after a document's end."""
        place = self.start[pick][:, None] + np.arange(SPAN)
        ids = self.code[np.minimum(place, len(self.code) - 1)]
        ids[place >= self.stop[pick][:, None]] = len(self.word)
        return ids

    def logits(self, p: dict) -> np.ndarray:
        """Of every window, some thousand at a time."""
        x = self.inputs(p)
        parts = [logits(x, self.windows(slice(k, k + CHUNK)), p) for k in range(0, len(self.doc), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def inputs(self, p: dict) -> np.ndarray:
        """Word vector beside the sum of its grams' vectors over the root of their number."""
        x = np.zeros((len(self.word) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = p["word"][self.word]
        full = np.flatnonzero(np.diff(self.begin))
        if len(full):
            sums = np.add.reduceat(p["char"][self.gram], self.begin[full], axis=0)
            x[full, WORD_DIM:] = sums / np.sqrt(np.diff(self.begin)[full])[:, None]
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gates(x: np.ndarray, p: dict, way: str) -> np.ndarray:
    g = x @ p["W" + way] + p["b" + way]
    g[-1] = 0
    g[-1, HIDDEN : 2 * HIDDEN] = 25  # padding keeps the state
    return g


def run_gru(g: np.ndarray, ids: np.ndarray, U: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """States (SPAN, windows, HIDDEN); keep gets what the gradient needs."""
    h = np.zeros((len(ids), HIDDEN), np.float32)
    out = np.empty((SPAN, len(ids), HIDDEN), np.float32)
    for t in order:
        x = g[ids[:, t]]
        hu = h @ U
        s = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = s[:, :HIDDEN], s[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if keep is not None:
            keep.append((t, h, r, z, c, hu[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def logits(x: np.ndarray, ids: np.ndarray, p: dict, tape: dict | None = None) -> np.ndarray:
    kf, kb = (None, None) if tape is None else ([], [])
    hs = np.concatenate([run_gru(gates(x, p, "f"), ids, p["Uf"], range(SPAN), kf),
                         run_gru(gates(x, p, "b"), ids, p["Ub"], range(SPAN - 1, -1, -1), kb)], axis=2)
    e = hs @ p["att"]
    e[(ids == len(x) - 1).T] = -1e9
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, hs)
    if tape is not None:
        tape.update(hs=hs, a=a, pooled=pooled, kf=kf, kb=kb)
    return pooled @ p["out"] + p["bias"][0]


def gradients(x: np.ndarray, ids: np.ndarray, p: dict, dl: np.ndarray) -> dict:
    """Of the sum of dl * logits, by every dense parameter and (as "x") by the inputs; includes the forward pass."""
    tape: dict = {}
    logit = logits(x, ids, p, tape)
    d = dl(logit)
    g = {"bias": np.array([d.sum()]), "out": tape["pooled"].T @ d}
    dpool = d[:, None] * p["out"]
    dhs = tape["a"][:, :, None] * dpool
    da = np.einsum("tbh,bh->tb", tape["hs"], dpool)
    de = tape["a"] * (da - (tape["a"] * da).sum(axis=0))
    g["att"] = np.einsum("tb,tbh->h", de, tape["hs"])
    dhs = dhs + de[:, :, None] * p["att"]
    g["x"] = np.zeros_like(x)
    for way, part, keep in (("f", slice(0, HIDDEN), tape["kf"]), ("b", slice(HIDDEN, None), tape["kb"])):
        dg, dU, dh = np.zeros((len(x), GATES), np.float32), np.zeros_like(p["U" + way]), np.zeros((len(ids), HIDDEN), np.float32)
        for t, h, r, z, c, hn in reversed(keep):
            dh = dh + dhs[t][:, part]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hn * r * (1 - r)
            dhu = np.concatenate([dr, dz, dc * r], axis=1)
            dU += h.T @ dhu
            np.add.at(dg, ids[:, t], np.concatenate([dr, dz, dc], axis=1))
            dh = dh * z + dhu @ p["U" + way].T
        dg[-1] = 0
        g["U" + way], g["W" + way], g["b" + way] = dU, x.T @ dg, dg.sum(axis=0)
        g["x"] += dg @ p["W" + way].T
    return g


def initial(rng: np.random.Generator) -> dict:
    n = WORD_DIM + CHAR_DIM
    p = {"word": rng.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)), "char": rng.normal(0, 0.05, (1 << CHAR_BITS, CHAR_DIM)),
         "att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
    for way in "fb":
        p |= {"W" + way: rng.normal(0, 0.3, (n, GATES)), "U" + way: rng.normal(0, 0.2, (HIDDEN, GATES)), "b" + way: np.zeros(GATES)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def train(texts: list[str | None] | pa.ChunkedArray, labels, *, rounds: int = 14, seed: int = 5) -> dict:
    """Parameters fitted to labelled texts.

    A text counts as toxic by its most toxic window: in each round all windows
    are scored and the highest window of every text is learned from, both classes
    with the same total weight.  The first coordinate of the word and gram tables
    starts at the smoothed log-odds of the bucket among the labelled texts.
    With one class only, or no texts, the parameters say that class (or 0.5).
    """
    rng = np.random.default_rng(seed)
    p, y = initial(rng), np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        p["out"][:] = 0
        p["bias"][:] = p["none"] = 0 if not len(y) else 4 * (2 * y[0] - 1)
        return {k: np.atleast_1d(v) for k, v in p.items()}
    words, parts, at = Words(), [], 0
    texts = texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string())
    for lo, hi, buf, off in pieces(texts, 1 << 19):
        parts.append((Piece(words, buf, off), lo))
    for table, bits, field in (("word", WORD_BITS, "word"), ("char", CHAR_BITS, "gram")):
        total = np.array([np.sum(y == 0), np.sum(y == 1)]) + 1.0
        seen = np.repeat(6 * total[:, None] / total.sum(), 1 << bits, axis=1)  # an unseen bucket says nothing
        for part, lo in parts:
            ids = part.windows(slice(None))
            real = ids < len(part.word)
            doc, code = np.broadcast_to(part.doc[:, None], ids.shape)[real], ids[real]
            if field == "gram":
                pair = np.unique(doc.astype(np.int64) * len(part.word) + code)
                doc, code = pair // len(part.word), pair % len(part.word)
                n = np.diff(part.begin)[code]
                doc = np.repeat(doc, n)
                inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                bucket = part.gram[np.repeat(part.begin[:-1][code], n) + inner].astype(np.int64)
            else:
                bucket = part.word[code]
            pair = np.unique(doc.astype(np.int64) << bits | bucket)
            np.add.at(seen, (y[lo + (pair >> bits)].astype(int), pair & ((1 << bits) - 1)), 1)
        p[table][:, 0] = np.clip(np.log(seen[1] / total[1]) - np.log(seen[0] / total[0]), -3, 3).astype(np.float32)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * 256
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    batch = min(256, max(32, sum(len(np.unique(part.doc)) for part, _ in parts) // 16))
    for r in range(rounds):
        rate = 0.02 if r < rounds - 4 else 0.005
        for k in rng.permutation(len(parts)):
            part, lo = parts[k]
            if not len(part.doc):
                continue
            x = part.inputs(p)
            s = part.logits(p)
            order = np.lexsort((s, part.doc))
            top = order[np.append(np.flatnonzero(np.diff(part.doc[order])), len(order) - 1)]
            for pick in np.array_split(rng.permutation(top), max(1, len(top) // batch)):
                step += 1
                t, w = y[lo + part.doc[pick]], weight[lo + part.doc[pick]]
                ids = np.where(rng.random((len(pick), SPAN)) < 0.1, len(part.word), part.windows(pick))  # words left out at random
                used, local = np.unique(np.append(ids.ravel(), len(part.word)), return_inverse=True)
                g = gradients(x[used], local[:-1].reshape(ids.shape), p, lambda z: ((sigmoid(z) - t) * w).astype(np.float32))
                dx = g.pop("x")[:-1]
                used = used[:-1]
                n = np.diff(part.begin)[used]
                gram = part.gram[np.repeat(part.begin[:-1][used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                dchar = np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
                for name, rows, d in (("word", part.word[used], dx[:, :WORD_DIM]), ("char", gram, dchar)):
                    rows, inv = np.unique(rows, return_inverse=True)
                    sums = np.zeros((len(rows), d.shape[1]), np.float32)
                    np.add.at(sums, inv, d)
                    m[name][1][rows] += sums * sums
                    p[name][rows] -= 0.005 * sums / (np.sqrt(m[name][1][rows]) + 1e-3)
                for name, d in g.items():
                    a, b = m[name]
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    p[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                x = part.inputs(p) if step % 8 == 0 else x
    return p | {"none": np.array([-4.0])}  # a text without words holds nothing toxic


def score_column(column, p: dict, words: Words) -> np.ndarray:
    best = []
    for _, _, buf, off in pieces(column):
        part = Piece(words, buf, off)
        top = np.full(part.docs, -np.inf)
        if len(part.doc):
            np.maximum.at(top, part.doc, part.logits(p).astype(float))
        best.append(np.where(np.isfinite(top), top, p["none"][0]))
    return sigmoid(np.concatenate(best)) if best else np.zeros(0)


def score_batches(batches, p: dict, text: str, keep: list[str]):
    words = Words()
    for batch in batches:
        score = score_column(batch.column(text), p, words)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(score, pa.float64())], [*keep, "score"])


def reject_batches(batches, p: dict, text: str, limit: float):
    words = Words()
    for batch in batches:
        yield batch.filter(pa.array(score_column(batch.column(text), p, words) < limit))


def fit(docs: DataFrame, labels: DataFrame, *, allowed: Column, most: tuple[int, int] = (5000, 2500), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", seed: int = 5) -> dict:
    """Trains on at most ``most`` clean and toxic labelled documents (those with the smallest hashes of their ids).

    ``allowed`` says which ids may be learned from.  This bounded sample is all
    that reaches the driver.  An id labelled more than
    once is toxic if any of its labels is; null ids and labels teach nothing.
    """
    lab = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y"))
    lab = lab.where(allowed(F.col("_i")))
    order = F.xxhash64("_i")
    picked = [lab.where(F.col("_y") == y).orderBy(order, "_i").limit(most[y]) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    text = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_x"))
    rows = text.join(F.broadcast(picked), "_i").groupBy("_i").agg(F.min("_x").alias("_x"), F.max("_y").alias("_y")).orderBy("_i").select("_x", "_y").toArrow()
    return train(rows.column("_x"), rows.column("_y").to_numpy(), seed=seed)


def score(docs: DataFrame, params: dict, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds ``score``: the toxicity of a text's most toxic window, 0 to 1.

    All windows of 32 words, each 16 words after the last, are scored over the
    whole text.  Empty and null texts score 0.018 (0.5 if nothing was learned).  Only
    ``keep`` and the text are read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(params)  # about 2 MB, whatever the input
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep) + ", score double"
    return src.mapInArrow(lambda batches: score_batches(batches, held.value, "_text", keep), schema)


def reject(docs: DataFrame, params: dict, *, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``limit``, all columns as they were.

    Null and empty texts stay (they score 0.018; 0.5, and so go, only if nothing
    was learned); repeated rows and null ids are judged by their text; an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(params)
    return docs.mapInArrow(lambda batches: reject_batches(batches, held.value, text_col, limit), docs.schema)
