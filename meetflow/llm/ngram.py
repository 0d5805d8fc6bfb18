"""Language-model scores: interpolated modified Kneser-Ney over word pairs."""

from __future__ import annotations

import io
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import shared_dir
from .graph import groups
from .text import U64, Words, mix, owner, pieces

#: A word is 48 bits of its hash.
ID = U64((1 << 48) - 1)
END, START = U64(1), U64(2)
#: Training tokens a bucket of pairs holds on average; words are in an eighth as many buckets.
BUCKET_TOKENS = 1_500_000
#: Tokens counted in a task before its sums go to the buckets.
TASK_TOKENS = 2_000_000


def tokens(w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens (words, then an end, for each document), of the tokens before them, and where documents begin."""
    ids = np.full(len(w.hash) + n_docs, END)
    ids[np.arange(len(w.hash)) + owner(w.first)] = w.hash & ID
    begin = w.first + np.arange(n_docs + 1)
    before = np.concatenate([[START], ids[:-1]])
    before[begin[:-1]] = START
    return ids, before, begin


class Layout:
    """Buckets: pairs by the hash of the pair, so that no frequent word fills one; words by id."""

    def __init__(self, n: int) -> None:
        self.pairs = max(1, n)
        self.words = max(1, -(-n // 8))

    def pair(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return part(pair_key(before, ids) >> U64(16), self.pairs)

    def word(self, ids: np.ndarray) -> np.ndarray:
        return part(ids, self.words)


def part(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids >> U64(24)) * U64(n) >> U64(24)).astype(np.int64)


def pair_key(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(mix(before) + ids * U64(0x9E3779B97F4A7C15))


def six(ids: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return ids.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def packed(x: np.ndarray) -> bytes:
    x = small(x)
    return x.dtype.char.encode() + zlib.compress(x.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), np.dtype(raw[:1].decode())).astype(np.int64)


def send(bucket: np.ndarray, kind: int, make) -> list[tuple]:
    """Rows (kind, bucket, ids, more, counts) of each bucket; bucket is sorted, make gets a slice."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    return [(kind, int(bucket[a]), *make(slice(a, b))) for a, b in zip(edge[:-1], edge[1:])]


ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
DDL = "kind int, bucket long, ids binary, more binary, counts binary"


def count_pairs(batches, layout: Layout):
    """Sorted distinct pairs with counts, by bucket: contexts and lengths of their runs, then the words."""
    words = Words()
    waiting, size = [], 0

    def out():
        before, ids = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((ids, before, layout.pair(before, ids)))
        before, ids = before[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (ids[1:] != ids[:-1])]))
        count = np.diff(np.append(first, len(ids)))
        before, ids = before[first], ids[first]

        def make(s):
            b = before[s]
            run = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            lengths = packed(np.diff(np.append(run, len(b))))
            return six(b[run]), len(lengths).to_bytes(8, "little") + lengths + six(ids[s]), packed(count[s])

        return pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r)) for r in send(layout.pair(before, ids), 0, make)], ROWS)

    for batch in batches:
        for lo, hi, buf, off in pieces(batch.column("_text")):
            ids, before, _ = tokens(words(buf, off), hi - lo)
            waiting.append((before, ids))
            size += len(ids)
            if size >= TASK_TOKENS:
                yield out()
                waiting, size = [], 0
    if waiting:
        yield out()


def local(uri: str) -> str | None:
    return uri[5:] if uri.startswith("file:") else uri if uri.startswith("/") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under the shared folder; a task that runs again writes the same."""
    path = local(folder)
    if path is None:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        tmp = f"{top}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as f:
            np.save(f, array)
        store.move(tmp, f"{top}/{name}.npy")
        return
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(tmp, array)
    os.replace(tmp, f"{path}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Maps an array of the shared folder; empty if there is none.  Stores that cannot be mapped are read into memory."""
    path = local(folder)
    if path is not None:
        path = f"/{path.lstrip('/')}/{name}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, U64)
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{top}/{name}.npy").type == fs.FileType.NotFound:
        return np.zeros(0, U64)
    with store.open_input_file(f"{top}/{name}.npy") as src:
        return np.load(io.BytesIO(src.read()))


def sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of values over each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def by_count(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)] + [int((x >= 3).sum())]


def reduce_pairs(batches, layout: Layout, folder: str):
    """Stores a bucket's pairs as sorted hashes with counts; sends on each word's and context's part of them."""
    for t, begin in groups(batches, ["bucket"]):
        for lo, hi in zip(begin[:-1], begin[1:]):
            rows = t.slice(lo, hi - lo)
            name = rows.column("bucket")[0].as_py()
            before, ids, count = [], [], []
            for c, more, n in zip(*(rows.column(k).to_pylist() for k in ("ids", "more", "counts"))):
                cut = 8 + int.from_bytes(more[:8], "little")
                before.append(np.repeat(from_six(c), unpacked(more[8:cut])))
                ids.append(from_six(more[cut:]))
                count.append(unpacked(n))
            before, ids, count = np.concatenate(before), np.concatenate(ids), np.concatenate(count)
            key = pair_key(before, ids)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.add.reduceat(count[order], first)
            before, ids = before[order][first], ids[order][first]
            save(folder, f"pair-{name}", key[first])
            save(folder, f"pair-{name}-count", small(count))
            out = [(3, 0, b"", b"", packed(np.array(by_count(count))))]
            w, n, c = sums(ids, np.ones(len(ids), np.int64), count)
            out += send(layout.word(w), 1, lambda s: (six(w[s]), packed(n[s]), packed(c[s])))
            x, *n123 = sums(before, *((count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64)))
            out += send(layout.word(x), 2, lambda s: (six(x[s]), b"", packed(np.concatenate([v[s] for v in n123]))))
            yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r)) for r in out], ROWS)


WORD_ARRAYS = ("c", "cont", "n1", "n2", "n3")


def reduce_words(batches, folder: str):
    """Stores a bucket's words; gives out sums over the model."""
    for t, begin in groups(batches, ["bucket"]):
        for lo, hi in zip(begin[:-1], begin[1:]):
            rows = t.slice(lo, hi - lo)
            name = rows.column("bucket")[0].as_py()
            pairs, ids, val = np.zeros(5, np.int64), [np.zeros(0, U64)], [np.zeros((5, 0), np.int64)]
            for kind, i, more, n in zip(*(rows.column(k).to_pylist() for k in ("kind", "ids", "more", "counts"))):
                if kind == 3:
                    pairs += unpacked(n)
                    continue
                i = from_six(i)
                v = np.zeros((5, len(i)), np.int64)
                if kind == 1:
                    v[0], v[1] = unpacked(n), unpacked(more)
                else:
                    v[2:] = unpacked(n).reshape(3, -1)
                ids.append(i)
                val.append(v)
            val = np.concatenate(val, axis=1)
            w, *val = sums(np.concatenate(ids), *val)
            save(folder, f"word-{name}", w)
            for k, v in zip(WORD_ARRAYS, val):
                save(folder, f"word-{name}-{k}", small(v))
            total = [int(val[0].sum()), int((val[0] > 0).sum()), int(val[1].sum()), *by_count(val[1]), *pairs.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, pa.int64())], ["i", "x"])


def discounts(t: list[int]) -> np.ndarray:
    """For counts of 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4 (0.5, 1, 1.5 where they say nothing)."""
    d = [0.0]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] and t[1] else 0
    for k in (1, 2, 3):
        x = k - (k + 1) * y * t[k] / t[k - 1] if y and t[k - 1] and t[k] else k / 2
        d.append(min(max(x, 0.01), k - 0.01))
    return np.array(d)


class Model:
    """What every worker needs to know, and the arrays it maps."""

    def __init__(self, folder: str, layout: Layout, s: list[int]) -> None:
        self.folder, self.layout = folder, layout
        self.n, self.v, self.pairs = s[0], s[1], s[2]
        self.d1, self.d2 = discounts(s[3:7]), discounts(s[8:12])
        rest = self.d1[1] * s[3] + self.d1[2] * s[4] + self.d1[3] * s[7]
        self.rest = rest / self.pairs if self.pairs else 1.0

    def open(self) -> None:
        self.word: dict = {}
        self.pair: dict = {}

    def held(self, kept: dict, k: int, *names: str) -> tuple:
        """Arrays of a bucket.  Mapped ones stay open; of those read into memory the last 16 buckets."""
        if k not in kept:
            if local(self.folder) is None and len(kept) >= 16:
                kept.pop(next(iter(kept)))
            kept[k] = tuple(load(self.folder, x) for x in names)
        return kept[k]

    def words(self, ids: np.ndarray) -> np.ndarray:
        """(5, ids) of WORD_ARRAYS; ids sorted."""
        out = np.zeros((5, len(ids)), np.int64)
        edge = np.searchsorted(self.layout.word(ids), np.arange(self.layout.words + 1))
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if a == b:
                continue
            key, *values = self.held(self.word, k, f"word-{k}", *(f"word-{k}-{x}" for x in WORD_ARRAYS))
            if len(key):
                at = np.minimum(np.searchsorted(key, ids[a:b]), len(key) - 1)
                hit = np.flatnonzero(key[at] == ids[a:b])
                for row, v in zip(out, values):
                    row[a + hit] = v[at[hit]]
        return out

    def counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        key, bucket = pair_key(before, ids), self.layout.pair(before, ids)
        order = np.lexsort((key, bucket))
        bucket = bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
        for a, b in zip(edge[:-1], edge[1:]):
            k = bucket[a]
            keys, count = self.held(self.pair, k, f"pair-{k}", f"pair-{k}-count")
            if len(keys):
                q = key[order[a:b]]
                at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == q)
                out[order[a:b][hit]] = count[at[hit]]
        return out

    def log10(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, the base's log probability, the model's."""
        distinct, code = np.unique(np.concatenate([ids, before]), return_inverse=True)
        c, cont, n1, n2, n3 = self.words(distinct)
        w, x = code[: len(ids)], code[len(ids) :]
        total = np.where(distinct == START, n1 * 0, c)
        if (at := np.flatnonzero(distinct == START)).size:
            e = np.flatnonzero(distinct == END)
            total[at] = c[e]  # as many beginnings as ends
        base = np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))
        low = self.rest / (self.v + 1)
        if self.pairs:
            low = low + np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / self.pairs
        low = np.broadcast_to(low, len(distinct))
        left = np.where(total > 0, (self.d2[1] * n1 + self.d2[2] * n2 + self.d2[3] * n3) / np.maximum(total, 1), 1.0)
        pair = self.counts(before, ids)
        p = np.maximum(pair - self.d2[np.minimum(pair, 3)], 0) / np.maximum(total[x], 1) + left[x] * low[w]
        return c[w], base[w], np.log10(p)


def score_batches(batches, model: Model, keep: list[str]):
    words = Words()
    model.open()
    for batch in batches:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for lo, hi, buf, off in pieces(batch.column("_text")):
            ids, before, begin = tokens(words(buf, off), hi - lo)
            c, base, p = model.log10(ids, before)
            for o, v in zip(out, (np.diff(begin), *(np.add.reduceat(x, begin[:-1]) for x in ((c > 0).astype(np.int64), base, p)))):
                o.append(v)
        cols = [pa.array(np.concatenate(o)) for o in out]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], [*keep, "n_tokens", "n_known", "base_score", "score"])


def train(docs: DataFrame, *, text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Counts all pairs of neighbouring tokens and writes the model to the shared folder.

    A text is its words (A-Z lowered) between a start and an end.  Tasks send
    sorted distinct pairs to hash buckets; each bucket becomes two arrays (sorted
    64-bit pair hashes, counts) and passes on, by word, how often and after how
    many different words it occurs and how many followers occur once, twice and
    more.  A pair's bucket is its hash, so buckets are alike (some 1.5 million
    tokens each) whatever words are frequent; a task sends a pair at most once for
    each 2 million tokens.  The driver gets 13 sums.  Nulls count as empty texts;
    ids are not looked at; an empty table gives a model that knows nothing.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).collect()[0]
    layout = Layout(max(1, ((size[0] or 0) // 6 + size[1]) // bucket_tokens))
    folder = f"{shared_dir(spark)}/ngram-{uuid.uuid4().hex}"
    src = docs.select(F.col(text_col).alias("_text"))
    pairs = src.mapInArrow(lambda it: count_pairs(it, layout), DDL).repartition("bucket").sortWithinPartitions("bucket")
    words = pairs.mapInArrow(lambda it: reduce_pairs(it, layout, folder), DDL).repartition("bucket").sortWithinPartitions("bucket")
    total = words.mapInArrow(lambda it: reduce_words(it, folder), "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
    s = [0] * 13
    for r in total:
        s[r["i"]] = r["x"]
    return Model(folder, layout, s)


def score(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score of every whole text.

    Base: unigrams with 0.1 added to each count and one class for all unseen
    words.  Score: pair counts less a discount, the rest shared by the
    discounted number of contexts a word follows, the rest of that evenly over
    all words and the unseen class.  Null counts as empty: an end alone.
    Workers map the model's arrays from the shared folder.
    """
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return src.mapInArrow(lambda it: score_batches(it, model, keep), f"{kinds}, n_tokens long, n_known long, base_score double, score double")
