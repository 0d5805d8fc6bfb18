"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Words, constants, mix, owner, pieces

#: 1: the token counts, 0: any token.  Of 13 tokens of which any two differ, one of
#: these two masks finds six equal ones at some place (all 78 pairs were tried).
MASKS = ("1111011", "1010100111")
#: An overlap: so many tokens in a row (or the whole item if it is shorter), and the share of them that must agree.
OVERLAP, AGREE = 13, 0.8
#: Tokens of benchmark items that are searched for at once; a larger benchmark takes several passes.
BLOCK_TOKENS = 4_000_000
#: Equal seeds looked at in one go: a line that all items share makes places times items of them.
HITS = 2_000_000


def alnum_words() -> Words:
    """Words of letters and digits (and whatever is not ASCII): punctuation separates."""
    w = Words()
    w.black = np.zeros(256, bool)
    w.black[48:58] = w.black[65:91] = w.black[97:123] = w.black[128:] = True
    return w


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the tokens that a mask looks at, for every place where it fits a document, and the places."""
    span = len(mask)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for k, i in zip(constants(len(mask), 900 + span), range(span)):
        if mask[i] == "1":
            out += h[i : i + n] * k
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(room >= span)
    return mix(out[at]), at


def whole_masks(n: int) -> list[str]:
    """Masks that find a whole item of n tokens whichever tokens differ of those that may.

    The item is split in five parts, and each mask leaves out as many parts as
    tokens may differ: however these lie, some mask looks at none of them.
    """
    parts = np.array_split(np.arange(n), 5)
    differ = int(n - np.ceil(AGREE * n - 1e-9))
    out = []
    for gone in combinations(parts, differ):
        mask = np.full(n, "1")
        mask[np.concatenate([[], *gone]).astype(int)] = "0"
        out.append("".join(mask))
    return out


class Index:
    """Sorted seed hashes of benchmark items, with a table of their leading bits before them."""

    def __init__(self, ids: list, texts: list) -> None:
        self.ids = ids
        tokens, first = [np.zeros(0, U64)], [0]
        words = alnum_words()
        for _, _, buf, off in pieces(pa.array(texts, pa.large_string())):
            w = words(buf, off)
            tokens.append(w.hash)
            first += (first[-1] + w.first[1:]).tolist()
        self.tokens, self.first = np.concatenate(tokens), np.array(first)
        # items shorter than an overlap are searched whole
        size = np.diff(self.first)
        short = sorted({int(x) for x in size if 0 < x < OVERLAP})
        self.masks = list(dict.fromkeys([*MASKS, *(m for n in short for m in whole_masks(n))]))
        self.seed, self.item, self.place, self.bits = [], [], [], []
        doc = owner(self.first)
        for mask in self.masks:
            s, at = seeds(self.tokens, self.first, mask)
            if mask not in MASKS:
                own = size[doc[at]] == len(mask)
                s, at = s[own], at[own]
            order = np.argsort(s, kind="stable")
            self.seed.append(s[order])
            self.item.append(doc[at][order])
            self.place.append((at - self.first[doc[at]])[order])
            bits = np.zeros(1 << 20, bool)
            bits[(s >> U64(44)).astype(np.int64)] = True
            self.bits.append(bits)

    def hits(self, words: Words):
        """Arrays (document, item, diagonal) of equal seeds, a bounded number at a time."""
        h, first = words.hash, words.first
        doc = owner(first)
        for mask, seed, item, place, bits in zip(self.masks, self.seed, self.item, self.place, self.bits):
            s, at = seeds(h, first, mask)
            maybe = np.flatnonzero(bits[(s >> U64(44)).astype(np.int64)])
            s, at = s[maybe], at[maybe]
            lo, hi = np.searchsorted(seed, s, "left"), np.searchsorted(seed, s, "right")
            total = np.concatenate([[0], np.cumsum(hi - lo)])
            for begin in range(0, int(total[-1]), HITS):
                g = np.arange(begin, min(begin + HITS, int(total[-1])))
                row = np.searchsorted(total, g, "right") - 1
                k = lo[row] + g - total[row]
                yield np.unique(np.stack([doc[at[row]], item[k], at[row] - first[doc[at[row]]] - place[k]], axis=1), axis=0)

    def verify(self, words: Words, d: int, i: int, diagonal: int):
        """(document, item, tokens agreeing, first and last word) of the overlap on a diagonal, or None."""
        first = words.first
        x, y = words.hash[first[d] : first[d + 1]], self.tokens[self.first[i] : self.first[i + 1]]
        a, b = max(0, diagonal), min(len(x), diagonal + len(y))
        same = x[a:b] == y[a - diagonal : b - diagonal]
        size = min(OVERLAP, len(y))
        if len(same) < size:
            return None
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(total[size:] - total[:-size] >= np.ceil(AGREE * size - 1e-9))
        if not len(good):
            return None
        p, q = good[0], good[-1] + size
        return d, i, int(total[q] - total[p]), int(first[d] + a + p), int(first[d] + a + q - 1)

    def search(self, words: Words):
        """Verified overlaps, one for each document, item and diagonal."""
        found = np.zeros((0, 3), np.int64)
        for new in self.hits(words):
            found = np.unique(np.concatenate([found, new]), axis=0)
        for d, i, diagonal in found.tolist():
            hit = self.verify(words, d, i, diagonal)
            if hit:
                yield hit

    def hit_documents(self, words: Words) -> set[int]:
        """Documents that overlap with some item; none is looked at again."""
        done: set[int] = set()
        for new in self.hits(words):
            for d, i, diagonal in new.tolist():
                if d not in done and self.verify(words, d, i, diagonal):
                    done.add(d)
        return done


def overlaps(batches, id_col: str, index: Index, item_type: pa.DataType):
    words = alnum_words()
    cont = np.zeros(256, bool)
    cont[128:192] = True
    for batch in batches:
        out = []
        ids = batch.column(id_col)
        for lo, _, buf, off in pieces(batch.column("_text")):
            w = words(buf, off)
            points = None
            for d, i, n, p, q in index.search(w):
                if points is None:
                    points = np.concatenate([[0], np.cumsum(~cont[buf])])
                zero = points[off[d]]
                out.append((lo + d, i, n, int(index.first[i + 1] - index.first[i]), int(points[w.start[p]] - zero), int(points[w.end[q]] - zero)))
        rows = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), pa.array([index.ids[i] for i in rows[1]], item_type), *(pa.array(x, pa.int64()) for x in rows[2:])],
                                         [id_col, "_item", "matched", "item_tokens", "start", "end"])


def indexes(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int):
    """An index for each block of the benchmark; a block holds about ``block_tokens`` tokens, or one longer item."""
    b = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("x"))
    total = b.agg(F.sum(F.coalesce(F.octet_length("x"), F.lit(0)))).collect()[0][0] or 0
    n = 1 + int(total) // (4 * block_tokens)
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i", "x"), F.lit(n)) == k).orderBy("i", "x").collect()
        yield Index([r["i"] for r in rows], [r["x"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document and benchmark item that overlap.

    Tokens are runs of letters and digits, A-Z lowered.  Seeds of the benchmark
    (hashes of the tokens a mask looks at) are joined with those of every place of
    every document; around a hit, item and document are compared token by token on
    the hit's diagonal, and an overlap is 13 tokens in a row (the whole item if it
    is shorter) of which at least 80% agree.  The documents are read once for each
    block of about 4 million benchmark tokens; a block, at most some 100 MB, is
    all that is broadcast.

    Returns id, item id, matched (tokens agreeing, the most on one diagonal),
    item_tokens, start and end (code points, end exclusive) of the overlap.  Null
    and blank texts and items overlap with nothing; repeated rows give repeated
    hits that fall together by id; empty tables give no rows.  Where both tables
    call their id the same, the item's is named ``benchmark_<name>``.
    """
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    kind, item = src.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item)
    schema = f"`{id_col}` {kind}, _item {item.simpleString()}, matched long, item_tokens long, start long, `end` long"
    found = None
    for index in indexes(benchmark, item_id, item_text, block_tokens):
        held = docs.sparkSession.sparkContext.broadcast(index)
        part = src.mapInArrow(lambda it, held=held: overlaps(it, id_col, held.value, item_type), schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("matched", -F.col("start"), -F.col("end"), "item_tokens")).alias("_b")
    found = found.groupBy(id_col, "_item").agg(best)
    return found.select(id_col, F.col("_item").alias(item_id if item_id != id_col else f"benchmark_{item_id}"), "_b.matched", "_b.item_tokens", (-F.col("_b.col2")).alias("start"), (-F.col("_b.col3")).alias("end"))


def clean_batches(batches, index: Index, text_col: str):
    words = alnum_words()
    for batch in batches:
        ok = np.ones(batch.num_rows, bool)
        for lo, _, buf, off in pieces(batch.column(text_col)):
            ok[[lo + d for d in index.hit_documents(words(buf, off))]] = False
        yield batch.filter(pa.array(ok))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents that overlap with no benchmark item (see ``contaminated``), all columns as they were.

    Null and blank texts stay; repeated rows and null ids are judged by their
    text; with an empty benchmark all stay; an empty table gives no rows.
    """
    for index in indexes(benchmark, item_id, item_text, block_tokens):
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(lambda it, held=held: clean_batches(it, held.value, text_col), docs.schema)
    return docs
