"""Substring dedup by suffix sorting: bytes of passages that start at two places of the corpus or more.

Two equal passages choose the same anchor: the substring of GRAM bytes with the
least hash in them.  Windows are dealt out by the hash of their anchor, so equal
windows meet in one task, and only those whose anchor occurs twice travel.  In a
task suffixes are sorted in two stages, and adjacent common prefixes tell which
windows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut, stored
from .graph import groups
from .text import U64, constants, mix, pieces

#: Bytes of a passage and of its anchor.
LENGTH, GRAM = 200, 32
#: Rows that share an anchor and are sorted together; larger groups are split by what surrounds the anchor.
GROUP = 1 << 14
#: Bytes of text that are sorted at once, and of rows given on together.
SORTED, GIVEN = 1 << 20, 1 << 23


class Anchors:
    """Finds runs of windows with the same anchor in the texts of a piece: ``doc``, ``first`` and ``last`` window, ``at`` (anchor), ``hash``."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.values = length, gram, constants(256, 11)
        self.base = U64(0xA0761D6478BD642F)
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.zeros(0, U64)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> "Anchors":
        n, wide = len(buf), self.length - self.gram + 1
        windows = max(n - self.length + 1, 0)
        if not windows:
            self.doc = self.first = self.last = self.at = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.int64)
            return self
        if n > len(self.up):
            self.up, self.down = np.cumprod(np.full(n, self.base, U64)), np.cumprod(np.full(n, self.inverse, U64))
        total = np.zeros(n + 1, U64)
        np.cumsum(self.values[buf] * self.up[:n], out=total[1:])
        h = mix((total[self.gram :] - total[: -self.gram]) * self.down[: n - self.gram + 1])
        least, at, span = h, np.arange(len(h), dtype=np.int32), 1

        def nearer(least, at, by, keep):
            """The smaller of each value and the one so many places on; the first of equal ones."""
            after = least[by : by + keep] < least[:keep]
            return np.where(after, least[by : by + keep], least[:keep]), np.where(after, at[by : by + keep], at[:keep])

        while span * 2 <= wide:
            least, at = nearer(least, at, span, len(least) - span)
            span *= 2
        _, at = nearer(least, at, wide - span, windows)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
        inside = np.arange(windows) + self.length <= off[doc + 1]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        self.first = np.flatnonzero(new)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
        self.last = np.flatnonzero(ends)
        self.doc, self.at = doc[self.first], at[self.first].astype(np.int64)
        self.hash = h[self.at].view(np.int64)
        return self


def two_stage_sort(t: np.ndarray, raw: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes in order of their first ``depth`` symbols or more.

    ``t``: bytes plus one, a 0 after each text; ``raw``: the same with bytes as they are.
    A suffix is small if it is less than its successor.  Only small suffixes are
    sorted directly.  A large one lies behind the symbol of its bucket as its
    successor lies among all: one scan over the buckets, least symbol first, puts
    each in its place.  Only wanted suffixes take part, and those after them up
    to the next small one.
    """
    n = len(t)
    step = t[1:] - t[:-1]
    change = np.minimum.accumulate(np.where(np.append(step, 1) != 0, np.arange(n), n)[::-1])[::-1]
    small = np.append(step, 1)[change] > 0
    until = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]  # the next small suffix
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, wanted, 1)
    np.subtract.at(edge, until[wanted] + 1, 1)
    part = np.cumsum(edge[:-1]) > 0
    direct = np.flatnonzero(part & small & (t > 0))
    stop = np.flatnonzero(t == 0)
    stop = np.minimum(direct + depth, stop[np.searchsorted(stop, direct)])
    keys = [raw[a:b] for a, b in zip(direct.tolist(), stop.tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    bounds = np.searchsorted(t[direct], np.arange(258))
    large = part & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def before(at: np.ndarray) -> np.ndarray:
        prior = at[at > 0] - 1
        return prior[large[prior]]

    for c in range(257):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):  # large suffixes of a run of one symbol induce each other
            prior = before(wave)
            wave = prior[t[prior] == c]
            bucket.append(wave)
        bucket.append(direct[bounds[c] : bounds[c + 1]] if c else np.flatnonzero(part & (t == 0)))
        here = np.concatenate(bucket)
        prior = before(here)
        prior = prior[t[prior] > c]
        prior = prior[np.argsort(t[prior], kind="stable")]
        symbols, begin = np.unique(t[prior], return_index=True)
        for s, rows in zip(symbols, np.split(prior, begin[1:])):
            waiting[s].append(rows)
        if c:
            out.append(here)
    order = np.concatenate(out)
    chosen = np.zeros(n, bool)
    chosen[wanted] = True
    return order[chosen[order]]


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix has in common with the next in order."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(buf) + 1,), (1,)) if len(buf) else np.zeros(1, U64)
    a, b = order[:-1], order[1:]
    common, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        differ = words[a[open_] + k] ^ words[b[open_] + k]
        low = differ & (~differ + U64(1))
        common[open_] = k + np.where(differ == 0, 8, np.log2(np.maximum(low, U64(1)).astype(float)).astype(np.int64) >> 3)
        open_ = open_[differ == 0]
    return np.minimum(common, most)


def repeated_windows(contexts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): runs of windows, of the first ``windows`` of each context, that are equal to another one of them.

    Equal contexts, all of whose windows repeat, are sorted as one.
    """
    places: dict[bytes, int] = {}
    which = np.array([places.setdefault(c, len(places)) for c in contexts], np.int64)
    many = np.bincount(which, minlength=len(places))[which] > 1
    size = np.array([len(c) for c in places], np.int64)
    count = np.zeros(len(places), np.int64)
    count[which] = windows
    raw = b"\0".join(places) + b"\0"
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    buf = np.frombuffer(raw, np.uint8)
    t = buf.astype(np.int16) + 1
    t[begin + size] = 0
    owner = np.repeat(np.arange(len(places)), count)
    wanted = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    order = two_stage_sort(t, raw, wanted, length)
    equal = common_prefixes(buf, order, length) >= length
    found = np.zeros(len(t) + 1, bool)
    found[order[:-1][equal]] = found[order[1:][equal]] = True
    hit = found[wanted]
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    opens = hit & (edge | ~np.concatenate([[False], hit[:-1]]))
    closes = hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))
    first, last, mine = wanted[opens], wanted[closes], owner[opens]
    back = np.zeros(len(places), np.int64)
    back[which] = np.arange(len(which))
    alone = ~many[back[mine]]
    who, first, last = back[mine][alone], (first - begin[mine])[alone], (last - begin[mine])[alone]
    all_ = np.flatnonzero(many)
    return np.concatenate([all_, who]), np.concatenate([np.zeros(len(all_), np.int64), first]), np.concatenate([windows[all_] - 1, last])


def _binary(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[places])])


def _anchor_rows(length: int, gram: int):
    def rows(batches) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for batch in batches:
            digest = batch.column("_digest")
            for lo, _, buf, off in pieces(batch.column("_text")):
                a = find(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array(a.hash), digest.take(pa.array(a.doc + lo)), pa.array((a.at - off[a.doc]).astype(np.int32))], names=["key", "_digest", "at"])
    return rows


def _context_rows(length: int, gram: int):
    def rows(batches) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for batch in batches:
            digest, lists = batch.column("_digest"), batch.column("hits")
            ends, hits = lists.offsets.to_numpy(), lists.values
            at, hot = hits.field("at").to_numpy(), hits.field("hot").to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in pieces(batch.column("_text")):
                a = find(buf, off)
                own = slice(ends[lo], ends[hi])
                place = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])) << 32 | at[own]
                by = np.argsort(place)
                mine = a.doc << 32 | (a.at - off[a.doc])
                near = np.minimum(np.searchsorted(place[by], mine), max(len(place) - 1, 0))
                kept = np.flatnonzero(place[by][near] == mine) if len(place) else np.zeros(0, np.int64)
                size = a.last[kept] - a.first[kept] + length
                for some in np.split(np.arange(len(kept)), np.flatnonzero(np.diff(np.cumsum(size) // GIVEN)) + 1):
                    r = kept[some]
                    if len(r):
                        doc, first = a.doc[r], a.first[r]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a.hash[r]), digest.take(pa.array(doc + lo)), pa.array((first - off[doc]).astype(np.int32)), pa.array((a.last[r] - first + 1).astype(np.int32)), pa.array((a.at[r] - first).astype(np.int32)),
                             pa.array(np.full(len(r), gram, np.int32)), _binary(buf, first, size[some]), pa.array(hot[own][by][near[r]])], names=["key", "_digest", "start", "windows", "block", "wide", "context", "hot"])
    return rows


def _sorted_rows(length: int):
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for table, change in groups(batches, ["key"]):
            size = pc.binary_length(table.column("context")).to_numpy().astype(np.int64)
            ends, g = np.concatenate([[0], np.cumsum(size)]), 0
            while g + 1 < len(change):  # whole groups, as many as fit
                h = max(g + 1, int(np.searchsorted(ends[change], ends[change[g]] + SORTED, "right")) - 1)
                part = table.slice(change[g], change[h] - change[g])
                who, first, last = repeated_windows(part.column("context").to_pylist(), part.column("windows").to_numpy().astype(np.int64), length)
                start = part.column("start").to_numpy()[who]
                yield pa.RecordBatch.from_arrays([part.column("_digest").combine_chunks().take(pa.array(who)), pa.array((start + first).astype(np.int32)), pa.array((start + last + length).astype(np.int32))], names=["_digest", "first", "stop"])
                g = h
    return rows


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Windows that reach far to the left of their block go by it and what is left of it, the others by it and what is right of it.

    A block grows by half of what it lacks of a window, so blocks are whole windows after some eight times.
    """
    lack = F.lit(length) - F.col("wide")
    half = F.ceil(lack / 2).cast("int")
    left = F.least("windows", F.col("block") - half + 1)
    skip = F.greatest(F.lit(0), F.col("block") - half + 1)

    def row(first: Column, windows: Column, block: Column, wide: Column) -> Column:
        return F.struct((F.col("start") + first).alias("start"), windows.alias("windows"), block.alias("block"), wide.alias("wide"), F.substring("context", first + 1, windows + length - 1).alias("context"))

    parts = F.array(row(F.lit(0), left, F.col("block") - half, F.col("wide") + half), row(skip, F.col("windows") - skip, F.col("block") - skip, F.col("wide") + lack - half + 1))
    d = rows.select("_digest", F.inline(F.filter(parts, lambda x: x["windows"] > 0)))
    return d.select(F.xxhash64("wide", F.substring("context", F.col("block") + 1, F.col("wide"))).alias("key"), *d.columns)


def repeated_ranges(texts: DataFrame, ids: list[str], length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(digest, first, stop): byte ranges covered by windows that start anywhere else as well; and (digest, n, first id) of equal texts.

    ``texts``: (ids, _text, _digest).  Of equal texts one is looked into.  Anchors
    are counted by partial sums, rows of anchors that occur twice meet them by a
    join that may split its larger side, and texts meet their anchors by (digest,
    id).  In anchors' groups of more than ``group`` rows equal contexts become one
    (all their windows repeat), and groups with more different ones than that are
    split until they have fewer: once blocks are whole windows there is one.
    """
    (id_col,) = ids
    classes = cut(texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("_first"), F.max(F.octet_length("_text")).alias("_size")))
    long_ = texts.where(F.octet_length("_text") >= length)
    anchors = long_.select("_text", "_digest").mapInArrow(_anchor_rows(length, gram), "key long, _digest binary, at int")
    place = F.xxhash64("_digest", "at")
    twice = anchors.groupBy("key").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo <> _hi")
    hits = anchors.join(twice.select("key", (F.col("_n") > group).alias("hot")), "key").groupBy("_digest").agg(F.collect_set(F.struct("at", "hot")).alias("hits"))
    hits = hits.join(classes.where(F.col("_size") >= length).select("_digest", "_first"), "_digest").withColumnsRenamed({"_digest": "_d"})
    found = long_.join(hits, (long_["_digest"] == hits["_d"]) & long_[id_col].eqNullSafe(hits["_first"])).select("_text", "_digest", "hits")
    rows, _ = stored(found.mapInArrow(_context_rows(length, gram), "key long, _digest binary, start int, windows int, block int, wide int, context binary, hot boolean"))
    ready, todo = rows.where("not hot").drop("hot"), rows.where("hot").drop("hot")
    found = []
    while todo.limit(1).count():
        rest = ["_digest", "start", "windows", "block", "wide"]
        same, _ = stored(todo.groupBy("key", "context").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest]))
        twice = same.where("_n > 1").select("key", "context")
        found.append(todo.join(twice.hint("merge"), ["key", "context"], "left_semi").select("_digest", F.col("start").alias("first"), (F.col("start") + F.col("windows") + length - 1).alias("stop")))
        count = cut(same.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("key"))
        ready = ready.unionByName(same.join(count, "key", "left_anti").drop("_n"))
        todo, _ = stored(_split(same.join(count, "key", "left_semi"), length))
    dealt = ready.select("key", "_digest", "start", "windows", "context").repartition("key").sortWithinPartitions("key")
    ranges = dealt.mapInArrow(_sorted_rows(length), "_digest binary, first int, stop int")
    for d in found:
        ranges = ranges.unionByName(d)
    return ranges, classes


def _cut_rows(rest: list[str]):
    def rows(batches) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            made = []
            for text, ranges in zip(batch.column("_text"), batch.column("ranges")):
                text, kept, at, removed, spans = memoryview(text.as_py().encode()), sha256(), 0, 0, 0
                for first, stop in sorted((x["first"], x["stop"]) for x in ranges.as_py()):
                    if first > at or not spans:
                        kept.update(text[at:first])
                        spans, at = spans + 1, first
                    removed += max(0, stop - at)
                    at = max(at, stop)
                kept.update(text[at:])
                made.append((removed, spans, kept.hexdigest()))
            made = [pa.array(list(x), k) for x, k in zip(zip(*made), (pa.int64(), pa.int64(), pa.string()))] if made else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "n_removed", "n_spans", "kept_sha256"])
    return rows


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256, without bytes covered by ``length`` bytes that also start elsewhere.

    Of equal texts long enough everything goes, whatever else is found; only texts
    that are alone are cut.  Null text counts as empty; documents without an id and
    rows that repeat are documents of their own (so their texts are equal to each
    other); an empty table gives no rows; other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_digest", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16))
    ranges, classes = repeated_ranges(base, ["_id"], length, gram, group)
    ranges, _ = stored(ranges)
    single = classes.where("n = 1").select(F.col("_digest").alias("_d"), "_first")
    lists = ranges.groupBy(F.col("_digest").alias("_d")).agg(F.collect_list(F.struct("first", "stop")).alias("ranges")).join(single, "_d")
    same = lambda a, b: (a["_digest"] == b["_d"]) & a["_id"].eqNullSafe(b["_first"])
    texts = base.where(F.octet_length("_text") >= length)
    done = texts.join(lists, same(texts, lists)).select("_d", "_first", "_text", "ranges")
    done = done.mapInArrow(_cut_rows(["_d", "_first"]), f"_d binary, _first {base.schema['_id'].dataType.simpleString()}, n_removed long, n_spans long, kept_sha256 string")
    alone = single.join(done.withColumnsRenamed({"_d": "_e", "_first": "_f"}), F.col("_d") == F.col("_e"), "left").drop("_e", "_f").withColumn("_single", F.lit(True))
    light = base.select("_id", "_digest", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"))
    d = light.join(alone, same(light, alone), "left")
    whole = F.col("_single").isNull() & (F.col("n_bytes") >= length)
    return d.select(F.col("_id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"))
