"""MinHash near-duplicates by a multi-index Hamming join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, stored
from .graph import blocks, components, groups, spanning
from .text import U64, Words, constants, mix, ngrams, pieces

#: A signature: CHUNKS chunks of WIDTH symbols of 8 bits.  Two signatures that differ
#: in at most 2*CHUNKS-1 = 27 of 70 symbols have a chunk with at most one error, and
#: so share one of the chunk's keys, each of which leaves one symbol out.  At a
#: similarity of 0.8 a symbol differs with probability 0.2: 28 or more errors are a
#: matter of 1 pair in about 10,000 right at the threshold, fewer above it.
CHUNKS, WIDTH = 14, 5
SYMBOLS = CHUNKS * WIDTH
#: Sketch: one bit of 64 of the minima.  At similarity 0.8 a bit differs with probability
#: 0.1, so more than 20 of 64 differ once in a million; unrelated pairs differ in 32.
SKETCH_ERRORS = 20
#: Rows of a bucket, and rows or shingles of a cluster, compared in one task at once.
BUCKET_ROWS, CLUSTER_ROWS, CLUSTER_SHINGLES = 1024, 512, 2_000_000
#: Dropped rows, or hubs of large clusters, whose numbers are broadcast (a few MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def shingle_sets(words: Words, buf, off, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each begins."""
    w = words(buf, off)
    h, at = ngrams(w.hash, w.first, n)
    begin = np.searchsorted(at, w.first)
    parts, size = [], np.diff(begin)
    count = np.diff(w.first)
    for d in range(len(size)):
        if size[d]:
            parts.append(np.unique(h[begin[d] : begin[d + 1]]))
            size[d] = len(parts[-1])
        elif count[d]:  # fewer words than a shingle: the whole sequence is one
            x = U64(count[d])
            for k in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x ^ k]))[0] + U64(n)
            parts.append(np.array([x], U64))
            size[d] = 1
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate([[0], np.cumsum(size)])


def set_names(u: np.ndarray, begin: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each non-empty set."""
    s1 = mix(np.add.reduceat(mix(u ^ U64(0x5BD1E995)), begin[full]))
    s2 = np.bitwise_xor.reduceat(mix(u + U64(0x27D4EB2F)), begin[full])
    return s1, s2


def sign(batches, id_col: str, n: int):
    words, a, b = Words(), constants(SYMBOLS, 101), constants(SYMBOLS, 202)
    for batch in batches:
        out = [[], [], [], [], []]
        for lo, hi, buf, off in pieces(batch.column("_text")):
            u, begin = shingle_sets(words, buf, off, n)
            size = np.diff(begin)
            full = np.flatnonzero(size)
            s1, s2, sketch = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
            sig = np.zeros((hi - lo, SYMBOLS), np.uint8)
            if len(full):
                s1[full], s2[full] = set_names(u, begin, full)
                for k in range(SYMBOLS):
                    m = mix(np.minimum.reduceat((u ^ b[k]) * a[k], begin[full]))
                    sig[full, k] = m & U64(255)
                    if k < 64:
                        sketch[full] |= ((m >> U64(8)) & U64(1)) << U64(k)
            for o, x in zip(out, (size, s1, s2, sketch)):
                o.append(x.astype(np.int64) if x.dtype != U64 else x.view(np.int64))
            out[4].append(sig)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:4]]
        sig = np.concatenate(out[4]) if out[4] else np.zeros((0, SYMBOLS), np.uint8)
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SYMBOLS), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x) for x in cols), binary], [id_col, "n", "s1", "s2", "sketch", "sig"])


def chunk_keys(batches):
    """The keys of every class: for each chunk and each symbol left out, the hash of the others."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, CHUNKS, WIDTH).astype(U64)
        keys = np.empty((n, CHUNKS, WIDTH), U64)
        chunk = np.arange(CHUNKS, dtype=U64)[None, :]
        for hole in range(WIDTH):
            x = chunk * U64(WIDTH) + U64(hole)
            for k in range(WIDTH):
                if k != hole:
                    x = x << U64(8) | sig[:, :, k]
            keys[:, :, hole] = mix(x + U64(1 << 60))
        node = np.repeat(batch.column("c").to_numpy(), CHUNKS * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(node)], ["key", "c"])


def sketch_links(batches):
    """Spanning links of each bucket (block pair) among members with near sketches."""
    for t, begin in groups(batches, ["key", "_i", "_j"]):
        c, s = t.column("c").to_numpy(), t.column("sketch").to_numpy().view(U64)
        a, b = [], []
        for lo, hi in zip(begin[:-1], begin[1:]):
            x = s[lo:hi]
            root = spanning(np.bitwise_count(x[:, None] ^ x[None, :]) <= SKETCH_ERRORS)
            far = np.flatnonzero(root != np.arange(hi - lo))
            a.append(c[lo + far])
            b.append(c[lo + root[far]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def wanted_sets(batches, bits: np.ndarray, n: int):
    """The shingle sets of documents whose id may be wanted."""
    words, size = Words(), U64(len(bits) * 64)
    for batch in batches:
        h = batch.column("_h").to_numpy().view(U64)
        ok = np.ones(len(h), bool)
        for at in (h % size, mix(h) % size):
            ok &= (bits[at // U64(64)] >> (at % U64(64))) & U64(1) == 1
        batch = batch.filter(pa.array(ok))
        for _, _, buf, off in pieces(batch.column("_text")):
            u, begin = shingle_sets(words, buf, off, n)
            full = np.flatnonzero(np.diff(begin))
            if len(full):
                s1, _ = set_names(u, begin, full)
                sets = pa.array([u[begin[d] : begin[d + 1]].tobytes() for d in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), sets], ["c", "set"])


def exact_links(batches, num: int, den: int):
    """Spanning links of each cluster (block pair): den * |intersection| >= num * |union| on whole sets."""
    for t, begin in groups(batches, ["cluster", "_i", "_j"]):
        c, raw = t.column("c").to_numpy(), t.column("set").to_pylist()
        a, b = [], []
        for lo, hi in zip(begin[:-1], begin[1:]):
            sets = [np.frombuffer(x, U64) for x in raw[lo:hi]]
            size = np.array([len(x) for x in sets])
            shared = intersections(sets, size)
            root = spanning(den * shared >= num * (size[:, None] + size[None, :] - shared))
            far = np.flatnonzero(root != np.arange(hi - lo))
            a.append(c[lo + far])
            b.append(c[lo + root[far]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def hub_links(batches, num: int, den: int):
    """Links of a cluster's members with its hub, whose row comes first in every group (cluster, own block)."""
    for t, begin in groups(batches, ["cluster", "_own"]):
        c, raw = t.column("c").to_numpy(), t.column("set").to_pylist()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(begin[:-1], begin[1:]):
            hub = np.frombuffer(raw[lo], U64)
            size = np.array([len(x) // 8 for x in raw[lo + 1 : hi]], np.int64)
            flat = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in raw[lo + 1 : hi])])
            at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
            ends = np.cumsum(size)
            total = np.concatenate([[0], np.cumsum(hub[at] == flat)])
            shared = total[ends] - total[ends - size]
            near = np.flatnonzero(den * shared >= num * (size + len(hub) - shared)) + lo + 1
            a.append(c[near])
            b.append(np.full(len(near), c[lo]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def intersections(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[size[0], k], [k, size[1]]])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    common = np.cumsum(count > 1) - 1  # a shingle of one set only meets nothing
    keep = count[code] > 1
    row, col = row[keep], common[code[keep]]
    out, width = np.zeros((n, n), np.float64), max(1, 8_000_000 // n)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width if lo else min(width, int(col[-1]) + 1)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, size)
    return out


def bloom(ids: DataFrame, most_words: int = 1 << 20) -> np.ndarray:
    """Bits of two hashes of each id.  At most 8 MB whatever the number of ids: past that it only lets more through."""
    words = 1 << 10
    n = ids.count()
    while words < most_words and words * 4 < n:
        words *= 2
    at = ids.select(F.explode(F.array(F.col("h1"), F.col("h2"))).alias("h"))
    at = at.select(F.expr(f"h & {words * 64 - 1}").alias("p"))
    rows = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(words, U64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(U64)
    return bits


def add_mix(batches):
    for batch in batches:
        h = batch.column("h1")
        yield pa.RecordBatch.from_arrays([h, pa.array(mix(h.to_numpy().view(U64)).view(np.int64))], ["h1", "h2"])


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Components of documents whose word-shingle sets are similar.

    Texts with equal sets are one class.  Classes that share a chunk key of their
    signatures and have near sketches are linked tentatively, through each
    bucket's first member, or, in buckets where some member is far from it,
    comparing all members in blocks; only spanning links leave a task.  The
    components of these links are clusters; within a cluster all pairs are
    compared on the whole sets and linked where ``den*|A&B| >= num*|A|B||``;
    components of these exact links are the result.  In a cluster too large for
    one task members are first compared with its hub: those near it are one
    component already, and only the others are compared with all members, in
    blocks, so a large group of near copies costs in proportion to its size.
    Sets are built again only for documents in clusters, found through a Bloom
    filter of at most 8 MB; nothing else is collected or broadcast.

    Returns id, n_shingles, component_id (smallest id reachable) and kept (id is
    the component's).  Null, empty and blank texts have no shingles and are linked
    with nothing; repeated rows are rows of one class; rows without an id are
    linked like others but name no component; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    signed = cut(src.mapInArrow(lambda it: sign(it, "_id", shingle), f"_id {id_type}, n long, s1 long, s2 long, sketch long, sig binary"))
    classes = cut(signed.where("n > 0").groupBy(F.col("s1").alias("c"), "s2", "n", "sketch", "sig").agg(F.min("_id").alias("rep")))
    keys = classes.select("c", "sig").mapInArrow(chunk_keys, "key long, c long")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("p")).where("m > 1")
    members = cut(keys.join(buckets, "key"))
    sketches = classes.select("c", "sketch")
    star = members.where("c <> p").select("c", "p").distinct().join(sketches, "c")
    star = star.join(sketches.select(F.col("c").alias("p"), F.col("sketch").alias("_s")), "p")
    star = cut(star.select("c", "p", (F.bit_count(F.expr("sketch ^ _s")) <= SKETCH_ERRORS).alias("near")))
    missed = members.where("m > 2 and c <> p").join(star.where("not near"), ["c", "p"], "left_semi").select("key").distinct()
    rest = members.join(missed, "key", "left_semi").join(sketches, "c")
    rest = rest.select("key", "c", "sketch", F.ceil(F.col("m") / BUCKET_ROWS).alias("nb"))
    found = blocks(rest, "nb", "c", ["key"]).select("key", "_i", "_j", "c", "sketch").mapInArrow(sketch_links, "a long, b long")
    tentative = star.where("near").select(F.col("c").alias("a"), F.col("p").alias("b")).unionByName(found)
    cluster = components(tentative).select(F.col("v").alias("c"), F.col("comp").alias("cluster"))

    inside = cut(cluster.join(classes.select("c", "n", "rep"), "c"))
    bits = bloom(inside.select(F.xxhash64("rep").alias("h1")).mapInArrow(add_mix, "h1 long, h2 long"))
    held = docs.sparkSession.sparkContext.broadcast(bits)
    sets = src.select("_text", F.xxhash64("_id").alias("_h")).mapInArrow(lambda it: wanted_sets(it, held.value, shingle), "c long, set binary")
    total = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    total = total.select("cluster", F.ceil(F.greatest(F.col("m") / CLUSTER_ROWS, F.col("all") / CLUSTER_SHINGLES)).alias("nb"))
    sized = inside.join(total, "cluster").select("c", "cluster", "nb")
    inside = cut(sets.join(sized, "c").dropDuplicates(["c"]))
    exact = lambda rows: rows.select("cluster", "_i", "_j", "c", "set").mapInArrow(lambda it: exact_links(it, num, den), "a long, b long")
    links = exact(blocks(inside.where("nb = 1"), "nb", "c", ["cluster"]))

    # large clusters: members near the hub are one component; only the others meet all members
    large = inside.where("nb > 1").withColumn("_own", F.pmod(F.xxhash64(F.lit(3), "c"), F.col("nb")).cast("int"))
    hub = cut(large.groupBy("cluster").agg(F.min("c").alias("_hub")))
    members = large.join(F.broadcast(hub) if hub.count() <= BROADCAST_ROWS else hub, "cluster")
    stars = members.where("c <> _hub").select("cluster", "_own", F.lit(1).alias("_side"), "c", "set")
    stars = stars.unionByName(members.where("c = _hub").select("cluster", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)).alias("_own"), F.lit(0).alias("_side"), "c", "set"))
    stars = stars.repartition("cluster", "_own").sortWithinPartitions("cluster", "_own", "_side").select("cluster", "_own", "c", "set")
    near = cut(stars.mapInArrow(lambda it: hub_links(it, num, den), "a long, b long"))
    far = cut(members.where("c <> _hub").join(near.select(F.col("a").alias("c")), "c", "left_anti").drop("_hub"))
    blocks_of = far.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_ROWS).cast("int").alias("_n"), F.max("nb").cast("int").alias("_m"))
    far = far.join(blocks_of, "cluster").withColumn("_i", F.pmod(F.xxhash64(F.lit(5), "c"), F.col("_n")).cast("int"))
    # a block of the others with a block of all members; their own rows come as members as well, and once is enough
    one = far.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).where("_j <> _own")
    all_ = large.join(blocks_of, "cluster").withColumnRenamed("_own", "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    both = one.select("cluster", "_i", "_j", "c", "set").unionByName(all_.select("cluster", "_i", "_j", "c", "set"))
    links = links.unionByName(near).unionByName(exact(both.repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j")))
    linked = components(links).select(F.col("v").alias("c"), "comp").join(classes.select("c", "rep"), "c")
    least = cut(linked.groupBy("comp").agg(F.min("rep").alias("component_id")))  # joined by a key that a large component shares
    named = linked.join(least, "comp").select("c", "component_id")
    # a table of its own, so that the join with all rows can split a class of many copies
    named = cut(classes.select("c", "rep").join(named, "c", "left").select("c", F.coalesce("component_id", "rep").alias("component_id")))
    out = signed.join(named.withColumnRenamed("c", "s1"), "s1", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("_id") == comp, comp.isNull()).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """One row of each component of near copies, all columns as they were.

    The row with the smallest id stays; rows without an id come after all others,
    and among equal ids one row is taken.  Rows are judged by their own text,
    whatever other rows have the same id or none; rows without shingles all stay.
    The rows are first written to a table, so that a row has the same number in
    every pass.
    """
    row = "_row"
    while row.lower() in map(str.lower, docs.columns):
        row += "_"
    rows, _ = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = near_duplicates(rows.withColumn(row, key), id_col=row, **how)
    gone = cut(found.where("not kept").select(F.col(f"{row}.row").alias("_gone")))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, rows[row] == gone["_gone"], "left_anti").drop(row)
