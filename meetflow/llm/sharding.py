"""Sharding by global byte-size prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, stored

GROUP = ["_h", "size", "text_crc32"]
#: Places a shard at which group borders are looked up; a cut may move to any of them less than a shard away.
LOOKS = 8


def prefix(column: str, order: Window) -> Column:
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard_at(place: Column, begins: list[int]) -> Column:
    """The last shard that begins at or before a place, by halving."""
    n, at_ = len(begins), F.array(*[F.lit(x) for x in begins])
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0),
                       lambda at, x: F.when((at + x < n) & (F.get(at_, at + x) <= place), at + x).otherwise(at))


def choose_cuts(borders: dict[int, int], near: dict[int, list[int]], total: int, n: int) -> list[tuple[int, int]]:
    """(byte, row) at which each shard begins.

    ``borders`` gives the rows before each known border, ``near`` the borders about
    each of the targets 1 to n-1.  Of all ascending choices the one with the least
    sum of (size / mean - 1) ** 4 is taken, target by target.
    """
    cost = lambda a, b: ((b - a) * n / total - 1) ** 4
    best, back = {0: 0.0}, []
    for k in range(1, n):
        found = {}
        for b in near[k]:
            found[b] = min(((c + cost(a, b), a) for a, c in best.items() if a <= b), default=None)
        found = {b: x for b, x in found.items() if x is not None}
        back.append({b: x[1] for b, x in found.items()})
        best = {b: x[0] for b, x in found.items()}
    at = min(best, key=lambda b: (best[b] + cost(b, total), b))
    cuts = [at]
    for step in reversed(back):
        cuts.append(step[cuts[-1]])
    return [(b, borders[b]) for b in reversed(cuts)]


def balanced_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 16) -> DataFrame:
    """Contiguous shards of nearly equal bytes that keep equal texts together.

    All rows lie on one line of bytes in the order of (xxhash64(text), size, crc32,
    id): range partitions, whose totals become offsets, and running sums inside.
    Equal texts are neighbours there and form a group.  The line is cut near equal
    targets, and only at borders of groups; a group larger than a shard may be cut
    between any two of its rows.  Borders are looked up at eight places a shard
    (the last at or before a place, the first after it), so the driver sees at
    most sixteen numbers a shard; among those less than a shard from a target the
    cuts are chosen together, so that what one shard has too much the next ones
    lack.  A row's shard is the last that begins at or before it, its slot what
    rows lie between.  A group, whatever its size, never meets in one task.

    Returns id, ``size`` (UTF-8 bytes + ``overhead``), ``text_crc32``, ``shard``
    and ``slot`` (0, 1, ... in each shard).  Null text counts as empty; null and
    repeated ids are rows like any other (of rows with the same id and text any
    may have the smaller slot); an empty table gives no rows; other columns of the
    input are not looked at.
    """
    return _placed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), n_shards, overhead).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int, *, text_col: str = "text", overhead: int = 16) -> DataFrame:
    """All columns of the documents with their ``shard`` and ``slot`` (see ``balanced_shards``).

    The rows are first written to a table that numbers them, so that rows with the
    same id, or none, keep their own places.  Columns named shard or slot are replaced.
    """
    row = "_row"
    while row.lower() in map(str.lower, docs.columns):
        row += "_"
    rows, _ = stored(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()))
    places = _placed(rows.select(F.col(row).alias("_id"), F.col(text_col).alias("_text")), n_shards, overhead)
    return rows.join(places.select(F.col("_id").alias(row), "shard", "slot"), row).drop(row)


def _placed(src: DataFrame, n: int, overhead: int) -> DataFrame:
    """(_id, size, text_crc32, shard, slot) for rows (_id, _text)."""
    base = cut(src.select(
        "_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("_text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_h"),
        F.spark_partition_id().alias("_part"),
    ))
    line = [*GROUP, "_id", "_part"]
    rows = cut(base.repartitionByRange(*line).withColumn("_pid", F.spark_partition_id()))
    totals = rows.groupBy("_pid").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    parts = Window.orderBy("_pid")  # a row a partition
    totals = totals.select("_pid", prefix("_bytes", parts).alias("_byte0"), prefix("_rows", parts).alias("_row0"))
    inside = Window.partitionBy("_pid").orderBy(*line)
    rows = rows.withColumn("_byte", prefix("size", inside)).withColumn("_nth", F.row_number().over(inside) - 1).join(F.broadcast(totals), "_pid")
    rows = cut(rows.select("_id", *GROUP, (F.col("_byte0") + F.col("_byte")).alias("_byte"), (F.col("_row0") + F.col("_nth")).alias("_nth")))
    total = rows.agg(F.coalesce(F.max(F.col("_byte") + F.col("size")), F.lit(0))).first()[0]

    # of each place that is looked at, the border at or before it and the one after it
    groups = rows.groupBy(*GROUP).agg(F.min("_byte").alias("_from"), F.min("_nth").alias("_row0"), F.count(F.lit(1)).alias("_rows"))
    groups = groups.withColumn("_bytes", F.col("_rows") * F.col("size"))
    groups = groups.withColumn("_unit", F.when(F.col("_bytes") * n > total, F.lit(1)).otherwise(F.col("_rows")))
    looks = n * LOOKS
    first, last = F.expr(f"(_from * {looks}L + {total - 1}L) div {max(total, 1)}L"), F.expr(f"((_from + _bytes) * {looks}L - 1) div {max(total, 1)}L")
    found = groups.select("*", first.alias("_a"), last.alias("_b")).where("_a <= _b").withColumn("_look", F.explode(F.sequence("_a", "_b")))
    units = F.expr(f"((_look * {total}L) div {looks}L - _from) div (size * _unit)")
    found = found.select("_look", "size", "_from", "_row0", "_unit", "_rows", (units * F.col("_unit")).alias("_before"))
    borders, near = {0: 0}, {k: [] for k in range(1, n)}
    for r in found.collect():  # at most n * LOOKS
        for count in (r["_before"], min(r["_before"] + r["_unit"], r["_rows"])):
            byte = r["_from"] + count * r["size"]
            borders[byte] = r["_row0"] + count
            for k in range(max(1, r["_look"] // LOOKS), min(n - 1, -(-r["_look"] // LOOKS)) + 1):
                near[k].append(byte)
    cuts = choose_cuts(borders, {k: sorted(set(x)) for k, x in near.items()}, total, n) if total else [(0, 0)] * n
    shard = shard_at(F.col("_byte"), [b for b, _ in cuts])
    out = rows.withColumn("shard", shard.cast("int"))
    start = F.get(F.array(*[F.lit(r).cast("long") for _, r in cuts]), F.col("shard"))
    return out.select("_id", "size", "text_crc32", "shard", (F.col("_nth") - start).cast("long").alias("slot"))
