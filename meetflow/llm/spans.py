"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .text import U64, Words, mix, pieces

#: Sentences and words a run must have (under eight words "Yes. No." and the like repeat), and words that make a sentence a run of its own.
LEAST_SENTENCES, LEAST_WORDS, LONG_SENTENCE = 2, 8, 25


def sentences(w: Words, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every sentence and, after them, the number of words; first sentence of every document.

    A sentence ends with a word ending in . ! or ?, at a line break, and with its document.
    """
    n = len(w.start)
    ends = np.zeros(n, bool)
    if n:
        ends = np.isin(buf[w.end - 1], np.frombuffer(b".!?", np.uint8))
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        ends[:-1] |= lines[w.start[1:]] != lines[w.end[:-1]]
        ends[w.first[1:][w.first[1:] > 0] - 1] = True
    begin = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return begin, np.searchsorted(begin, w.first)


def sentence_runs(batches, id_col: str, sentences_: int, least: int, long: int):
    """(hash, id, packed place) of every run: the shortest from each sentence on and back from each, and long sentences."""
    words = Words()
    cont = np.zeros(256, bool)
    cont[128:192] = True
    base = U64(0xD6E8FEB86659FD93)
    down = U64(pow(int(base), -1, 1 << 64))
    for batch in batches:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for lo, hi, buf, off in pieces(batch.column("_text")):
            w = words(buf, off)
            n = len(w.start)
            if not n:
                continue
            begin, sfirst = sentences(w, buf, off)
            doc = np.repeat(np.arange(hi - lo), np.diff(sfirst))
            here = np.arange(len(begin) - 1)
            stop = np.maximum(here + sentences_, np.searchsorted(begin, begin[:-1] + least))  # the sentence after the run
            on = stop <= sfirst[doc + 1]
            back = np.minimum(here + 1 - sentences_, np.searchsorted(begin, begin[1:] - least, "right") - 1)  # the run's first
            off_ = (back >= sfirst[doc]) & (begin[1:] >= least)
            alone = np.diff(begin) >= long
            both = np.unique(np.concatenate([begin[here[on]] << 32 | begin[stop[on]], begin[back[off_]] << 32 | begin[1:][off_], begin[:-1][alone] << 32 | begin[1:][alone]]))
            first, stop = both >> 32, both & 0xFFFFFFFF
            doc = np.searchsorted(w.first, first, "right") - 1
            total = np.zeros(n + 1, U64)
            np.cumsum(w.hash * np.cumprod(np.full(n, base, U64)), out=total[1:])
            h = mix((total[stop] - total[first]) * np.cumprod(np.full(n, down, U64))[first] + (stop - first).astype(U64))
            points = np.concatenate([[0], np.cumsum(~cont[buf])])
            a = points[w.start[first]] - points[off[doc]]
            size = points[w.end[stop - 1]] - points[w.start[first]]
            order = np.lexsort((first, h, doc))  # a run that its own document has before
            again = np.zeros(len(h), np.int64)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
            # it is cut whatever others have: a hash of its own keeps it from meeting them
            h = np.where(again == 1, mix(h + mix((lo + doc).astype(U64) << U64(32) | first.astype(U64))), h)
            out[0].append(h.view(np.int64))
            out[1].append(lo + doc)
            out[2].append((a << 32 | size << 1 | again).astype(np.int64))
        h, row, place = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(id_col).take(pa.array(row)), pa.array(place)], ["h", "_id", "place"])


def merge_places(batches):
    """Unions of a document's runs."""
    for batch in batches:
        starts, ends, removed = [], [], []
        for places in batch.column("places").to_pylist():
            p = np.unique(np.array(places, np.int64) >> 1)
            a = p >> 31
            b = np.maximum.accumulate(a + (p & ((1 << 31) - 1)))
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            s, e = a[new], b[np.append(new[1:] - 1, len(b) - 1)]
            starts.append(s.tolist())
            ends.append(e.tolist())
            removed.append(int((e - s).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([len(x) for x in starts], pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["_id", "n_spans", "removed", "starts", "ends"])


def repeated_spans(docs: DataFrame, *, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS,
                   long_sentence: int = LONG_SENTENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to cut from each document: sentences covered by a run that stands somewhere before.

    A run is several (``least_sentences``, at least 2) consecutive sentences of
    together at least ``least_words`` words; a sentence of ``long_sentence`` words
    is a run, too, since passages may be one long sentence.  From every sentence
    on, and back from every sentence, the shortest run is hashed: any longer run
    that two texts share is covered by these.  Words compare with A-Z lowered and
    any white space between.  Of equal runs the first in order of id and place
    stays; all others are cut.  A run that its own document has before is cut
    without meeting others.  The rest are counted with the smallest id and then
    joined back, so a run in a third of all documents meets only in partial sums
    and in a join whose skewed side can be split.

    Returns a row for each document that loses something: id, n_spans, removed
    (code points), starts and ends (arrays of code points, end exclusive).  Null
    and blank texts lose nothing; rows with the same id count as one document;
    documents without an id keep all they have, and what they repeat is not counted
    as first elsewhere; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    runs = src.mapInArrow(lambda it: sentence_runs(it, "_id", max(2, least_sentences), least_words, long_sentence), f"h long, _id {kind}, place long")
    known = cut(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("d")).where("n > 1").select("h", "d", F.lit(True).alias("met")))
    later = F.col("met") & F.coalesce(F.col("_id") != F.col("d"), F.col("d").isNotNull())
    cuts = runs.join(known, "h", "left").where(F.coalesce(later, F.lit(False)) | (F.col("place").bitwiseAND(1) == 1)).select("_id", "place")
    cuts = cuts.where("_id is not null").groupBy("_id").agg(F.collect_list("place").alias("places"))
    out = cuts.mapInArrow(merge_places, f"_id {kind}, n_spans long, removed long, starts array<long>, ends array<long>")
    return out.withColumnRenamed("_id", id_col)


def cut_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated spans; all columns as they were.

    Rows of one id lose the same places; rows without an id, null texts and
    documents without spans stay whole; empty tables give no rows.  Columns of any
    names pass.
    """
    s = spans.select(F.col(id_col).alias("_id"), "starts", "ends")
    kept = F.aggregate(
        F.arrays_zip("starts", "ends"),
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("p")),
        lambda acc, x: F.struct(F.concat(acc["t"], F.substring("_text", (acc["p"] + 1).cast("int"), (x["starts"] - acc["p"]).cast("int"))).alias("t"), x["ends"].alias("p")),
        lambda acc: F.concat(acc["t"], F.substring("_text", (acc["p"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    joined = rows.join(s, F.col("_key").eqNullSafe(F.col("_id")), "left")
    text = F.when(F.col("starts").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
