"""Cross-tokenizer alignment: groups and links of two tokenizers' tokens over the same bytes.

Texts are tokenised and aligned in Arrow batches; links are counted and met with
their counts by Spark's joins and aggregates.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import cut, stored

#: Bytes of text that are tokenised before rows are handed on.
PIECE = 1 << 20
#: Bits of an id in a pair of ids.
ID_BITS = 20
#: Id pairs that hold more than one in so many of all links are broadcast: there can't be more of them.
FREQUENT = 1 << 18
#: Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary (``tokenizers`` JSON): ids of texts, bytes of ids.

    Where ids follow the order of merges, tiktoken encodes with the same merges
    several times faster; else the vocabulary's own library does.
    """

    def __init__(self, source: bytes) -> None:
        spec, letters = json.loads(source), byte_of_letter()
        vocab, special = spec["model"]["vocab"], {t["id"] for t in spec.get("added_tokens") or []}
        ids = {bytes(letters[c] for c in word): i for word, i in vocab.items() if i not in special}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        merged = [vocab["".join(p)] for p in pairs]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for word, i in ids.items():
            self.bytes[i] = word
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if plain and merged == sorted(merged) and len(ids) == len(merged) + 256:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
            self.encode = lambda text: own.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(source.decode())
            own.encode_special_tokens = True
            self.encode = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentencepiece model: ids of texts, bytes of ids (U+2581 is a space, <0xHH> a byte)."""

    def __init__(self, source: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.encode = lambda text: np.array(model.encode(text, num_threads=1), np.int64)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


def aligned_ends(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ends of links, their pairs, ends of groups, and all tokens in the order of the groups' text, of texts laid one after another.

    ``a``, ``b``: ids; ``a_ends``, ``b_ends``: byte offsets, which end at the same byte.  Every
    end of either side closes a stretch of bytes that one token of each side covers: one link.
    Ends of both sides close groups.  Tokens come as ``2 * id``, plus 1 for the last of its side
    in a group, B's as -1 less that.  Every step is linear in the bytes.
    """
    size = max(int(a_ends[-1]) if len(a_ends) else 0, int(b_ends[-1]) if len(b_ends) else 0) + 1
    at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
    at_a[a_ends], at_b[b_ends] = True, True
    both = at_a & at_b
    upto_a, upto_b, upto = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, both))
    link, group = np.flatnonzero(at_a | at_b), np.flatnonzero(both)
    pairs = a[upto_a[link] - at_a[link]] << ID_BITS | b[upto_b[link] - at_b[link]]
    # before an A token in the text are the B tokens of earlier groups, before a B token the A tokens of its group, too
    begun = np.concatenate([np.zeros(1, np.int64), group])
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + upto_b[begun[upto[a_ends] - both[a_ends]]]] = 2 * a + both[a_ends]
    order[np.arange(len(b)) + upto_a[group[upto[b_ends] - both[b_ends]]]] = -1 - (2 * b + both[b_ends])
    return link, pairs, group, order


def aligned(docs: DataFrame, first: str, second: str, *, text_col: str = "text") -> DataFrame:
    """Replaces the text by n_a, n_b, n_groups, groups_sha256 and links (array of ``a id << 20 | b id``) of the tokens of space+text.

    No tokens where the text is null or empty or a tokenizer changes its bytes.
    The two vocabularies (some MB, whatever the corpus) are read on the driver and
    sent to the workers.  Texts are tokenised one at a time and aligned and given
    on some at a time.
    """
    files = docs.sparkSession.sparkContext.broadcast([open(p, "rb").read() for p in (first, second)])
    rest = [c for c in docs.columns if c != text_col]
    made = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType(), "links": T.ArrayType(T.LongType(), False)}
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, k) for c, k in made.items()])

    def align(batches):
        vocabs = ByteLevel(files.value[0]), Pieces(files.value[1])
        if max(len(v.bytes) for v in vocabs) > 1 << ID_BITS:
            raise ValueError(f"ids of {1 << ID_BITS} and more are not supported")
        tables = [np.array([*v.bytes, None], object)[:-1] for v in vocabs]
        lengths = [np.array([len(w) for w in v.bytes], np.int64) for v in vocabs]
        # texts of tokens by 2 * id, those of B from the end
        shown = [f"{i}{mark}" for i in range(len(tables[0])) for mark in ",|"] + [f"{i}{mark}" for i in reversed(range(len(tables[1]))) for mark in ";,"]
        shown, none = np.array(shown, object), [np.zeros(0, np.int64)] * 2

        def of(text: str) -> list[np.ndarray]:
            whole, out = b" " + text.encode(), []
            for side, (vocab, table) in enumerate(zip(vocabs, tables)):
                ids = vocab.encode(text if side else " " + text)
                if b"".join(table[ids].tolist()) != whole:
                    return none
                out.append(ids)
            return out

        def columns(found: list[list[np.ndarray]]) -> list[pa.Array]:
            n = np.array([[len(x) for x in sides] for sides in found], np.int64).reshape(-1, 2)
            ids = [np.concatenate([none[0], *side]) for side in zip(*found)]
            ends = [np.cumsum(length[x]) for length, x in zip(lengths, ids)]
            link, pairs, group, order = aligned_ends(ids[0], ends[0], ids[1], ends[1])
            last = np.cumsum(n, axis=0)  # of each text, the tokens up to its end; texts without tokens end where the one before does
            bytes_ = np.concatenate([np.zeros(1, np.int64), ends[0]])[last[:, 0]]
            links, groups = np.searchsorted(link, bytes_, "right"), np.searchsorted(group, bytes_, "right")
            upto, sha = [0, *last.sum(axis=1).tolist()], []
            for lo, hi in zip(upto, upto[1:]):
                sha.append(hashlib.sha256("".join(shown[order[lo:hi]].tolist())[:-1].encode()).hexdigest() if hi > lo else "")
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], links]).astype(np.int32)), pa.array(pairs), type=pa.list_(pa.field("element", pa.int64(), False)))
            return [pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(np.diff(groups, prepend=0)), pa.array(sha), listed]

        for batch in batches:
            lo, text = 0, batch.column(text_col)
            while lo < batch.num_rows:
                found, size, hi = [], 0, lo
                while hi < batch.num_rows and size < PIECE:
                    t = text[hi].as_py()
                    found.append(of(t) if t else none)
                    size, hi = size + len(t or ""), hi + 1
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *columns(found)], names=[*rest, *made])
                lo = hi

    return docs.mapInArrow(align, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how many of the links hold each id pair, and whether that is the most of its B id."""
    n = cut(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    most = n.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return n.join(most, b == most["_b"]).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see ``aligned``).

    Texts are tokenised once; links go to a table, numbered by row.  Counts of
    pairs that hold more than 1 in 2^18 of all links (so at most 2^18 pairs) are
    broadcast and meet the links without a shuffle; links of the other pairs, none
    of which is frequent, meet their counts by a shuffle of the pair.

    Null and empty texts, and texts whose bytes a tokenizer changes, have zeros and
    an empty ``groups_sha256``.  Repeated rows and rows without an id are rows of
    their own; other columns are not looked at; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    d = aligned(src, first, second, text_col="_text")
    rows, _ = stored(d.select("_row", "_id", "n_a", "n_b", "n_groups", "groups_sha256", F.size("links").cast("long").alias("n_links"), "links"))
    counts = cut(pair_counts(rows))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.broadcast(counts.where(F.col("n") * FREQUENT > total))
    each = rows.select("_row", F.explode("links").alias("pair"))
    sums = [F.sum("n").alias("count_sum"), F.count_if("best").alias("n_best")]
    head = each.join(frequent, "pair").groupBy("_row").agg(*sums)
    rare = counts.where(F.col("n") * FREQUENT <= total)
    tail = each.join(frequent, "pair", "left_anti").join(rare.hint("shuffle_hash"), "pair").groupBy("_row").agg(*sums)
    both = head.unionByName(tail).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(both, "_row", "left").select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
