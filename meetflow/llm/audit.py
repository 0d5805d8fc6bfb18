"""Filter interaction audit: what each filter removes, in every order of the filters (DataFrame operations only)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: words are what lies between these characters; D fails texts that hold one of the symbols.
BLANKS, SYMBOLS = "[\\x20\\x09-\\x0D]+", "[#$%&*|]"
FILTERS = "ABCDE"


def word_counts(texts: DataFrame, keys: list[str], text_col: str = "_text") -> DataFrame:
    """(keys, rows, n_words, n_distinct) of rows that share their keys and so their text.

    Words are exploded and counted by (keys, word), then by keys.  A null word for
    each row counts the rows themselves and keeps those without words.  Texts are
    dealt out by their keys before they are exploded, so words are not shuffled.
    """
    words = F.filter(F.split(text_col, BLANKS), lambda w: w != "")
    each = texts.repartition(*keys).select(*keys, F.explode(F.concat(words, F.array(F.lit(None).cast("string")))).alias("_word"))
    per_word = each.groupBy(*keys, "_word").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.sum(F.when(F.col("_word").isNull(), F.col("_n")))
    total = F.sum(F.when(F.col("_word").isNotNull(), F.col("_n")))
    return per_word.groupBy(*keys).agg(rows.alias("rows"), (F.coalesce(total, F.lit(0)) / rows).cast("long").alias("n_words"), F.count("_word").alias("n_distinct"))


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for documents with the same id, text and part: (id, part, copies, mask); bit k of mask: filter k of ABCDE fails.

    Documents meet their word counts and the smallest id of their text by (id,
    digest of the text), which no group of copies shares.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"))
    base = base.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]", ""))
    flags = base.select("_id", "_digest", "part", (100 * capitals > 10 * F.length("_text")).alias("_c"), F.col("_text").rlike(SYMBOLS).alias("_d"))
    flags = flags.groupBy("_id", "_digest", "part").agg(F.count(F.lit(1)).alias("copies"), F.first("_c").alias("_c"), F.first("_d").alias("_d"))
    words = word_counts(base.select("_id", "_digest", "_text"), ["_id", "_digest"])
    first = flags.groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"_id": "_rid", "_digest": "_rdigest"})
        return left.join(r, left["_id"].eqNullSafe(r["_rid"]) & (left["_digest"] == r["_rdigest"]), "left").drop("_rid", "_rdigest")

    j = meet(meet(flags, words), first)
    failed = [F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"), F.col("_c"), F.col("_d"), F.col("_first").isNull() & F.col("_id").isNotNull()]
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))
    return j.select(F.col("_id").alias(id_col), "part", "copies", mask.alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Per part, documents are counted by which of the 32 sets of filters they fail,
    in as many conditional counts, and again for good and toxic ones; all orders
    follow from those sums.

    Null text counts as empty, null lang as the part ''.  A document without an id
    has no labels, is no copy and makes none; of several labels of an id any 1
    counts; rows that repeat count each, and rows that share id and text are no
    copies of each other.  An empty table gives no rows; other columns are not
    looked at.
    """
    masks = failures(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    marks = labels.groupBy(F.col(id_col)).agg(F.max("quality").alias("_good"), F.max("toxic").alias("_toxic"))
    d = masks.join(marks, id_col, "left")
    kinds = {"all": F.lit(True), "good": F.col("_good") == 1, "toxic": F.col("_toxic") == 1}
    counts = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.when(c, F.col("copies")))), F.lit(0)).alias(f"{k}_{m}") for k, c in kinds.items() for m in range(32)]
    sums = d.groupBy("part").agg(*counts)
    sums = sums.select("part", *[F.array(*[f"{k}_{m}" for m in range(32)]).alias(f"_{k}") for k in kinds])
    orders = list(permutations(range(len(FILTERS))))
    steps = [("".join(FILTERS[f] for f in o), k + 1, 1 << o[k], sum(1 << f for f in o[:k])) for o in orders for k in range(len(o))]
    steps = sums.select("*", F.expr(f"inline(array({', '.join(f'struct{x}' for x in steps)})) as (filter_order, step, _own, _before)"))
    has = lambda m, b: m.bitwiseAND(b) != 0

    def total(kind: str, which) -> Column:
        return F.aggregate(F.transform(f"_{kind}", lambda n, m: F.when(which(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)

    here = lambda m: has(m, F.col("_own")) & ~has(m, F.col("_before"))
    # of the orders of a failing set each filter in it is first equally often
    shapley = F.aggregate(F.transform("_all", lambda n, m: F.when(has(m, F.col("_own")), n * F.floor(F.lit(len(orders)) / F.bit_count(m))).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)
    return steps.select(
        "part", "filter_order", "step", total("all", lambda m: ~has(m, F.col("_before").bitwiseOR(F.col("_own")))).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda m: has(m, F.col("_own")) & has(m, F.col("_before"))).alias("redundant"), total("all", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"))
