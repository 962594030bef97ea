"""Quality rules: repetition measures and a hashed n-gram likelihood ratio.

Words and word pairs of a text fall into ``BUCKETS`` hash buckets.  One multinomial over the
buckets is counted from trusted documents, another from all documents; a text's score is the mean
log ratio of the two over its n-grams.  Every document is judged by the same fixed threshold.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .common import small, words

BUCKETS = 1 << 16
#: Mean log ratio (natural logarithm) below which a text is rejected.
THRESHOLD = -0.15
#: Trusted n-grams added to every bucket.
SMOOTHING = 8.0
MIN_WORDS = 10
REPEAT_WORDS = 5
SYMBOLS = r"[#*$%&|<>]"


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def _side_by_side(a: Column, b: Column, step: int) -> Column:
    """Hashes of ``a[i]`` with ``b[i + step]``."""
    n = F.least(F.size(a), F.size(b) - step)
    return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(b, step + 1, n), lambda x, y: F.xxhash64(x, y))) \
        .otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column, n: int = REPEAT_WORDS) -> Column:
    """Words inside windows of ``n`` words that occur at least twice in the text.

    ``windows`` are the windows' hashes in order.  If all differ, which is the common case and cheap to see, the
    count is 0; else the windows are sorted by (hash, place), neighbours of equal hash are kept, and the
    stretches they cover are added up in order of place.
    """
    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(o: Column) -> Column:
        again = F.filter(o, lambda x, j: ((j > 0) & (_at(o, j - 1)["h"] == x["h"]))
                         | F.coalesce(_at(o, j + 1)["h"] == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
                           lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"),
                                                 p.alias("last")),
                           lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)) \
        .otherwise(_let(ordered, covered)).cast("long")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_h`` and ``_p`` (hashes of words and of neighbouring pairs) and the base measures.

    A null text has no words; every measure is then 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = F.when(F.instr(t, "\n") > 0, _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))) \
        .otherwise(F.lit(0))
    base = docs.withColumn("_w", words(F.col(text))).select(
        "*", F.size("_w").cast("long").alias("_n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("_word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("_n_symbols"),
        n_lines.cast("long").alias("_n_dup_lines"), _hashes(F.col("_w")).alias("_h")).drop("_w")
    base = base.withColumn("_p", _side_by_side(F.col("_h"), F.col("_h"), 1))
    # five words: two pairs and a word
    base = base.withColumn("_four", _side_by_side(F.col("_p"), F.col("_p"), 2))
    base = base.withColumn("_five", _side_by_side(F.col("_four"), F.col("_h"), 4))
    return base.withColumn("_n_repeat_words", repeated_words(F.col("_five"))).drop("_four", "_five")


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
               buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratios``, the log ratio of every bucket (``buckets`` doubles).

    The trusted counts are smoothed by ``SMOOTHING`` per bucket, the raw ones by as much at the raw corpus' scale,
    so a bucket without evidence has ratio 0.  ``trusted`` holds the ids (column ``doc_id``) of
    the trusted documents; without any, all ratios are about 0 and nothing is rejected by them.
    """
    ids = trusted.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    marked = rows.join(small(ids.withColumn("_good", F.lit(1))), "_id", "left")
    hashed = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), _hashes(words(F.col("_t"))).alias("h"))
    grams = F.explode(F.concat("h", _side_by_side(F.col("h"), F.col("h"), 1)))
    # first per task by bucket and mark, so that each task sends at most two rows a bucket
    counts = materialise(
        hashed.select("good", grams.alias("gram")).groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("b"))
.agg(F.count(F.lit(1)).alias("n_raw"), F.sum("good").alias("n_good")), "ngram-counts")
    sums = counts.agg(F.coalesce(F.sum("n_raw"), F.lit(0)).alias("all_raw"),
                      F.coalesce(F.sum("n_good"), F.lit(0)).alias("all_good"))
    # every bucket, seen or not; one row a bucket, then one row of all
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    table = every.join(counts, "b", "left").fillna(0, ["n_raw", "n_good"]).join(F.broadcast(sums))
    share = F.col("all_good") / F.col("all_raw")
    ratio = F.when(F.col("all_good") == 0, 0.0).otherwise(
        F.log((F.col("n_good") + SMOOTHING) / (F.col("n_raw") * share + SMOOTHING)))
    listed = F.array_sort(F.collect_list(F.struct("b", ratio.alias("r"))))
    return table.agg(F.transform(listed, lambda x: x["r"]).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Measures, score and verdict of every document.

    ``base_failed``: fewer than ten words, or more than a fifth of them repeated.  ``score`` is the mean log
    ratio, null without words.  ``kept`` is false if the base rules fail, else whether the score
    reaches the threshold.  Repeated rows are judged alike; ties with the threshold are kept.
    """
    spark = docs.sparkSession
    ratios = materialise(log_ratios(docs, trusted, doc_id, text, buckets), "ngram-ratios")
    m = measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    m = m.withColumn("_llr", ratios.scalar())
    add = lambda a, x: a + _at(F.col("_llr"), F.pmod(x, F.lit(buckets)).cast("int"))
    total = F.aggregate("_h", F.lit(0.0), add) + F.aggregate("_p", F.lit(0.0), add)
    n = F.col("_n_words")
    scored = m.select(
        "doc_id", n.alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("_n_repeat_words") > 20 * n)).alias("base_failed"),
        F.when(n > 0, F.round(total / (2 * n - 1), 9)).alias("score"))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
