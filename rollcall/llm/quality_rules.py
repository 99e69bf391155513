"""Quality rules: repetition and symbol counts, and an n-gram likelihood ratio.

Method.  The one-word and two-word n-grams of a text are hashed into
``BUCKETS`` buckets.  Two multinomials over the buckets are counted, one over
the trusted target documents and one over the whole raw corpus, and smoothed by
``SMOOTHING`` pseudo-counts each on the scale of the trusted counts.  A
document's score is the log-likelihood ratio of its n-grams between the two,
divided by their number.  It is kept if the score is at least ``MIN_SCORE``
(its n-grams are on average 0.86 times as likely among the trusted, or more)
and no base rule fails: a fixed threshold, no random draw.

Only DataFrame functions run here.  Counting and scoring explode n-grams but
aggregate them within the task before any shuffle: the counts shuffle at most
``BUCKETS`` rows per task and the scores one row per document.  The ratio
table has ``BUCKETS`` rows, which bounds its broadcast.

Repeated windows are found inside the row: window hashes are sorted and
compared with their neighbours, so a text of any length costs n log n.

Defined results: null or empty text has 0 words, no n-grams, and fails the
base rules; null, repeated or shared doc_ids give each row the result of its
own text; without trusted documents all ratios are 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import SPACE_RUN, WORD, split_words
from rollcall.session import durable

BUCKETS = 1 << 18
SMOOTHING = 10.0
MIN_SCORE = -0.15
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _windows(hashes: Column, size: int) -> Column:
    starts = F.when(F.size(hashes) >= size, F.slice(hashes, F.lit(1), F.size(hashes) - size + 1))
    # the hash of the elements one by one is that of their array, which need not be made
    return F.transform(
        F.coalesce(starts, F.array().cast("array<bigint>")),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + step) for step in range(1, size)]),
    )


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of the n-grams of one and two words, from word hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(_windows(hashes, 2), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return F.concat(one, pairs)


def _word_hashes(docs: DataFrame, *columns: str) -> DataFrame:
    words = docs.select(*columns, split_words(F.col("text")).alias("_w"))
    return words.select(*columns, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))


def ratio_table(docs: DataFrame, trusted: Column, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, ratio): log of trusted over raw probability; ``trusted`` marks rows of ``docs``.

    Buckets that no document has are missing; no document can ask for them.
    """
    flagged = docs.withColumn("_trusted", F.coalesce(trusted, F.lit(False)).cast("long"))
    hashed = _word_hashes(flagged, "_trusted")
    grams = hashed.select("_trusted", F.explode(ngram_buckets(F.col("_h"), buckets)).alias("bucket"))
    counts = durable(
        grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("good")), "ngrams"
    )
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    # raw counts on the scale of the trusted ones: what is rare in both says little either way
    scale = float((total["good"] or 0) / (total["raw"] or 1))
    ratio = F.log((F.col("good") + smoothing) / (F.col("raw") * scale + smoothing))
    return counts.select("bucket", ratio.alias("ratio"))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with _h (word hashes) and the base counts as long columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    counted = docs.select(
        *docs.columns,
        split_words(F.col("text")).alias("_w"),
        F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    hashed = counted.select(
        "*",
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    ).drop("_lines", "_w")
    windows = hashed.select("*", _windows(F.col("_h"), WINDOW).alias("_g"))
    # most texts repeat no window; only the others are sorted
    placed = windows.select(
        "*",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("_s"),
    ).drop("_g")
    last = F.size("_s") - 1
    twice = F.filter(
        "_s",
        lambda s, i: ((i > 0) & (F.col("_s")[F.greatest(i - 1, F.lit(0))]["g"] == s["g"]))
        | ((i < last) & (F.col("_s")[F.least(i + 1, last)]["g"] == s["g"])),
    )
    starts = placed.select("*", F.sort_array(F.transform(twice, lambda s: s["i"])).alias("_p")).drop("_s")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    words = F.aggregate(
        "_p",
        begin,
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n"), (p + WINDOW).alias("to")),
        lambda a: a["n"],
    )
    return starts.select(
        "*",
        F.size("_h").cast("long").alias("n_words"),
        F.coalesce(words, F.lit(0).cast("long")).alias("n_repeat_words"),
    ).drop("_p")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept.

    ``ratios`` has at most ``buckets`` rows, hence the broadcast.
    """
    based = base_counts(docs.select("doc_id", "text")).drop("text")
    # numbers rows only to group their n-grams again; no result depends on it
    numbered = based.withColumn("_row", F.monotonically_increasing_id())
    grams = numbered.select(
        "_row",
        "doc_id",
        *BASE,
        F.explode_outer(ngram_buckets(F.col("_h"), buckets)).alias("bucket"),
    )
    scored = grams.join(F.broadcast(ratios), "bucket", "left").groupBy("_row", "doc_id", *BASE)
    mean = F.sum("ratio") / F.count("bucket")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )
    return scored.agg(mean.alias("score")).select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        "score",
        (~failed & (F.coalesce("score", F.lit(0.0)) >= min_score)).alias("kept"),
    )
