"""Quality rules and a hashed n-gram log-likelihood ratio (DataFrame functions only).

Words and word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets are
counted: one from trusted documents, one from the whole corpus. A document's score is the mean over
its n-grams of log(trusted / corpus); documents below a threshold go, which all labelled documents set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.functions.windows import running
from bookreplay.llm.common import WORD_GAP, cut

#: Buckets of the hashed n-grams, as many as the published method uses.
BUCKETS = 10_000
SYMBOLS = "#*$%&|<>"
#: Mean log ratio (natural) below which a document goes where too few labels could say.
THRESHOLD = -0.15
#: Fewer documents of either label than this say nothing of the threshold.
LEAST = 20
#: Counts that the corpus lends to the trusted multinomial, so that few trusted documents decide little.
PRIOR = 20_000
#: Labels are joined by broadcast up to so many rows (of 64 neighbouring ids each), else by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty where there are none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def with_hashes(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_words``, ``_h``, the words' hashes, and ``_h2``, those of pairs of adjacent words.

    Each step is a column of its own: Spark then works it out once, however often it is used."""
    held = docs.withColumn("_words", words_of(text)).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return held.withColumn("_h2", joined(F.col("_h"), F.col("_h"), 1))


def joined(a: Column, b: Column, by: int) -> Column:
    """Hash of a[i] and b[i + by], as far as there is one."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + by, n), lambda x, y: F.xxhash64(x, y))


def label_bits(labels: DataFrame) -> DataFrame:
    """at, trusted, good, bad: which of the ids at * 64 to at * 64 + 63 are labelled good and not toxic, which good,
    toxic or not, and which of low quality and never good, as bits of a long each. Every id with a quality is in it."""
    each = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    tests = {"trusted": "max(quality = 1 and toxic = 0)", "good": "max(quality = 1)", "bad": "max(quality) = 0 and min(quality) = 0"}
    each = each.groupBy("doc_id").agg(*[F.coalesce(F.expr(x), F.lit(False)).alias(c) for c, x in tests.items()])
    bit = "shiftleft(1L, cast(doc_id & 63 as int))"
    bits = [F.expr(f"bit_or(if({c}, {bit}, 0L))").alias(c) for c in tests]
    return each.where("good or bad").groupBy(F.shiftright("doc_id", 6).alias("at")).agg(*bits)


def with_labels(docs: DataFrame, bits: DataFrame, how: str) -> DataFrame:
    """text, trusted, good and bad (0 or 1) of documents; with ``how`` inner perhaps of those alone that have a label."""
    held = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    bits = F.broadcast(bits) if bits.count() <= BROADCAST_ROWS else bits
    of = lambda c: F.expr(f"shiftright({c}, cast(_id & 63 as int)) & 1L").alias(c)
    return held.join(bits, F.shiftright("_id", 6) == F.col("at"), how).select("text", of("trusted"), of("good"), of("bad"))


def split_point(good: list[float], bad: list[float]) -> float:
    """Where the share of good scores at or above less the share of bad ones is largest; the middle of
    the gap below the lowest such score. ``split_of`` on lists."""
    scores = sorted([(x, 1 / len(good)) for x in good] + [(x, -1 / len(bad)) for x in bad])
    above, best, at = 0.0, 0.0, scores[0][0]
    below = scores[-1][0]
    for k in range(len(scores) - 1, -1, -1):
        above += scores[k][1]
        below = scores[k - 1][0] if k else scores[0][0]
        if above > best + 1e-12 and (not k or below < scores[k][0]):
            best, at = above, (scores[k][0] + below) / 2
    return round(at, 10)


def split_of(scores: DataFrame) -> float | None:
    """The split point of any number of rows (at, good, bad): scores in billionths, and whether (0 or 1) they are
    good or bad ones'. None where there are fewer than LEAST of either.

    Counts above a score are running sums by blocks of scores; one row reaches the driver."""
    n = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = cut(scores.groupBy("at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("good + bad > 0"), "scores")
    all_good, all_bad, lowest = sums.agg(n("good"), n("bad"), F.min("at")).first()
    if min(all_good or 0, all_bad or 0) < LEAST:
        return None
    down = sums.select("at", (-F.col("at")).alias("down"), "good", "bad", F.lit(0).alias("unit"))
    # A block is a span of scores, so it has no more rows than billionths, however many documents.
    above = running(down, {"good_above": ("sum", F.col("good")), "bad_above": ("sum", F.col("bad"))}, by="unit", order="down", inclusive=True, block=250_000, nulls=False)
    gain = F.col("good_above").cast("decimal(19,0)") * F.lit(int(all_bad)).cast("decimal(19,0)") - F.col("bad_above").cast("decimal(19,0)") * F.lit(int(all_good)).cast("decimal(19,0)")
    best = above.select(gain.alias("gain"), "at").where("gain > 0").agg(F.max(F.struct("gain", "at"))["at"]).first()[0]
    if best is None:
        return round(lowest / 1e9, 10)
    below = sums.where(F.col("at") < best).agg(F.max("at")).first()[0]
    return round((best + (best if below is None else below)) / 2e9, 10)


def threshold_of(docs: DataFrame, bits: DataFrame, counts: tuple[list[float], list[int]], buckets: int = BUCKETS) -> float:
    """The threshold that parts all documents labelled good, toxic or not, from all of low quality; THRESHOLD where
    there are fewer than LEAST documents of either.

    A trusted document is scored without its own counts, as one without a label would be: it would
    otherwise lie too high. Documents that the base rules drop say nothing here."""
    held = with_labels(docs, bits, "inner").where("good + bad > 0").select("text", F.col("trusted").alias("_good"), F.col("good").alias("_over"))
    held = with_windows(with_hashes(held, F.col("text"))).withColumn("_n", F.size("_h").cast("long"))
    # No null among the buckets, so that they are sorted as plain numbers.
    grams = F.transform(F.concat("_h", "_h2"), lambda h: F.coalesce(F.pmod(h, F.lit(buckets)).cast("int"), F.lit(0)))
    held = held.select("_good", "_over", failed_base().alias("_failed"), F.sort_array(grams).alias("_g"))
    held, score = with_score_without_own(held, *counts)
    at = F.round(score * 1e9).cast("long")
    # A filter here would be pushed into the steps above and repeat them; dropped rows count for nothing instead.
    found = split_of(held.select(at.alias("at"), F.expr("if(_failed, 0, _over)").alias("good"), F.expr("if(_failed, 0, 1 - _over)").alias("bad")))
    return THRESHOLD if found is None else found


def numbers(spark: SparkSession, xs: list[float]) -> Column:
    """A list as a scalar subquery. As literals its numbers would stand in every plan, and in every text of a
    plan, that the driver holds. A higher-order function takes no subquery, so the list is a column first, which
    is gone from a row once that is scored."""
    held = spark.range(1).select(F.split(F.lit(" ".join(map(repr, xs))), " ").cast("array<double>").alias("xs"))
    return cut(held, "numbers").scalar()


def with_score_without_own(rows: DataFrame, n: list[float], good: list[int]) -> tuple[DataFrame, Column]:
    """Rows with the numbers that the score takes, and that score: the mean log ratio of a row's buckets ``_g``, in
    order, where its own counts are taken off if ``_good`` is 1. Equal buckets are neighbours; a row's sum goes
    by bucket, so it never depends on other rows."""
    corpus, trusted_n = sum(n), sum(good)
    held = numbers(rows.sparkSession, [float(f"{g + PRIOR * x / corpus:.15e}") for g, x in zip(good, n)])
    share = numbers(rows.sparkSession, [float(f"{math.log(x / corpus):.15e}") for x in n])
    part = lambda g, c: c * (F.log(F.get("_held", g) - F.col("_good") * c) - F.get("_share", g))
    state = lambda g, c, total: F.struct(g.alias("g"), c.alias("c"), total.alias("total"))
    one, ends = F.lit(1).cast("long"), lambda acc: acc["total"] + F.when(acc["c"] > 0, part(acc["g"], acc["c"])).otherwise(0.0)
    step = lambda acc, g: F.when(g == acc["g"], state(g, acc["c"] + 1, acc["total"])).otherwise(state(g, one, ends(acc)))
    total = F.aggregate("_g", state(F.lit(-1), F.lit(0).cast("long"), F.lit(0.0)), step, ends)
    return rows.withColumns({"_held": held, "_share": share}), total / F.greatest(F.size("_g"), F.lit(1)) - F.log(F.lit(float(trusted_n + PRIOR)) - F.col("_good") * F.size("_g"))


def ratios_of(n: list[float], good: list[int]) -> list[float]:
    """log(trusted / corpus) of each bucket."""
    corpus, trusted_n = sum(n), sum(good)
    share = [x / corpus for x in n]
    return [math.log((g + PRIOR * p) / (trusted_n + PRIOR) / p) for g, p in zip(good, share)]


def gram_counts(docs: DataFrame, bits: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], list[int]]:
    """Counts of each bucket in the corpus and in all trusted documents; ``buckets`` numbers reach the driver, whatever the corpus.

    One pass over all documents; sums are made in each task before they are shuffled. The corpus has
    half a count more in every bucket, and the trusted side PRIOR counts spread as the corpus is, so
    empty tables give ratios of zero."""
    marked = with_labels(docs, bits, "left").withColumn("_good", F.expr("if(trusted = 1, 1, null)"))
    held = marked.select("_good", words_of(F.col("text")).alias("_words"))
    # Word by word in generated code, the next word read from the array beside it.
    each = held.select("_good", "_words", F.posexplode("_words").alias("_at", "_word"))
    after = F.get("_words", F.col("_at") + 1)
    pair = F.when(after.isNotNull(), F.xxhash64(F.xxhash64("_word"), F.xxhash64(after)))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    grams = each.select("_good", F.explode(F.array(bucket(F.xxhash64("_word")), bucket(pair))).alias("g")).where("g is not null")
    sums = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("_good").alias("good")).collect()
    n, good = [0.5] * buckets, [0] * buckets
    for r in sums:
        n[r["g"]] += r["n"]
        good[r["g"]] += r["good"]
    return n, good


def failed_base() -> Column:
    return (F.col("_n") < 10) | (100 * F.col("_repeat") > 20 * F.col("_n"))


def with_windows(held: DataFrame) -> DataFrame:
    """Adds ``_w5``, the hashes of all windows of five words, and ``_repeat``, the number of words inside
    windows that occur twice or more in the text."""
    n = F.greatest(F.size("_h2") - 3, F.lit(0))
    held = held.withColumn("_w5", F.transform(F.slice("_h2", 1, n), lambda x, i: F.xxhash64(x, F.get("_h2", i + 2), F.get("_h", i + 4))))
    unique = F.size(F.array_distinct("_w5")) == F.size("_w5")
    # Sorted by hash, equal windows are neighbours. Most texts repeat none and sort nothing.
    pairs = F.sort_array(F.transform("_w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = held.withColumn("_pairs", F.when(~unique, pairs))
    alike = lambda x, k: F.coalesce(F.get("_pairs", k)["h"] == x["h"], F.lit(False))
    hit = F.filter("_pairs", lambda x, k: alike(x, k - 1) | alike(x, k + 1))
    held = held.withColumn("_starts", F.sort_array(F.transform(hit, lambda x: x["i"])))
    # Each window covers what lies before the next one's start, at most its own width.
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate("_starts", zero, step, lambda acc: acc["n"])
    return held.withColumn("_repeat", F.coalesce(covered, F.lit(0).cast("long"))).drop("_w5", "_pairs", "_starts")


def lines_with_words(text: Column) -> Column:
    """Null where there is one line only."""
    return F.when(F.contains(text, F.lit("\n")), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))


def judge(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, carry: bool = False
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept
    for every row; with ``carry`` the row itself as a struct, and ``_kept``.

    A null text has no words and fails. Repeated rows are judged alike, row by row; nothing of a row
    is shuffled. The score of a text without words is zero, and a score at the threshold is kept. Texts of
    any length are read whole. An empty table gives no rows; other columns are not carried but inside the
    row, whatever their names. The labels set the threshold unless it is given."""
    bits = cut(label_bits(labels), "labels")
    counts = gram_counts(docs, bits, buckets)
    ratios = ratios_of(*counts)
    if threshold is None:
        threshold = threshold_of(docs, bits, counts, buckets)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.struct(*[F.col(c) for c in docs.columns]) if carry else F.lit(None)
    docs = docs.select(whole.alias("_row"), "doc_id", "text")
    held = with_windows(with_hashes(docs, F.col("text").cast("string"))).withColumn("_n", F.size("_h").cast("long"))
    held = held.withColumn("_ratios", numbers(docs.sparkSession, [float(f"{x:.9e}") for x in ratios]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, h: acc + F.get("_ratios", F.pmod(h, F.lit(buckets)).cast("int")))
    score = F.when(F.col("_n") > 0, (total("_h") + total("_h2")) / F.greatest(2 * F.col("_n") - 1, F.lit(1))).otherwise(0.0)
    failed = failed_base()
    held = held.withColumn("_score", score).withColumn("_lines", lines_with_words(text))
    kept = ~failed & (F.col("_score") >= threshold)
    if carry:
        # The row number keeps the filter above this projection: pushed below, it would repeat every
        # step's expression inside every later one.
        return held.select("_row", kept.alias("_kept"), F.monotonically_increasing_id().alias("_nth"))
    return held.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_n").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), failed.alias("base_failed"), F.col("_score").alias("score"), kept.alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judge(docs, labels, carry=True, **options).where("_kept and _nth >= 0").select("_row.*")
