"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule is a rate in hundredths; a document whose rate reaches the rule's
cutoff in its stratum is rejected. A cutoff is admissible if the labelled
holdout shows, by the exact binomial (Clopper-Pearson) bound, that it rejects
at most alpha / rules of the stratum's good documents, at the level delta
shared out over all rules, strata and cutoffs (Bonferroni). Of the admissible
ones that with the most rejected bad documents, less `price` times the good
ones, is taken, if that is positive; else the rule rejects nothing there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .native import count_chars, let, span, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"
#: Numerator and denominator of each rule's rate.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
}
STEPS = 100


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each word once."""

    def covered(starts: Column) -> Column:
        more = F.aggregate(span(1, F.size(starts) - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(more + 3)

    def repeated(order: Column) -> Column:
        twin = lambda x, k: (F.get(order, k)["h"] == x["h"]) & F.get(order, k).isNotNull()
        hit = F.filter(order, lambda x, k: F.when((k > 0) & twin(x, F.greatest(k - 1, F.lit(0))), True).otherwise(F.coalesce(twin(x, k + 1), F.lit(False))))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        grams = F.transform(span(0, F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(grams), repeated)

    return let(words, windows)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts that base and rules use, one row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("lang"), F.lit("")).alias("stratum"),
        counted.alias("w"),
        lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        count_chars(text, UPPER).cast("long").alias("n_upper"),
        count_chars(text, MARKS).cast("long").alias("n_marks"),
    ).select("doc_id", "stratum", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_marks")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, taken back by eight steps; x is 1 or more."""
    y = x + 8
    down = F.ln(x) + F.ln(x + 1) + F.ln(x + 2) + F.ln(x + 3) + F.ln(x + 4) + F.ln(x + 5) + F.ln(x + 6) + F.ln(x + 7)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable, for k below n p: terms from k downwards, to where they no longer count."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    terms = F.least(k, F.ceil(50 + 12 * F.sqrt(n * p * (1 - p))).cast("double")).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return top * F.aggregate(span(1, terms), start, step, lambda acc: acc["s"])


def cutoffs(labelled: DataFrame, alpha: float, delta: float, price: float) -> DataFrame:
    """stratum and the cutoff of each rule (STEPS + 1: none); labelled has stratum, quality and a rate column for each rule."""
    sizes = labelled.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("good"))
    rates = labelled.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rate")) for r in RULES])).alias("x")).select("stratum", "quality", "x.*")
    cells = rates.where("rate > 0").groupBy("stratum", "rule", "rate").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # a cell counts for every cutoff up to its rate: at most STEPS rows a cell, and STEPS cells a rule and stratum
    reached = cells.select("stratum", "rule", "good", "bad", F.explode(F.sequence(F.lit(1), F.col("rate").cast("int"))).alias("cutoff"))
    sums = reached.groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("k"), F.sum("bad").alias("bad"))
    share = alpha / len(RULES)
    strata = sizes.select(F.count("*")).scalar()
    tests = sums.join(sizes.withColumnRenamed("good", "n"), "stratum").withColumn("level", F.lit(delta) / (strata * len(RULES) * STEPS))
    ok = tests.where((F.col("k") < F.col("n") * share) & (F.col("bad") > F.col("k") * price))
    ok = ok.where(binomial_cdf(F.col("k"), F.col("n"), share) <= F.col("level"))
    best = ok.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("bad") - F.col("k") * price, F.col("cutoff"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.coalesce(F.max(F.when(F.col("rule") == r, F.col("cutoff"))), F.lit(STEPS + 1)).alias(r) for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, price: float = 3.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the rates of every row of docs.

    The stratum is docs.lang, a null one its own. Labels are labels.quality by
    doc_id; a doc_id with labels that differ is not used, repeated equal ones
    count once, null ones not at all. A null text has no words and fails the
    base, as any text under 50 words does or one with over half its words in
    repeated windows. Only documents that pass the base are a holdout.
    Repeated rows give a row each; with no labels the base alone decides. An
    empty table gives no rows."""
    rate = {r: F.when(F.col(d) > 0, F.least(F.lit(STEPS), F.floor(STEPS * F.col(n) / F.col(d)))).otherwise(0).cast("int") for r, (n, d) in RULES.items()}
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(text_statistics(docs).withColumn("base_failed", base).withColumns(rate))
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    labelled = stats.where("NOT base_failed").join(truth, "doc_id").select("stratum", "quality", *RULES)
    limits = cut(cutoffs(labelled, alpha, delta, price).withColumnsRenamed({r: f"{r}_limit" for r in RULES}))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(r) >= F.coalesce(f"{r}_limit", F.lit(STEPS + 1)))
    return stats.join(limits, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), *[F.col(r).alias(f"{r}_rate") for r in RULES])
