"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose feature lies beyond a cutoff. The rules, each from
its laxest cutoff to its strictest, make one sequence of steps fixed beforehand,
the surest signs of junk first; step s rejects whatever a step up to s rejects, so
each text has one number, the first step at which it goes, and the rejected sets
grow with s. Labelled texts that pass the base rule calibrate: for every stratum the
good texts rejected at each step are counted, and the steps are tested in order
while the exact binomial test rejects "the share of good texts lost by all rules
together is alpha or more". Fixed-sequence testing needs no correction over the
steps of a stratum; Bonferroni over the strata makes the level delta / strata.
The last step passed is the verdict; where not even the first passes, the rules
reject nothing. So with probability 1 - delta the rules together lose at most a
share alpha of the good texts of every stratum at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Strata up to this many are sent to all executors.
BROADCAST_STRATA = 10_000
#: Up to so many labelled ids (a long each) are sent to all executors; more are shuffled.
BROADCAST_LABELLED = 2_000_000
#: At most this share of a stratum's good texts may be lost by all rules together ...
ALPHA = 0.02
#: ... with this probability of losing more in any stratum.
DELTA = 0.05
WINDOW = 8
#: (rule, feature as SQL, cutoffs from lax to strict) in the order of the steps: a text is rejected if the feature is larger.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", (0.8, 0.4, 0.2, 0.1, 0.05)),
    ("long_words", "word_chars / greatest(n_words, 1)", (12.0, 10.0, 9.0, 8.0, 7.0)),
    ("short_words", "-word_chars / greatest(n_words, 1)", (-2.0, -2.5, -3.0, -3.5, -4.0)),
    ("duplicate_lines", "n_dup_lines / greatest(n_words, 1)", (0.1, 0.05, 0.02, 0.01, 0.005)),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.2, 0.15, 0.1, 0.05, 0.02)),
    ("few_words", "-n_words", (-25.0, -30.0, -40.0, -50.0, -60.0)),
)
STEPS = tuple((feature, cut) for _, feature, cuts in RULES for cut in cuts)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""

    def covered(at: Column) -> Column:
        # at: sorted positions of repeated windows; the union of [p, p + WINDOW)
        gaps = F.zip_with(F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, g: s + g) + WINDOW)

    def positions(keys: Column) -> Column:
        # windows sorted by hash; those equal to a neighbour are repeated
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.array_sort(F.transform(F.filter(F.transform(p, lambda x, j: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)) | F.when(j > 0, F.get(p, j - 1)["h"] == x["h"]).otherwise(False)).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))

    def by_windows(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(positions(keys), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows, by_windows))


def features(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop(*FEATURES, "kept", "__q")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    own = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = docs.withColumn("__q", own)
    return out.select(*(out[c] for c in docs.columns), "__q.w.n_words", "__q.w.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.w.n_repeat_words").withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), from the largest term downwards, for k < n p; otherwise 1.

    Log factorials are Stirling's series, exact to 1e-10. Beyond 20,000 terms
    the rest is bounded by a geometric series, so the value never is too small.
    """

    def logf(x: Column) -> Column:
        y = x + 1.0
        z = y + 7  # shifted up, where the series is exact
        series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
        return series - F.log(y * (y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6))

    top = F.exp(logf(n) - logf(k) - logf(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.sequence(F.lit(1), F.least(k, F.lit(20_000)).cast("int"))

    def add(s: Column, j: Column) -> Column:
        i = k - j + 1
        term = s["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.when(k < 1, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))).otherwise(F.aggregate(steps, start, add))
    rest = F.greatest(k - 20_000, F.lit(0.0))
    ratio = rest / (n - rest + 1) * odds
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (total["sum"] + F.when(rest > 0, total["term"] * ratio / (1 - ratio)).otherwise(0.0))))


def first_step() -> Column:
    """The first step at which a measured text goes; one more than there are for a text that none rejects."""
    return F.expr("case " + " ".join(f"when {feature} > {cut} then {i}" for i, (feature, cut) in enumerate(STEPS, 1)) + f" else {len(STEPS) + 1} end")


def labelled_good(labels: DataFrame) -> DataFrame:
    """doc_id of the rows that all their labels call good."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def choose_steps(good: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """__stratum, __step: the last step passed in each stratum; good: features of the good holdout with the stratum."""
    holdout = good.where("not base_failed").where(F.col(stratum).isNotNull()).withColumn("__first", first_step())
    lost = F.array(*(F.count_if(F.col("__first") <= i).cast("double") for i in range(1, len(STEPS) + 1)))
    counts = holdout.groupBy(F.col(stratum).alias("__stratum")).agg(F.count(F.lit(1)).cast("double").alias("n"), lost.alias("lost"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("strata"))))  # one row
    steps = counts.select("__stratum", "n", "strata", F.posexplode("lost").alias("at", "k"))
    # the tail grows with k and k with the step, so the last step that passes has only passes before it
    passed = steps.where(binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))
    return passed.groupBy("__stratum").agg(F.max(F.col("at") + 1).alias("__step"))


def _bounded(steps: DataFrame) -> DataFrame:
    steps = cut(steps)
    return F.broadcast(steps) if steps.count() <= BROADCAST_STRATA else steps


def apply_steps(scored: DataFrame, steps: DataFrame, stratum: str = "lang") -> DataFrame:
    joined = scored.join(steps, F.col(stratum) == F.col("__stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (first_step() > F.coalesce("__step", F.lit(0)))).drop("__stratum", "__step")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the stratum, the features, base_failed and kept; a row for each input row.

    Null texts have no words and fail the base rule; null or unlabelled strata
    have no steps of their own, so only the base rule judges them. Labels
    without a text, and null labels, are ignored; a doc_id labelled twice counts
    as good only if both labels say so. Repeated rows stay, equal features get
    equal verdicts, very long texts are measured whole, and an empty table gives
    no rows.
    """
    measured = cut(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum, "text")).drop("text"))
    return apply_steps(measured, _bounded(choose_steps(measured.join(labelled_good(labels), "doc_id", "left_semi"), stratum)), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    ids, texts = cut(labelled_good(labels)), docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum, "text")
    # only labelled rows calibrate; they are measured where they lie, or, beyond what may be sent to all tasks, all are and features move: never texts
    good = features(texts.join(F.broadcast(ids), "doc_id", "left_semi")) if ids.count() <= BROADCAST_LABELLED else features(texts).drop("text").join(ids, "doc_id", "left_semi")
    steps = _bounded(choose_steps(good, stratum))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(stratum).alias(stratum), F.col("text").alias("text"))
    return apply_steps(features(rows), steps, stratum).where("kept").select("__row.*")
