"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens are summed by cell (source, language, topic). The cells' weights are
raked in turn until their three marginals meet the targets; a document's
probability is in proportion to its cell's weight per token, at most 1, and
scaled so that the expected tokens meet the budget. DataFrame functions only:
sums over the cells by marginal, and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Up to this many cells are raked in one partition and sent to all executors (100 bytes each); more are summed and joined by shuffles.
SMALL_CELLS = 50_000
ROUNDS, PASSES, TOLERANCE = 6, 20, 1e-10
#: Target shares of languages before they are scaled to those that occur; others get OTHER.
LANGUAGES = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
OTHER = 0.05
#: Sources and topics get shares in proportion to their tokens to these powers.
SOURCE_POWER, TOPIC_POWER = 0.5, 0.7
CELL = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def form(text: Column, n: Column) -> Column:
    """A text's topic by its form."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(text, F.lit("[#*$%&<>]"))
    return (
        F.when(text.contains(" | "), "table").when(marks * 5 > n, "markup").when(n < 100, "short").when(n < 1000, "medium").otherwise("long")
    )


def chance(doc_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on the id alone; null counts as an id of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") / float(2**48)


def _targets(cells: DataFrame, c: str) -> DataFrame:
    """(value, to): the share that each value of a marginal should have; a row for each value."""
    sums = cells.groupBy(c).agg(F.sum("tokens").cast("double").alias("tokens"))
    power = {"source": SOURCE_POWER, "topic": TOPIC_POWER}.get(c)
    raw = F.pow("tokens", F.lit(power)) if power else F.coalesce(*(F.when(F.col(c) == k, v) for k, v in LANGUAGES.items()), F.lit(OTHER))
    sums = cut(sums.select(c, raw.alias("raw")))
    return sums.select(c, (F.col("raw") / F.lit(sums.agg(F.sum("raw")).first()[0])).alias(f"__to_{c}"))


def rake(cells: DataFrame) -> DataFrame:
    """cells (source, lang, topic, tokens) plus weight, which sums to 1 and meets the three marginals.

    Targets that the cells cannot meet together are met as nearly as raking can in the rounds it has.
    Up to SMALL_CELLS cells are one partition with window sums; of more, every turn sums one marginal by groupBy.
    """
    cells = cells.where("tokens > 0")
    n = cells.count()
    if not n:
        return cells.select(*CELL, "tokens", F.lit(0.0).alias("weight"))
    total = cells.agg(F.sum("tokens")).first()[0]
    targets = {c: _targets(cells, c) for c in CELL}
    return (_rake_small if n <= SMALL_CELLS else _rake_wide)(cells, total, targets).select(*CELL, "tokens", "weight")


def _rake_small(cells: DataFrame, total: int, targets: dict[str, DataFrame]) -> DataFrame:
    for c in CELL:
        cells = cells.join(targets[c], c)
    cells = cut(cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))).coalesce(1)
    for _ in range(PASSES):
        for _ in range(ROUNDS):
            for c in CELL:
                cells = cells.withColumn("weight", F.col("weight") * F.col(f"__to_{c}") / F.sum("weight").over(Window.partitionBy(c)))
        errors = [F.abs(F.sum("weight").over(Window.partitionBy(c)) - F.col(f"__to_{c}")).alias(f"e{c}") for c in CELL]
        cells = cut(cells).coalesce(1)
        if (cells.select(F.greatest(*errors).alias("e")).agg(F.max("e")).first()[0] or 0) < TOLERANCE:
            break
    return cells


def _rake_wide(cells: DataFrame, total: int, targets: dict[str, DataFrame]) -> DataFrame:
    """A cell's weight is its tokens' share times a factor for each marginal; a turn sets the factors of one."""
    factor = {c: targets[c].select(c, F.lit(1.0).alias(f"__by_{c}")) for c in CELL}

    def weighted() -> DataFrame:
        out = cells
        for c in CELL:
            out = out.join(factor[c], c)
        by = F.lit(1.0)
        for c in CELL:
            by = by * F.col(f"__by_{c}")
        return out.withColumn("weight", F.col("tokens") / F.lit(float(total)) * by)

    for _ in range(PASSES * ROUNDS):
        error = 0.0
        for c in CELL:
            sums = cut(weighted().groupBy(c, f"__by_{c}").agg(F.sum("weight").alias("sum")).join(targets[c], c))
            error = max(error, sums.agg(F.max(F.abs(F.col("sum") - F.col(f"__to_{c}")))).first()[0])
            drop(factor[c])
            factor[c] = sums
            factor[c] = cut(sums.select(c, (F.col(f"__by_{c}") * F.col(f"__to_{c}") / F.col("sum")).alias(f"__by_{c}")))
            drop(sums)
        if error < TOLERANCE:
            break
    return cut(weighted())


def probabilities(raked: DataFrame, share: float) -> DataFrame:
    """raked plus prob: min(1, c * weight / tokens), with c such that the expected tokens are `share` of all.

    c only grows while cells reach 1 and leave their surplus to the others, so the turns end.
    """
    cells = raked.withColumn("per", F.col("weight") / F.col("tokens"))
    scale, full = 0.0, -1
    while True:
        at_one = F.lit(scale) * F.col("per") > 1
        r = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(at_one, F.col("tokens"))).alias("used"), F.sum(F.when(~at_one, F.col("weight"))).alias("left"), F.count_if(at_one).alias("full")).first()
        if r["all"] is None or r.full == full:
            break
        full = r.full
        scale = max(scale, (r["all"] * share - (r.used or 0)) / max(r.left or 0.0, 1e-300))
    prob = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(scale) * F.col("per")))
    return cells.select(*CELL, "per", prob.alias("prob"))


def mix(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """docs plus topic, n_tokens, weight, prob and kept; a row for each input row.

    weight is the share of the mixture that the document should make up, prob
    its chance, kept the draw, which depends on doc_id alone. Null sources and
    languages are cells of their own; texts without tokens, or null, have weight
    0 and are not kept. Columns of docs with the outputs' names are replaced. Rows of
    one doc_id share a draw; very long texts are counted whole; an empty table gives no rows.
    """
    docs = docs.drop("topic", "n_tokens", "weight", "prob", "kept")
    rows = docs.withColumn("n_tokens", tokens(F.col("text")))
    rows = rows.withColumn("topic", form(F.col("text"), F.col("n_tokens")))
    return _drawn(rows, _cells(rows), share)


def _cells(rows: DataFrame) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CELL]
    return cut(rows.select(*named, "n_tokens").groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")))


def _drawn(rows: DataFrame, cells: DataFrame, share: float) -> DataFrame:
    found = cut(probabilities(rake(cells), share))
    found = found.select(*(F.col(c).alias(f"__{c}") for c in CELL), "per", "prob")
    found = F.broadcast(found) if found.count() <= SMALL_CELLS else found
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"__{c}") for c in CELL]
    out = rows.join(found, same[0] & same[1] & same[2], "left").drop(*(f"__{c}" for c in CELL))
    prob = F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("weight", F.coalesce(F.col("per") * F.col("n_tokens"), F.lit(0.0))).drop("per").withColumn("prob", prob).withColumn("kept", chance(F.col("doc_id")) < F.col("prob"))


def mixed_ids(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """mix() without texts: doc_id, source, lang, topic, n_tokens, weight, prob, kept; texts are read once."""
    n = tokens(F.col("text"))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", n.alias("n_tokens"), form(F.col("text"), n).alias("topic")))
    return _drawn(rows, _cells(rows), share).select("doc_id", *CELL, "n_tokens", "weight", "prob", "kept")


def keep_mixed(docs: DataFrame, share: float) -> DataFrame:
    """The rows of docs that mix() draws, columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "lang", "text")
    return mix(rows, share).where("kept").select("__row.*")
