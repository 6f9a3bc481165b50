"""Toxicity by a learnt lexicon, a Levenshtein automaton over its trie, and context windows.

Words that labelled toxic texts use more often than chance allows, with a
correction for the number of words tried, make a lexicon. Its trie is intersected with the Levenshtein automaton of distance 1;
the product is made deterministic state by state, as words ask for it, so most
words die after a few characters. Each hit is weighed by its window: quotation
marks and words of reporting speak for quotation, address and shouting for
abuse. A logistic regression over these sums gives the score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The classifier is fitted on at most so many labelled rows, those of smallest hash.
MAX_LABELLED = 20_000
#: Words shorter than this must match exactly.
FUZZY_FROM = 5
WINDOW = 6
#: The expected share of the lexicon that chance put there.
LEXICON_ERROR = 0.05
#: Words of fewer labelled texts are not tried.
LEAST_TEXTS = 3
# Cue words of a context window, in English, German, Spanish and French.
REPORTING = frozenset(
    "said says wrote writes called quoted quote quotes word term phrase means meaning definition allegedly "
    "sagte sagt schrieb schreibt nannte zitierte zitat wort begriff ausdruck bedeutet bedeutung angeblich "
    "dijo dice escribió escribe llamó citó cita palabra término frase significa significado supuestamente "
    "dit disait écrit écrivait appelé cité citation mot terme expression signifie sens prétendument".split()
)
ADDRESS = frozenset(
    "you your youre u are is such total utter absolute complete "
    "du dich dir dein deine bist ihr euch so totaler völliger "
    "tú tu te eres usted ustedes vosotros tan total completo "
    "tu toi ton ta es vous votre êtes tellement complet".split()
)
QUOTES = "\"'“”‘’«»„`"
FEATURES = 9


class Lexicon:
    """word -> weight, matched within one edit. State 0 is dead, state 1 the start."""

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for w in words:
            at = 0
            for c in w:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                at = self.children[at][c]
            self.ends[at] = w
        self.alphabet = frozenset("".join(words))
        self.sets: list[frozenset] = [frozenset(), self._closed({(0, 0)})]
        self.names = {s: i for i, s in enumerate(self.sets)}
        self.steps: list[dict[str, int]] = [{}, {}]
        self.cache: dict[str, tuple[str, int] | None] = {}

    def _closed(self, states: set) -> frozenset:
        return frozenset(states | {(n, 1) for at, e in states if not e for n in self.children[at].values()})

    def _step(self, state: int, c: str) -> int:
        out = set()
        for at, e in self.sets[state]:
            if c in self.children[at]:
                out.add((self.children[at][c], e))
            if not e:
                out.add((at, 1))
                out.update((n, 1) for n in self.children[at].values())
        key = self._closed(out)
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        self.steps[state][c] = self.names[key]
        return self.names[key]

    def match(self, word: str) -> tuple[str, int] | None:
        """(lexicon word, edits) of the nearest entry within reach, else None."""
        state = 1
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
            if not state:
                return None
        best = min(((e, -self.words[self.ends[at]], self.ends[at]) for at, e in self.sets[state] if at in self.ends), default=None)
        if best is None or best[0] and (len(word) < FUZZY_FROM or len(best[2]) < FUZZY_FROM):
            return None
        return best[2], best[0]

    def __call__(self, token: str) -> tuple[str, int] | None:
        try:
            return self.cache[token]
        except KeyError:
            pass
        if len(self.cache) > 200_000:
            self.cache.clear()
        word = plain(token)
        hit = self.cache[token] = self.match(word) if word else None
        return hit


def plain(token: str) -> str:
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b].lower()


def features(text: str, lexicon: Lexicon) -> list[float]:
    tokens = text.split()
    hits = [(i, h) for i, t in enumerate(tokens) if (h := lexicon(t))]
    if not hits:
        return [0.0] * FEATURES
    abuse = quoted = fuzzy = shout = top = total = 0.0
    for i, (word, edits) in hits:
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        cues = [plain(t) for t in around]
        marks = sum(t[0] in QUOTES or t[-1] in QUOTES for t in around)
        quoting = tokens[i][0] in QUOTES or tokens[i][-1] in QUOTES or marks > 1
        told = sum(c in REPORTING for c in cues)
        weight = lexicon.words[word] * (1 - 0.3 * edits)
        share = (1 + quoting + told) and (quoting + told) / (1 + quoting + told)
        quoted += weight * share
        abuse += weight * (1 - share) * (1 + 0.25 * any(c in ADDRESS for c in cues))
        fuzzy += bool(edits)
        shout += tokens[i].isupper() or "!" in tokens[i]
        top, total = max(top, weight), total + weight
    return [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), math.log1p(shout), top, math.log1p(len({w for _, (w, _) in hits})), math.log1p(100 * len(hits) / len(tokens)), math.log1p(total)]


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of the four learning folds, at most MAX_LABELLED, with texts."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (fold != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # a doc_id that stands in several rows counts once
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _word_rows(batches):
    for batch in batches:
        words, toxic = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {w for x in set((t or "").split()) if (w := plain(x))}
            words += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def learn_lexicon(sample: DataFrame, pos: int, neg: int) -> dict[str, float]:
    """The words that toxic labelled texts use more often than chance allows; the sample bounds their number.

    If a word fell on texts by chance, a or more of its a + b texts would be toxic with
    probability exp(-(a + b) KL(a / (a + b), pos / (pos + neg))) at most (Chernoff). The
    largest bound is taken at which the words tried would give LEXICON_ERROR of those
    found by chance (Benjamini and Hochberg's rule on a grid of exponents).
    """
    counts = sample.mapInArrow(_word_rows, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    n, base = F.col("a") + F.col("b"), pos / (pos + neg)
    clean = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / (1 - base))).otherwise(0.0)
    strange = F.when(F.col("a") / n > base, F.col("a") * F.log(F.col("a") / n / base) + clean).otherwise(0.0)
    weight = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    words = cut(counts.where(n >= LEAST_TEXTS).select("word", weight.alias("w"), strange.alias("strange")))
    steps = {r.step: r["count"] for r in words.groupBy(F.least(F.floor(F.col("strange") * 4), F.lit(400)).cast("int").alias("step")).count().collect()}
    tried = sum(steps.values())
    passed = [step for step in range(1, 401) if tried * math.exp(-step / 4) <= LEXICON_ERROR * sum(c for s, c in steps.items() if s >= step)]
    if not passed:
        return {}
    return {r.word: r.w for r in words.where(F.col("strange") >= passed[0] / 4).orderBy("word").collect()}


def _feature_rows(words: dict[str, float]):
    def run(batches):
        lexicon = Lexicon(words)
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression, intercept last, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(lexicon, weights); without both classes no lexicon, and a constant score."""
    sample = _sampled(docs, labels)
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos or pos == n:
        share = pos / (n + 1)
        return {}, [0.0] * FEATURES + [math.log(share / (1 - share)) if share else -30.0]
    words = learn_lexicon(sample, pos, n - pos)
    rows = sample.mapInArrow(_feature_rows(words), "x array<double>, toxic int").collect()
    return words, fit(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)).tolist()


def _score(words: dict[str, float], weights: list[float]):
    def run(batches):
        lexicon = Lexicon(words)
        w = np.array(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = np.array([features(t or "", lexicon) for t in b.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(x[:, 1] - x[:, 2])], ["doc_id", "score", "abuse_margin"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, abuse_margin; a row for each input row.

    Only text is scored; labels (doc_id, toxic, ...) of the rows whose
    crc32(doc_id as text) mod 5 is 0 are never used. Null texts count as empty;
    repeated rows stay and equal texts have equal scores; null ids are not held out;
    repeated labels count once; very long texts are scored whole; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(_score(*learn(docs, labels)), "doc_id long, score double, abuse_margin double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "abuse_margin")
