"""Moments of persons, and what every fold makes of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import split, stats

SIZE, PLACES, GROUPS = 7, 10, 3


def windows_of(seed, persons, offset=0.0, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(persons):
        for label in range(3):
            if gaps and (p + label) % 4 == 0:
                continue  # not everyone does everything
            for _ in range(int(rng.integers(1, 4))):
                rows.append((f"p{p:02}", label, (offset + rng.normal(size=PLACES)).tolist(), rng.uniform(0.1, 2, PLACES).tolist(), (rng.uniform(0, 3, SIZE) + label).tolist()))
    return rows


def loops(rows, persons):
    z, best = {}, {}
    for k in range(persons):
        train = [r for r in rows if int(r[0][1:]) not in (k, (k + 1) % persons)]
        mean, var, x, y = (np.array([r[i] for r in train]) for i in (2, 3, 4, 1))
        if not len(train):
            continue
        z[k] = mean.mean(0), np.sqrt(var.mean(0) + mean.var(0)) + 1e-8
        between = sum((y == c).sum() * (x[y == c].mean(0) - x.mean(0)) ** 2 for c in set(y))
        score = between / (sum((y == c).sum() * x[y == c].var(0) for c in set(y)) + 1e-12)
        best[k] = score, [int(g[np.argmax(score[g])]) for g in np.array_split(np.arange(SIZE), GROUPS)]
    return z, best


SCHEMA = "person string, label int, mean array<double>, var array<double>, x array<double>"


@pytest.mark.parametrize("seed,persons,offset", [(0, 3, 0.0), (1, 6, 0.0), (2, 11, 1e6)])
def test_every_fold_equals_its_own_windows(spark, seed, persons, offset):
    rows = windows_of(seed, persons, offset)
    df = spark.createDataFrame(rows, SCHEMA)
    people = spark.createDataFrame([(f"p{p:02}",) for p in range(persons)], "person string")
    zscore, scores, chosen = stats.fold_statistics(stats.person_moments(df), split.person_ranks(people, "person"), SIZE, GROUPS)
    z, best = loops(rows, persons)
    got = {(r.fold, r.place): r for r in zscore.collect()}
    assert len(got) == len(z) * PLACES
    for k, (mu, sigma) in z.items():
        assert [got[k, i].mu for i in range(PLACES)] == pytest.approx(mu.tolist(), rel=1e-12)
        assert [got[k, i].sigma for i in range(PLACES)] == pytest.approx(sigma.tolist(), rel=1e-6)
    own = {(r.fold, r["sub"]): r.score for r in scores.collect()}
    picked = {(r.fold, r.grp): r["sub"] for r in chosen.collect()}
    for k, (score, subs) in best.items():
        assert [own[k, i] for i in range(SIZE)] == pytest.approx(score.tolist(), rel=1e-9)
        assert [picked[k, g] for g in range(GROUPS)] == subs


def test_a_person_without_windows_has_a_fold(spark):
    rows = [r for r in windows_of(4, 5, gaps=False) if r[0] != "p02"]
    people = spark.createDataFrame([(f"p{p:02}",) for p in range(5)], "person string")
    zscore, _, _ = stats.fold_statistics(stats.person_moments(spark.createDataFrame(rows, SCHEMA)), split.person_ranks(people, "person"), SIZE, GROUPS)
    z, _ = loops(rows, 5)
    got = {(r.fold, r.place): r.mu for r in zscore.collect()}
    assert len(got) == 5 * PLACES and all(got[k, 3] == pytest.approx(z[k][0][3]) for k in range(5))


def test_windows_become_rows_once(spark, tmp_path):
    """No row for each fold and window: windows are exploded below the first aggregate, folds above it, and tables read moments alone."""
    df = spark.createDataFrame(windows_of(5, 9), SCHEMA)
    moments = stats.person_moments(df)
    plan = moments._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Aggregate") < plan.index("Generate posexplode")
    assert moments.count() <= 9 * 3 * PLACES
    moments.write.parquet(str(tmp_path / "m"))
    people = df.select("person").distinct()
    for table in stats.fold_statistics(spark.read.parquet(str(tmp_path / "m")), split.person_ranks(people, "person"), SIZE, GROUPS):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        folds = plan.index("Generate explode")
        assert "posexplode" not in plan and "Aggregate" in plan[folds:]


def test_large_means_do_not_cancel(spark):
    rows = [(f"p{p:02}", 0, [1e9 + p] * PLACES, [1e-3] * PLACES, [1.0] * SIZE) for p in range(4) for _ in range(3)]
    people = spark.createDataFrame([(f"p{p:02}",) for p in range(4)], "person string")
    zscore, _, _ = stats.fold_statistics(stats.person_moments(spark.createDataFrame(rows, SCHEMA)), split.person_ranks(people, "person"), SIZE, GROUPS)
    for r in zscore.where(F.col("place") == 0).collect():
        left = [p for p in range(4) if p not in (r.fold, (r.fold + 1) % 4)]
        assert r.sigma == pytest.approx(np.sqrt(1e-3 + np.var(left)), rel=1e-6) and r.mu == 1e9 + np.mean(left)
