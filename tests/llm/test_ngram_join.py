import random

import numpy as np
import pytest

from tidewave.llm import ngram_join as J

from .helpers import no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    out, cur = [], ""
    for c in (t or "").translate(LOWER):
        if c in " \t\n\x0b\x0c\r":
            out, cur = out + [cur], ""
        else:
            cur += c
    return [w for w in out + [cur] if w]


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    """Families of near copies at many distances, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    while len(rows) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200]))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                i = rng.randrange(len(w) + 1)
                w[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [*w[i : i + 1], rng.choice(vocabulary)]])
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("k,percent,pivots,most,weight,close", [(3, 90, 16, 1000, 10**6, False), (5, 80, 16, 1000, 10**6, True), (3, 60, 2, 6, 10**6, True), (2, 70, 3, 4, 10**6, False), (2, 60, 2, 8, 300, True)])
def test_against_brute_force(spark, k, percent, pivots, most, weight, close):
    """Regions of any size: those that fit a task, those that pivots divide and those compared block by block."""
    rows = corpus(percent)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, pivots, most, weight, close)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows, k, percent)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = J.jaccard_components(docs, 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 3, 90)
    assert J.jaccard_components(no_docs(spark), 3, 90).count() == 0


def test_keep_one_each(spark):
    docs = odd_docs(spark)
    kept = J.keep_one_each(docs, 5, 80)
    assert kept.columns == docs.columns
    # of rows 5, 5 and 6, which are equal, one row stays; the other text of id 5 is no copy
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 5, 5, 7, 8, 9, None], key=repr)
    assert J.keep_one_each(no_docs(spark), 5, 80).count() == 0


def test_names_of_other_columns_cannot_clash(spark):
    docs = odd_docs(spark).withColumns({"__text": J.F.lit("own"), "__id": J.F.lit(-1), "__key": J.F.lit(None).cast("string"), "row": J.F.lit(2), "id": J.F.lit(3)})
    kept = J.keep_one_each(docs, 5, 80)
    assert kept.columns == docs.columns and kept.count() == 11
    assert all((r["__text"], r["__id"], r["__key"], r.row, r.id) == ("own", -1, None, 2, 3) for r in kept.collect())


def test_copies_are_one_row_before_anything_moves(spark):
    """A page copied thousands of times takes part in the exchange of blocks once."""
    page = " ".join(f"p{i}" for i in range(150))
    near = [(10_000 + i, page.replace(f"p{i * 3} ", "x ")) for i in range(40)]
    docs = spark.createDataFrame([(i, page) for i in range(4000)] + near + [(20_000, "alone " * 3)], "doc_id long, text string").repartition(6)
    _, summary = J._summarised(docs, 3, 90)
    assert J._once(summary).count() == 42 == J._once(summary).select("h1").distinct().count()
    assert "Exchange hashpartitioning(h1" not in J._once(summary)._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    members = J._members(summary, 90)
    assert members.groupBy("region").count().agg(J.F.max("count")).first()[0] <= 41
    few = spark.createDataFrame([(i, page) for i in range(J.MANY - 1)], "doc_id long, text string")  # not worth it
    assert J._once(J._summarised(few, 3, 90)[1]).count() == J.MANY - 1
    got = J.jaccard_components(docs, 3, 90).groupBy("component_id").count().collect()
    assert sorted((r.component_id, r["count"]) for r in got) == [(0, 4040), (20_000, 1)]


def test_districts_meet_whatever_the_blocks():
    """Two sets at the threshold share a district among their D + 1 rarest, in any order of rarity."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        percent = int(rng.choice([60, 80, 90]))
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        more = 0
        while 100 * (n - gone) >= percent * (n + more + 1) and rng.random() < 0.8:
            more += 1
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, more, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        order = lambda s, seed=int(rng.integers(1 << 30)): hash((int(s), seed))
        met = set()
        for s in (a, b):
            own = set()
            for _, v in J.districts(s, percent):
                own |= set(sorted(v.tolist(), key=order)[: J.spread(len(s), percent) + 1])
            met = met & own if met else own
        assert met


def test_overlaps():
    rng = np.random.default_rng(3)
    for m, top in ((1, 5), (2, 9), (40, 60), (90, 5000)):
        sets = [np.unique(rng.integers(0, top, rng.integers(1, 80))) for _ in range(m)]
        assert (J.overlaps(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets])[~np.eye(m, dtype=bool)].all()


@pytest.mark.parametrize("seed, k, percent, pivots, most", [(21, 3, 90, 16, 1000), (22, 2, 70, 2, 5), (23, 2, 60, 3, 10)])
def test_every_link_is_counted(spark, seed, k, percent, pivots, most):
    rows = corpus(seed, 90)
    # near copies of one component, all linked, and exact copies of one of them
    line = [f"q{i}" for i in range(120)]
    rows += [(5000 + i, " ".join(w for j, w in enumerate(line) if j != 10 * i)) for i in range(12)] + [(6000, " ".join(line)), (6001, " ".join(line).upper()), (6002, None), (None, " ".join(line))]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    linked = [[bool(a) and 100 * len(a & b) >= percent * len(a | b) for b in sets] for a in sets]
    want = sorted(((d, len(s), sum(row) - bool(s)) for (d, _), s, row in zip(rows, sets, linked)), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs, k, percent, pivots, most).select("doc_id", "n_shingles", "n_links").collect()), key=repr) == want
    pairs = {(min(i, j), max(i, j)) for i, a in enumerate(set(sets)) for j, b in enumerate(set(sets)) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)}
    links = J.jaccard_links(docs, k, percent, pivots, most)
    assert links.count() == len(pairs) == links.distinct().count() and links.where("a >= b").count() == 0
