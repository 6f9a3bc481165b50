"""Quality rules, URL filters, mixing, licenses: brute force, oracles at sf0.001, odd rows, plans without Python."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewave.llm import license_scan, mixing, quality_rules, queries, sql, url_filter

from .helpers import labels, no_docs, odd_docs

D = "/root/testdata/sf0.001"


def normal(v):
    return "null" if v is None else f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        db.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    r = db.sql(sql.ORACLE[name])
    cols, want = r.columns, r.fetchall()
    assert sorted(cols) == sorted(df.columns)
    keys = sorted(cols)
    assert sorted(tuple(normal(x[k]) for k in keys) for x in df.collect()) == sorted(tuple(normal(x[cols.index(k)]) for k in keys) for x in want)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_url_filters", "op6_mixing", "op10_licenses"])
def test_native_plans_hold_no_python(spark, name):
    plan = queries.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_quality(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in wins if wins.count(x) > 1} if len(wins) < 3000 else set()
    inside = {i + j for i, x in enumerate(wins) if x in twice for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_features(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n", " \t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "line\nline\n \n \nother\nline", "𝔘é# *|<>"]
    for _ in range(120):
        t = rng.choices(["a", "b", "c", "dd", "#", "\n"], k=rng.randrange(60))
        texts.append(" ".join(t + t[: rng.randrange(20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.features(docs).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 50, 400, 5000, 200_000) for k in (0, 1, 2, 7, 60, 90, 3000, 3900) if k <= n]
    df = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double")
    for r in df.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        n, k = int(r.n), int(r.k)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98) for i in range(k + 1)]
        want = min(1.0, math.fsum(map(math.exp, logs))) if k < n * 0.02 else 1.0
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_steps_limit_false_rejections(spark):
    """Good texts have few symbols in one stratum and many in the other; only the first gets the rules."""
    text = lambda i, s: " ".join(f"w{i}x{j}" for j in range(70)) + "".join(f" #{i}y{j}" for j in range(s))
    rows = [(i, text(i, 0 if i % 2 or i % 50 == 0 else 60), "en" if i % 2 else "de") for i in range(4000)]
    rows += [(10_000 + i, text(i, 60), "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = labels(spark, [(i, 1, 0) for i in range(4000)])
    out = quality_rules.judge(docs, marks)
    assert out.where("doc_id >= 10000 and kept").count() == 0
    assert out.where("doc_id < 4000 and not kept").count() == 0
    # without labels only the base rule judges
    assert quality_rules.judge(docs, marks.limit(0)).where("kept = base_failed").count() == 0


def test_rules_work_and_their_losses_are_bounded_on_rows_not_calibrated_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    out = quality_rules.judge(docs.join(marks.select("doc_id"), "doc_id", "left_semi"), marks.where(half == 0))
    held = out.join(marks, "doc_id").where(half == 1).where("not base_failed")
    rates = held.groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, (~F.col("kept")).cast("int"))).alias("lost"), F.avg(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int"))).alias("found")).collect()
    calibrated = [r for r in rates if r.found]
    assert all(r.lost <= quality_rules.ALPHA + 0.01 for r in rates) and len(calibrated) >= 3
    assert all(r.found > 0.9 for r in calibrated)


def test_rules_judge_beyond_the_base_rule(spark):
    assert queries.queries()["op3_quality_rules"](spark, "/root/testdata/sf0.01").where("not kept and not base_failed").count() > 5


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    out = quality_rules.judge(docs, labels(spark))
    assert out.count() == docs.count() and out.where("kept is null or kept and base_failed").count() == 0
    kept = quality_rules.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} <= {"n", None, ""}
    assert quality_rules.judge(no_docs(spark), labels(spark)).count() == 0


def test_many_labels_calibrate_alike(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    few = sorted(r.doc_id for r in quality_rules.keep_good(docs, marks).select("doc_id").collect())
    monkeypatch.setattr(quality_rules, "BROADCAST_LABELLED", 0)
    many = quality_rules.keep_good(docs, marks)
    assert sorted(r.doc_id for r in many.select("doc_id").collect()) == few and 0 < len(few) < docs.count()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "/x/y", "block"), ("b", "", "allow"), ("same", "/", "allow"), ("same", "/", "block")]


def plain_url(url):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    before = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = before.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "x.net", "example.net", "EXAMPLE.net", "notexample.net", "a.example.com", "org", "fr.org", "b", "a.b", "q.a.b", "same", "", ".net", "net.", "İ.net", "x:80"]
    paths = ["", "/", "/en/", "/en", "/en/a", "/de/x/", "/fr/", "/x/y", "/x/yz", "/x/", "//", "/a/b/c/d"]
    urls = [None, "", "no scheme/net/", "://", "http://", "a://b://net/"]
    urls += [rng.choice(["http://", "https://", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#f", "?a#b"]) for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=repr)
    assert got == sorted([(i, *plain_url(u)) for i, u in enumerate(urls)] + [(0, *plain_url(None))], key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_raking_meets_the_marginals(spark):
    rows = [(f"s{i % 5}", "en de fr".split()[i % 3], "ab"[i % 2], 10 + i * 7 % 90) for i in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake(cells)
    total = {r.lang: r.w for r in raked.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    want = {"en": 0.55 / 0.85, "de": 0.15 / 0.85, "fr": 0.15 / 0.85}
    assert total == pytest.approx(want, abs=1e-6)
    for share in (0.1, 0.5, 0.9, 1.0):
        r = mixing.probabilities(raked, share).join(cells, ["source", "lang", "topic"]).agg((F.sum(F.col("prob") * F.col("tokens")) / F.sum("tokens")).alias("x"), F.max("prob").alias("m")).first()
        assert r.x == pytest.approx(share, abs=1e-9) and r.m <= 1


def test_many_cells_are_raked_alike(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"s{i % 7}", "en de fr es".split()[i % 4], "abc"[rng.randrange(3)], rng.randrange(1, 500)) for i in range(80)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    few = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells).collect()}
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-5)
    many = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells).collect()}
    assert many == pytest.approx(few, rel=1e-2, abs=1e-5) and mixing.rake(cells.limit(0)).count() == 0


def test_mixture_draws_what_it_should(spark):
    rows = [(i, "some words of a text " * (1 + i % 7), ("de", "en")[i % 2], f"s{i % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed_ids(docs, 0.5)
    r = out.agg((F.sum(F.when(F.col("kept"), F.col("n_tokens"))) / F.sum("n_tokens")).alias("share"), F.sum("weight").alias("w")).first()
    assert r.share == pytest.approx(0.5, abs=0.03) and r.w == pytest.approx(1, abs=1e-6)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mixed_ids(docs, 0.5)
    assert out.count() == docs.count() and out.where("kept is null or prob is null or kept and n_tokens = 0").count() == 0
    kept = mixing.keep_mixed(docs, 1.0)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '[^ \\\\s]'").count()
    assert mixing.mixed_ids(no_docs(spark), 0.5).count() == 0


def plain_license(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if x]
    at = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["gnu", "general", "public", "license", "Apache", "LICENSE", "mit", "cc", "by", "BY-NC", ",", ".", "\n", "é", "x", "0"]
    texts = [None, "", "...", "mit license mit license", "CC BY"] + ["".join(p + rng.choice([" ", "", "-"]) for p in rng.choices(parts, k=rng.randrange(14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.scan_licenses(docs)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect()}
    assert got == {i: plain_license(t) for i, t in enumerate(texts)}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in out.collect())


def test_diagonals_survive_small_edits(spark):
    isc = next(t for label, t in license_scan.TEMPLATES if label == "isc").split()
    edited = isc[:7] + ["really"] + isc[7:12] + isc[13:]
    texts = ["before it " + " ".join(isc) + " after", " ".join(edited), " ".join(isc[:6]), " ".join(reversed(isc)), "x " * 500 + " ".join(isc)]
    out = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i].labels for i in range(5)] == ["isc", "isc", "", "", "isc"]
    assert out[0].score == 1.0 and license_scan.COVER <= out[1].score < 1 and out[2].score == 0


def plain_spans(text):
    """(label, cover) of every verified run, by loops over places, diagonals and windows."""
    k, w, out = license_scan.K, [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x], []
    for label, notice in license_scan.TEMPLATES:
        t = notice.split()
        hits = sorted(((p - a, p, a) for p in range(len(w) - k + 1) for a in range(len(t) - k + 1) if w[p : p + k] == t[a : a + k]))
        runs = []
        for h in hits:
            if not runs or h[0] - runs[-1][-1][0] > license_scan.DRIFT:
                runs.append([])
            runs[-1].append(h)
        for run in runs:
            best = max(len({a for _, p, a in run if start <= p and p + k <= start + license_scan.STRETCH * len(t)}) for _, start, _ in run) / (len(t) - k + 1)
            if best >= license_scan.COVER:
                out.append((label, round(best, 9)))
    return sorted(out)


def test_spans_against_plain_diagonals(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["odd", w[i]], w[i : i + 3] * rng.randrange(1, 15)])
            parts += [*w, *["filler"] * rng.randrange(5)]
        texts.append(" ".join(parts))
    isc = next(t for label, t in license_scan.TEMPLATES if label == "isc")
    texts.append(isc.replace("or without fee", "or without fee " * 13))
    got = license_scan.spans(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")).collect()
    found = {i: [] for i in range(len(texts))}
    for r in got:
        found[int(r.key)].append((r.label, round(r.cover, 9)))
    assert {i: sorted(x) for i, x in found.items()} == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert "isc" in dict(found[len(texts) - 1])


def test_licenses_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((tuple(r)[:6] for r in license_scan.scan_licenses(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *plain_license(r.text)) for r in docs.collect()), key=repr)
    assert license_scan.scan_licenses(no_docs(spark)).count() == 0
