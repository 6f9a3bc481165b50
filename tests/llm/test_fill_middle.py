import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import fill_middle as M

from .helpers import no_docs, odd_docs


def brute(doc, text, seed=1, plain=10, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    pieces = ["abc ", "é", "漢字", "𝔘𝔫", "\n", "<", "P>", "<S", ">", "<M>", "ß" * 9, " \t", "\0", "é"]
    return [(i, "".join(rng.choices(pieces, k=rng.choice([0, 1, 2, 5, 30, 200])))) for i in range(900)]


def test_equals_the_rule_on_characters(spark):
    rows = texts()
    got = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", M.restored(F.col("output"), F.col("form"))).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [brute(*r) for r in rows]
    assert [r.back for r in got] == [t for _, t in rows]
    forms = {f: sum(r.form == f for r in got) for f in ("plain", "psm", "spm")}
    assert forms["psm"] > forms["spm"] > 20 and forms["plain"] > 40


def test_shares_are_parameters(spark):
    rows = texts()
    got = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), seed=7, plain_percent=0, spm_percent=100).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [brute(*r, 7, 0, 100) for r in rows]


def test_runs_find_every_cut():
    whole = ["añb漢𝔘c", "", "ßßßaaa", "x"]
    raw = [t.encode() for t in whole]
    runs = M.Runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, text in enumerate(whole):
        start = sum(map(len, raw[:i]))
        units = np.arange(len(text) + 1)
        assert list(runs.bytes_at(runs.before[i] + units) - start) == [len(text[:u].encode()) for u in units]
    assert len(runs.unit) == 6 + 2 + 1 and M.Runs(np.zeros(0, np.uint8), np.zeros(3, np.int64)).bytes_at(np.zeros(2, int)).tolist() == [0, 0]


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("key", "form")
    got = M.fill_in_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    rows = docs.collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(r.doc_id, r.text) for r in rows), key=repr)
    assert sorted(r.back for r in got) == sorted(r.text or "" for r in rows)
    assert M.fill_in_middle(no_docs(spark)).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restored_with_halves_of_marks(spark, form):
    """Cuts may leave halves of marks at the seams; the whole marks are still the first of their kind."""
    parts = [("<", "P>", "S>"), ("<S", ">", "<"), ("", "", "<M"), (">", "<P", ""), ("a<", "<", "<<")]
    rows = [(p + m + s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", form) for p, m, s in parts]
    df = spark.createDataFrame(rows, "text string, output string, form string")
    assert all(r.text == r.back for r in df.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect())
