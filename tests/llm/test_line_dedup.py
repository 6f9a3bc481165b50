import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewave.llm import line_dedup as L
from tidewave.llm import queries as Q

from .helpers import no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rank(d):
    return (d is not None, d or 0)


def brute(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, text) of each row, by the rule as it is written."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for d, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    top = {k: max(ds, key=rank) for k, ds in holders.items() if len(ds) >= min_docs}
    out = []
    for d, lines in split:
        kept = [line for line in lines if top.get(key(line), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    shared = [f"{'shared passage ' * 3}{i} ünï" for i in range(12)]
    rows = []
    for i in range(n):
        lines = [f"own line {i} {j} of this document alone, long enough to count" for j in range(rng.randrange(4))]
        if rng.random() < 0.4:  # one line in a third of all documents and more
            lines.append(rng.choice(["", "  ", "\t"]) + "The Cookie Notice Of This Site, On Every Page Of It" + rng.choice(["", " \r"]))
        lines += rng.choices(shared, k=rng.randrange(3))
        lines += [rng.choice(["short", "", " ", "x" * 39, "é" * 40, "\x0b" + "y" * 40])]
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, None, i // 7]), "\n".join(lines)))
    return rows + rng.sample(rows, 10) + [(None, None), (3, ""), (4, "\n\n")]


@pytest.mark.parametrize("seed", range(3))
def test_whole_rule(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.dedup_lines(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute(rows)


def decided(rows, min_docs, tasks, batch):
    """Drops of sorted (h1, h2, doc, key, at) rows cut into tasks and batches."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1], (r[2] is None, -(r[2] or 0)), r[3], r[4]))
    bounds = [0, *sorted(tasks), len(rows)]
    out, runs, late = set(), {}, []
    for a, b in zip(bounds, bounds[1:]):
        while 0 < b < len(rows) and rows[b][:3] == rows[b - 1][:3]:
            b += 1  # rows of one hash and document share a task
        while 0 < a < len(rows) and rows[a][:3] == rows[a - 1][:3]:
            a += 1
        part = rows[a:b]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part[i : i + batch])], L._NAMES[1:]) for i in range(0, len(part), batch)]
        summaries = 0
        for found in L._stream(min_docs)(iter(batches)):
            for kind, h1, h2, doc, key, at in zip(*(c.to_pylist() for c in found.columns)):
                if kind == L.DROP:
                    assert (h1, h2, doc, key, at) not in out
                    out.add((h1, h2, doc, key, at))
                elif kind == L.OPEN:
                    late.append((h1, h2, doc, key, at))
                else:
                    summaries += 1
                    runs.setdefault((h1, h2), []).append((at, doc))
        assert summaries <= 2
    for h1, h2, doc, key, at in late:
        n, top = sum(x[0] for x in runs[h1, h2]), max((x[1] for x in runs[h1, h2]), key=rank)
        if n >= min_docs and doc != top:
            out.add((h1, h2, doc, key, at))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_stream_over_any_cut(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 5, 40, 120])
    rows = [(rng.choice([1, 1, 1, rng.randrange(8)]), rng.randrange(2), rng.choice([None, *range(9)]), rng.randrange(2), rng.randrange(4)) for _ in range(n)]
    cuts = [rng.randrange(n + 1) for _ in range(rng.randrange(6))]
    holders = {}
    for r in rows:
        holders.setdefault(r[:2], set()).add(r[2])
    want = {r for r in rows if len(holders[r[:2]]) >= 3 and r[2] != max(holders[r[:2]], key=rank)}
    assert decided(rows, 3, cuts, rng.choice([1, 2, 7, 1000])) == want


def test_bitmaps_are_small_and_read_back(spark):
    rows = [(i, "\n".join(["keep me"] * 3000 + ["the same line stands in all of these documents here"] + ["tail"] * 50)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bitmaps = L.line_bitmaps(df).collect()
    assert sorted(r.doc_id for r in bitmaps) == list(range(8)) and all(len(r.keep) < 40 and r.n_dropped == 1 for r in bitmaps)
    assert L.kept_lines(rows[0][1], bitmaps[0].keep) == "\n".join(["keep me"] * 3000 + ["tail"] * 50)


def test_many_bitmaps_join_by_a_shuffle(spark):
    rows = corpus(9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute(rows)


def test_odd_rows_and_clashing_names(spark):
    docs = odd_docs(spark).withColumnsRenamed({"key": "text_key", "score": "n_dropped", "n_words": "at"})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = L.dedup_lines(docs, min_chars=5, min_docs=2).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute(rows, 5, 2)
    assert L.dedup_lines(no_docs(spark)).collect() == []


def test_a_very_common_line_spreads_over_tasks(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "'one line that is the same in every document of the table' as text")
    lines = L.line_hashes(df, 40).repartitionByRange(8, "h1", "h2", L.F.desc_nulls_last("doc_id"))
    sizes = [r["count"] for r in lines.groupBy(L.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000


def test_query_digests(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_line_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert np.array(got).shape == (len(rows), 4)
