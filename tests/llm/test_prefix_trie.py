import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from tidewave.llm import prefix_trie as P

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def base_of(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def rebuilt(rows):
    """conv_id -> [(role, text)] as the rule reads; equal turns by the digest of role and text."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base_of(c), [])[:h] + turns[h:]
    return out


def brute(seqs):
    """seqs: conv_id -> sequence of (role, text)."""
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * (words(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(seqs[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=90):
    rng = random.Random(seed)
    hot = ("user", "the first turn of very many conversations")
    rows = []
    for c in rng.sample(range(-60, 200), n):
        turns = [hot] if rng.random() < 0.4 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "hello  there you", "a"])) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))]
        if rng.random() < 0.3:
            turns = [hot, ("assistant", "x y z")]  # one conversation many times over
        numbers = [None, *range(len(turns))] if rng.random() < 0.3 else list(range(len(turns)))
        rows += [(c, t, *turn) for t, turn in zip(numbers, turns)]
    rows += [(500, 0, "user", "tie"), (500, 0, "user", "other tie"), (500, 0, "user", "tie"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,parts,run", [(0, 1, 4096), (1, 13, 4096), (2, 40, 3), (3, 7, 1)])
def test_whole_trie(spark, seed, parts, run):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collected(P.prefix_trie(df, run_rows=run)) == brute(rebuilt(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keyed(seqs):
    digest = lambda t: hashlib.md5(repr(t).encode()).digest()
    return [(c, b"".join(map(digest, s)), [words(t[1]) for t in s]) for c, s in seqs.items()]


def batches(rows, size):
    schema = pa.schema([("conv_id", pa.int64()), ("turns", pa.binary()), ("words", pa.list_(pa.int32()))])
    return [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_into_tasks_and_runs(seed):
    rng = random.Random(seed)
    alphabet = [("u", w) for w in ("a", "b b", "c c c")]
    seqs = {c: tuple(rng.choices(alphabet[: rng.choice([1, 2, 3])], k=rng.randrange(6))) for c in rng.sample(range(1000), rng.choice([1, 2, 30, 80]))}
    rows = sorted(keyed(seqs), key=lambda r: (r[1], r[0]))
    bounds = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(8)))})
    whole, edges = [], []
    for task, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = rows[a:b]
        rng.shuffle(part)
        stream = list(P.merged(P.spooled(batches(part, 11), rng.choice([1, 3, 100]))))
        assert [(r[1], r[0]) for r in stream] == [(c, k) for c, k, _ in rows[a:b]]
        assert [r[3] for r in stream[1:]] == [P.shared(x[0], y[0]) for x, y in zip(stream, stream[1:])]
        for row in P.nodes(iter(stream), task):
            (edges if "place" in row else whole).append(row)
    edges.sort(key=lambda r: (r["task"], r["place"], r["part"]))
    filled = [dict.fromkeys(P._NAMES) | r for r in edges]
    everything = whole + list(P.joined_paths(iter(filled)))
    of = {r["id"]: r["conv_id"] for r in everything}
    assert len(of) == len(everything)
    got = sorted(((r["conv_id"], r["depth"], of[r["parent"]] if r["parent"] else None, *(r[c] for c in COLUMNS[3:])) for r in everything), key=repr)
    assert got == brute(seqs)


def test_ids_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "ENDS", 7)
    rows = keyed({c: (("u", "a"),) for c in range(300)})
    edges = []
    for task in range(3):
        edges += P.nodes(P.merged(P.spooled(batches(rows[task * 100 : task * 100 + 100], 50))), task)
    assert max(len(r["ends"]) for r in edges) == 7
    last = [r for r in P.joined_paths(dict.fromkeys(P._NAMES) | r for r in edges) if r["depth"] == 1]
    assert len(last) == 1 and last[0]["n_convs"] == 300 and last[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()


def test_merge_compares_shared_turns_once(monkeypatch):
    """Conversations that share 200 turns: beyond the runs' own neighbours, the merge looks at few of them."""
    seqs = {c: tuple(("u", "s") for _ in range(200)) + (("u", str(c)),) for c in range(64)}
    runs = P.spooled(batches(keyed(seqs), 8))
    looked = []
    plain = P.shared
    monkeypatch.setattr(P, "shared", lambda a, b, start=0: looked.append(plain(a, b, start) - start) or looked[-1] + start)
    assert len(list(P.merged(runs))) == 64
    assert sum(looked) <= 200 * len(runs) and len(looked) >= 56


def test_odd_tables(spark):
    rows = [(20, None, None, None), (20, 1, "u", ""), (21, 0, "u", "long " * 50_000), (21, 0, "u", "long " * 50_000), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], SCHEMA + ", id string, parent binary, turns int")
    assert collected(P.prefix_trie(df)) == brute(rebuilt(rows))
    assert collected(P.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert collected(P.prefix_trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA))) == []
