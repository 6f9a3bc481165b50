"""The capture source: whole files, splits, resynchronisation, senders taken into the reader."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.sources import capture

MAGIC = {"<6": b"\xd4\xc3\xb2\xa1", ">6": b"\xa1\xb2\xc3\xd4", "<9": b"\x4d\x3c\xb2\xa1", ">9": b"\xa1\xb2\x3c\x4d"}


def sample_packet(mac=b"\xaa\xbb\xcc\xdd\xee\x01", seq=7, core=2, bins=64, mark=b"\x11" * 4, tail=b"", options=0):
    words = np.arange(bins, dtype=np.uint64) | (np.arange(bins, dtype=np.uint64) << 22) | np.uint64(31 << 16)
    body = mark + mac + struct.pack("<HHHH", seq, core, 0, 0) + words.astype("<u4").tobytes() + tail
    ip = bytes([0x45 + options, 0]) + struct.pack(">H", 28 + len(body)) + b"\0" * 4 + bytes([64, 17]) + b"\0" * (10 + 4 * options)
    return b"\0" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", 5500, 5500, 8 + len(body), 0) + body


def file_of(frames, order="<", digits="6", first=1_700_000_000):
    at = lambda i: (first + i // 3, i % 3 * 250_000)
    return MAGIC[order + digits] + b"\0" * 20 + b"".join(struct.pack(order + "4I", *at(i), len(f), len(f)) + f for i, f in enumerate(frames))


def walked(data):
    """(position, seconds, frame) by reading one record after the other."""
    order, digits = next(k for k, v in MAGIC.items() if data[:4] == v)
    at = 24
    while at + 16 <= len(data):
        s, part, n, _ = struct.unpack(order + "4I", data[at : at + 16])
        if at + 16 + n > len(data):
            return
        yield at, s + part * 10.0 ** -int(digits), data[at + 16 : at + 16 + n]
        at += 16 + n


def test_capture_roundtrip(spark, tmp_path):
    frames = [sample_packet(), b"\0" * 60, sample_packet(mac=b"\x01" * 6, seq=8, core=3, mark=b"\x11\x11", options=2)]
    (tmp_path / "a.pcap").write_bytes(file_of(frames, first=100) + b"\0" * 7)
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    (tmp_path / "c.pcap").write_bytes(b"")
    rows = capture.read_captures(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.ts, r.mac, r.core) for r in rows] == [(100.0, "aa:bb:cc:dd:ee:01", 2), (100.5, "01:01:01:01:01:01", 3)]
    assert rows[0].re[:3] == [0.0, 1.0, 2.0] and len(rows[1].im) == 64
    assert capture.read_captures(spark, str(tmp_path), mac="AA:BB:CC:DD:EE:01").count() == 1
    assert capture.read_captures(spark, str(tmp_path), bins=65).count() == 0


def noisy(rng, n):
    """Frames of many kinds, some with a whole capture inside."""
    inner = file_of([bytes(rng.randrange(256) for _ in range(rng.randrange(1, 60))) for _ in range(20)])
    frames = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind < 3:
            frames.append(sample_packet(mac=bytes([2, 0, 0, 0, 0, rng.randrange(3)]), seq=i % 65536, core=i % 4, tail=inner if kind == 2 else b""))
        elif kind == 3:
            frames.append(bytes(rng.randrange(4) for _ in range(rng.randrange(1, 1500))))
        elif kind == 4:
            frames.append(inner)
        else:
            frames.append(b"\0" * rng.randrange(1, 3000))
    return frames


@pytest.mark.parametrize("order,digits", [("<", "6"), (">", "9")])
def test_every_split_gives_the_records_of_the_whole(order, digits):
    rng = random.Random(5)
    data = file_of(noisy(rng, 1200), order, digits) + b"\1" * 9  # a cut-off end
    whole = [(at, pytest.approx(ts, abs=1e-5), frame) for at, ts, frame in walked(data)]
    assert len(data) > 6 * capture.MARGIN
    for step in (len(data), 200_000, 77_777, 30_011):
        got = []
        for start in range(0, len(data), step):
            records = capture.Records(lambda at, n: data[at : at + n], len(data), start, start + step)
            got += [(at, ts, records.data[a:b]) for at, ts, a, b in records]
        assert len(got) == len(whole) and got == whole


def test_a_split_may_begin_anywhere():
    rng = random.Random(6)
    data = file_of(noisy(rng, 300))
    places = [at for at, _, _ in walked(data)]
    for start in rng.sample(range(len(data)), 60) + [places[5], places[5] + 1, places[-1], len(data) - 1, 24, 25]:
        records = capture.Records(lambda at, n: data[at : at + n], len(data), start, len(data))
        assert [r[0] for r in records] == [at for at in places if at >= max(start, 24)]


def test_several_tasks_read_one_file(spark, tmp_path):
    data = file_of(noisy(random.Random(7), 1500))
    (tmp_path / "big.pcap").write_bytes(data)
    whole = capture.packets(spark, str(tmp_path))
    parts = capture.packets(spark, f"file://{tmp_path}/big.pcap", split=90_000)
    assert parts.rdd.getNumPartitions() == -(-len(data) // 90_000) and whole.rdd.getNumPartitions() == 1
    a, b = (sorted(map(tuple, x.drop("path").collect())) for x in (whole, parts))
    assert a == b and len(a) > 500
    assert parts.groupBy(F.spark_partition_id()).count().count() > 5


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.pcap").write_bytes(file_of([sample_packet(seq=i)] * 3))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    df = capture.packets(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 90 and df.select("path").distinct().count() == 30


def test_senders_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(file_of(noisy(random.Random(8), 300)))
    wanted = "02:00:00:00:00:01"
    plain = capture.packets(spark, str(tmp_path)).where(F.col("mac") == wanted).collect()
    assert plain and capture.packets(spark, str(tmp_path), mac=wanted.upper()).collect() == plain
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = capture.packets(spark, str(tmp_path)).where((F.col("mac") == wanted) & (F.col("at") > 0))
        assert df.collect() == plain
        assert f"PushedFilters: [EqualTo(mac,{wanted})]" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert capture.packets(spark, str(tmp_path)).where(F.col("mac") == "02-00-00-00-00-01").count() == 0
        assert capture.packets(spark, str(tmp_path), mac=wanted).where("mac = '02:00:00:00:00:02'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stores_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pcap").write_bytes(file_of(noisy(random.Random(9), 100)))
    first = capture.packets(spark, str(tmp_path)).drop("path").collect()

    def unknown(path):
        raise capture.pa.ArrowInvalid("no such store")

    monkeypatch.setattr(capture, "located", unknown)
    assert capture.packets(spark, str(tmp_path)).drop("path").collect() == first


def test_headers_and_samples_of_odd_payloads(spark):
    body = sample_packet(bins=3)[42:]
    rows = [(0, None), (1, b""), (2, b"\x11"), (3, b"\x11" * 6), (4, body), (5, body[:-1]), (6, body[2:] + b"\0\0"), (7, b"\x12" + body)]
    df = spark.createDataFrame(rows, "id int, payload binary")
    out = capture.samples(capture.headers(df, "payload", 3), "payload", 3).orderBy("id").collect()
    assert [(r.id, r.mac, r.seq, r.core, r.re) for r in out] == [(4, "aa:bb:cc:dd:ee:01", 7, 2, [0.0, 1.0, 2.0]), (6, "aa:bb:cc:dd:ee:01", 7, 2, [0.0, 1.0, 2.0])]
    assert capture.samples(capture.headers(df.limit(0), "payload", 3), "payload", 3).count() == 0


def test_headers_of_one_sender(spark):
    rng = random.Random(11)
    macs = [b"\x11" * 6, b"\x11\x11\xaa\xbb\xcc\xdd", b"\xaa\xbb\xcc\xdd\xee\x01", b"\xaa\xbb\xcc\xdd\x11\x11", b"\xcc\xdd\xee\x01\0\0"]
    bodies = [sample_packet(mac=m, seq=i, bins=3, mark=mark)[42:] for i, m in enumerate(macs) for mark in (b"\x11" * 4, b"\x11\x11")]
    rows = [None, b"", b"\x11", *bodies, *(b[: rng.randrange(len(b))] for b in bodies), *(b[:-1] for b in bodies), *(b[1:] for b in bodies)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, payload binary")
    every = capture.headers(df, "payload", 3)
    seen = {r.mac for r in every.collect()}
    assert len(seen) > len(macs)
    for mac in [*seen, "01:02:03:04:05:06"]:
        assert sorted(capture.headers(df, "payload", 3, mac.upper()).collect()) == sorted(capture.of_mac(every, mac).collect())
    for odd in ("", "11:11", "11-11-11-11-11-11", "zz:11:11:11:11:11", "111111111111"):
        assert capture.headers(df, "payload", 3, odd).count() == capture.of_mac(every, odd).count() == 0


def test_a_sender_is_filtered_without_decoding(spark):
    """A payload that is computed appears in the filter a few times, not once for each header byte."""
    from tidewave import catalogue

    plan = catalogue.queries()["mac_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("unhex(") < 12 and "concat_ws" not in plan
