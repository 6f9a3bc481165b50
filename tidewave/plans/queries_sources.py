"""Catalogue: captures, discovery and the preprocessing pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, read
from ..operators import split
from ..sources import arrays, capture, folds
from . import preprocess


@query("recording_discovery", "SRC10 SRC12 SCL9", """
with f as (select 'data/person_P' || s_nationkey || '/room_' || s_suppkey % 3 || '/setup_1/trajectory_Tr' || s_suppkey % 2 || '/walk_rep' || s_suppkey as id, s_suppkey from supplier)
select id as recording_id, 'P' || regexp_extract(id, 'person_P([0-9]+)/', 1) as person, regexp_extract(id, 'room_([0-9]+)/', 1) as room, 'walk' as activity, s_suppkey::varchar as repetition, s_suppkey % 5 = 0 as copied
from f
""")
def recording_discovery(spark, d):
    """Receiver files of made-up recordings; every fifth one has its first receiver only."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("data/person_P"), "s_nationkey", F.lit("/room_"), F.col("s_suppkey") % 3, F.lit("/setup_1/trajectory_Tr"), F.col("s_suppkey") % 2, F.lit("/walk_rep"), "s_suppkey").alias("id"), "s_suppkey")
    files = s.select("s_suppkey", "id", F.explode(F.array(*map(F.lit, range(3)))).alias("rx")).where("rx = 0 or s_suppkey % 5 <> 0")
    found = capture.recordings(files.select(F.concat("id", F.lit("_rx"), "rx", F.lit(".pcap")).alias("path")), fallback=True)
    return found.select("recording_id", "person", "room", "activity", "repetition", "copied")


_HEX = "printf('%012x', l_orderkey * 1000003 + l_partkey) || printf('%04x', l_partkey % 65536) || printf('%04x', (l_suppkey * 13) % 65536)"
_HEADERS = f"""
h as (select l_orderkey, l_linenumber, {_HEX} as hex from lineitem),
p as (select l_orderkey, l_linenumber, array_to_string(list_transform(range(6), lambda i: substr(hex, (1 + 2 * i)::bigint, 2)), ':') as mac,
      (('0x' || substr(hex, 15, 2) || substr(hex, 13, 2))::bigint)::int as seq, (('0x' || substr(hex, 17, 2))::bigint & 7)::int as core from h)
"""


def payloads(spark, d, sender=None):
    """Sample packets with header bytes from lineitem keys: MAC, little-endian sequence, stream with the core in its low bits; two zero samples."""
    part = lambda c, n: F.lpad(F.hex(c), n, "0")
    hexed = F.concat(F.lit("1111"), part(F.col("l_orderkey") * 1000003 + F.col("l_partkey") if sender is None else sender, 12), part(F.col("l_partkey") % 65536, 4), part((F.col("l_suppkey") * 13) % 65536, 4), F.lit("00" * (capture.HEADER - 10 + 8)))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unhex(hexed).alias("payload"))


@query("header_decode", "SRC2 SCL12", f"with {_HEADERS} select * from p")
def header_decode(spark, d):
    return capture.headers(payloads(spark, d), "payload", 2).select("l_orderkey", "l_linenumber", "mac", "seq", "core")


@query("mac_filter", "SRC4", """
select l_orderkey, l_linenumber, (l_partkey % 256 * 256 + l_partkey // 256 % 256)::int as seq from lineitem where l_suppkey % 16 = 10
""")
def mac_filter(spark, d):
    """The packets of one of sixteen senders, whose address is given in capitals."""
    sent = payloads(spark, d, F.lit(0x02A0B0C0D0E0) + F.col("l_suppkey") % 16)
    return capture.headers(sent, "payload", 2, "02:A0:B0:C0:D0:EA").select("l_orderkey", "l_linenumber", "seq")


@query("summary_json", "SNK6", """
with f as (select user_id % 3 as dataset, user_id % 15 as fold, round(avg(value), 4) as macro_f1 from events group by 1, 2)
select dataset, count(*) as folds, round(avg(macro_f1), 4) as mean, round(stddev_pop(macro_f1), 3) as std from f group by 1
""")
def summary_json(spark, d):
    """Fold values to JSON documents and read back."""
    f = read(spark, d, "events").groupBy((F.col("user_id") % 3).alias("dataset"), (F.col("user_id") % 15).alias("fold")).agg(F.round(F.avg("value"), 4).alias("macro_f1"))
    back = folds.summary_json(f, ["dataset"]).select("dataset", F.from_json("json", "mean double, std double, per_fold array<struct<fold:long,macro_f1:double>>").alias("j"))
    return back.select("dataset", F.size("j.per_fold").cast("long").alias("folds"), F.round("j.mean", 4).alias("mean"), F.round("j.std", 3).alias("std"))


@query("window_feature_pipeline", "DSP3 DSP4 DSP5 WIN15 AGG9 SRC16 TST1 PRJ6")
def window_feature_pipeline(spark, d):
    """Synthetic packets through cleaning, alignment, resampling and both feature branches."""
    packets = preprocess.synthetic_packets(spark, persons=1)
    frames = preprocess.uniform_frames(packets.drop("person", "label"))
    refs = frames.select("recording_id").distinct().withColumn("ref", F.lit(0))
    w = preprocess.window_features(frames, refs, 52)
    return w.select("recording_id", "window_idx", "rx", F.size("amplitude").alias("n_amplitude"), F.size("doppler").alias("n_doppler"))


def _values(classes):
    return ", ".join(f"('{name}', {value}, {i})" for i, (name, value) in enumerate(classes))


@query("array_discovery", "SRC11 LBL1", f"""
with m(name, id, ord) as (values {_values(split.CLASSES_30)}),
f as (select s_suppkey, (select name from m where ord = s_suppkey % 24) as name, 'data/set/' || upper((select name from m where ord = s_suppkey % 24)) || '/S' || s_nationkey || '_' || s_suppkey || case when s_suppkey % 2 = 0 then '.npy' else '.mat' end as path from supplier)
select path, 'S' || s_nationkey || '_' || s_suppkey as recording_id, 'S' || s_nationkey as person, 'default' as room, (select id from m where m.name = f.name)::int as class_id
from (select f.*, s_nationkey from f join supplier using (s_suppkey)) f
""")
def array_discovery(spark, d):
    """Array files in folders of activities, names in capitals."""
    names = F.array(*(F.lit(name) for name, _ in split.CLASSES_30))
    s = read(spark, d, "supplier").withColumn("name", F.get(names, (F.col("s_suppkey") % 24).cast("int")))
    files = s.select(F.concat(F.lit("data/set/"), F.upper("name"), F.lit("/S"), "s_nationkey", F.lit("_"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, ".npy").otherwise(".mat")).alias("path"))
    return arrays.array_recordings(files, split.CLASSES_30, "data/set")


@query("fold_features", "DSP3 DSP4 DSP5 PRJ4 JN5 SRC16")
def fold_features(spark, d):
    """Synthetic packets of three persons to both branches of all folds, by each fold's own training statistics."""
    packets = preprocess.synthetic_packets(spark, persons=3, seconds=2.2)
    frames = preprocess.uniform_frames(packets.drop("person", "label"))
    recordings = packets.select("recording_id", "person", F.lit("room").alias("room"), "label").distinct().withColumn("ref", F.lit(1))
    out = preprocess.fold_features(frames, recordings, preprocess.fit_folds(preprocess.moments_of(frames, recordings, 52), recordings, 52), 52)
    return out.select("fold", "split", "recording_id", "person", "label", "window_idx", "rx", F.size("amplitude").alias("n_amplitude"), F.size("doppler").alias("n_doppler"))
