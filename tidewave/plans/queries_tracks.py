"""Catalogue: filters over whole tracks. `events` stands for packets: user_id a recording, ts time, value amplitude."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import query, read
from ..operators import align, filters
from . import preprocess
from .queries_clean import _TRACK, track


def _low_pass(q: str) -> tuple[str, ...]:
    """The low-pass of 30 Hz at 350 Hz as second-order section b0 b1 b2 a1 a2, in closed form; q: 1 / (2 Q)."""
    w = "2 * pi() * 30 / 350"
    a0 = f"(1 + sin({w}) * {q})"
    return f"(1 - cos({w})) / 2 / {a0}", f"(1 - cos({w})) / {a0}", f"(1 - cos({w})) / 2 / {a0}", f"-2 * cos({w}) / {a0}", f"(1 - sin({w}) * {q}) / {a0}"


LOW = (_low_pass("cos(pi() / 8)"), _low_pass("cos(3 * pi() / 8)"))
# The band-pass of 0.5 to 80 Hz at 350 Hz, order 4, as sections b0 b1 b2 a1 a2.
BAND = (
    ("6.954541397311463e-2", "13.909082794622926e-2", "6.954541397311463e-2", "-14.938273942868086e-2", "4.548470132063999e-2"),
    ("1e0", "2e0", "1e0", "-19.724514632895998e-2", "45.36793575268407e-2"),
    ("1e0", "-2e0", "1e0", "-1983350761361466e-15", "9834320834898469e-16"),
    ("1e0", "-2e0", "1e0", "-1993122977309598e-15", "9932035092821594e-16"),
)


def zero_phase_sql(sections: tuple[tuple[str, ...], ...], rows: str) -> str:
    """The recurrence sample by sample, forward and backward over an odd extension; rows: user_id, event_id, t, value."""
    return f"with recursive {zero_phase_ctes(sections, rows)} select user_id, event_id, round(y, 4) as filtered from filtered"


def zero_phase_ctes(sections: tuple[tuple[str, ...], ...], rows: str) -> str:
    """Tables up to filtered (user_id, event_id, y), for after `with recursive`."""
    n, lead = len(sections), 3 * (2 * len(sections) + 1)
    names = "b0 b1 b2 a1 a2".split()
    constants = ", ".join(f"({e})::double as {c}{k}" for k, s in enumerate(sections) for c, e in zip(names, s))
    dc = [f"((b0{k} + b1{k} + b2{k}) / (1 + a1{k} + a2{k}))" for k in range(n)]
    scale = ["1e0", *(" * ".join(dc[:k]) for k in range(1, n))]
    steady = ", ".join(f"{scale[k]} * (b1{k} - a1{k} * {dc[k]} + b2{k} - a2{k} * {dc[k]}) as z{k}, {scale[k]} * (b2{k} - a2{k} * {dc[k]}) as w{k}" for k in range(n))
    state = [f"{s}{k}" for k in range(n) for s in "zw"]

    def pass_(name: str, source: str) -> str:
        # inside out: each level adds the output of a section
        inner = f"select f.user_id, e.p, e.x as x0, {', '.join('f.' + s for s in state)}, z_c.* exclude ({', '.join(state)}) from {name} f join {source} e on e.user_id = f.user_id and e.p = f.p + 1, z_c"
        for k in range(n):
            inner = f"select *, b0{k} * x{k} + z{k} as x{k + 1} from ({inner})"
        new = ", ".join(f"b1{k} * x{k} - a1{k} * x{k + 1} + w{k}, b2{k} * x{k} - a2{k} * x{k + 1}" for k in range(n))
        first = ", ".join(f"e.x * z_c.{s} as {s}" for s in state)
        return f"{name} as (select e.user_id, -1::bigint as p, 0e0 as y, {first} from {source} e, z_c where e.p = 0 union all select user_id, p, x{n}, {new} from ({inner}))"

    return f"""
z_k as (select {constants}), z_c as (select *, {steady} from z_k),
z_o as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as i, count(*) over (partition by user_id) as n from ({rows})),
z_g as (select user_id, n, max(value) filter (i = 0) as a, max(value) filter (i = n - 1) as z from z_o group by 1, 2),
z_e as (
  select user_id, i + {lead} as p, value as x from z_o where n > {lead}
  union all select user_id, {lead} - i, 2 * a - value from z_o join z_g using (user_id, n) where n > {lead} and i between 1 and {lead}
  union all select user_id, {lead} + 2 * (n - 1) - i, 2 * z - value from z_o join z_g using (user_id, n) where n > {lead} and i between n - 1 - {lead} and n - 2
),
{pass_("z_there", "z_e")},
z_r as (select z_there.user_id, n + {2 * lead} - 1 - p as p, y as x from z_there join z_g using (user_id) where p >= 0),
{pass_("z_back", "z_r")},
filtered as (select z_o.user_id, z_o.event_id, z_back.y from z_o left join z_back on z_back.user_id = z_o.user_id and z_back.p = z_o.n + {lead} - 1 - z_o.i)
"""


def _filtered(kind: str):
    def run(spark, d):
        rows = track(spark, d).where("value is not null")
        out = filters.zero_phase(rows, ["user_id"], "t", "value", filters.butterworth_sections(kind), order=("event_id",))
        return out.select("user_id", "event_id", F.round("filtered", 4).alias("filtered"))

    return run


_ROWS = f"select user_id, event_id, t, value from ({_TRACK}) where value is not null"
query("lowpass_track", "DSP1", zero_phase_sql(LOW, _ROWS))(_filtered("low"))
query("bandpass_track", "DSP2", zero_phase_sql(BAND, _ROWS))(_filtered("band"))


@query("xcorr_lag_full", "WIN4 JN10 FLT7", f"""
with h as (select event_type, floor(t / 3600)::bigint as i, count(*)::double as v from ({_TRACK}) group by 1, 2),
c as (select event_type, i, v - avg(v) over (partition by event_type) as v from h),
r as (select i, v from c where event_type = (select min(event_type) from h)),
s as (select c.event_type, c.i - r.i as lag, sum(c.v * r.v) as score from c, r group by 1, 2)
select event_type, max(lag) - min(lag) + 1 as n_lags, arg_max(lag, (round(score, 6), -lag)) as lag, round(max(score), 4) as score, arg_max(lag, (round(score, 6), -lag)) / 1e1 as shift from s group by 1
""")
def xcorr_lag_full(spark, d):
    """Every lag at which two series of hourly counts overlap, not only those near zero."""
    hours = track(spark, d).groupBy("event_type", F.floor(F.col("t") / 3600).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    first = hours.agg(F.min("event_type")).first()[0]
    scores = align.correlations(hours, [], "event_type", "i", "v", first, piece=64, bins=16)
    best = align.full_lags(hours, [], "event_type", "i", "v", first, rate=10.0, piece=64).select("event_type", "lag", "shift")
    return scores.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_lags"), F.round(F.max("score"), 4).alias("score")).join(best, "event_type")


# frames of made-up radio channels from lineitem: recording a supplier, time the order of its lines, 2 bins x 4 antennas; windows of 350 every 175
_FRAMES = """
l as (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i, l_quantity::bigint as q, l_partkey as p, round(l_discount * 100)::bigint as d from lineitem),
h as (select l_suppkey, i, j, 10e0 + (q * (j + 3) + p) % 17 as re, ((p * (j + 1) + d * 7 + q) % 11) - 5e0 as im from l, range(8) as c(j)),
n as (select l_suppkey, max(i) + 1 as n from l group by 1),
w as (select h.l_suppkey, win, i - 175 * win as place, j, re, im from h join n using (l_suppkey), range(20000) as g(win) where i >= 175 * win and i < 175 * win + 350 and 175 * win + 350 <= n.n)
"""


def frames(spark, d):
    q, p, k = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.round(F.col("l_discount") * 100).cast("long")
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    re = F.array(*(10.0 + (q * (j + 3) + p) % 17 for j in range(8)))
    im = F.array(*((p * (j + 1) + k * 7 + q) % 11 - 5.0 for j in range(8)))
    return read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("recording_id"), i.alias("t_idx"), F.lit(0).alias("rx"), re.alias("re"), im.alias("im"))


def _window_features(spark, d):
    f = frames(spark, d)
    return preprocess.window_features(f, f.select("recording_id").distinct().withColumn("ref", F.lit(1)), 2, kind="double").withColumn("l_suppkey", F.col("recording_id").cast("long"))


def _digest(rows, by, place):
    """What a series is by a few numbers: its sum, first moment, energy and limits."""
    v = F.col("v")
    return rows.groupBy(*by).agg(F.round(F.sum(v), 3).alias("total"), F.round(F.sum(v * F.col(place)) / 1000, 3).alias("moment"), F.round(F.sum(v * v), 3).alias("energy"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"))


_DIGEST = "round(sum(v), 3) as total, round(sum(v * {0}) / 1000, 3) as moment, round(sum(v * v), 3) as energy, round(min(v), 4) as low, round(max(v), 4) as high"


@query("amplitude_branch", "DSP3 DSP5 PRJ6", f"""
with recursive {_FRAMES},
{zero_phase_ctes(LOW, "select (l_suppkey * 20000 + win) * 8 + j as user_id, place as event_id, place as t, sqrt(re * re + im * im) as value from w")},
v as (select user_id // 8 // 20000 as l_suppkey, user_id // 8 % 20000 as window_idx, user_id % 8 as channel, event_id as place, y - median(y) over (partition by user_id) as v from filtered)
select l_suppkey, window_idx, channel, {_DIGEST.format("place")} from v group by 1, 2, 3
""")
def amplitude_branch(spark, d):
    """Magnitudes of whole windows, low-passed, less their median."""
    rows = _window_features(spark, d).select("l_suppkey", F.col("window_idx").cast("long"), F.posexplode("amplitude").alias("k", "v"))
    rows = rows.withColumn("channel", (F.col("k") % 8).cast("long")).withColumn("place", F.floor(F.col("k") / 8))
    return _digest(rows, ["l_suppkey", "window_idx", "channel"], "place")


@query("doppler_branch", "DSP4 DSP5 PRJ5", f"""
with recursive {_FRAMES},
r as (select l_suppkey, win, place, j // 4 as bin, re, im from w where j % 4 = 1),
c as (select w.l_suppkey, w.win, w.place, r.bin, avg(w.re * r.re + w.im * r.im) as re, avg(w.im * r.re - w.re * r.im) as im from w join r on r.l_suppkey = w.l_suppkey and r.win = w.win and r.place = w.place and r.bin = j // 4 where j % 4 <> 1 group by all),
z as (select *, re - avg(re) over x as a, im - avg(im) over x as b from c window x as (partition by l_suppkey, win, bin)),
{zero_phase_ctes(BAND, "select ((l_suppkey * 20000 + win) * 2 + bin) * 2 as user_id, place as event_id, place as t, a as value from z union all select ((l_suppkey * 20000 + win) * 2 + bin) * 2 + 1, place, place, b from z")},
t as (select user_id // 2 as s, list(y order by event_id) filter (user_id % 2 = 0) as a, list(y order by event_id) filter (user_id % 2 = 1) as b from filtered group by 1),
hann as (select list_transform(range(128), lambda n: 5e-1 - 5e-1 * cos(2 * pi() * n / 128)) as hw),
f as (select s, frame, list_transform(range(128), lambda n: a[8 * frame + n + 1] * hw[n + 1]) as a, list_transform(range(128), lambda n: b[8 * frame + n + 1] * hw[n + 1]) as b from t, hann, range(28) as g(frame)),
e as (select k, list_transform(range(128), lambda n: cos(2 * pi() * k * n / 128)) as co, list_transform(range(128), lambda n: sin(2 * pi() * k * n / 128)) as si from range(128) as g(k)),
p as (select s // 2 as win, frame, (k + 64) % 128 as bin, avg(pow((list_dot_product(a, co) + list_dot_product(b, si)) / 64, 2) + pow((list_dot_product(b, co) - list_dot_product(a, si)) / 64, 2)) as power from f, e group by all),
q as (select *, 10 * log10(power + 1e-10) as db from p),
v as (select win, frame, bin, (db - quantile_cont(db, 5e-1) over y) / ((quantile_cont(db, 95e-2) over y - quantile_cont(db, 5e-2) over y) / 2 + 1e-8) as v from q window y as (partition by win))
select win // 20000 as l_suppkey, win % 20000 as window_idx, frame, {_DIGEST.format("bin")} from v group by 1, 2, 3
""")
def doppler_branch(spark, d):
    """Spectrograms of the products with the reference antenna: mean removed, band-passed, in dB, scaled robustly."""
    rows = _window_features(spark, d).select("l_suppkey", F.col("window_idx").cast("long"), F.posexplode("doppler").alias("k", "v"))
    rows = rows.withColumn("frame", F.floor(F.col("k") / 128)).withColumn("bin", F.col("k") % 128)
    return _digest(rows, ["l_suppkey", "window_idx", "frame"], "bin")
