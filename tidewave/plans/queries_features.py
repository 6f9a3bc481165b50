"""Catalogue: windows, statistics and spectra. `embeddings` stands for packets of 64 bins, `events` for time series."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import query, read
from ..functions import arrays as A
from ..functions.kernels import filter_matrix
from ..operators import augment, clean, metrics, split, stats
from .queries_clean import _TRACK, track


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("e"), "label")


def rounded(c, digits):
    return F.transform(c, lambda x: F.round(x, digits))


_E = "select vec_id, list_transform(embedding, lambda x: x::double) as e, label from embeddings"


@query("subcarrier_select_52", "PRJ1", f"select vec_id, i, round(b[i + 1], 6) as value from (select vec_id, e[2:27] || e[39:64] as b from ({_E})), range(52) as r(i)")
def subcarrier_select_52(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(A.data_bins(F.col("e"))).alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("uniform_select_subcarriers", "PRJ2", f"select vec_id, i, round(e[round_even(i * 63 / 51e0, 0)::int + 1], 6) as value from ({_E}), range(52) as r(i)")
def uniform_select_subcarriers(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(A.spread_bins(F.col("e"), 64, 52)).alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("pad_antennas", "PRJ3", f"select vec_id, i, round(coalesce(e[i + 1], 0e0), 6) as value from ({_E}), range(72) as r(i)")
def pad_antennas(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(A.padded(F.col("e"), 72)).alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


_WORD = "((l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber * 7919) % 4294967296)::bigint"
_HALF = "(case when (w >> {s}) & 1 = 1 then ((w >> {m}) & 511) - 512 else (w >> {m}) & 511 end) * pow(2e0, ((w >> {e}) & 63) - 31)"


@query("float_unpack_bits", "SRC3 SCL6", f"""
select l_orderkey, l_linenumber, w as word, {_HALF.format(s=31, m=22, e=16)} as re, {_HALF.format(s=15, m=6, e=0)} as im from (select l_orderkey, l_linenumber, {_WORD} as w from lineitem)
""")
def float_unpack_bits(spark, d):
    word = F.expr("cast((l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber * 7919) % 4294967296 as bigint)")
    re, im = A.unpacked(F.col("word"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", word.alias("word")).select("l_orderkey", "l_linenumber", "word", re.alias("re"), im.alias("im"))


_AGC = f"""
g as (select vec_id, label, list_transform(e, lambda x: abs(x)) as a, list_avg(list_transform(e, lambda x: abs(x))) as gain from ({_E})),
n as (select *, case when gain > max(gain) over (partition by label) * 1e-3 then gain else 1e0 end as safe from g)
"""


def normalised(spark, d):
    e = vectors(spark, d).withColumn("a", F.transform("e", F.abs))
    return clean.gain_normalised(e, ["label"], "a")


@query("agc_normalize", "AGG2 AGG3", f"with {_AGC} select vec_id, round(gain, 6) as gain, i, round(a[i + 1] / (safe + 1e-8), 5) as value from n, range(64) as r(i)")
def agc_normalize(spark, d):
    out = normalised(spark, d).select("vec_id", F.round("gain", 6).alias("gain"), F.posexplode("normalised").alias("i", "value"))
    return out.select("vec_id", "gain", F.col("i").cast("long"), F.round("value", 5).alias("value"))


_FISHER = f"""
with {_AGC}, x as (select label, i, (a[2:27] || a[39:64])[i + 1] / (safe + 1e-8) as v from n, range(52) as r(i)),
p as (select i, label, count(*) as c, avg(v) as m, var_pop(v) as s from x group by 1, 2),
g as (select i, sum(c * m) / sum(c) as g from p group by 1),
f as (select p.i as sub, sum(c * (m - g) * (m - g)) / (sum(c * s) + 1e-12) as score from p join g using (i) group by 1)
"""


def fisher_of(spark, d):
    n = normalised(spark, d).select("label", F.posexplode(A.data_bins(F.col("normalised"))).alias("sub", "v"))
    return stats.fisher(n, "sub", "label", "v")


@query("fisher_scores", "AGG6", _FISHER.replace("with ", "with ", 1).replace("g as (select i,", "gm as (select i,").replace("join g using", "join gm using") + "select sub, round(score, 6) as score from f")
def fisher_scores(spark, d):
    return fisher_of(spark, d).select(F.col("sub").cast("long"), F.round("score", 6).alias("score"))


@query("fisher_select", "PRJ1 AGG2 AGG6 AGG7", _FISHER.replace("g as (select i,", "gm as (select i,").replace("join g using", "join gm using") + """
, s as (select sub // 4 as grp, sub, round(score, 9) as score from f) select grp, arg_max(sub, (score, -sub)) as sub, round(max(score), 6) as score from s group by 1
""")
def fisher_select(spark, d):
    """Packets -> 52 bins -> gain normalisation -> Fisher scores -> 13 selected bins."""
    best = stats.best_per_group(fisher_of(spark, d).withColumn("score", F.round("score", 9)), "sub", 52)
    return best.select(F.col("grp").cast("long"), F.col("sub").cast("long"), F.round("score", 6).alias("score"))


_ANT = f"select vec_id, label, j % 4 as ant, j // 4 as sub, abs(e[j + 1]) as m from ({_E}), range(64) as r(j)"


def antennas(spark, d):
    x = vectors(spark, d).select("vec_id", "label", F.posexplode("e").alias("j", "v"))
    return x.select("vec_id", "label", (F.col("j") % 4).alias("ant"), F.floor(F.col("j") / 4).alias("sub"), F.abs("v").alias("m"))


@query("ref_antenna", "AGG8 SRT3", f"""
with t as (select label, ant, vec_id, avg(m) as m from ({_ANT}) group by all), s as (select label, ant, avg(m) as mean, var_pop(m) as v from t group by all),
o as (select *, mean > 1e-1 * max(mean) over (partition by label) as ok from s)
select label, arg_min(ant, (v, ant)) as ant, round(min(v), 6) as variance from o where ok group by 1
""")
def ref_antenna(spark, d):
    out = stats.reference_antenna(antennas(spark, d), ["label"], "vec_id", "ant", "m")
    return out.select("label", F.col("ant").cast("long"), F.round("variance", 6).alias("variance"))


@query("other_antennas", "PRJ5", f"""
with t as (select label, ant, vec_id, avg(m) as m from ({_ANT}) group by all), s as (select label, ant, avg(m) as mean, var_pop(m) as v from t group by all),
r as (select label, arg_min(ant, (v, ant)) as ref from s group by 1)
select a.label, a.ant, count(*) as n from (select label, ant from ({_ANT})) a join r on r.label = a.label and r.ref <> a.ant group by all
""")
def other_antennas(spark, d):
    x = antennas(spark, d)
    ref = stats.reference_antenna(x, ["label"], "vec_id", "ant", "m").select("label", F.col("ant").alias("ref"))
    return x.join(F.broadcast(ref), "label").where("ant <> ref").groupBy("label", F.col("ant").cast("long").alias("ant")).agg(F.count(F.lit(1)).alias("n"))


@query("topk_variance_subcarriers", "AGG9", f"""
select label, sub, round(v, 6) as variance, k::int as rank from (select label, sub, v, row_number() over (partition by label order by round(v, 10) desc, sub desc) as k from (select label, sub, var_pop(m) as v from ({_ANT}) group by all)) where k <= 5
""")
def topk_variance_subcarriers(spark, d):
    return stats.top_variance(antennas(spark, d), ["label"], "sub", "m").select("label", "sub", F.round("variance", 6).alias("variance"), "rank")


_WIN = f"""
o as (select user_id, t, value, row_number() over (partition by user_id order by t) - 1 as i, count(*) over (partition by user_id) as n from ({_TRACK})),
w as (select user_id, k as window_idx, i - k * 10 as place, t, value from o, lateral (select unnest(range((n - 20) // 10 + 1)) as k) where n >= 20 and i >= k * 10 and i < k * 10 + 20)
"""


def windows(spark, d):
    w = stats.sliding(track(spark, d).select("user_id", "t", "value"), ["user_id"], "t", 20, 10)
    return stats.whole_windows(w, ["user_id"], "value")


@query("sliding_windows", "WIN6 FLT8", f"with {_WIN} select user_id, window_idx, count(*) as n, round(sum(value), 4) as total, round(max(t) - min(t), 3) as seconds from w group by 1, 2")
def sliding_windows(spark, d):
    g = windows(spark, d).groupBy("user_id", F.col("window_idx").cast("long").alias("window_idx"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query("window_center", "WIN8 WIN9 AGG10", f"""
with {_WIN} select user_id, window_idx, place, round(value - avg(value) over z, 5) as minus_mean, round(value - median(value) over z, 5) as minus_median from w window z as (partition by user_id, window_idx)
""")
def window_center(spark, d):
    c = stats.centred(windows(spark, d), ["user_id"], "value")
    return c.select("user_id", F.col("window_idx").cast("long").alias("window_idx"), F.col("place").cast("long").alias("place"), F.round("minus_mean", 5).alias("minus_mean"), F.round("minus_median", 5).alias("minus_median"))


@query("zscore_fit", "AGG4", f"with {_WIN} select user_id % 3 as fold, round(avg(value), 5) as mu, round(stddev_pop(value) + 1e-8, 4) as sigma from w group by 1")
def zscore_fit(spark, d):
    z = stats.zscore_fit(windows(spark, d).withColumn("fold", F.col("user_id") % 3), ["fold"], "value")
    return z.select("fold", F.round("mu", 5).alias("mu"), F.round("sigma", 4).alias("sigma"))


@query("zscore_apply", "SCL4 JN5", f"""
with {_WIN}, s as (select user_id % 3 as fold, avg(value) as mu, stddev_pop(value) + 1e-8 as sigma from w group by 1)
select user_id, window_idx, round(avg(abs((value - mu) / sigma)), 5) as z from w join s on s.fold = user_id % 3 group by 1, 2
""")
def zscore_apply(spark, d):
    w = windows(spark, d).withColumn("fold", F.col("user_id") % 3)
    z = stats.zscore_apply(w, F.broadcast(stats.zscore_fit(w, ["fold"], "value")), ["fold"], "value")  # three rows
    return z.groupBy("user_id", F.col("window_idx").cast("long").alias("window_idx")).agg(F.round(F.avg(F.abs("z")), 5).alias("z"))


@query("blurpool", "WIN13 MDL6", f"""
with o as (select user_id, row_number() over z - 1 as i, count(*) over (partition by user_id) as n, value as a, lead(value, 1) over z as b, lead(value, 2) over z as c, lead(value, 3) over z as d, lead(value, 4) over z as e from ({_TRACK}) window z as (partition by user_id order by t))
select user_id, i // 4 as i, round((a + 4 * b + 6 * c + 4 * d + e) / 16, 5) as value from o where i % 4 = 0 and i + 4 < n
""")
def blurpool(spark, d):
    return stats.blurpool(track(spark, d), ["user_id"], "t", "value").withColumn("value", F.round("value", 5))


@query("conj_multiply", "SCL1", f"""
select vec_id, i, round(e[i + 1] * r[i + 1] + e[i + 33] * r[i + 33], 5) as re, round(e[i + 33] * r[i + 1] - e[i + 1] * r[i + 33], 5) as im
from (select vec_id, e, coalesce(lag(e) over (order by vec_id), e) as r from ({_E})), range(32) as q(i)
""")
def conj_multiply(spark, d):
    """Each packet times the conjugate of the one before it."""
    v = vectors(spark, d)
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("e").alias("r"))
    v = v.join(before, "vec_id", "left").withColumn("r", F.coalesce("r", "e"))
    half = lambda c, k: F.slice(c, 1 + 32 * k, 32)
    re, im = A.multiply_conjugate(half("e", 0), half("e", 1), half("r", 0), half("r", 1))
    out = v.select("vec_id", F.posexplode(F.arrays_zip(re.alias("re"), im.alias("im"))).alias("i", "c"))
    return out.select("vec_id", F.col("i").cast("long"), F.round("c.re", 5).alias("re"), F.round("c.im", 5).alias("im"))


@query("dft_power", "WIN10 WIN11 SCL5 SCL11", f"""
with x as (select vec_id, j, e[j + 1] as v from (select * from ({_E})), range(64) as r(j)),
p as (select vec_id, k, pow(sum(v * cos(2 * pi() * k * j / 64)), 2) + pow(sum(v * sin(2 * pi() * k * j / 64)), 2) as p from x, range(64) as q(k) group by 1, 2)
select vec_id, (k + 32) % 64 as bin, round(p, 4) as power from p
""")
def dft_power(spark, d):
    p = vectors(spark, d).select("vec_id", F.posexplode(A.centred_bins(A.dft_power(F.col("e"), 64), 64)).alias("bin", "power"))
    return p.select("vec_id", F.col("bin").cast("long"), F.round("power", 4).alias("power"))


@query("stft_spectrogram", "WIN10 SCL2", f"""
with {_WIN}, f as (select user_id, window_idx, h as frame, place - h * 4 as j, value * (5e-1 - 5e-1 * cos(2 * pi() * (place - h * 4) / 8)) as v from w, range(4) as r(h) where place >= h * 4 and place < h * 4 + 8)
select user_id, window_idx, frame, k as bin, round(10 * log10((pow(sum(v * cos(2 * pi() * k * j / 8)), 2) + pow(sum(v * sin(2 * pi() * k * j / 8)), 2)) / 16 + 1e-10), 3) as db
from f, range(1, 4) as q(k) group by all having (pow(sum(v * cos(2 * pi() * k * j / 8)), 2) + pow(sum(v * sin(2 * pi() * k * j / 8)), 2)) > 1e-6
""")
def stft_spectrogram(spark, d):
    """Frames of 8 samples, hop 4, of windows of 20: each sample goes to its frames, each frame to its bins."""
    w = windows(spark, d)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("place") - 7) / 4)), F.least(F.lit(3), F.floor(F.col("place") / 4))
    w = w.withColumn("frame", F.explode(F.sequence(lo.cast("long"), hi.cast("long")))).withColumn("j", F.col("place") - F.col("frame") * 4)
    v = F.col("value") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("j") / 8))
    sums = w.withColumn("v", v).groupBy("user_id", F.col("window_idx").cast("long").alias("window_idx"), "frame").agg(
        *(F.sum(F.col("v") * f(2 * math.pi * k * F.col("j") / 8)).alias(f"{f.__name__}{k}") for k in range(1, 4) for f in (F.cos, F.sin)))
    bins = F.array(*(F.struct(F.lit(k).cast("long").alias("bin"), (F.col(f"cos{k}") ** 2 + F.col(f"sin{k}") ** 2).alias("p")) for k in range(1, 4)))
    out = sums.select("user_id", "window_idx", "frame", F.explode(bins).alias("b")).where("b.p > 1e-6")
    return out.select("user_id", "window_idx", "frame", "b.bin", F.round(10 * F.log10(F.col("b.p") / 16 + 1e-10), 3).alias("db"))


@query("log_robust_norm", "SCL2 SCL3 AGG11 MET11", f"""
with {_WIN}, s as (select user_id, window_idx, place, 10 * log10(value * value + 1e-10) as s from w),
q as (select user_id, window_idx, median(s) as m, quantile_cont(s, 5e-2) as lo, quantile_cont(s, 95e-2) as hi from s group by 1, 2)
select user_id, window_idx, place, round((s - m) / ((hi - lo) / 2 + 1e-8), 4) as value from s join q using (user_id, window_idx)
""")
def log_robust_norm(spark, d):
    w = windows(spark, d).withColumn("s", 10 * F.log10(F.col("value") * F.col("value") + 1e-10))
    by = Window.partitionBy("user_id", "window_idx")
    half = (F.percentile("s", F.lit(0.95)).over(by) - F.percentile("s", F.lit(0.05)).over(by)) / 2
    v = (F.col("s") - F.median("s").over(by)) / (half + 1e-8)
    return w.select("user_id", F.col("window_idx").cast("long").alias("window_idx"), F.col("place").cast("long").alias("place"), F.round(v, 4).alias("value"))


def _matrix_sql(kind: str) -> str:
    rows = ", ".join("[" + ", ".join(f"{x:.12e}" for x in row) + "]" for row in filter_matrix(kind, 64))
    return f"with m as (select [{rows}] as m) select vec_id, i, round(list_dot_product(m[i + 1], e), 4) as value from ({_E}), m, range(64) as r(i)"


def _filtered(kind: str):
    def run(spark, d):
        rows = A.filtered(F.col("e"), filter_matrix(kind, 64))
        out = vectors(spark, d).select("vec_id", F.posexplode(rows).alias("i", "value"))
        return out.select("vec_id", F.col("i").cast("long"), F.round("value", 4).alias("value"))

    return run


query("lowpass_matrix", "DSP1", _matrix_sql("low"))(_filtered("low"))
query("bandpass_matrix", "DSP2", _matrix_sql("band"))(_filtered("band"))


@query("mask_fixed", "AUG2", f"select vec_id, i, case when i >= 10 and i < 16 then 0e0 else round(e[i + 1], 6) end as value from ({_E}), range(64) as r(i)")
def mask_fixed(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(A.masked(F.col("e"), 10, 6)).alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("shift_fixed", "WIN12", f"select vec_id, i, round(e[greatest(0, least(63, i - 5)) + 1], 6) as value from ({_E}), range(64) as r(i)")
def shift_fixed(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(A.shifted(F.col("e"), 5)).alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("cutmix_fixed", "AUG3", f"""
with v as (select *, row_number() over (partition by vec_id // 16 order by vec_id) - 1 as k, count(*) over (partition by vec_id // 16) as n from ({_E}))
select a.vec_id, b.vec_id as partner, i, round(case when i >= 20 and i < 32 then b.e[i + 1] else a.e[i + 1] end, 6) as value
from v a join v b on a.vec_id // 16 = b.vec_id // 16 and b.k = (a.k + 1) % a.n, range(64) as r(i)
""")
def cutmix_fixed(spark, d):
    """Samples 20..31 come from the next packet of the batch of 16."""
    by = Window.partitionBy(F.floor(F.col("vec_id") / 16))
    w = by.orderBy("vec_id")
    v = vectors(spark, d).withColumn("o", F.coalesce(F.lead(F.struct("vec_id", "e")).over(w), F.first(F.struct("vec_id", "e")).over(w)))
    mixed = F.concat(F.slice("e", 1, 20), F.slice("o.e", 21, 12), F.slice("e", 33, 32))
    out = v.select("vec_id", F.col("o.vec_id").alias("partner"), F.posexplode(mixed).alias("i", "value"))
    return out.select("vec_id", "partner", F.col("i").cast("long"), F.round("value", 6).alias("value"))


# tracks of embeddings: recording = label, person = label % 5, class = label % 3; windows of 20 vectors, 10 apart
_WIN = f"""
t as (select label, row_number() over (partition by label order by vec_id) - 1 as i, count(*) over (partition by label) as n, e from ({_E})),
w as (select label, w as win, j // 4 as sub, j % 4 as ant, abs(e[j + 1]) as m, abs(e[j - j % 4 + 1]) as r from t, range(1000) as g(w), range(64) as q(j) where n >= 20 and w <= (n - 20) // 10 and i between 10 * w and 10 * w + 19),
c as (select *, m - median(m) over (partition by label, win, sub, ant) as a, m * r - avg(m * r) over (partition by label, win, sub, ant) as p from w),
v as (select label, win, sub, ant, avg(a) as mean, var_pop(a) as var, var_pop(abs(p)) as x from c group by all),
k as (select distinct label % 5 as person from v), f as (select fold::int as fold, label from (select distinct label from v) l, range(5) as g(fold) where (label % 5) not in (fold, (fold + 1) % 5)),
z as (select fold, (sub * 4 + ant)::int as place, avg(mean) as mu, sqrt(avg(var) + var_pop(mean)) + 1e-8 as sigma from v join f using (label) group by 1, 2),
x as (select fold, label % 3 as cls, sub, avg(x) as x from v join f using (label) where ant > 0 group by fold, label, win, sub),
s as (select fold, cls, sub, count(*) as n, avg(x) as m, var_pop(x) as v from x group by 1, 2, 3), g as (select fold, sub, sum(n * m) / sum(n) as m from s group by 1, 2),
h as (select s.fold, s.sub, sum(s.n * (s.m - g.m) * (s.m - g.m)) / (sum(s.n * s.v) + 1e-12) as score from s join g on g.fold = s.fold and g.sub = s.sub group by 1, 2)
"""


def fold_windows(spark, d):
    """Windows of made-up frames of 16 subcarriers and 4 antennas, with the reference antenna 0."""
    v = vectors(spark, d)
    rows = v.select("vec_id", "label", F.posexplode("e").alias("j", "v"))
    ref = F.abs(F.get(F.col("e"), F.col("j") - F.col("j") % 4))
    rows = rows.join(v.select("vec_id", "e"), "vec_id").select("vec_id", "label", "j", F.abs("v").alias("m"), (F.abs("v") * ref).alias("product"))
    w = stats.sliding(rows, ["label", "j"], "vec_id", 20, 10)
    by = Window.partitionBy("label", "j", "window_idx")
    w = w.withColumn("a", F.col("m") - F.median("m").over(by)).withColumn("p", F.abs(F.col("product") - F.avg("product").over(by)))
    per = w.groupBy("label", "window_idx", "j").agg(F.avg("a").alias("mean"), F.var_pop("a").alias("var"), F.var_pop("p").alias("x"))
    places = F.array_sort(F.collect_list(F.struct("j", "mean", "var")))  # 64 places
    subs = per.where("j % 4 <> 0").groupBy("label", "window_idx", F.floor(F.col("j") / 4).alias("sub")).agg(F.avg("x").alias("x"))
    subs = subs.groupBy("label", "window_idx").agg(F.array_sort(F.collect_list(F.struct("sub", "x"))).alias("s"))
    whole = per.groupBy("label", "window_idx").agg(places.alias("p")).join(subs, ["label", "window_idx"])
    whole = whole.select((F.col("label") % 5).alias("person"), (F.col("label") % 3).alias("label"), F.concat_ws(":", "label", "window_idx").alias("window"), F.col("p.mean").alias("mean"), F.col("p.var").alias("var"), F.col("s.x").alias("x"))
    return whole


def fold_tables(spark, d):
    people = vectors(spark, d).select((F.col("label") % 5).alias("person"))
    return stats.fold_statistics(stats.person_moments(fold_windows(spark, d)), split.person_ranks(people, "person"), 16, 4)


@query("fold_zscore", "AGG4 JN5 JN6", f"with {_WIN} select fold, place, round(mu, 6) as mu, round(sigma, 6) as sigma from z")
def fold_zscore(spark, d):
    """Each fold's z-score statistics, from the windows of its training persons."""
    zscore, _, _ = fold_tables(spark, d)
    return zscore.select(F.col("fold").cast("int"), "place", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("fold_selection", "AGG5 AGG6 AGG7", f"with {_WIN} select fold, (sub // 4)::bigint as grp, arg_max(sub, (score, -sub))::int as sub, round(max(score), 5) as score from h group by 1, 2")
def fold_selection(spark, d):
    """Each fold's Fisher-selected subcarriers by the variance of the product with the reference antenna."""
    _, _, best = fold_tables(spark, d)
    return best.select(F.col("fold").cast("int"), F.col("grp").cast("long"), F.col("sub").cast("int"), F.round("score", 5).alias("score"))


def _draw(key, seed, what):
    return f"(('0x' || substr(md5({key} || ':{seed}:{what}'), 1, 12))::bigint / 281474976710656e0)"


@query("mask_drawn", "AUG2", f"""
with m as (select vec_id, e, case when {_draw('vec_id', 42, 'bins?')} < 4e-1 then floor({_draw('vec_id', 42, 'bins width')} * 7)::int + 3 else 0 end as width from ({_E})),
s as (select *, floor({_draw('vec_id', 42, 'bins')} * (65 - width))::int as start from m)
select vec_id, i, case when i >= start and i < start + width then 0e0 else round(e[i + 1], 6) end as value from s, range(64) as r(i)
""")
def mask_drawn(spark, d):
    """Stretches of 3 to 9 bins masked with chance 0.4."""
    out = augment.masked_bins(vectors(spark, d), "vec_id", "e", 42)
    return out.select("vec_id", F.posexplode("masked").alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("spectrogram_mask_drawn", "AUG4", f"""
with m as (select vec_id, e, case when {_draw('vec_id', 7, 'doppler?')} < 3e-1 then floor({_draw('vec_id', 7, 'doppler width')} * 5)::int + 2 else 0 end as cw, case when {_draw('vec_id', 7, 'frames?')} < 3e-1 then floor({_draw('vec_id', 7, 'frames width')} * 3)::int + 1 else 0 end as rw from ({_E})),
s as (select *, floor({_draw('vec_id', 7, 'doppler')} * (17 - cw))::int as c, floor({_draw('vec_id', 7, 'frames')} * (5 - rw))::int as r from m)
select vec_id, i, case when (i % 16 >= c and i % 16 < c + cw) or (i // 16 >= r and i // 16 < r + rw) then 0e0 else round(e[i + 1], 6) end as value from s, range(64) as q(i)
""")
def spectrogram_mask_drawn(spark, d):
    """Vectors as spectrograms of 4 frames and 16 bins."""
    out = augment.masked_spectrogram(vectors(spark, d), "vec_id", "e", 4, 16, 7)
    return out.select("vec_id", F.posexplode("masked").alias("i", "value")).select("vec_id", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("cutmix_drawn", "AUG3 JN9", f"""
with v as (select *, vec_id // 16 as b, row_number() over (partition by vec_id // 16 order by {_draw('vec_id', 53, 'order')}, vec_id) - 1 as k, count(*) over (partition by vec_id // 16) as n from ({_E})),
m as (select *, case when {_draw('b', 53, 'cut?')} < 3e-1 then floor({_draw('b', 53, 'cut width')} * 12)::int + 1 else 0 end as width from v),
s as (select *, floor({_draw('b', 53, 'cut')} * (65 - width))::int as start from m)
select a.vec_id, o.vec_id as partner, round(1 - a.width / 64, 6) as weight, i, round(case when i >= start and i < start + width then o.e[i + 1] else a.e[i + 1] end, 6) as value
from s a join v o on a.b = o.b and o.k = (a.k + 1) % a.n, range(64) as r(i)
""")
def cutmix_drawn(spark, d):
    """Epoch 11: batches of 16 take up to a fifth of the time from a shuffled partner with chance 0.3."""
    rows = vectors(spark, d).withColumn("b", F.floor(F.col("vec_id") / 16))
    out = augment.cut_and_mixed(rows, "b", "vec_id", "e", "label", 42, epoch=11)
    out = out.select("vec_id", "partner", F.round("weight", 6).alias("weight"), F.posexplode("mixed").alias("i", "value"))
    return out.select("vec_id", "partner", "weight", F.col("i").cast("long"), F.round("value", 6).alias("value"))


@query("frequency_axis", "SCL11", "select k, (k - 64) * 350e0 / 128 as hz from range(128) as r(k)")
def frequency_axis(spark, d):
    return spark.range(128).select(F.col("id").alias("k"), A.frequency(F.col("id")).alias("hz"))


@query("spectrogram_mean", "MET11", f"""
with m as (select vec_id, i, (e[i + 1] + e[i + 22] + e[i + 43]) / 3 as v from ({_E}), range(21) as r(i))
select vec_id, round(quantile_cont(v, 5e-2), 6) as low, round(quantile_cont(v, 95e-2), 6) as high, round(sum(v), 6) as total from m group by 1
""")
def spectrogram_mean(spark, d):
    """Three receivers' spectrograms of 21 values: their mean and its colour limits."""
    v = vectors(spark, d).withColumn("m", A.mean_of(F.array(*(F.slice("e", 1 + 21 * r, 21) for r in range(3)))))
    c = metrics.colour_limits(F.col("m"))
    return v.select("vec_id", F.round(c["low"], 6).alias("low"), F.round(c["high"], 6).alias("high"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("augment_joint", "AUG1", f"""
with w as (select vec_id, rx, ant, (vec_id % 4)::int as ref, list_transform(range(5), lambda i: e[((rx * 4 + ant) * 5 + i + 1)::bigint]) as v from ({_E}), range(3) as r(rx), range(4) as q(ant)),
f as (select *, case when {_draw('vec_id', 5, 'shift?')} < 5e-1 then floor({_draw('vec_id', 5, 'shift')} * 5)::int - 2 else 0 end as by_, case when {_draw('vec_id', 5, 'scale?')} < 5e-1 then 6e-1 + 8e-1 * {_draw('vec_id', 5, 'scale')} else 1e0 end as factor,
      floor({_draw('vec_id', 5, 'antenna')} * 3)::int as o, {_draw('vec_id', 5, 'antenna?')} < 2e-1 as drops, {_draw('vec_id', 5, 'receiver?')} < 1e-1 and rx = floor({_draw('vec_id', 5, 'receiver')} * 3)::int as lost from w),
g as (select *, lost or (drops and ant = o + (o >= ref)::int) as gone from f)
select vec_id, rx::int as rx, ant::int as ant, i, round(case when gone then 0e0 else v[greatest(0, least(4, i - by_)) + 1] * factor end, 6) as re, round(case when gone then 0e0 else 2 * v[greatest(0, least(4, i - by_)) + 1] * factor end, 6) as im from g, range(5) as s(i)
""")
def augment_joint(spark, d):
    """Windows of 3 receivers and 4 antennas with 5 samples each, shifted by up to 2, noise of no strength."""
    v = vectors(spark, d).select("vec_id", (F.col("vec_id") % 4).cast("int").alias("ref"), "e")
    cells = F.array(*(F.struct(F.lit(rx).alias("rx"), F.lit(ant).alias("ant"), F.slice("e", 1 + 5 * (4 * rx + ant), 5).alias("re")) for rx in range(3) for ant in range(4)))
    rows = v.select("vec_id", "ref", F.explode(cells).alias("c")).select("vec_id", "ref", "c.rx", "c.ant", "c.re").withColumn("im", F.transform("re", lambda x: 2 * x))
    out = augment.augmented_joint(rows, "vec_id", "rx", "ant", "ref", "re", "im", 5, shift=2, noise=0.0)
    out = out.select("vec_id", "rx", "ant", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return out.select("vec_id", "rx", "ant", F.col("i").cast("long"), F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


@query("dual_readout", "MDL6", f"""
with x as (select vec_id, c, i, e[i * 4 + c + 1] as v from ({_E}), range(4) as q(c), range(16) as r(i)),
b as (select vec_id, c, j, list_sum(list_transform(range(5), lambda k: e[(j * 4 + k) * 4 + c + 1] * [1, 4, 6, 4, 1][k + 1])) / 16 as v from ({_E}), range(4) as q(c), range(3) as s(j))
select x.vec_id, x.c as channel, round(avg(x.v), 6) as mean, round(avg(x.v * x.v), 6) as energy, round(any_value(m.blurred), 6) as blurred
from x join (select vec_id, c, avg(v) as blurred from b group by 1, 2) m on m.vec_id = x.vec_id and m.c = x.c group by 1, 2
""")
def dual_readout(spark, d):
    """Vectors as 16 steps of 4 channels: mean, energy, and the mean of the blurred quarter of steps."""
    rows = vectors(spark, d).select("vec_id", F.posexplode("e").alias("j", "v")).select("vec_id", (F.col("j") % 4).alias("channel"), F.floor(F.col("j") / 4).alias("step"), "v")
    return stats.readout(rows, ["vec_id", "channel"], "step", "v").select("vec_id", F.col("channel").cast("long"), *(F.round(c, 6).alias(c) for c in ("mean", "energy", "blurred")))
