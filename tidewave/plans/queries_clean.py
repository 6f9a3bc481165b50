"""Catalogue: cleaning, time base, splits. `events` stands for packets: user_id a recording, ts time, value amplitude."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, read
from ..operators import align, clean, split


def track(spark, d):
    """Packets with t, seconds since 2024-01-01, exact in double precision, in whatever time zone the session is."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    return read(spark, d, "events").select("user_id", "event_id", "event_type", seconds.alias("t"), "value")


_T = "(epoch_us(ts) - 1704067200000000) / 1e6"
_TRACK = f"select user_id, event_id, event_type, {_T} as t, value from events"


@query("packet_dedupe_keep_first", "FLT1 FLT2 SRT1", f"""
select user_id, event_id, t, value from ({_TRACK}) where value is not null and isfinite(value)
""")
def packet_dedupe_keep_first(spark, d):
    e = track(spark, d)
    again = e.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    packed = e.unionByName(again).withColumn("v", F.array(F.coalesce("value", F.lit(float("nan")))))
    kept = clean.first_by_time(clean.finite(packed, "v"), ["user_id"], "t", "event_id")
    return kept.select("user_id", "event_id", "t", "value")


RATE = 25e-6


@query("packet_loss_reject", "FLT3 FLT4", f"""
with s as (select user_id, count(*) as n, max(t) - min(t) as duration from ({_TRACK}) group by 1),
l as (select *, case when duration > 0 then 1 - n / (duration * 25e-6) else 0e0 end as loss from s)
select user_id, n, round(duration, 3) as duration, round(loss, 5) as loss, n < 60 or loss > 15e-2 as rejected from l
""")
def packet_loss_reject(spark, d):
    out = clean.loss_report(track(spark, d), ["user_id"], F.col("t"), rate=RATE, min_count=60)
    return out.select("user_id", "n", F.round("duration", 3).alias("duration"), F.round("loss", 5).alias("loss"), "rejected")


@query("ipi_gap_flags", "FLT5 WIN7", f"""
with i as (select user_id, event_id, t - lag(t) over (partition by user_id order by t) as ipi from ({_TRACK})),
m as (select *, median(ipi) over (partition by user_id) as med from i)
select user_id, event_id, round(ipi, 4) as ipi, ipi > 3 * med as gap_small, ipi > 3 * med or ipi > 60000 as gap_medium, ipi > 150000 as gap_large from m
""")
def ipi_gap_flags(spark, d):
    out = clean.gaps(track(spark, d), ["user_id"], "t", F.col("t"), medium=60000.0, large=150000.0)
    return out.select("user_id", "event_id", F.round("ipi", 4).alias("ipi"), "gap_small", "gap_medium", "gap_large")


_SPAN = 36000
@query("core_merge_anchored", "AGG1 JN3", f"""
with recursive o as (
  select user_id, event_id, t, row_number() over (partition by user_id order by t, event_id) as rn from ({_TRACK})
), r as (
  select user_id, rn, t, event_id, t as start from o where rn = 1
  union all
  select o.user_id, o.rn, o.t, o.event_id, case when o.t - r.start <= {_SPAN} then r.start else o.t end from r join o on o.user_id = r.user_id and o.rn = r.rn + 1
), c as (
  select user_id, start, event_id % 4 as core, max(event_id) as last from (select *, row_number() over (partition by user_id, start, event_id % 4 order by rn desc) as k from r) where k = 1 group by all
)
select user_id, start as group_start, count(*)::bigint as cores, count(*) = 4 as complete, sum(last)::bigint as last_ids from c group by 1, 2
""")
def core_merge_anchored(spark, d):
    """Groups anchored at their first packet; the last packet of each core wins."""
    core = F.struct((F.col("event_id") % 4).alias("core"), F.col("event_id").alias("id"))
    g = clean.anchored_groups(track(spark, d).withColumn("k", F.struct("t", "event_id")).drop("k"), ["user_id"], "t", core, _SPAN)
    last = F.transform(F.array(*map(F.lit, range(4))), lambda c: F.try_element_at(F.filter("items", lambda x: x["core"] == c), F.lit(-1))["id"])
    kept = F.filter(last, lambda x: x.isNotNull())
    return g.select("user_id", "group_start", F.size(kept).cast("long").alias("cores"), (F.size(kept) == 4).alias("complete"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x).alias("last_ids"))


_HAMPEL = f"""
with l as (select user_id, list(value order by t, event_id) as v, list(t order by t, event_id) as ts from ({_TRACK}) group by 1),
a as (select *, list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - list_sort(list_transform(range(i - 7, i + 8), lambda j: v[greatest(1, least(j, len(v)))]))[8])) as dev from l),
b as (select *, list_transform(range(1, len(v) + 1), lambda i: list_sort(list_transform(range(i - 7, i + 8), lambda j: dev[greatest(1, least(j, len(v)))]))[8]) as mad from a),
c as (select *, list_transform(range(1, len(v) + 1), lambda i: dev[i] > 3 * 14826e-4 * mad[i]) as bad from b),
f as (select user_id, unnest(ts) as t, unnest(v) as value, unnest(bad) as bad, unnest(list_transform(range(1, len(v) + 1), lambda i: bad[i] or coalesce(bad[i + 1], false) or (i > 1 and bad[greatest(i - 1, 1)]))) as dilated from c)
"""


def _flags(spark, d):
    return clean.hampel(track(spark, d).where("value is not null"), ["user_id"], "t", "value")


@query("hampel_flags", "WIN1 WIN2 AGG3", _HAMPEL + "select user_id, t, value, bad, dilated from f")
def hampel_flags(spark, d):
    return _flags(spark, d)


@query("hampel_reject", "FLT6 WIN15", _HAMPEL + """
select user_id, round(avg(dilated::int), 6) as share, avg(dilated::int) > 5e-1 as rejected, avg(dilated::int) > 2e-1 as warned from f group by 1
""")
def hampel_reject(spark, d):
    return clean.outlier_verdict(_flags(spark, d), ["user_id"]).withColumn("share", F.round("share", 6))


# Slopes by their definition on plain columns; knots k(g, x, y).
_SLOPES = """
s0 as (select g, x, y, lead(x) over w as x1, lead(y) over w as y1, lag(x) over w as xp, lag(y) over w as yp, lead(x, 2) over w as x2, lead(y, 2) over w as y2, lag(x, 2) over w as xq, lag(y, 2) over w as yq
  from k window w as (partition by g order by x)),
s1 as (select *, x1 - x as h, (y1 - y) / (x1 - x) as d, x - xp as hp, (y - yp) / (x - xp) as dp, x2 - x1 as hn, (y2 - y1) / (x2 - x1) as dn, xp - xq as hq, (yp - yq) / (xp - xq) as dq from s0),
s2 as (select *, case
    when dp is null and dn is null then d
    when dp is null then case when sign(((2*h+hn)*d-h*dn)/(h+hn)) <> sign(d) then 0e0 when sign(d) <> sign(dn) and abs(((2*h+hn)*d-h*dn)/(h+hn)) > abs(3*d) then 3*d else ((2*h+hn)*d-h*dn)/(h+hn) end
    when d is null and dq is null then dp
    when d is null then case when sign(((2*hp+hq)*dp-hp*dq)/(hp+hq)) <> sign(dp) then 0e0 when sign(dp) <> sign(dq) and abs(((2*hp+hq)*dp-hp*dq)/(hp+hq)) > abs(3*dp) then 3*dp else ((2*hp+hq)*dp-hp*dq)/(hp+hq) end
    when d * dp <= 0 then 0e0 else (3*h+3*hp) / ((2*h+hp)/dp + (h+2*hp)/d) end as m from s1),
s3 as (select g, x, y, x1, y1, h, m, lead(m) over (partition by g order by x) as m1 from s2)
"""
_CURVE = """case when {t} <= s3.x or s3.x1 is null then s3.y else
  (2*pow(({t}-s3.x)/h,3) - 3*pow(({t}-s3.x)/h,2) + 1)*s3.y + (pow(({t}-s3.x)/h,3) - 2*pow(({t}-s3.x)/h,2) + ({t}-s3.x)/h)*h*m
  + (3*pow(({t}-s3.x)/h,2) - 2*pow(({t}-s3.x)/h,3))*s3.y1 + (pow(({t}-s3.x)/h,3) - pow(({t}-s3.x)/h,2))*h*m1 end"""


@query("pchip_resample", "WIN5 JN4", f"""
with k as (select user_id as g, t as x, value as y from ({_TRACK}) where value is not null), {_SLOPES},
n as (select g, min(x) as a, max(x) as b from k group by 1),
grid as (select g, i, a + i * 3600e0 as t from n, lateral (select unnest(range(ceil((b - a) / 36e2)::bigint)) as i))
select grid.g as user_id, grid.i as i, round({_CURVE.format(t='grid.t')}, 4) as value from grid asof join s3 on grid.g = s3.g and grid.t >= s3.x
""")
def pchip_resample(spark, d):
    out = align.resampled(track(spark, d).where("value is not null"), ["user_id"], "t", "value", 3600.0)
    return out.select("user_id", "i", F.round("value", 4).alias("value"))


@query("edge_fill", "WIN14", f"""
with g as (select user_id, event_id, t, case when event_id % 3 = 0 or user_id % 10 = 0 then null else value end as v from ({_TRACK})),
b as (select *, last_value(v ignore nulls) over (partition by user_id order by t, event_id rows unbounded preceding) as before,
      first_value(v ignore nulls) over (partition by user_id order by t, event_id rows between current row and unbounded following) as after, count(v) over (partition by user_id) as n from g)
select user_id, event_id, round(case when n = 0 then 0e0 when before is null then after when after is null then before else v end, 6) as filled from b
""")
def edge_fill(spark, d):
    """A third of the values and every tenth track are missing; gaps at the edges are filled, inner ones stay."""
    gone = (F.col("event_id") % 3 == 0) | (F.col("user_id") % 10 == 0)
    e = track(spark, d).withColumn("v", F.when(~gone, F.col("value"))).withColumn("order", F.struct("t", "event_id"))
    return clean.edge_filled(e, ["user_id"], "order", "v").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query("pchip_repair", "WIN3 WIN15", _HAMPEL + f""", o as (select *, (row_number() over (partition by user_id order by t) - 1)::bigint as i from f),
k as (select user_id as g, i::double as x, value as y from o where not dilated), {_SLOPES},
kc as (select g, count(*) as n, min(x) as lo, arg_min(y, x) as ylo from k group by 1)
select o.user_id, o.i, round(case when not dilated or coalesce(kc.n, 0) < 4 then o.value when o.i < kc.lo then kc.ylo else {_CURVE.format(t="o.i")} end, 6) as repaired
from o left join kc on kc.g = o.user_id asof left join s3 on s3.g = o.user_id and o.i >= s3.x
""")
def pchip_repair(spark, d):
    f = _flags(spark, d)
    from pyspark.sql import Window

    f = f.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1)
    out = align.repaired(f, ["user_id"], "i", "value", "dilated")
    return out.select("user_id", "i", F.round("repaired", 6).alias("repaired"))


@query("xcorr_lag", "WIN4 JN10 FLT7", f"""
with h as (select event_type, floor(t / 3600)::bigint as i, count(*)::double as v from ({_TRACK}) group by 1, 2),
c as (select event_type, i, v - avg(v) over (partition by event_type) as v from h),
r as (select i, v from c where event_type = (select min(event_type) from h)),
s as (select c.event_type, c.i - r.i as lag, sum(c.v * r.v) as score from c join r on abs(c.i - r.i) <= 12 group by 1, 2)
select event_type, arg_max(lag, (round(score, 6), -lag)) as lag, arg_max(lag, (round(score, 6), -lag)) / 1e1 as shift,
       abs(arg_max(lag, (round(score, 6), -lag)) / 1e1) > 1e-1 as warned, abs(arg_max(lag, (round(score, 6), -lag)) / 1e1) > 5e-1 as rejected from s group by 1
""")
def xcorr_lag(spark, d):
    hours = track(spark, d).groupBy("event_type", F.floor(F.col("t") / 3600).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    first = hours.agg(F.min("event_type")).first()[0]
    return align.lags(hours, [], "event_type", "i", "v", first, 12, rate=10.0).withColumn("lag", F.col("lag").cast("long"))




def _few(spark, d):
    return read(spark, d, "events").withColumn("person", (F.col("user_id") % 15).cast("int"))


@query("loso_split", "SPL1 SPL2 AGG16 SET2 SRT2", """
with p as (select distinct (user_id % 15)::int as person from events), r as (select person, (row_number() over (order by person) - 1)::int as k, (select count(*) from p)::int as n from p)
select fold::int as fold, person, case when k = fold then 'test' when k = (fold + 1) % n then 'val' else 'train' end as split from r, range((select count(*) from p)) as g(fold)
""")
def loso_split(spark, d):
    return split.subject_folds(_few(spark, d), "person")


@query("loso_leakage_audit", "SPL3 SET1 JN6", """
with u as (select distinct user_id, (user_id % 15)::int as person from events union select distinct user_id, ((user_id + 1) % 15)::int from events where user_id % 10 = 0),
r as (select person, row_number() over (order by person) - 1 as k, count(*) over () as n from (select distinct person from u)),
s as (select fold::int as fold, user_id, case when k = fold then 'test' when k = (fold + 1) % n then 'val' else 'train' end as split from u join r using (person), range((select count(*) from r)) as g(fold)),
x as (select fold, a.split || '/' || b.split as pair, count(distinct user_id) as shared from s a join s b using (fold, user_id) group by 1, 2)
select g.fold, p.pair, coalesce(x.shared, 0)::bigint as shared from (select distinct fold from s) g cross join (values ('test/train'), ('test/val'), ('train/val')) as p(pair) left join x on x.fold = g.fold and x.pair = p.pair
""")
def loso_leakage_audit(spark, d):
    """Every tenth recording also stands under a second person, so some folds leak."""
    e = _few(spark, d)
    twice = e.where("user_id % 10 = 0").withColumn("person", ((F.col("user_id") + 1) % 15).cast("int"))
    units = e.select("person", "user_id").unionByName(twice.select("person", "user_id")).distinct()
    return split.leakage(split.with_folds(units, "person"), "user_id")


@query("class_counts_per_split", "AGG14", """
with p as (select distinct (user_id % 15)::int as person from events), r as (select person, row_number() over (order by person) - 1 as k, (select count(*) from p) as n from p),
s as (select g.fold::int as fold, person, case when k = fold then 'test' when k = (fold + 1) % n then 'val' else 'train' end as split from r, range((select count(*) from p)) as g(fold)),
c as (select fold, split, event_type, count(*) as n from events join s on s.person = (user_id % 15)::int group by all)
select g.fold, g.split, t.event_type, coalesce(c.n, 0)::bigint as n from (select distinct fold, split from s) g cross join (select distinct event_type from events) t
left join c on c.fold = g.fold and c.split = g.split and c.event_type = t.event_type
""")
def class_counts_per_split(spark, d):
    e = _few(spark, d)
    folds = split.subject_folds(e, "person")
    per = e.groupBy("person", "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = per.join(folds, "person").groupBy("fold", "split", "event_type").agg(F.sum("n").alias("n"))
    cells = folds.select("fold", "split").distinct().crossJoin(F.broadcast(e.select("event_type").distinct()))  # folds x 3 x classes
    return cells.join(counts, ["fold", "split", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


#: An activity map in the style of the blueprint's: first match wins.
CLASSES = [("small", 0), ("large", 1), ("steel", 2), ("brass", 3), ("tin", 4), ("copper", 5), ("nickel", 6), ("economy", 7)]


@query("class_map_fuzzy", "JN7 FLT9 SCL8", """
with k as (select p_partkey, replace(lower(trim(p_type)), ' ', '_') as key from part),
m(name, id, ord) as (values ('small', 0, 0), ('large', 1, 1), ('steel', 2, 2), ('brass', 3, 3), ('tin', 4, 4), ('copper', 5, 5), ('nickel', 6, 6), ('economy', 7, 7))
select p_partkey, coalesce(min(case when key = name then id end), arg_min(id, ord) filter (contains(key, name) or contains(name, key)))::int as class_id from k, m group by 1
having coalesce(min(case when key = name then id end), arg_min(id, ord) filter (contains(key, name) or contains(name, key))) is not null
""")
def class_map_fuzzy(spark, d):
    return split.mapped_class(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", CLASSES).where("class_id is not null").select("p_partkey", "class_id")


#: Names in the style of the blueprint's classes; some lie within others.
ACTIVITIES = ("steel", "polished_steel", "tin", "small", "brushed", "plated", "green", "forest_green", "nickel")


@query("activity_from_path", "LBL3", f"""
with f as (select p_partkey, 'set/' || replace(p_type, ' ', '_') || '/' || case when p_partkey % 3 = 0 then 'For_Est_Green/' else '' end || replace(p_name, ' ', '_') || '_rep' || p_partkey || '.pcap' as path from part),
m(name, ord) as (values {", ".join(f"('{name}', {i})" for i, name in enumerate(ACTIVITIES))}),
q as (select p_partkey, unnest(string_split(replace(lower(path), '_', ''), '/')) as part, generate_subscripts(string_split(path, '/'), 1) as k from f),
l as (select p_partkey, arg_max(name, (k, ord)) as last_match from q, m where contains(part, replace(name, '_', '')) group by 1),
s as (select p_partkey, arg_min(name, ord) as stem_match from f, m where contains(regexp_extract(replace(lower(path), '_', ''), '([^/.]*)[.]pcap$', 1), replace(name, '_', '')) group by 1)
select f.p_partkey, last_match, stem_match from f left join l using (p_partkey) left join s using (p_partkey)
""")
def activity_from_path(spark, d):
    """Both rules on made-up paths: the last match of any part, and the first one of the stem."""
    folder = F.when(F.col("p_partkey") % 3 == 0, "For_Est_Green/").otherwise("")
    path = F.concat(F.lit("set/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), folder, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_rep"), F.col("p_partkey").cast("string"), F.lit(".pcap"))
    f = read(spark, d, "part").select("p_partkey", path.alias("path"))
    return f.select("p_partkey", split.activity_of(F.col("path"), ACTIVITIES).alias("last_match"), split.activity_of(F.col("path"), ACTIVITIES, "stem").alias("stem_match"))


def _values(classes):
    return ", ".join(f"('{name}', {value}, {i})" for i, (name, value) in enumerate(classes))


@query("class_map_sets", "LBL1 LBL2", " union all ".join(f"""
select p_partkey, '{label}' as set_, name, coalesce(min(case when name = key then id end), arg_min(id, ord) filter (contains(name, key) or contains(key, name)))::int as class_id
from (select p_partkey, ['', 'fast ', 'gr', 'no '][1 + p_partkey % 4] || ['walking', 'sit', 'lying down', 'picking', 'empty room', 'dance', 'falling', 'stand up', 'run'][1 + p_partkey % 9] as name from part) n,
(values {_values(classes)}) as m(key, id, ord) group by 1, 2, 3
""" for label, classes in (("30", split.CLASSES_30), ("2048", split.CLASSES_2048))))
def class_map_sets(spark, d):
    """Made-up activity names through the class maps of both data sets."""
    first, second = F.array(*map(F.lit, ("", "fast ", "gr", "no "))), F.array(*map(F.lit, ("walking", "sit", "lying down", "picking", "empty room", "dance", "falling", "stand up", "run")))
    k = F.col("p_partkey")
    names = read(spark, d, "part").select("p_partkey", F.concat(F.get(first, (k % 4).cast("int")), F.get(second, (k % 9).cast("int"))).alias("name"))
    both = [split.mapped_class(names, "name", classes, blanks=" ").select("p_partkey", F.lit(label).alias("set_"), "name", "class_id") for label, classes in (("30", split.CLASSES_30), ("2048", split.CLASSES_2048))]
    return both[0].unionByName(both[1])


@query("receiver_triplet_join", "JN1 FLT10", """
select l_orderkey, min(l_partkey) filter (l_linenumber = 1) as rx0, min(l_partkey) filter (l_linenumber = 2) as rx1, min(l_partkey) filter (l_linenumber = 3) as rx2, false as copied
from lineitem group by 1 having count(distinct l_linenumber) filter (l_linenumber in (1, 2, 3)) = 3
""")
def receiver_triplet_join(spark, d):
    return split.receiver_triplets(read(spark, d, "lineitem").withColumn("rx", F.col("l_linenumber") - 1), ["l_orderkey"], "rx", "l_partkey")


@query("receiver_triplet_fallback", "JN2", """
with w as (select l_orderkey, min(l_partkey) filter (l_linenumber = 1) as a, min(l_partkey) filter (l_linenumber = 2) as b, min(l_partkey) filter (l_linenumber = 3) as c from lineitem group by 1)
select l_orderkey, a as rx0, coalesce(b, a) as rx1, case when b is null then a else c end as rx2, b is null as copied from w where a is not null and (b is null or c is not null)
""")
def receiver_triplet_fallback(spark, d):
    return split.receiver_triplets(read(spark, d, "lineitem").withColumn("rx", F.col("l_linenumber") - 1), ["l_orderkey"], "rx", "l_partkey", fallback=True)
