"""Catalogue: predictions, losses, metrics. Probabilities are softmax(embedding[0:8]), truth label % 8, recording vec_id div 10, fold vec_id % 8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import query, read
from ..functions import arrays as A
from ..operators import augment, metrics, model, training
from ..sources import folds
from .queries_features import _E, _draw, vectors

WEIGHTS = [1.0, 1.0, 1.5, 1.5, 1.2, 2.0, 1.0, 0.8]

_P = f"""
z as (select vec_id, label % 8 as truth, vec_id // 10 as rec, vec_id % 8 as fold, list_transform(e[1:8], lambda x: exp(x - list_max(e[1:8]))) as u from ({_E})),
p as (select *, list_transform(u, lambda x: x / list_sum(u)) as probs from z),
a as (select *, list_position(probs, list_max(probs)) - 1 as pred, list_max(probs) as conf from p)
"""
_CELLS = "cells as (select t.c as truth, q.c as pred, (select count(*) from a where a.truth = t.c and a.pred = q.c) as n from range(8) as t(c), range(8) as q(c))"
_CLASSES = """
cls as (select c, sum(case when truth = c and pred = c then n else 0 end) as tp, sum(case when pred = c then n else 0 end) as said, sum(case when truth = c then n else 0 end) as support from cells, range(8) as k(c) group by 1),
prf as (select c as cls, coalesce(tp / nullif(said, 0), 0e0) as precision, coalesce(tp / nullif(support, 0), 0e0) as recall, coalesce(2 * tp / nullif(said + support, 0), 0e0) as f1, support::bigint as support, said + support > 0 as present from cls)
"""


def predictions(spark, d):
    p = vectors(spark, d).withColumn("probs", A.softmax(F.slice("e", 1, 8)))
    return p.select("vec_id", (F.col("label") % 8).alias("truth"), F.floor(F.col("vec_id") / 10).alias("rec"), (F.col("vec_id") % 8).alias("fold"), "probs", "e", metrics.argmax(F.col("probs")).alias("pred"), F.array_max("probs").alias("conf"))


@query("confusion_matrix", "MET1 MET2", f"with {_P}, {_CELLS} select truth::int as truth, pred::int as pred, n from cells")
def confusion_matrix(spark, d):
    return metrics.confusion(predictions(spark, d), 8)


@query("confusion_row_normalized", "MET9", """
select t.c::int as truth, q.c::int as pred, (select count(*) from labels where quality = t.c and toxic = q.c) as n,
       round(coalesce((select count(*) from labels where quality = t.c and toxic = q.c) / nullif((select count(*) from labels where quality = t.c), 0), 0e0), 6) as share
from range(2) as t(c), range(2) as q(c)
""")
def confusion_row_normalized(spark, d):
    cells = metrics.confusion(read(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred")), 2)
    return metrics.row_normalised(cells).withColumn("share", F.round("share", 6))


@query("per_class_prf", "MET3 MET5", f"with {_P}, {_CELLS}, {_CLASSES} select cls::int as cls, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support, present from prf")
def per_class_prf(spark, d):
    c = metrics.per_class(metrics.confusion(predictions(spark, d), 8))
    return c.select("cls", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "support", "present")


@query("macro_f1", "MET4 MET5", f"""
with {_P}, {_CELLS}, {_CLASSES} select round(avg(f1) filter (present), 6) as macro_f1, round(max(recall) filter (cls = 5), 6) as fall_recall, round(max(f1) filter (cls = 7), 6) as empty_f1 from prf
""")
def macro_f1(spark, d):
    c = metrics.per_class(metrics.confusion(predictions(spark, d), 8))
    return c.agg(F.round(F.avg(F.when(F.col("present"), F.col("f1"))), 6).alias("macro_f1"), F.round(F.max(F.when(F.col("cls") == 5, F.col("recall"))), 6).alias("fall_recall"), F.round(F.max(F.when(F.col("cls") == 7, F.col("f1"))), 6).alias("empty_f1"))


@query("ece", "MET6", f"""
with {_P}, b as (select floor(conf * 10) as bin, count(*) as n, avg(conf) as c, avg((truth = pred)::int) as acc from a group by 1)
select round(sum(n / (select count(*) from a) * abs(acc - c)), 6) as ece from b where bin < 10
""")
def ece(spark, d):
    p = predictions(spark, d).select(F.col("conf").alias("confidence"), (F.col("truth") == F.col("pred")).alias("correct"))
    return metrics.calibration_error(p).withColumn("ece", F.round("ece", 6))


@query("recording_pool_metrics", "AGG12 MET7 JN8", f"""
with {_P}, m as (select rec, i, avg(probs[i + 1]) as p from a, range(8) as r(i) group by 1, 2), t as (select rec, min(truth) as truth from a group by 1)
select rec, truth, arg_max(i, (round(p, 9), -i))::int as pred, round(max(p), 6) as conf from m join t using (rec) group by 1, 2
""")
def recording_pool_metrics(spark, d):
    p = predictions(spark, d)
    pool = metrics.pooled(p, ["rec"], "probs").withColumn("probs", F.transform("probs", lambda x: F.round(x, 9)))
    return pool.join(p.groupBy("rec").agg(F.min("truth").alias("truth")), "rec").select("rec", "truth", metrics.argmax(F.col("probs")).alias("pred"), F.round(F.array_max("probs"), 6).alias("conf"))


_FOLDF1 = f"""
with {_P}, fc as (select fold, c, count(*) filter (truth = c and pred = c) as tp, count(*) filter (pred = c) as said, count(*) filter (truth = c) as support from a, range(8) as k(c) group by 1, 2),
ff as (select fold, avg(2 * tp / (said + support)) as f1, avg(case when c = 5 then coalesce(tp / nullif(support, 0), 0e0) end) as x from fc where said + support > 0 group by 1)
"""


def fold_scores(spark, d):
    cells = metrics.confusion(predictions(spark, d), 8, ("fold",))
    return metrics.macro_f1(metrics.per_class(cells, ("fold",)), ("fold",))


@query("fold_summary", "AGG13 AGG15 SRT3", _FOLDF1 + "select round(avg(f1), 6) as mean, round(stddev_pop(f1), 6) as std, arg_max(fold, (f1, -fold)) as best_fold from ff")
def fold_summary(spark, d):
    s = metrics.fold_summary(fold_scores(spark, d), [], "macro_f1")
    return s.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "best_fold")


@query("comparison_table", "MET8 SCL10", _FOLDF1 + """
select case when fold < 4 then 'a' else 'b' end as dataset, count(*) as folds, printf('%.2f%%', 100 * avg(f1)) as mean, printf('%.2f%%', 100 * stddev_pop(f1)) as std, printf('%.2f%%', 100 * max(f1)) as best from ff group by 1
""")
def comparison_table(spark, d):
    f = fold_scores(spark, d).withColumn("dataset", F.when(F.col("fold") < 4, "a").otherwise("b"))
    show = lambda c: F.format_string("%.2f%%", 100 * c)
    return f.groupBy("dataset").agg(F.count(F.lit(1)).alias("folds"), show(F.avg("macro_f1")).alias("mean"), show(F.stddev_pop("macro_f1")).alias("std"), show(F.max("macro_f1")).alias("best"))


_HEADS = "h as (select vec_id, 1 / (1 + exp(-e[1])) as occ, 1 / (1 + exp(-e[2])) as dyn, list_transform(e[3:8], lambda x: exp(x - list_max(e[3:8]))) as u from (" + _E + "))"


@query("heads_compose", "MDL7 SCL7", f"""
with {_HEADS} select vec_id, i, round(case when i < 6 then occ * dyn * u[i + 1] / list_sum(u) when i = 6 then occ * (1 - dyn) else 1 - occ end, 6) as p from h, range(8) as r(i)
""")
def heads_compose(spark, d):
    v = vectors(spark, d)
    p = metrics.composed(A.sigmoid(F.col("e")[0]), A.sigmoid(F.col("e")[1]), A.softmax(F.slice("e", 3, 6)))
    return v.select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", F.col("i").cast("long"), F.round("p", 6).alias("p"))


GRID = [0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


@query("temperature_scale_grid", "MDL8", f"""
with {_P}, g as (select unnest([5e-1, 1e0, 15e-1, 2e0, 3e0, 5e0]) as temperature),
n as (select temperature, -ln(greatest(pow(probs[truth + 1], 1 / temperature) / list_sum(list_transform(probs, lambda x: pow(x, 1 / temperature))), 1e-12)) as nll from a, g)
select temperature, round(avg(nll), 6) as nll from n group by 1
""")
def temperature_scale_grid(spark, d):
    return metrics.temperature_grid(predictions(spark, d), "probs", "truth", GRID).withColumn("nll", F.round("nll", 6))


@query("temperature_fit", "MDL8", f"""
with {_P}, g as (select t / 100e0 as temperature from range(5, 2001) as r(t)),
n as (select temperature, -ln(greatest(pow(probs[truth + 1], 1 / temperature) / list_sum(list_transform(probs, lambda x: pow(x, 1 / temperature))), 1e-12)) as nll from a, g),
b as (select temperature, avg(nll) as nll from n group by 1)
select arg_min(temperature, (nll, temperature)) as temperature, round(min(nll), 6) as nll from b
""")
def temperature_fit(spark, d):
    """The temperature of least loss, to a hundredth."""
    p = predictions(spark, d)
    best = metrics.fitted_temperature(p, "probs", "truth")
    return metrics.temperature_grid(p, "probs", "truth", [best]).withColumn("nll", F.round("nll", 6))


@query("comparison_lines", "SNK7 MET8", _FOLDF1 + """
, b as (select case when fold < 4 then 'a' else 'b' end as dataset, avg(f1) as mean, stddev_pop(f1) as std, avg(x) as fall, arg_max(fold, (f1, -fold)) as best from ff group by 1),
k as (select dataset, best, mean, std, fall, list(printf('%.1f', 100 * coalesce(2 * tp / nullif(said + support, 0), 0e0)) order by c) as per from b join fc on fc.fold = b.best group by all),
t as (select dataset, printf('%.2f%%', 100 * mean) as m, printf('%.2f%%', 100 * std) as s, printf('%.2f%%', 100 * coalesce(fall, 0e0)) as f, array_to_string(per, ' ') as p from k)
select dataset, lpad(dataset, 4, ' ') || ' | ' || lpad(m, 8, ' ') || ' | ' || lpad(s, 8, ' ') || ' | ' || lpad(f, 8, ' ') || ' | ' || lpad(p, 48, ' ') as text_line, dataset || ' & ' || replace(m, '%', '') || ' & ' || replace(s, '%', '') || ' & ' || replace(f, '%', '') || ' & ' || p || ' \\\\' as latex_line from t
""")
def comparison_lines(spark, d):
    """Mean, spread, fall recall and the best fold's F1 by class, as lines of a text table and of LaTeX."""
    p = predictions(spark, d)
    per = metrics.per_class(metrics.confusion(p, 8, ("fold",)), ("fold",))
    by = lambda c: F.when(F.col("fold") < 4, "a").otherwise("b").alias("dataset") if c else None
    f = metrics.macro_f1(per, ("fold",)).join(per.where("cls = 5").select("fold", F.when(F.col("present"), F.col("recall")).alias("fall")), "fold")
    t = metrics.fold_summary(f.select("*", by(True)), ["dataset"], "macro_f1").join(f.groupBy(by(True)).agg(F.coalesce(F.avg("fall"), F.lit(0.0)).alias("fall")), "dataset")
    best = per.join(t.select(F.col("best_fold").alias("fold"), "dataset"), "fold").groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("cls", F.format_string("%.1f", 100 * F.col("f1")).alias("f")))).alias("c"))
    show = lambda c: F.format_string("%.2f%%", 100 * F.col(c)).alias(c)
    rows = t.join(best, "dataset").select("dataset", show("mean"), show("std"), show("fall"), F.array_join("c.f", " ").alias("classes"))
    text = folds.text_table(rows, {"dataset": 4, "mean": 8, "std": 8, "fall": 8, "classes": 48}).select(F.trim(F.substring("line", 1, 4)).alias("dataset"), F.col("line").alias("text_line"))
    plain = rows.select("dataset", *(F.replace(c, F.lit("%"), F.lit("")).alias(c) for c in ("mean", "std", "fall")), "classes")
    latex = folds.latex_rows(plain).select(F.substring_index("line", " &", 1).alias("dataset"), F.col("line").alias("latex_line"))
    return text.join(latex, "dataset")


@query("loss_main", "LSS1", f"""
with {_P} select round(avg(-list_sum(list_transform(range(8), lambda i: ((case when i = truth then 95e-2 else 0e0 end) + 5e-2 / 8) * ln(greatest(probs[i + 1], 1e-8)))) * [1e0, 1e0, 15e-1, 15e-1, 12e-1, 2e0, 1e0, 8e-1][truth + 1]), 6) as loss from a
""")
def loss_main(spark, d):
    return predictions(spark, d).agg(F.round(F.avg(metrics.smoothed_loss(F.col("probs"), F.col("truth"), WEIGHTS)), 6).alias("loss"))


@query("loss_occ_dyn", "LSS2", f"""
with {_HEADS}, t as (select h.*, label % 8 as truth from h join embeddings using (vec_id)),
b as (select *, least(greatest(occ, 1e-7), 1 - 1e-7) as o, least(greatest(dyn, 1e-7), 1 - 1e-7) as y from t)
select round(avg(-case when truth <> 7 then ln(o) else ln(1 - o) end), 6) as presence, round(avg(-case when truth < 6 then ln(y) else ln(1 - y) end) filter (truth <> 7), 6) as motion from b
""")
def loss_occ_dyn(spark, d):
    v = vectors(spark, d).withColumn("truth", F.col("label") % 8)
    flag = lambda c: c.cast("int").cast("double")
    occ = metrics.binary_loss(A.sigmoid(F.col("e")[0]), flag(F.col("truth") != 7))
    dyn = metrics.binary_loss(A.sigmoid(F.col("e")[1]), flag(F.col("truth") < 6))
    return v.agg(F.round(F.avg(occ), 6).alias("presence"), F.round(F.avg(F.when(F.col("truth") != 7, dyn)), 6).alias("motion"))


@query("loss_focal", "LSS3", f"""
with {_HEADS}, t as (select h.*, label % 8 as truth from h join embeddings using (vec_id)), q as (select greatest(u[truth + 1] / list_sum(u), 1e-8) as p from t where truth < 6)
select round(avg(-pow(1 - p, 2) * ln(p)), 6) as loss from q
""")
def loss_focal(spark, d):
    v = vectors(spark, d).withColumn("truth", F.col("label") % 8).where("truth < 6")
    p = F.get(A.softmax(F.slice("e", 3, 6)), F.col("truth"))
    return v.agg(F.round(F.avg(metrics.focal_loss(p)), 6).alias("loss"))


@query("loss_consistency", "LSS4 MDL5", f"""
with x as (select vec_id, r, i, e[r * 16 + i + 1] as z from ({_E}), range(3) as q(r), range(16) as s(i)), m as (select *, avg(z) over (partition by vec_id, i) as m from x)
select round(avg((z - m) * (z - m)), 6) as loss from m
""")
def loss_consistency(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode(F.slice("e", 1, 48)).alias("j", "z")).withColumn("i", F.col("j") % 16)
    m = F.avg("z").over(Window.partitionBy("vec_id", "i"))
    return x.withColumn("m", m).agg(F.round(F.avg((F.col("z") - F.col("m")) * (F.col("z") - F.col("m"))), 6).alias("loss"))


@query("loss_total", "LSS5", f"""
with {_P}, {_HEADS}, l as (select avg(-list_sum(list_transform(range(8), lambda i: ((case when i = truth then 95e-2 else 0e0 end) + 5e-2 / 8) * ln(greatest(probs[i + 1], 1e-8)))) * [1e0, 1e0, 15e-1, 15e-1, 12e-1, 2e0, 1e0, 8e-1][truth + 1]) as main from a),
t as (select h.*, label % 8 as truth from h join embeddings using (vec_id)), b as (select *, least(greatest(occ, 1e-7), 1 - 1e-7) as o, least(greatest(dyn, 1e-7), 1 - 1e-7) as y from t),
k as (select avg(-case when truth <> 7 then ln(o) else ln(1 - o) end) as occ, avg(-case when truth < 6 then ln(y) else ln(1 - y) end) filter (truth <> 7) as dyn,
      avg(-pow(1 - greatest(u[truth + 1] / list_sum(u), 1e-8), 2) * ln(greatest(u[truth + 1] / list_sum(u), 1e-8))) filter (truth < 6) as act from b),
x as (select vec_id, r, i, e[r * 16 + i + 1] as z from ({_E}), range(3) as q(r), range(16) as s(i)), m as (select *, avg(z) over (partition by vec_id, i) as m from x), c as (select avg((z - m) * (z - m)) as cons from m)
select epoch, round(main + least(epoch / 5, 1) * (3e-1 * (k.occ + k.dyn + act) + 5e-2 * cons), 6) as loss from l, k, c, (values (0), (3), (9)) as g(epoch)
""")
def loss_total(spark, d):
    """All five losses of the heads, before, within and after the ramp."""
    v = vectors(spark, d).withColumn("truth", (F.col("label") % 8).cast("int"))
    flag = lambda c: c.cast("int").cast("double")
    main = metrics.smoothed_loss(A.softmax(F.slice("e", 1, 8)), F.col("truth"), WEIGHTS)
    occ = metrics.binary_loss(A.sigmoid(F.col("e")[0]), flag(F.col("truth") != 7))
    dyn = F.when(F.col("truth") != 7, metrics.binary_loss(A.sigmoid(F.col("e")[1]), flag(F.col("truth") < 6)))
    act = F.when(F.col("truth") < 6, metrics.focal_loss(F.get(A.softmax(F.slice("e", 3, 6)), F.col("truth"))))
    receivers = F.array(*(F.slice("e", 1 + 16 * r, 16) for r in range(3)))
    v = v.withColumn("m", A.mean_of(receivers))
    apart = F.aggregate(F.flatten(F.transform(receivers, lambda p: F.zip_with(p, "m", lambda z, m: (z - m) * (z - m)))), F.lit(0.0), lambda s, x: s + x) / 48
    one = v.agg(F.avg(main).alias("main"), F.avg(occ).alias("occ"), F.avg(dyn).alias("dyn"), F.avg(act).alias("act"), F.avg(apart).alias("cons"))
    parts = [(0.3, F.col("occ")), (0.3, F.col("dyn")), (0.3, F.col("act")), (0.05, F.col("cons"))]
    return one.select(F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), F.round(metrics.total_loss(F.col("main"), parts, e), 6).alias("loss")) for e in (0, 3, 9)))).alias("r")).select("r.*")


@query("receiver_fusion", "MDL5", f"""
with w as (select vec_id, e, list_transform(e[1:3], lambda x: exp(x - list_max(e[1:3]))) as u from ({_E}))
select vec_id, i, round((u[1] * e[i + 4] + u[2] * e[i + 24] + u[3] * e[i + 44]) / list_sum(u), 5) as z from w, range(20) as r(i)
""")
def receiver_fusion(spark, d):
    """Three receivers' 20-vectors, weighed by a softmax of three logits."""
    v = vectors(spark, d).withColumn("w", A.softmax(F.slice("e", 1, 3)))
    z = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: sum((F.get("w", F.lit(r)) * F.get("e", i + 3 + 20 * r) for r in range(3)), F.lit(0.0)))
    return v.select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", F.col("i").cast("long"), F.round("z", 5).alias("z"))


@query("envelope_per_class", "MET10 SRT4", f"""
with r as (select *, row_number() over (partition by label order by vec_id) as k from ({_E})), x as (select label, vec_id, i, list_avg(list_transform(e[i * 4 + 1:i * 4 + 4], lambda v: abs(v))) as m from r, range(16) as q(i) where k <= 10)
select label, i, round(avg(m), 5) as mean, round(stddev_pop(m), 5) as std from x group by 1, 2
""")
def envelope_per_class(spark, d):
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    v = vectors(spark, d).withColumn("k", k).where("k <= 10")
    x = v.select("label", "vec_id", F.posexplode("e").alias("j", "v")).groupBy("label", "vec_id", F.floor(F.col("j") / 4).alias("i")).agg(F.avg(F.abs("v")).alias("m"))
    return x.groupBy("label", "i").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.stddev_pop("m"), 5).alias("std"))


@query("lr_schedule", "TRN2", """
select epoch, round(1e9 * case when epoch < 5 then 1e-5 + 9e-5 * epoch / 4 when epoch < 55 then 1e-6 + 99e-6 * (1 + cos(pi() * (epoch - 5) / 50)) / 2 else 1e-7 + 99e-7 * (1 + cos(pi() * (epoch - 55) / 20)) / 2 end, 3) as nano_rate
from range(75) as r(epoch)
""")
def lr_schedule(spark, d):
    return spark.range(75).select(F.col("id").alias("epoch"), F.round(1e9 * metrics.learning_rate(F.col("id")), 3).alias("nano_rate"))


@query("heads_gradient", "TRN1 LSS5", f"""
with t as (select list_concat(e, [1e0]) as x, label % 8 as y, [1e0, 1e0, 1e0, 1e0, 1e0, 2e0, 15e-1, 3e0][label % 8 + 1] as w from ({_E})),
g as (select x, y, list_transform(range(8), lambda i: -w * ((case when i = y then 95e-2 else 0e0 end) + 5e-2 / 8) / (case when i < 6 then 1 / 24e0 when i = 6 then 25e-2 else 5e-1 end)) as g from t),
m as (select *, list_sum(g[1:6]) as six from g),
d as (select x, y, h, case h when 0 then (six / 12 + g[7] / 2 - g[8]) / 4 when 1 then (six / 6 - g[7]) / 8 else (g[h - 1] - six / 6) / 24 end as main,
        case when h = 0 then 5e-1 - (y <> 7)::int end as presence, case when h = 1 and y <> 7 then 5e-1 - (y < 6)::int end as motion,
        case when h > 1 and y < 6 then (10e0 / 6 * ln(1 / 6e0) - 25e0 / 6) / 6 * ((y = h - 2)::int - 1 / 6e0) end as activity from m, range(8) as r(h))
select h::int as head, f::int as feature, round(avg(main * x[f + 1]) + 3e-1 * (coalesce(avg(presence * x[f + 1]), 0) + coalesce(avg(motion * x[f + 1]), 0) + coalesce(avg(activity * x[f + 1]), 0)), 6) as gradient
from d, range(65) as q(f) group by 1, 2
""")
def heads_gradient(spark, d):
    """The joint loss's gradient over the whole table, from weights of zero and after the ramp."""
    plan = training.Plan(batches=1)
    rows = training.in_batches(vectors(spark, d).withColumn("truth", F.col("label") % 8), "vec_id", "e", "truth", plan)
    counts, _, parts = training.batch_sums(rows, np.zeros((training.HEADS, 65)), "e", "truth", plan)[0]
    g = training.joint(counts, parts, plan.ramp, plan)
    return spark.createDataFrame([(h, f, round(float(g[h, f]), 6)) for h in range(len(g)) for f in range(65)], "head int, feature int, gradient double")


@query("training_curves", "MET12", """
select case when event_id % 2 = 0 then 'train' else 'val' end as phase, user_id % 20 as epoch, round(avg(value), 5) as loss, round(avg(1 / (1 + abs(value))), 5) as f1, round(max(1e-4 * (user_id % 20)), 7) as rate from events group by 1, 2
""")
def training_curves(spark, d):
    """Events as rows of a log: loss, F1 and rate by phase and epoch, folds averaged."""
    log = read(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "train").otherwise("val").alias("phase"), (F.col("user_id") % 20).alias("epoch"), F.col("value").alias("loss"), (1 / (1 + F.abs("value"))).alias("f1"), (1e-4 * (F.col("user_id") % 20)).alias("rate"))
    c = metrics.curves(log)
    return c.select("phase", "epoch", *(F.round(x, 5).alias(x) for x in ("loss", "f1")), F.round("rate", 7).alias("rate"))


@query("hierarchical_folds", "TRN3 SPL2")
def hierarchical_folds(spark, d):
    """The hierarchical heads on every person left out in turn."""
    v = vectors(spark, d).withColumn("truth", F.col("label") % 8).withColumn("person", F.col("vec_id") % 4)
    return model.leave_one_out(v, "person", "vec_id", "e", "truth")


@query("augment_random", "AUG1")
def augment_random(spark, d):
    return augment.augmented(vectors(spark, d), "vec_id", "e", seed=42)


@query("weighted_sample", "SMP1", f"""
with r as (select vec_id, label, row_number() over (partition by label order by {_draw('vec_id', 42, 'rank')}, vec_id) - 1 as rank from embeddings),
c as (select label, row_number() over (order by label) - 1 as cls, count(*) as n, count(*) over () as k from embeddings group by 1),
s as (select vec_id as slot, floor({_draw('vec_id', 42, 'class')} * (select max(k) from c))::int as cls, {_draw('vec_id', 42, 'row')} as u from embeddings)
select slot, r.vec_id, r.label from s join c using (cls) join r on r.label = c.label and r.rank = floor(s.u * c.n)
""")
def weighted_sample(spark, d):
    return augment.weighted_sample(vectors(spark, d).select("vec_id", "label"), "label", "vec_id", seed=42)


@query("hierarchical_classifier", "MDL7")
def hierarchical_classifier(spark, d):
    v = vectors(spark, d).withColumn("truth", F.col("label") % 8)
    return model.fit_and_predict(v, "vec_id", "e", "truth", test=F.col("vec_id") % 5 == 0)
