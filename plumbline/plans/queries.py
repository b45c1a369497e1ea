"""One query for each relational operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import signals
from plumbline.operators import accumulate, atrial, boosting, cohort, decompose, delineation, inference, link, paths, regression, segments, splits, sweep, waves
from plumbline.operators.replicates import POISSON
from plumbline.plans.frames import LEAD_SQL, LEADS, ORDER_SQL, lead_samples, order_features, rounded, user_signal
from plumbline.sources.tables import header_fields, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Bootstrap replicates.
REPLICATES = 1000
#: Samples a second of events taken as a recording: above twice the band's upper end of 40 Hz.
EVENT_RATE = 100
#: Boosted explainers of the queries: larger steps than the default's, and so fewer passes.
QUICK = boosting.Settings(rounds=40, rate=0.2)
SIGNAL = "e as (select *, epoch_us(ts)::double / 1000000.0::double as s from events)"
TRAINING_SUMS = """g as (select fold, count(*)::double n, sum({x}) sx, sum(y) sy, sum({x}*{x}) sxx, sum({x}*y) sxy, sum(y*y) syy from f group by fold),
t as (select a.fold, a.n, a.sx, a.sy, a.sxx, a.sxy, a.syy, (w.n-a.n) tn, (w.sx-a.sx) tx, (w.sy-a.sy) ty, (w.sxx-a.sxx) txx, (w.sxy-a.sxy) txy
 from g a, (select sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy from g) w),
b as (select *, (tn*txy-tx*ty)/(tn*txx-tx*tx) slope from t),
c as (select *, (ty-slope*tx)/tn icept from b),
r as (select 1-sum(syy-2*(icept*sy+slope*sxy)+icept*icept*n+2*icept*slope*sx+slope*slope*sxx)/(sum(syy)-sum(sy)*sum(sy)/sum(n)) r2 from c)"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Cohorts


@query("""select c_custkey, c_nationkey::bigint as c_nationkey, round(c_acctbal, 6) as c_acctbal from customer
where c_acctbal <> 0 and c_acctbal between 0 and 9000 and c_mktsegment in ('BUILDING', 'MACHINERY')""")
def metadata_filter(spark, folder):
    return cohort.plausible(table(spark, folder, "customer"), "c_acctbal", 0, 9000, 0, "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_nationkey", "c_acctbal")


@query("""select count(*) as n, count(distinct o_custkey) as patients, round(min(o_totalprice), 6) as low, round(max(o_totalprice), 6) as high,
round(avg(o_totalprice), 4) as mean, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderpriority like '1%') as n_urgent,
round(avg(case when o_custkey % 2 = 1 then 1.0::double else 0.0::double end), 6) as share_odd from orders""")
def cohort_summary(spark, folder):
    o = table(spark, folder, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("patients"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"), F.avg((F.col("o_custkey") % 2 == 1).cast("double")).alias("share_odd"))


@query("""select code, count(*) as n, round(avg(v), 6) as mean from
(select unnest(json_keys(props)) as code, (json_extract(props, '$.k'))::double as v from events) group by code""")
def codes_parse_explode(spark, folder):
    codes = cohort.code_map(F.col("props"))
    return table(spark, folder, "events").select(F.explode(codes).alias("code", "v")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


@query("""select event_id, max(case when k % 2 = 0 then 1 else 0 end)::bigint as dx_even, max(case when k % 2 = 1 then 1 else 0 end)::bigint as dx_odd
from (select event_id, (json_extract(props, '$.k'))::bigint as k from events) group by event_id""")
def diagnostic_classes(spark, folder):
    """Codes are the values of the map; the dimension says which class each has."""
    e = table(spark, folder, "events")
    value = F.element_at(cohort.code_map(F.col("props")), "k").cast("long").cast("string")
    named = F.map_from_arrays(F.array(value), F.array(F.lit(100.0)))
    dimension = spark.range(0, 1000).select(F.col("id").cast("string").alias("code"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("diagnostic_class"))
    return cohort.class_sets(e.withColumn("m", F.when(value.isNotNull(), named)), "event_id", F.col("m"), dimension, ["even", "odd"])


@query("""select user_id, max(case when event_type in ('click', 'view') then 1 else 0 end)::bigint as browse,
max(case when event_type = 'purchase' then 1 else 0 end)::bigint as buy, max(case when event_type = 'error' then 1 else 0 end)::bigint as fail from events group by user_id""")
def indicator_multihot(spark, folder):
    return cohort.indicators(table(spark, folder, "events"), "user_id", "event_type", {"browse": ["click", "view"], "buy": ["purchase"], "fail": ["error"]})


@query("""with i as (select user_id, max((event_type = 'click')::int) as click, max((event_type in ('purchase', 'refund'))::int) as pay, max((event_type = 'nothing')::int) as absent from events group by 1)
select name, sum(has)::bigint as n, round(avg(has), 6) as share from (select unnest(['click', 'pay', 'absent', '(none)']) as name, unnest([click, pay, absent, (click + pay + absent = 0)::int]) as has from i) group by 1""")
def indicator_composition(spark, folder):
    groups = {"click": ["click"], "pay": ["purchase", "refund"], "absent": ["nothing"]}
    return cohort.composition(cohort.indicators(table(spark, folder, "events"), "user_id", "event_type", groups), list(groups))


@query("""select user_id, (bool_or(event_type = 'click') and not bool_or(event_type = 'error' and value > 90)) as steady from events group by user_id""")
def sinus_mask(spark, folder):
    e = table(spark, folder, "events").withColumn("kind", F.when((F.col("event_type") == "error") & (F.col("value") > 90), "bad").otherwise(F.col("event_type")))
    return cohort.steady(e, "user_id", "kind", "click", ["bad"], explicit=True)


@query("""select page_id, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') as host, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint) as number,
lower(regexp_extract(html, '(?i)lang="([a-z]+)"', 1)) as lang from pages""")
def header_regex(spark, folder):
    p = table(spark, folder, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return p.select("page_id", F.when(host != "", host).alias("host"), F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)").alias("number"), F.lower(F.regexp_extract("html", '(?i)lang="([a-z]+)"', 1)).alias("lang"))


@query("""select c_custkey, case when c_custkey % 7 = 0 then null else (c_custkey % 90)::double + 0.5::double end as age, case c_custkey % 3 when 0 then 0 when 1 then 1 else -1 end::bigint as sex from customer""")
def header_parse(spark, folder):
    """Header texts of customers, read as those of recordings are."""
    age = F.when(F.col("c_custkey") % 7 == 0, "NaN").otherwise(F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(".5")))
    sex = F.element_at(F.array(F.lit("Male"), F.lit("female"), F.lit("Unknown")), (F.col("c_custkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("r 12 500 5000\n# Age: "), age, F.lit("\n#Sex:  "), sex, F.lit("\n"))
    return table(spark, folder, "customer").select("c_custkey", *header_fields(text)).fillna(-1, ["sex"])


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_quantity, 6) as l_quantity from lineitem l
where exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_totalprice > 300000)""")
def late_materialise_semi(spark, folder):
    keys = table(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return cohort.only_keys(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), keys, "l_orderkey")


@query("""select count(*) filter (where l_tax <> 0 and l_discount is not null) as n_used, count(*) filter (where l_tax = 0 or l_discount is null) as n_dropped from lineitem""")
def drop_unmeasurable(spark, folder):
    line = table(spark, folder, "lineitem").select(F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), F.col("l_discount").alias("discount"))
    return cohort.drop_counts(line, ["tax", "discount"])


@query("""select user_id, n_runs from (select user_id, count(distinct event_type) as n_runs from events group by user_id)
where n_runs = (select count(distinct event_type) from events)""")
def runs_intersection(spark, folder):
    return cohort.in_all_runs(table(spark, folder, "events"), "user_id", "event_type")


@query("""(select o_orderkey, round(o_totalprice, 6) as o_totalprice, 'high' as side from orders order by o_totalprice desc, o_orderkey limit 10)
union all (select o_orderkey, round(o_totalprice, 6) as o_totalprice, 'low' as side from orders order by o_totalprice, o_orderkey limit 10)""")
def outlier_topk_both(spark, folder):
    return cohort.both_ends(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 10)


@query("""select a.o_orderkey, a.o_orderpriority, b.o_totalprice as permuted from
(select *, row_number() over (partition by o_orderpriority order by o_orderkey) n from orders) a join
(select *, row_number() over (partition by o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) n from orders) b
on a.o_orderpriority = b.o_orderpriority and a.n = b.n""")
def label_permutation(spark, folder):
    return cohort.permuted_labels(table(spark, folder, "orders"), "o_orderkey", "o_totalprice", "o_orderpriority")


@query("""with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as total from orders)
select o_orderkey from n where place in (select floor(i * total / 100.0::double)::bigint from range(100) r(i), (select max(total) total from n))""")
def stride_sample(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return cohort.even_stride(o, "o_orderkey", 100, o.count())


# Splits


@query("""select split, count(*) as n, count(distinct o_custkey) as patients from
(select o_custkey, case when h < 0.7::double then 'train' when h < 0.7::double + 0.1::double then 'val' else 'test' end as split from
 (select o_custkey, ('0x' || substr(md5(o_custkey::varchar), 1, 8))::bigint::double / 4294967296.0::double as h from orders)) group by split""")
def patient_split(spark, folder):
    return splits.patient_split(table(spark, folder, "orders"), "o_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("patients"))


@query("""select o_custkey, count(distinct split) as n_splits from (select o_custkey, case when o_orderkey % 10 = 9 then 'test' when o_orderkey % 10 = 8 then 'val' else 'train' end as split
from orders) group by o_custkey having count(distinct split) > 1""")
def leakage_check(spark, folder):
    return splits.leaking(splits.official_split(table(spark, folder, "orders"), F.col("o_orderkey") % 10, 8, 9), "o_custkey")


@query("""select sum(te)::bigint as n_test, coalesce(sum(case when tr > 0 then te end), 0)::bigint as n_leaked from
(select o_custkey, count(*) filter (where o_orderkey % 10 = 9) as te, count(*) filter (where o_orderkey % 10 not in (8, 9)) as tr from orders group by o_custkey)""")
def leakage_share(spark, folder):
    return splits.leakage(splits.official_split(table(spark, folder, "orders"), F.col("o_orderkey") % 10, 8, 9), "o_custkey")


@query("""select split, count(*) as n from (select case when o_custkey % 10 = 9 then 'val' when o_custkey % 10 = 0 then 'test' else 'train' end as split from orders) group by split""")
def official_fold_split(spark, folder):
    fold = F.col("o_custkey") % 10
    return splits.official_split(table(spark, folder, "orders"), F.when(fold == 0, 10).otherwise(fold)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {LEAD_SQL}, st as (select lead, avg(x) mean, stddev_pop(x) sd from s where vec_id % 10 < 8 group by lead)
select s.lead::bigint as lead, count(*) as n, round(avg((x - mean) / case when sd < 1e-8 then 1.0::double else sd end), 6) + 0.0::double as mean_z,
round(max((x - mean) / case when sd < 1e-8 then 1.0::double else sd end), 6) as max_z from s join st on s.lead = st.lead group by s.lead""")
def lead_normalise(spark, folder):
    s = lead_samples(spark, folder)
    z = splits.normalized(s, splits.lead_stats(s.where("vec_id % 10 < 8")))
    return z.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))


# Waves


@query(f"""with {SIGNAL}, d as (select user_id, s - lag(s) over (partition by user_id order by s, event_id) as rr from e)
select user_id, count(*) as n_beats, round(case when count(*) >= 3 then median(rr) end, 4) as rr,
round(case when count(*) >= 3 then coalesce(stddev_samp(rr), 0) end, 4) as rr_sd, round(case when count(*) >= 3 then 60.0::double / nullif(median(rr), 0) end, 6) as rate from d group by user_id""")
def rr_intervals(spark, folder):
    r = waves.rate_summary(waves.intervals(user_signal(spark, folder), "user_id", "s", ["s", "event_id"]), "user_id")
    return r.select("user_id", "n_beats", F.round("rr", 4).alias("rr"), F.round("rr_sd", 4).alias("rr_sd"), "rate")


@query(f"""with {SIGNAL}, d as (select user_id, event_id, s, s - lag(s) over (partition by user_id order by s, event_id) as rr from e)
select user_id, event_id, round(coalesce(rr, lead(rr) over (partition by user_id order by s, event_id)), 4) as before from d""")
def preceding_rr(spark, folder):
    order = ["s", "event_id"]
    p = waves.preceding(waves.intervals(user_signal(spark, folder), "user_id", "s", order), "user_id", order)
    return p.select("user_id", "event_id", F.round("before", 4).alias("before"))


@query("""select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following), 6) as smooth from events""")
def moving_window_integrate(spark, folder):
    return waves.moving_mean(table(spark, folder, "events"), "user_id", "value", ["ts", "event_id"], 3).select("user_id", "event_id", "smooth")


@query("""select user_id, event_id, round(value, 6) as value from (select *, lag(value) over (partition by user_id order by ts, event_id) b,
lead(value) over (partition by user_id order by ts, event_id) a from events) where value > a and value > b""")
def local_maxima(spark, folder):
    return waves.local_maxima(table(spark, folder, "events"), "user_id", "value", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""with o as (select user_id, value < 30 as quiet, row_number() over (partition by user_id order by ts, event_id) - 1 as place,
row_number() over (partition by user_id, value < 30 order by ts, event_id) as own from events),
i as (select user_id, place - own as run, min(place) as first, count(*) as length from o where quiet group by user_id, place - own having count(*) >= 3)
select user_id, min(first)::bigint as "at", arg_min(length, first)::bigint as length from i group by user_id""")
def quiet_run_boundary(spark, folder):
    return waves.first_quiet(table(spark, folder, "events"), "user_id", "value", ["ts", "event_id"], 30.0, 3)


@query("""with d as (select user_id, value, max(case when value >= 50 then 1 else 0 end) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and current row) as up from events)
select user_id, count(*) filter (where up = 0) as length, round(coalesce(max(case when up = 0 then 50.0::double - value end), 0), 6) as depth,
round(-(count(*) filter (where up = 0) * 2.0::double * coalesce(max(case when up = 0 then 50.0::double - value end), 0)) + 0.0::double, 6) + 0.0::double as force from d group by user_id""")
def terminal_run_force(spark, folder):
    return waves.trailing_force(table(spark, folder, "events"), "user_id", "value", ["ts", "event_id"], 50.0, 2.0)


@query("""select l_orderkey, count(*) as n, round(median(l_quantity), 6) as qty, round(median(l_extendedprice), 6) as price, round(median(l_discount), 6) as disc from lineitem group by l_orderkey""")
def beat_median_features(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("qty"), F.median("l_extendedprice").alias("price"), F.median("l_discount").alias("disc"))


@query("""select l_orderkey, count(l_quantity) as n, round(max(l_quantity) - min(l_quantity), 6) as dispersion from lineitem group by l_orderkey having count(l_quantity) >= 3""")
def dispersion(spark, folder):
    return waves.dispersion(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity", 3)


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_quantity / sqrt(l_tax), 6) as bazett, round(l_quantity / pow(l_tax, 1.0::double / 3.0::double), 6) as fridericia
from (select l_orderkey, l_linenumber, l_quantity, case when l_tax > 0 then l_tax end as l_tax from lineitem)""")
def qtc_rate_corrections(spark, folder):
    return waves.corrected(table(spark, folder, "lineitem"), "l_quantity", "l_tax").select("l_orderkey", "l_linenumber", "bazett", "fridericia")


@query("""select l_orderkey, round(degrees(atan2(sum(l_discount) - 0.2071::double, sum(l_tax) - 0.1537::double)), 5) as axis from lineitem group by l_orderkey""")
def axis_atan2(spark, folder):
    net = table(spark, folder, "lineitem").groupBy("l_orderkey").agg((F.sum("l_discount") - 0.2071).alias("v"), (F.sum("l_tax") - 0.1537).alias("h"))
    return waves.axis(net, "v", "h").select("l_orderkey", F.round("axis", 5).alias("axis"))


@query(f"""with recursive {SIGNAL}, u as (select user_id, coalesce(list(s order by s) filter (where event_type = 'click'), []) as refs, coalesce(list(s order by s) filter (where event_type = 'view'), []) as dets
 from e where event_type in ('click', 'view') group by 1),
go as (select user_id, 1 as i, refs, dets, dets as free, []::double[] as errors from u
 union all select user_id, i + 1, refs, dets, case when gap <= 20000 then list_concat(free[:pos - 1], free[pos + 1:]) else free end, case when gap <= 20000 then list_append(errors, gap) else errors end
 from (select *, list_min(list_transform(free, lambda x: abs(x - refs[i]))) as gap, list_position(list_transform(free, lambda x: abs(x - refs[i])), list_min(list_transform(free, lambda x: abs(x - refs[i])))) as pos from go where i <= len(refs))),
d as (select *, len(refs) as nr, len(dets) as nd, len(errors) as nm from go where i = len(refs) + 1)
select user_id, nr as n_reference, nd as n_detected, nm as n_matched, round(nm::double / nullif(nr, 0), 6) as sensitivity, round(nm::double / nullif(nd, 0), 6) as ppv,
round(2.0::double * nm / (nr + nd), 6) as f1, round(list_avg(errors), 3) as mean_error, round(list_max(errors), 3) as max_error from d""")
def detection_scoring(spark, folder):
    e = user_signal(spark, folder)
    out = waves.scored(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "s", 20000.0)
    return out.withColumn("mean_error", F.round("mean_error", 3)).withColumn("max_error", F.round("max_error", 3))


@query("""with r as (select *, value * 3.6::double - 180.0::double as angle from events), t as (select *, coalesce(-floor((angle - lag(angle) over w + 180.0::double) / 360.0::double), 0) as turn from r window w as (partition by user_id order by ts, event_id)),
o as (select user_id, angle + 360.0::double * sum(turn) over (partition by user_id order by ts, event_id) as led from t)
select user_id, round(median(led), 5) as median from o group by user_id""")
def circular_axis_median(spark, folder):
    e = table(spark, folder, "events").withColumn("angle", F.col("value") * 3.6 - 180.0)
    return waves.circular_median(e, "user_id", "angle", ["ts", "event_id"]).select("user_id", F.round("median", 5).alias("median"))


@query(None)
def signal_pipeline(spark, folder):
    """A user's event values, in order, as a recording of one lead: peaks, waves, and the table of intervals.

    Users have some 70 events each, so that a rate of EVENT_RATE makes recordings of about a second.
    """
    e = table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    r = e.select("user_id", F.transform("e", lambda x: x["value"] / 100.0).alias("signal"), F.array(F.transform("e", lambda x: x["value"] / 100.0)).alias("leads"))
    r = r.withColumn("peaks", signals.r_peaks(F.col("signal"), EVENT_RATE))
    out = delineation.interval_table(r, delineation.delineated(r, "user_id", "leads", "peaks", EVENT_RATE), "user_id", EVENT_RATE)
    return out


def _recordings(spark, folder):
    """Embeddings as recordings of LEADS leads with two beats each, at 100 samples a second; and the beats."""
    e = table(spark, folder, "embeddings")
    width = F.floor(F.size("embedding") / LEADS).cast("int")
    leads = F.transform(F.sequence(F.lit(0), F.lit(LEADS - 1)), lambda i: F.transform(F.slice("embedding", i * width + 1, width), lambda v: v.cast("double")))
    r = e.where("size(embedding) >= 64").select("vec_id", leads.alias("leads"))
    bounds = [(0, 3, 6, 1, 2, 3, 4, 5, 6), (1, 12, 14, 9, 10, 11, None, None, None)]
    names = ("beat", "qrs_onset", "qrs_offset", "p_onset", "p_peak", "p_offset", "t_onset", "t_peak", "t_offset")
    beats = F.array(*[F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip(names, b, strict=True)], F.lit(b[1] + 1).alias("r_peak")) for b in bounds])
    return r, r.select("vec_id", F.inline(beats))


@query(None)
def atrial_features(spark, folder):
    """Terminal force, area, notch and dispersion of P windows; a record a vector."""
    r, b = _recordings(spark, folder)
    return atrial.atrial_table(r, b, "vec_id", "leads", ["II", "V1", "I", "aVF"], 100)


@query(None)
def amplitude_features(spark, folder):
    r, b = _recordings(spark, folder)
    return delineation.amplitude_table(r, b, "vec_id", "leads", ["II", "V1", "I", "aVF"], 100)


@query(None)
def p_dispersion_floor(spark, folder):
    """Does P dispersion spread more between records than it does where every lead has the same wave?"""
    r, b = _recordings(spark, folder)
    return atrial.dispersion_reliability(r, b, "vec_id", "leads", ["II", "V1", "I", "aVF"], 100)


# Segments

SHARES = """m as (select vec_id, lead, segment, sum(abs(x)) mass, sum(x) sg, count(*) n from s group by 1, 2, 3),
q as (select vec_id, lead, segment, mass / sum(mass) over (partition by vec_id) as share, (mass / sum(mass) over (partition by vec_id)) / (n / sum(n) over (partition by vec_id)) as density,
 sg / sum(mass) over (partition by vec_id) as signed_share from m)"""


@query(f"""with {LEAD_SQL}, {SHARES} select vec_id, lead::bigint as lead, segment, round(share, 6) as share, round(density, 6) as density, round(signed_share, 6) as signed_share from q""")
def segment_aggregate(spark, folder):
    return segments.by_segment(lead_samples(spark, folder), "vec_id", "x")


@query(f"""with {LEAD_SQL}, {SHARES} select lead::bigint as lead, segment, round(avg(share), 6) as share_mean, round(stddev_samp(share), 6) as share_sd, round(avg(density), 6) as density_mean,
round(stddev_samp(density), 6) as density_sd, round(avg(signed_share), 6) as signed_share_mean from q group by 1, 2""")
def segment_cohort_summary(spark, folder):
    return segments.cohort_summary(segments.by_segment(lead_samples(spark, folder), "vec_id", "x"))


@query(f"""with {LEAD_SQL}, {SHARES}, w as (select lead, segment, avg(share) as share, avg(density) as density from q group by 1, 2)
select segment, round(sum(share), 6) as share, round(avg(density), 6) as density from w group by 1""")
def segment_totals(spark, folder):
    return segments.segment_totals(segments.cohort_summary(segments.by_segment(lead_samples(spark, folder), "vec_id", "x")))


@query(f"""with {LEAD_SQL}, {SHARES}, t as (select vec_id, sum(share) as share from q where segment = 'p' group by 1),
ml as (select e.vec_id, share, unnest(['first', 'label', 'third']) as feature, unnest([embedding[1]::double, label::double, case when e.vec_id % 3 = 0 then embedding[3]::double end]) as v from embeddings e join t on t.vec_id = e.vec_id)
select feature, count(v) as n, round(corr(share, v), 6) as r from ml group by 1""")
def attention_correlation(spark, folder):
    e = table(spark, folder, "embeddings")
    measured = e.select(F.col("vec_id").alias("record"), F.get("embedding", F.lit(0)).alias("first"), "label", F.when(F.col("vec_id") % 3 == 0, F.get("embedding", F.lit(2))).alias("third"))
    return segments.attention_correlation(segments.by_segment(lead_samples(spark, folder), "vec_id", "x"), "vec_id", "p", measured, "record", ["first", "label", "third"])


@query(f"""with {LEAD_SQL}, {SHARES}, t as (select vec_id, segment, sum(share) as share from q where segment <> 'other' group by 1, 2)
select vec_id, arg_max(segment, share) as segment, round(max(share), 6) as share from t group by vec_id""")
def dominant_segment(spark, folder):
    return segments.dominant(segments.by_segment(lead_samples(spark, folder), "vec_id", "x"), "vec_id")


@query(f"""with {LEAD_SQL}, z as (select vec_id, segment, sum(abs(x)) as a, sum(x * x) as b from s group by 1, 2),
t as (select vec_id, segment, b / sum(b) over (partition by vec_id) - a / sum(a) over (partition by vec_id) as d from z)
select segment, count(*) as n, round(avg(d), 6) as mean, round(stddev_samp(d) / sqrt(count(*)), 6) as se, round(avg(d) - 2.497705474412374::double * stddev_samp(d) / sqrt(count(*)), 6) as low,
round(avg(d) + 2.497705474412374::double * stddev_samp(d) / sqrt(count(*)), 6) as high from t group by segment""")
def amplitude_null_diff(spark, folder):
    s = lead_samples(spark, folder)
    trained = segments.by_segment(s.withColumn("energy", F.col("x") * F.col("x")), "vec_id", "energy")
    return segments.paired_difference(trained, segments.by_segment(s, "vec_id", "x"), "vec_id")


@query(f"""with {LEAD_SQL}, z as (select vec_id, lead, segment, sum(abs(x)) as a, sum(x * x) as b from s group by 1, 2, 3)
select count(*) as n, round(corr(b, a), 6) as r from z""")
def amplitude_corr(spark, folder):
    z = lead_samples(spark, folder).groupBy("vec_id", "lead", "segment").agg(F.sum(F.abs("x")).alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    return z.agg(F.count(F.lit(1)).alias("n"), F.corr("b", "a").alias("r"))


@query(f"""with {LEAD_SQL}, z as (select vec_id, lead, avg(case when segment = 'p' then abs(x) end) - avg(case when segment <> 'p' then abs(x) end) as d from s group by 1, 2)
select lead::bigint as lead, count(d) as n, round(avg(d), 6) as elevation, round(avg(d) - 1.9599639845400539::double * stddev_samp(d) / sqrt(count(d)), 6) as low,
round(avg(d) + 1.9599639845400539::double * stddev_samp(d) / sqrt(count(d)), 6) as high from z group by lead""")
def per_lead_elevation(spark, folder):
    return segments.elevation(lead_samples(spark, folder).withColumn("a", F.abs("x")), "vec_id", "a", "p")


@query(f"""with {LEAD_SQL}, md as (select vec_id, lead, median(x) as m from s group by 1, 2),
c as (select s.vec_id, s.segment, (m - x) * ((s.lead + 1) * 0.5::double - s."at" * 0.1::double) as change,
 row_number() over (partition by s.vec_id, segment order by md5(s.vec_id::varchar || ':' || s.lead::varchar || ':' || s."at"::varchar), s.lead, s."at") as place from s join md on s.vec_id = md.vec_id and s.lead = md.lead),
z as (select vec_id, segment, sum(change) as effect, count(*) as n from c where segment <> 'other' group by 1, 2),
k as (select z.vec_id, z.segment, sum(change) as control from z join c on c.vec_id = z.vec_id and c.segment = 'other' and place <= z.n group by 1, 2),
j as (select z.segment, effect, coalesce(control, 0) as control from z left join k on z.vec_id = k.vec_id and z.segment = k.segment)
select segment, count(*) as n, round(avg(effect), 6) as effect, round(avg(control), 6) as control, round(avg(abs(effect) - abs(control)), 6) as difference,
round(stddev_samp(abs(effect) - abs(control)) / sqrt(count(*)), 6) as se, round(avg(case when effect > 0 then 1.0::double else 0.0::double end), 6) as older from j group by segment""")
def occlusion_paired(spark, folder):
    s = lead_samples(spark, folder).withColumn("w", (F.col("lead") + 1) * 0.5 - F.col("at") * 0.1)
    return segments.occlusion(segments.occluded_scores(s, "vec_id", "x", "w", ["p", "qrs", "t"]))


@query(f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings where len(embedding) = 64),
w as (select list_transform(range(64), lambda i: (i % 7 - 3) / 4.0::double) as w),
z as (select vec_id, x, w, list_sum(list_transform(list_zip(x, w), lambda p: p[1] * p[2])) as s from e, w),
g as (select z.*, (select avg((1 / (1 + exp(-(0.5::double + s * (k + 0.5::double) / 64)))) * (1 - 1 / (1 + exp(-(0.5::double + s * (k + 0.5::double) / 64))))) from range(64) r(k)) as slope from z)
select vec_id, round(1 / (1 + exp(-(0.5::double + s))), 6) as score, round(1 / (1 + exp(-0.5::double)), 6) as baseline_score, round(s * slope - (1 / (1 + exp(-(0.5::double + s))) - 1 / (1 + exp(-0.5::double))), 6) + 0 as error,
abs(s * slope - (1 / (1 + exp(-(0.5::double + s))) - 1 / (1 + exp(-0.5::double)))) > 0.001::double as flagged, round(x[1] * w[1] * slope, 6) + 0 as first, round(x[64] * w[64] * slope, 6) + 0 as last from g""")
def path_attribution(spark, folder):
    """A logistic scorer over vectors, its path from zero; the whole attribution is in the operator's array."""
    weights = (np.arange(64) % 7 - 3) / 4.0
    e = table(spark, folder, "embeddings")
    found = paths.path_attribution(e, "vec_id", "embedding", paths.logistic(weights, 0.5), "zero", LEADS, 64, absolute=0.001, relative=0.0)
    return found.select("vec_id", "score", "baseline_score", "error", "flagged", F.get("attribution", F.lit(0)).alias("first"), F.get("attribution", F.lit(63)).alias("last"))


@query(f"""with {LEAD_SQL}, g as (select *, (x - 0.1::double) * list_sum(list_transform(range(1, 17), lambda k: (lead + 1) * 0.5::double + 0.5::double * (0.1::double + (k - 0.5::double) / 16.0::double * (x - 0.1::double)))) / 16.0::double as a,
 ((lead + 1) * 0.5::double * x + 0.25::double * x * x) - ((lead + 1) * 0.5::double * 0.1::double + 0.25::double * 0.01::double) as d from s), t as (select vec_id, sum(a) as total, sum(d) as span from g group by 1)
select vec_id, round(total, 6) as total, round(span, 6) as span, round(total - span, 6) + 0.0::double as error, abs(total - span) > 1.0::double + 0.05::double * abs(span) as flagged from t""")
def integrated_gradients_completeness(spark, folder):
    s = lead_samples(spark, folder).withColumn("w", (F.col("lead") + 1) * 0.5).withColumn("x0", F.lit(0.1))
    out = segments.completeness(segments.integrated_gradients(s, "x", "x0", "w", 0.25, 16), "vec_id", "x", "x0", "w", 0.25)
    return out.withColumn("error", F.round("error", 6))


# Regression


@query(f"""with {ORDER_SQL}, e as (select y, 2.5::double * lines + 0.1::double * qty as p from f)
select count(*) as n, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2 from e""")
def regression_metrics(spark, folder):
    f = order_features(spark, folder)
    return regression.metrics(f, "y", 2.5 * F.col("lines") + 0.1 * F.col("qty"))


@query(f"""with {ORDER_SQL}, {TRAINING_SUMS.format(x='lines')} select 'lines' as feature, round(r2, 6) as r2 from r""")
def oof_ols_r2(spark, folder):
    return regression.univariate(order_features(spark, folder), "y", ["lines"], "fold")


@query("with " + ORDER_SQL + "".join(f", {p}r as (select '{p}' as feature, r2 from (with {TRAINING_SUMS.format(x=p)} select r2 from r))" for p in ("lines", "qty", "disc", "tax")) + """
select feature, round(r2, 6) as r2 from (select * from linesr union all select * from qtyr union all select * from discr union all select * from taxr)""")
def univariate_r2(spark, folder):
    return regression.univariate(order_features(spark, folder), "y", ["lines", "qty", "disc", "tax"], "fold")


@query("with " + ORDER_SQL + "".join(f", {p}r as (select '{p}' as feature, r2 from (with {TRAINING_SUMS.format(x=p)} select r2 from r))" for p in ("lines", "disc", "tax")) + """
select arg_max(feature, r2) as feature, round(max(r2), 6) as r2 from (select * from linesr union all select * from discr union all select * from taxr)""")
def most_explanatory(spark, folder):
    return regression.most_explanatory(regression.univariate(order_features(spark, folder), "y", ["lines", "disc", "tax"], "fold"), "feature", "r2")


TWO = """g as (select {k} as k, fold, count(*)::double n, sum(age) sx, sum(lines) sz, sum(y) sy, sum(age*age) sxx, sum(lines*lines) szz, sum(age*lines) sxz, sum(age*y) sxy, sum(lines*y) szy, sum(y*y) syy from f group by 1, 2),
w as (select k, sum(n) n, sum(sx) sx, sum(sz) sz, sum(sy) sy, sum(sxx) sxx, sum(szz) szz, sum(sxz) sxz, sum(sxy) sxy, sum(szy) szy from g group by k),
t as (select g.*, (w.n-g.n) tn, (w.sx-g.sx) tx, (w.sz-g.sz) tz, (w.sy-g.sy) ty, (w.sxx-g.sxx) txx, (w.szz-g.szz) tzz, (w.sxz-g.sxz) txz, (w.sxy-g.sxy) txy, (w.szy-g.szy) tzy from g join w on g.k = w.k),
c as (select *, txx-tx*tx/tn cxx, tzz-tz*tz/tn czz, txz-tx*tz/tn cxz, txy-tx*ty/tn cxy, tzy-tz*ty/tn czy from t),
b as (select *, cxy/cxx as b1, (cxy*czz-czy*cxz)/(cxx*czz-cxz*cxz) as p, (czy*cxx-cxy*cxz)/(cxx*czz-cxz*cxz) as q from c),
i as (select *, (ty-b1*tx)/tn as i1, (ty-p*tx-q*tz)/tn as i2 from b),
r as (select k, sum(n) n, 1-sum(syy-2*(i1*sy+b1*sxy)+i1*i1*n+2*i1*b1*sx+b1*b1*sxx)/(sum(syy)-sum(sy)*sum(sy)/sum(n)) r_base,
 1-sum(syy-2*(i2*sy+p*sxy+q*szy)+i2*i2*n+2*i2*(p*sx+q*sz)+p*p*sxx+2*p*q*sxz+q*q*szz)/(sum(syy)-sum(sy)*sum(sy)/sum(n)) r_full from i group by k)
select k as stratum, n::bigint as n, round(greatest(r_base, 0), 6) as r2_base, round(r_full, 6) as r2_full, round(r_full-greatest(r_base, 0), 6) as incremental, round(1-r_full, 6) as unexplained from r"""


@query(f"with {ORDER_SQL}, {TWO.format(k=chr(39) + 'all' + chr(39))}")
def incremental_r2(spark, folder):
    return regression.decomposition(order_features(spark, folder), "y", ["age"], ["lines"], "fold")


@query(f"with {ORDER_SQL}, {TWO.format(k='o_orderpriority')}")
def subgroup_decomposition(spark, folder):
    return regression.decomposition(order_features(spark, folder), "y", ["age"], ["lines"], "fold", "o_orderpriority")


# Inference

def _scrambled(x: str) -> str:
    z = f"(({x}) % 4294967296)"
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        z = f"((xor({z}, {z} >> {shift}) * {factor}) % 4294967296)"
    return f"xor({z}, {z} >> 15)"


#: replicate, c, times: how often each replicate draws each cluster.
DRAWS = f"""hc as (select c, {_scrambled('c')} as h from (select distinct {{c}} as c from {{t}}) where c is not null), hr as (select i as replicate, {_scrambled('i + 1')} as hi from range({REPLICATES}) r(i)),
hx as (select replicate, c, xor(h, hi) as x from hc, hr), hs as (select replicate, c, {_scrambled('x')}::double / 4294967296.0::double as share from hx),
mu as (select * from (select replicate, c, {' + '.join(f"(case when share >= {p!r}::double then 1 else 0 end)" for p in POISSON)} as times from hs) where times > 0)"""


@query(f"""with {ORDER_SQL}, {TWO.format(k=chr(39) + 'all' + chr(39)).split(chr(10) + 'r as')[0].rstrip(',')},
pr as (select o_custkey, y, i1 + b1 * age as base, i2 + p * age + q * lines as ful from f join i on i.fold = f.fold),
st as (select o_custkey, count(*) n, sum(y) sy, sum(y*y) syy, sum((y-base)*(y-base)) eb, sum((y-ful)*(y-ful)) ef from pr group by 1),
{DRAWS.format(c='o_custkey', t='st')},
wt as (select replicate, sum(times*n) n, sum(times*sy) sy, sum(times*syy) syy, sum(times*eb) eb, sum(times*ef) ef from mu join st on c = o_custkey group by 1),
rr as (select 1-ef/(syy-sy*sy/n) as rf, 1-ef/(syy-sy*sy/n)-greatest(1-eb/(syy-sy*sy/n), 0) as ri from wt)
select count(*) as replicates, round(quantile_cont(rf, 0.025), 6) as r_full_low, round(quantile_cont(rf, 0.975), 6) as r_full_high, round(quantile_cont(ri, 0.025), 6) as r_inc_low, round(quantile_cont(ri, 0.975), 6) as r_inc_high from rr""")
def cluster_bootstrap_r2(spark, folder):
    """All customers; full is age and lines fitted together, so that r_inc is what lines add to age."""
    f = regression.fold_fit(order_features(spark, folder), ["age"], "y", "fold").withColumnRenamed("fitted", "base")
    f = regression.fold_fit(f, ["age", "lines"], "y", "fold").withColumnRenamed("fitted", "full")
    return inference.bootstrap_r2(f, "o_custkey", "y", "base", "full", REPLICATES)


LABELLED = "lb as (select d.doc_id, d.doc_id // 3 as cluster, toxic as label, (n_chars % 50)::double as base, (n_chars % 50 + 20 * toxic)::double as ful from documents d join labels l on d.doc_id = l.doc_id)"


def _labelled(spark, folder):
    d, y = table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels").select("doc_id", "toxic", "quality")
    base = F.col("n_chars") % 50
    return d.join(y, "doc_id").select("doc_id", F.floor(F.col("doc_id") / 3).cast("long").alias("cluster"), F.col("toxic").alias("label"), "quality", base.cast("double").alias("base"), (base + 20 * F.col("toxic")).cast("double").alias("full"))


@query(f"""with {LABELLED}, rk as (select label, rank() over (order by ful) + (count(*) over (partition by ful) - 1) / 2.0::double as r from lb)
select count(*) filter (where label = 1) as n_positive, count(*) filter (where label = 0) as n_negative,
round((sum(case when label = 1 then r end) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0::double)
 / (count(*) filter (where label = 1)::double * count(*) filter (where label = 0)), 6) as auc from rk""")
def auc_pooled(spark, folder):
    return inference.auc(_labelled(spark, folder), "label", "full")


def _auc_sql(name: str, score: str) -> str:
    return f"""{name}a as (select replicate, {score} as sc, sum(case when label = 1 then times else 0 end) p, sum(case when label = 0 then times else 0 end) q from mu join lb on c = cluster group by 1, 2),
{name}b as (select *, coalesce(sum(q) over (partition by replicate order by sc rows between unbounded preceding and 1 preceding), 0) as below from {name}a),
{name} as (select replicate, case when sum(p) > 0 and sum(q) > 0 then sum(p * (below + q / 2.0::double)) / (sum(p)::double * sum(q)) end as auc from {name}b group by 1)"""


DELTA = f"{LABELLED}, {DRAWS.format(c='cluster', t='lb')}, {_auc_sql('fa', 'ful')}, {_auc_sql('ba', 'base')}, dl as (select fa.auc - ba.auc as d from fa join ba on fa.replicate = ba.replicate)"


@query(f"with {DELTA} select count(d) as replicates, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high from dl")
def delta_auc_bootstrap(spark, folder):
    return inference.delta_auc(_labelled(spark, folder), "cluster", "label", "base", "full", REPLICATES, 0.025)


@query(f"""with {DELTA}, qn as (select quantile_cont(d, 0.005) as low, quantile_cont(d, 0.025) as pl, quantile_cont(d, 0.975) as ph from dl)
select round(low, 6) as low, low > 0 as improves, (pl > -0.02::double and ph < 0.02::double) as equivalent,
case when low > 0 and pl > -0.02::double and ph < 0.02::double then 'improves within margin' when low > 0 then 'improves' when pl > -0.02::double and ph < 0.02::double then 'equivalent' else 'inconclusive' end as verdict from qn""")
def superiority_tost_verdict(spark, folder):
    d = inference.auc_differences(_labelled(spark, folder), "cluster", "label", "base", "full", REPLICATES)
    bounds = d.agg(F.count("d").alias("replicates"), *[F.percentile("d", F.lit(q)).alias(c) for c, q in (("low", segments.tail(0.95, 5)), ("pl", 0.025), ("ph", 0.975))])
    enough = F.col("replicates") * 2 >= REPLICATES
    bounds = bounds.select(*[F.when(enough, F.col(c)).alias(c) for c in ("low", "pl", "ph")])
    better, same = inference.verdict(F.col("low"), F.lit(None).cast("double"), F.col("pl"), F.col("ph"), 0.02)
    return bounds.select("low", better.alias("improves"), same.alias("equivalent"), inference.verdict_text(better, same).alias("verdict"))


@query("""select label, sum(y)::bigint as positives, count(*) as n, (sum(y) >= 20 and sum(y) <= count(*) - 20) as testable from
(select 'toxic' as label, toxic as y from labels union all select 'quality', quality from labels) where y is not null group by label""")
def testability_gate(spark, folder):
    return inference.testable(table(spark, folder, "labels"), ["toxic", "quality"], 20, 5)


@query("""with w as (select user_id, avg(case when event_type = 'click' then value end) a, avg(case when event_type = 'view' then value end) b, avg(case when event_type = 'purchase' then value end) c from events group by user_id),
k as (select count(*) n, (corr(a, b) + corr(a, c) + corr(b, c)) / 3 as r from w where a is not null and b is not null and c is not null)
select n, round(r, 6) as mean_correlation, round(least(greatest(1 - r, 0), 1), 6) as nu from k""")
def noise_floor(spark, folder):
    return inference.noise_floor(table(spark, folder, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"])


@query("""with w as (select user_id, avg(case when event_type = 'click' then value end) a, avg(case when event_type = 'view' then value end) b, avg(case when event_type = 'purchase' then value end) d from events group by user_id),
k as (select * from w where a is not null and b is not null and d is not null), """ + DRAWS.format(c="user_id", t="k") + """,
z as (select replicate, sum(times) n, sum(times*a) sa, sum(times*b) sb, sum(times*d) sd, sum(times*a*a) qa, sum(times*b*b) qb, sum(times*d*d) qd, sum(times*a*b) ab, sum(times*a*d) ad, sum(times*b*d) bd from mu join k on c = user_id group by 1),
r as (select ((ab-sa*sb/n)/sqrt((qa-sa*sa/n)*(qb-sb*sb/n)) + (ad-sa*sd/n)/sqrt((qa-sa*sa/n)*(qd-sd*sd/n)) + (bd-sb*sd/n)/sqrt((qb-sb*sb/n)*(qd-sd*sd/n))) / 3 as m from z),
x as (select quantile_cont(least(greatest(1 - m, 0), 1), 0.025) as low, quantile_cont(least(greatest(1 - m, 0), 1), 0.975) as high from r),
y as (select count(*) n, (corr(a, b) + corr(a, d) + corr(b, d)) / 3 as r from k)
select n, round(r, 6) as mean_correlation, round(least(greatest(1 - r, 0), 1), 6) as nu, round(low, 6) as low, round(high, 6) as high from y, x""")
def noise_floor_interval(spark, folder):
    return inference.noise_floor_interval(table(spark, folder, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"], REPLICATES)


@query("""with v as (select 'tax' as feature, case when l_tax <> 0 then l_tax end as x from lineitem union all select 'discount', l_discount from lineitem)
select feature, round(avg(case when x is not null then 1.0::double else 0.0::double end), 6) as finite, round(avg(case when x <> 0 then 1.0::double else 0.0::double end), 6) as nonzero, round(median(x), 6) as median, round(stddev_samp(x), 6) as sd from v group by 1""")
def feature_coverage(spark, folder):
    line = table(spark, folder, "lineitem").select(F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), F.col("l_discount").alias("discount"))
    return cohort.coverage(line, ["tax", "discount"])


# Sweep

FEATURES = ["lines", "qty", "disc", "tax"]
#: Subsets of a size at most; four features have six of a size, so all 15 are taken.
DRAWS_PER_SIZE = 20
SUBSETS = [x for size in sweep.subset_sizes(len(FEATURES)) for x in sweep.draw_subsets(FEATURES, size, DRAWS_PER_SIZE, 0)]


def _scores(spark, folder):
    return regression.subset_scores(order_features(spark, folder), "y", ["age"], SUBSETS, "fold")


def _fits_sql(subsets: list[list[str]], whole: bool = False) -> str:
    """g, gt: sums of products; sb: subsets; bt: coefficients by subset and fold, -1 for y. By Gauss-Jordan elimination
    over cells (subset, fold, i, j). whole: fold -1 is fitted to all rows."""
    names = ["1.0::double", "age", *FEATURES, "y"]
    place = {c: i + 1 for i, c in enumerate(names)}
    y = len(names)
    members = ", ".join(f"('{'+'.join(x) or 'base'}', {len(x)}, {[1, 2, *sorted(place[c] for c in x)]})" for x in subsets)
    out = f"""{ORDER_SQL}, sb(subset, k, own) as (values {members}), v as (select fold, [{', '.join(names)}] as x from f),
g as (select fold, i, j, sum(x[i] * x[j]) as v from v, range(1, {y + 1}) a(i), range(1, {y + 1}) b(j) group by 1, 2, 3{' union all select -1, i, j, 0.0::double from range(1, ' + str(y + 1) + ') a(i), range(1, ' + str(y + 1) + ') b(j)' if whole else ''}),
gt as (select i, j, sum(v) as v from g group by 1, 2),
w0 as (select subset, g.fold, g.i, g.j, gt.v - g.v as v from sb, g join gt on gt.i = g.i and gt.j = g.j where list_contains(own, g.i) and (g.j = {y} or list_contains(own, g.j)))"""
    for p in range(1, y):
        w, n = f"w{p - 1}", f"w{p}"
        out += f""",
{n} as (select a.subset, a.fold, a.i, a.j, case when d.v is null then a.v when a.i = {p} then a.v / d.v else a.v - b.v * c.v / d.v end as v from {w} a
 left join {w} b on b.subset = a.subset and b.fold = a.fold and b.i = a.i and b.j = {p} left join {w} c on c.subset = a.subset and c.fold = a.fold and c.i = {p} and c.j = a.j
 left join {w} d on d.subset = a.subset and d.fold = a.fold and d.i = {p} and d.j = {p})"""
    return out + f""",
bt as (select subset, fold, i, v from w{y - 1} where j = {y} union all select subset, fold, {y}, -1.0::double from sb, (select distinct fold from g))"""


def _sweep_sql() -> str:
    """lv: k, n, mean, sd, low, high of all subsets."""
    y = len(FEATURES) + 3
    return f"""{_fits_sql(SUBSETS)},
se as (select a.subset, sum(a.v * b.v * g.v) as sse from bt a join bt b on a.subset = b.subset and a.fold = b.fold join g on g.fold = a.fold and g.i = a.i and g.j = b.i group by 1),
sc as (select subset, k, 1 - sse / (select max(case when i = {y} and j = {y} then v end) - power(max(case when i = 1 and j = {y} then v end), 2) / max(case when i = 1 and j = 1 then v end) from gt) as r2 from se join sb using (subset)),
lv as (select k, count(*) as n, avg(r2) as mean, coalesce(stddev_samp(r2), 0) as sd, min(r2) as low, max(r2) as high from sc group by k),
st as (select k, mean, mean - lag(mean) over (order by k) as rise, ln(k) - ln(lag(k) over (order by k)) as run from lv)"""


SWEEP_SQL = _sweep_sql()
TREND_SQL = "round(regr_slope(mean, ln(k)), 6) as log_slope, round(arg_max(rise, k), 6) as tail_gain, round(arg_max(rise / run, k), 6) as tail_log_slope"


@query(f"with {SWEEP_SQL} select k::bigint as k, n, round(mean, 6) as mean, round(sd, 6) as sd, round(low, 6) as low, round(high, 6) as high from lv")
def sweep_levels(spark, folder):
    return sweep.levels(_scores(spark, folder))


@query(f"with {SWEEP_SQL} select {TREND_SQL} from st")
def log_slope_tail(spark, folder):
    return sweep.trend(sweep.levels(_scores(spark, folder)))


@query(f"with {SWEEP_SQL} select {TREND_SQL}, coalesce(arg_max(rise, k) <= 0.01::double and arg_max(rise / run, k) <= 0.01::double, false) as saturated from st")
def saturation_verdict(spark, folder):
    return sweep.saturation(sweep.trend(sweep.levels(_scores(spark, folder))))


@query(f"with {SWEEP_SQL} select arg_max(k, high - low)::bigint as k, round(max(high - low), 6) as spread, max(high - low) >= 0.02::double as warn from lv")
def spread_warning(spark, folder):
    return sweep.spread_warning(sweep.levels(_scores(spark, folder)))


@query(None)
def sweep_ceiling(spark, folder):
    """value, half, refused. A row a size comes to the driver."""
    rows = sweep.levels(_scores(spark, folder)).orderBy("k").collect()
    fit = sweep.ceiling([r["k"] for r in rows], [r["mean"] for r in rows])
    return spark.createDataFrame([(fit.value, fit.half, fit.refused)], "value double, half double, refused string")


ARMS = {"size": ["lines"], "amount": ["lines", "qty"], "price": ["disc", "lines", "qty"], "every": FEATURES}
ARM_SQL = ", ".join(f"({i}, '{a}', '{'+'.join(sorted(x))}')" for i, (a, x) in enumerate(ARMS.items()))


@query(f"""with {SWEEP_SQL}, ar(place, arm, members) as (values {ARM_SQL})
select arm, k::bigint as k, round(r2, 6) as r2_full, round(r2 - lag(r2) over (order by place), 6) as gain
from ar join sc on array_to_string(list_sort(string_split(subset, '+')), '+') = members""")
def enumeration_arms(spark, folder):
    return sweep.arms(_scores(spark, folder), ARMS)


# The whole decomposition

GAP = {"key": "o_orderkey", "y": "y", "covariates": ["age"], "features": FEATURES, "fold": "fold", "cluster": "o_custkey"}
#: pt, rp: shares of every subset over all rows and over each replicate; er: errors by order.
GAP_SQL = f"""{_fits_sql([[], FEATURES, *[[c] for c in FEATURES]], whole=True)},
vk as (select o_orderkey, o_custkey, fold, [1.0::double, age, {', '.join(FEATURES)}, y] as x from f),
er as (select vk.o_orderkey, vk.o_custkey, subset, -sum(bt.v * x[bt.i]) as e, any_value(x[{len(FEATURES) + 3}]) as y from vk join bt on bt.fold = vk.fold group by 1, 2, 3),
st as (select o_custkey, subset, count(*) as n, sum(y) as sy, sum(y * y) as syy, sum(e * e) as se from er group by 1, 2), {DRAWS.format(c='o_custkey', t='st')},
pt as (select subset, sum(n) as n, sqrt(greatest(sum(syy) / sum(n) - power(sum(sy) / sum(n), 2), 0)) as sd, 1 - sum(se) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) as r from st group by 1),
rp as (select replicate, subset, 1 - sum(times * se) / (sum(times * syy) - sum(times * sy) * sum(times * sy) / sum(times * n)) as r from mu join st on c = o_custkey group by 1, 2),
ab as (select a.subset, a.r, a.r - greatest(b.r, 0) as added from rp a join rp b on a.replicate = b.replicate and b.subset = 'base'),
qt as (select subset, quantile_cont(r, 0.025) as rl, quantile_cont(r, 0.975) as rh, quantile_cont(added, 0.025) as al, quantile_cont(added, 0.975) as ah from ab group by 1),
bs as (select n, sd, greatest(r, 0) as base from pt where subset = 'base')"""


def _linear(spark, folder):
    return decompose.decompose(order_features(spark, folder), **GAP, explainers=("linear",), replicates=REPLICATES)


@query(f"""with {GAP_SQL} select 'linear' as explainer, bs.n::bigint as n, 0::bigint as n_dropped, round(bs.sd, 6) as gap_sd, round(base, 6) as r2_base, round(r, 6) as r2_full, round(r - base, 6) as incremental, round(1 - r, 6) as unexplained,
round(rl, 6) as full_low, round(rh, 6) as full_high, round(al, 6) as incremental_low, round(ah, 6) as incremental_high, true as most_explanatory from pt join qt using (subset), bs where subset = '{'+'.join(FEATURES)}'""")
def gap_explainers(spark, folder):
    return _linear(spark, folder).explainers


@query(f"""with {GAP_SQL}, sp as (select i, sqrt(greatest(v / (select v from gt where i = 1 and j = 1) - power((select v from gt z where z.i = 1 and z.j = gt.i) / (select v from gt where i = 1 and j = 1), 2), 0)) as sd from gt where i = j),
ef as (select bt.i, bt.v * sp.sd as effect from bt join sp on sp.i = bt.i where fold = -1 and subset = '{'+'.join(FEATURES)}')
select 'linear' as explainer, subset as feature, round(effect, 6) as effect, round(r - base, 6) as univariate, round(al, 6) as low, round(ah, 6) as high
from pt join qt using (subset) join sb using (subset) join ef on ef.i = own[3], bs where k = 1""")
def gap_features(spark, folder):
    return _linear(spark, folder).features


@query(f"with {GAP_SQL} select o_orderkey, 'linear' as explainer, round(e, 6) as residual from er where subset = '{'+'.join(FEATURES)}'")
def gap_residuals(spark, folder):
    return _linear(spark, folder).residuals


GAP_ARMS = {"size": ["lines"], "size and price": ["lines", "disc", "tax"], "every": FEATURES, "absent": ["lines", "nowhere"]}


@query("\nunion all ".join(f"""select * from (with {GAP_SQL.replace(_fits_sql([[], FEATURES, *[[c] for c in FEATURES]], whole=True), _fits_sql([[], own]))}
select '{arm}' as arm, {len(own)}::bigint as n_features, 'linear' as explainer, bs.n::bigint as n, round(r - base, 6) as incremental, round(al, 6) as low, round(ah, 6) as high, round(1 - r, 6) as unexplained from pt join qt using (subset), bs where subset = '{'+'.join(own)}')""" for arm, own in GAP_ARMS.items() if "nowhere" not in own))
def gap_arms(spark, folder):
    more = {k: v for k, v in GAP.items() if k != "features"}
    return decompose.arms(order_features(spark, folder), **more, named=GAP_ARMS, explainers=("linear",), replicates=REPLICATES)


@query(None)
def gap_boosted(spark, folder):
    """Both explainers over the same rows and draws."""
    return decompose.decompose(order_features(spark, folder), **GAP, replicates=REPLICATES, settings=QUICK).explainers


@query(None)
def gap_sweep(spark, folder):
    """Points of drawn and named subsets, each by the explainer that explains most."""
    points = accumulate.sweep_known(order_features(spark, folder), **GAP, draws=2, named={"price": ["disc", "tax"]}, replicates=REPLICATES, settings=QUICK).points
    return points.withColumn("features", F.array_join("features", "+"))


# Folds of diagnostic links, and profiles against controls

DEALT = """gr as (select cluster as g, max(case when label = 1 then 1 else 0 end) as kind from lb group by 1),
dg as (select g, kind, (row_number() over (partition by kind order by md5('0:' || g::varchar), g) - 1) % 5 as fold from gr), lf as (select lb.*, fold from lb join dg on g = cluster)"""


@query(f"""with {LABELLED}, {DEALT} select fold::bigint as fold, count(*) as n, count(distinct cluster) as groups, count(*) filter (where label = 1) as positives, count(distinct label) as classes from lf group by 1""")
def stratified_folds(spark, folder):
    return splits.fold_balance(splits.stratified_folds(_labelled(spark, folder), "cluster", "label", 5), "fold", "cluster", "label")


@query(f"""with {LABELLED}, {DEALT}, pr as (select a.fold, avg(case when a.base > b.base then 1.0::double when a.base = b.base then 0.5::double else 0.0::double end) as x,
avg(case when a.ful > b.ful then 1.0::double when a.ful = b.ful then 0.5::double else 0.0::double end) as y from lf a join lf b on a.fold = b.fold and a.label = 1 and b.label = 0 group by 1)
select f.fold::bigint as fold, round(x, 6) as auc_base, round(y, 6) as auc_full, round(y - x, 6) as delta from (select distinct fold from lf) f left join pr on pr.fold = f.fold""")
def link_fold_deltas(spark, folder):
    return inference.fold_deltas(splits.stratified_folds(_labelled(spark, folder), "cluster", "label", 5), "fold", "label", "base", "full")


@query(None)
def diagnostic_links(spark, folder):
    """Two labels of documents: what a residual that only one of them drives adds to known features; untested ones with a reason."""
    rows = _labelled(spark, folder).where("quality is not null")
    known = F.col("doc_id") % 11
    rows = rows.select("doc_id", "cluster", "label", "quality", "base", known.cast("double").alias("known"), (F.col("doc_id") * 7919 % 1000 / 500 + F.col("label")).cast("double").alias("residual"))
    found = link.diagnostic_links(rows, "doc_id", ["label", "quality"], ["base", "known"], "residual", cluster="cluster", replicates=REPLICATES)
    return found.links.unionByName(found.skipped, allowMissingColumns=True)


@query("""with m as (select event_type, user_id, avg(value) as m, stddev_samp(value) / sqrt(count(value)) as se from events group by 1, 2),
k as (select event_type, count(m) as n, stddev_samp(m) as sd, avg(se) as floor from m group by 1)
select event_type, n, round(sd, 6) as sd, round(floor, 6) as floor, coalesce(sd > 2 * floor, false) as usable from k""")
def dispersion_verdict(spark, folder):
    return inference.dispersion_reliability(table(spark, folder, "events"), "user_id", "event_type", "value")


@query(f"""with {LEAD_SQL.replace("select vec_id, (i // 16)::int as lead, (i % 16)::int as", "select vec_id, (i // 16)::int as lead, x * ((i // 16 + 1) * 0.5::double + 0.5::double * x) as x, (i % 16)::int as").replace('as "at", x,', 'as "at",')}, {SHARES}
select vec_id, lead::bigint as lead, segment, round(share, 6) as share, round(density, 6) as density, round(signed_share, 6) as signed_share from q""")
def input_times_gradient(spark, folder):
    s = segments.input_times_gradient(lead_samples(spark, folder).withColumn("w", (F.col("lead") + 1) * 0.5), "x", "w", 0.25)
    return segments.by_segment(s, "vec_id", "attribution")


def _sides(spark, folder):
    """Samples with the values of a weighted scorer, of plain amplitude and of amplitude squared."""
    s = lead_samples(spark, folder).withColumn("scored", F.col("x") * (F.col("at") + 1)).withColumn("energy", F.col("x") * F.col("x"))
    return [segments.by_segment(s, "vec_id", c) for c in ("scored", "x", "energy")]


def _share_sql(name: str, value: str) -> str:
    return f"{name} as (select vec_id, segment, sum({value}) / sum(sum({value})) over (partition by vec_id) as share from s group by 1, 2)"


#: The normal quantile of eight tests at 95%: four segments, two controls.
Z_CONTROLS = 2.734368786533176


@query(f"""with {LEAD_SQL}, {_share_sql('tr', 'abs(x * ("at" + 1))')}, {_share_sql('am', 'abs(x)')}, {_share_sql('en', 'x * x')},
d as (select method, c.segment, tr.share - c.share as d from tr join (select 'amplitude' as method, * from am union all select 'energy', * from en) c on c.vec_id = tr.vec_id and c.segment = tr.segment),
z as (select method, segment, count(d) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(d)) as se from d group by 1, 2),
i as (select *, mean - {Z_CONTROLS}::double * se as low, mean + {Z_CONTROLS}::double * se as high from z)
select method, segment, n, round(mean, 6) as mean, round(se, 6) as se, round(low, 6) as low, round(high, 6) as high, low > 0 or high < 0 as departs from i""")
def against_controls(spark, folder):
    trained, amplitude, energy = _sides(spark, folder)
    return segments.against_controls(trained, {"amplitude": amplitude, "energy": energy}, "vec_id")


@query(f"""with {LEAD_SQL}, w(seg) as (values ('p'), ('qrs'), ('t')),
e as (select seg, vec_id, lead, avg(case when segment = seg then abs(x) end) - avg(case when segment <> seg then abs(x) end) as d from s, w group by 1, 2, 3),
l as (select seg, lead, avg(d) as el, avg(d) - 1.959963984540054::double * stddev_samp(d) / sqrt(count(d)) as lo from e group by 1, 2)
select seg as segment, count(*) as leads, round(avg(el), 6) as mean, round(min(el), 6) as low, round(max(el), 6) as high, count(*) filter (where lo > 0) as n_above from l group by 1""")
def elevation_summary(spark, folder):
    s = lead_samples(spark, folder).withColumn("a", F.abs("x"))
    p, qrs, t = (segments.elevation(s, "vec_id", "a", name).withColumn("segment", F.lit(name)) for name in ("p", "qrs", "t"))
    return segments.elevation_summary(p.unionByName(qrs).unionByName(t))
