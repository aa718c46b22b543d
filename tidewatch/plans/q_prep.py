"""Checks of imputation, encoders, scalers, sampling and splitting (C2-C4,
D1-D8, E1-E6) on ``event_flows`` (key ``flow_id``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import preprocess as P
from tidewatch.operators import sample as S
from tidewatch.plans.registry import qi, r6, register
from tidewatch.sources.fixtures import EVENT_FLOWS_SQL, event_flows

KEY = "flow_id"
EF = f"ef as ({EVENT_FLOWS_SQL})"
H15 = "cast(('0x' || substr(md5('42:' || cast({k} as varchar)), 1, 15)) as bigint)"
U32 = "(cast(('0x' || substr(md5('42:' || cast({k} as varchar)), 1, 8)) as bigint) / 4294967296.0)"
PROTOCOLS = ["click", "error", "purchase", "signup", "view"]
SPLIT_SQL = (f"sp as (select *, case when r <= floor(0.2 * n) then 'test' when r <= floor(0.4 * n) then 'val' "
             f"else 'train' end as split from (select *, row_number() over (partition by \"Label\" order by "
             f"{H15.format(k='flow_id')}, flow_id) as r, count(*) over (partition by \"Label\") as n from ef))")


def flows(spark, sf_dir):
    return event_flows(spark, sf_dir)


def split_flows(spark, sf_dir):
    return S.stratified_split(flows(spark, sf_dir), "Label", KEY)


# ---- C ------------------------------------------------------------------------------

@register("c2_median_impute", f"""with {EF}
select flow_id, {r6('coalesce(duration_gap, (select quantile_cont(duration_gap, 0.5) from ef))')} as duration_gap
from ef""")
def c2_median_impute(spark, sf_dir):
    out, _ = P.impute(flows(spark, sf_dir), ["duration_gap"], [])
    return out.select(KEY, "duration_gap")


@register("c3_mode_impute", f"""with {EF},
m as (select protocol_gap as v from ef where protocol_gap is not null group by 1 order by count(*) desc, 1 limit 1)
select flow_id, coalesce(protocol_gap, (select v from m)) as protocol_gap from ef""")
def c3_mode_impute(spark, sf_dir):
    out, _ = P.impute(flows(spark, sf_dir), [], ["protocol_gap"])
    return out.select(KEY, "protocol_gap")


@register("c4_impute_with_stored_fit", f"""with {EF}, {SPLIT_SQL},
med as (select quantile_cont(duration_gap, 0.5) as v from sp where split = 'train'),
m as (select protocol_gap as v from sp where split = 'train' and protocol_gap is not null
      group by 1 order by count(*) desc, 1 limit 1)
select flow_id, split, {r6('coalesce(duration_gap, (select v from med))')} as duration_gap,
       coalesce(protocol_gap, (select v from m)) as protocol_gap from sp""")
def c4_impute_with_stored_fit(spark, sf_dir):
    """C4 (R12): fill values fitted on the train split, applied to every split."""
    df = split_flows(spark, sf_dir)
    fv = P.fit_fill_values(df.where(F.col("split") == "train"), ["duration_gap"], ["protocol_gap"])
    return fv.apply(df).select(KEY, "split", "duration_gap", "protocol_gap")


# ---- D ------------------------------------------------------------------------------

@register("d1_onehot", f"""with {EF}
select flow_id, {', '.join(f"case when {qi('Protocol')} = '{p}' then 1.0 else 0.0 end as {qi('Protocol_' + p)}"
                           for p in PROTOCOLS)} from ef""")
def d1_onehot(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, "Protocol")
    return P.fit_encoder(df, ["Protocol"], "onehot").apply(df)


@register("d2_ordinal_codes", f"""with {EF}
select flow_id, cast(dense_rank() over (order by "Protocol") as bigint) as "Protocol" from ef""")
def d2_ordinal_codes(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, "Protocol")
    return P.fit_encoder(df, ["Protocol"], "label").apply(df)


@register("d3_target_encoding", f"""with {EF},
pr as (select avg("Label") as p from ef),
st as (select cast("Destination IP" as varchar) as v, count(*) as n, avg("Label") as m from ef
       where "Destination IP" is not null group by 1),
enc as (select v, case when n = 1 then (select p from pr) else
        (select p from pr) * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))) end as e
        from st)
select flow_id, {r6('coalesce(enc.e, (select p from pr))')} as "Destination IP"
from ef left join enc on cast(ef."Destination IP" as varchar) = enc.v""")
def d3_target_encoding(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, "Destination IP", "Label")
    enc = P.fit_encoder(df, ["Destination IP"], "target", target="Label")
    return enc.apply(df).select(KEY, "`Destination IP`")


@register("d4_binary_encoding", f"""with {EF}, c as (select flow_id, dense_rank() over (order by "Protocol") as code from ef)
select flow_id, cast((code >> 2) & 1 as bigint) as "Protocol_0", cast((code >> 1) & 1 as bigint) as "Protocol_1",
       cast(code & 1 as bigint) as "Protocol_2" from c""")
def d4_binary_encoding(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, "Protocol")
    return P.fit_encoder(df, ["Protocol"], "binary").apply(df)


_SC = ["Flow Duration", "Destination IP"]


@register("d6_standard_scale", f"""with {EF}
select flow_id, {', '.join(f"{r6(f'({qi(c)} - (select avg({qi(c)}) from ef)) / (select stddev_pop({qi(c)}) from ef)')} as {qi(c)}" for c in _SC)}
from ef""")
def d6_standard_scale(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, *[f"`{c}`" for c in _SC])
    return P.fit_scaler(df, _SC, "standard").apply(df)


@register("d7_minmax_scale", f"""with {EF}
select flow_id, {', '.join(f"{r6(f'({qi(c)} - (select min({qi(c)}) from ef)) / ((select max({qi(c)}) from ef) - (select min({qi(c)}) from ef))')} as {qi(c)}" for c in _SC)}
from ef""")
def d7_minmax_scale(spark, sf_dir):
    df = flows(spark, sf_dir).select(KEY, *[f"`{c}`" for c in _SC])
    return P.fit_scaler(df, _SC, "minmax").apply(df)


@register("d8_apply_stored_scaler", f"""with {EF}, {SPLIT_SQL},
st as (select avg("Flow Duration") as a, stddev_pop("Flow Duration") as s from sp where split = 'train')
select flow_id, split, {r6('("Flow Duration" - (select a from st)) / (select s from st)')} as "Flow Duration"
from sp where split = 'test'""")
def d8_apply_stored_scaler(spark, sf_dir):
    """Scaler fitted on the train split applied to test rows."""
    df = split_flows(spark, sf_dir).select(KEY, "split", "`Flow Duration`")
    sc = P.fit_scaler(df.where(F.col("split") == "train"), ["Flow Duration"], "standard")
    return sc.apply(df.where(F.col("split") == "test"))


@register("d5_apply_stored_encoder", f"""with {EF}, {SPLIT_SQL},
codes as (select "Protocol" as v, dense_rank() over (order by "Protocol") as code
          from (select distinct "Protocol" from sp where split = 'train'))
select flow_id, coalesce(cast(code as bigint), -1) as "Protocol" from sp left join codes on sp."Protocol" = codes.v
where split = 'test'""")
def d5_apply_stored_encoder(spark, sf_dir):
    df = split_flows(spark, sf_dir).select(KEY, "split", "Protocol")
    enc = P.fit_encoder(df.where(F.col("split") == "train"), ["Protocol"], "label")
    return enc.apply(df.where(F.col("split") == "test")).select(KEY, "Protocol")


# ---- E ------------------------------------------------------------------------------

@register("e1_hash_sample_n", f"""with {EF}
select flow_id from ef order by {H15.format(k='flow_id')}, flow_id limit 1000""")
def e1_hash_sample_n(spark, sf_dir):
    return S.sample_n(flows(spark, sf_dir), 1000, KEY).select(KEY)


@register("e2_fraction_sample", f"""with {EF} select flow_id from ef where {U32.format(k='flow_id')} < 0.1""")
def e2_fraction_sample(spark, sf_dir):
    return S.sample_fraction(flows(spark, sf_dir), 0.1, KEY).select(KEY)


@register("e3_exact_ratio_sample", f"""with {EF}
select flow_id from ef order by {H15.format(k='flow_id')}, flow_id
limit (select cast(floor(count(*) * 0.25) as bigint) from ef)""")
def e3_exact_ratio_sample(spark, sf_dir):
    return S.sample_ratio(flows(spark, sf_dir), 0.25, KEY).select(KEY)


@register("e4_sample_size", f"""with {EF}
select count(*) as row_count, least(count(*), 1000000) as sample_size,
       {r6('least(count(*), 1000000) / count(*)')} as sample_ratio from ef""")
def e4_sample_size(spark, sf_dir):
    return S.sample_size(flows(spark, sf_dir), 1_000_000)


@register("e5_stratified_split", f"with {EF}, {SPLIT_SQL} select flow_id, \"Label\", split from sp")
def e5_stratified_split(spark, sf_dir):
    return split_flows(spark, sf_dir).select(KEY, "Label", "split")


@register("e6_undersample", f"""with {EF},
r as (select flow_id, "Label", row_number() over (partition by "Label" order by {H15.format(k='flow_id')}, flow_id) as rn
      from ef)
select flow_id, "Label" from r where "Label" = 0 or rn <= (select cast(count(*) / 0.5 as bigint) from ef where "Label" = 0)""")
def e6_undersample(spark, sf_dir):
    return S.undersample(flows(spark, sf_dir).select(KEY, "Label"), "Label", KEY, 0.5)
