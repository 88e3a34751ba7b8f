"""Registered queries of voice and content measures over the waveforms view."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views
from .functions import signal, voice
from .queries import PAIR_SQL, WAVE_SQL, query, wave_pairs

FRAMES = f"fr as (select vec_id, label, samples, i, samples[i * 4 + 1 : i * 4 + 8] as f from (select *, unnest(range(0, 14)) as i from ({WAVE_SQL})))"
FRAMED = f"""{FRAMES}, fm as (select vec_id, i, list_dot_product(f, f) / 8 as e, len(list_filter(range(1, 8), lambda k: sign(f[k]) <> sign(f[k + 1]))) / 7.0 as z from fr)"""
PITCH = f"pt as (select vec_id, list_filter(list_transform(samples, lambda x: case when x > 0 then 1.0 / (80 + x * 400) end), lambda x: x is not null) as p from ({WAVE_SQL}))"


def _waves(spark, sf_dir):
    return views.waveforms(spark, sf_dir)


@query(f"select vec_id, i as frame, round(z, 6) as zcr from (with {FRAMED} select * from fm)")
def wave_frame_zcr(spark, sf_dir):
    w = _waves(spark, sf_dir).select("vec_id", F.posexplode(signal.frames(F.col("samples"), 8, 4, inclusive=False)).alias("frame", "f"))
    return w.select("vec_id", F.col("frame").cast("long"), F.round(voice.crossing_share(F.col("f")), 6).alias("zcr"))


JITTER = """select vec_id, case when n >= 4 then round(list_avg(list_transform(range(2, n + 1), lambda i: abs(p[i] - p[i - 1]))) / (m + 1e-14), 6) end as local,
case when n >= 5 then round(list_avg(list_transform(range(2, n), lambda i: abs(p[i] - (p[i - 1] + p[i] + p[i + 1]) / 3))) / (m + 1e-14), 6) end as three,
case when n >= 7 then round(list_avg(list_transform(range(3, n - 1), lambda i: abs(p[i] - (p[i - 2] + p[i - 1] + p[i] + p[i + 1] + p[i + 2]) / 5))) / (m + 1e-14), 6) end as five,
case when n >= 5 then round(list_avg(list_transform(range(3, n + 1), lambda i: abs(p[i] - 2 * p[i - 1] + p[i - 2]))) / (m + 1e-14), 6) end as second from (select vec_id, p, len(p) as n, list_avg(p) as m from pt)"""


@query(f"with {PITCH} {JITTER}")
def voice_jitter(spark, sf_dir):
    f0 = F.transform("samples", lambda x: F.when(x > 0, 80 + x * 400).otherwise(0.0))
    j = voice.jitter(F.col("f0"))
    return _waves(spark, sf_dir).select("vec_id", f0.alias("f0")).select("vec_id", F.round(j["local"], 6).alias("local"), F.round(j["rap"], 6).alias("three"), F.round(j["ppq5"], 6).alias("five"), F.round(j["ddp"], 6).alias("second"))


@query(f"with pt as (select vec_id, list_transform(samples, lambda x: abs(x) + 0.01) as p from ({WAVE_SQL})) {JITTER}")
def voice_shimmer(spark, sf_dir):
    s = voice.shimmer(F.col("a"))
    w = _waves(spark, sf_dir).select("vec_id", F.transform("samples", lambda x: F.abs(x) + 0.01).alias("a"))
    return w.select("vec_id", F.round(s["local"], 6).alias("local"), F.round(s["apq3"], 6).alias("three"), F.round(s["apq5"], 6).alias("five"), F.round(s["dda"], 6).alias("second"))


@query(f"select vec_id, round(count(*) filter (where e > 0.0001 and round(z, 9) < 0.58)::double / nullif(count(*) filter (where e > 0.0001), 0), 6) as ratio from (with {FRAMED} select * from fm) group by vec_id")
def voiced_ratio(spark, sf_dir):
    return _waves(spark, sf_dir).select("vec_id", F.round(voice.voiced_ratio(F.col("samples"), 8, 4, crossing=0.58), 6).alias("ratio"))


@query(
    f"""with b as (select vec_id, i, list_dot_product(samples[i * 4 + 1 : i * 4 + 8], samples[i * 4 + 1 : i * 4 + 8]) / 8 as e from (select *, unnest(range(0, 15)) as i from ({WAVE_SQL}))),
    g as (select vec_id, greatest(quantile_cont(10 * log10(e), 0.3), -50) as gate from b where e > 0 group by vec_id), a as (select b.*, e > 0 and 10 * log10(e) > gate as act from b join g using (vec_id)),
    w as (select vec_id, e, bool_or(act) over (partition by vec_id order by i rows between 1 preceding and 1 following) as wide from a)
    select vec_id, round(10 * log10(avg(e) filter (where wide)), 4) as level from w group by vec_id"""
)
def active_level(spark, sf_dir):
    return _waves(spark, sf_dir).select("vec_id", F.round(voice.active_level(F.col("samples"), 8, 4, 3), 4).alias("level"))


@query(
    f"""select vec_id, case when sqrt(list_dot_product(samples, samples) / 64) < 0.001 then 0.0 else round(least(1.0, 2 * loud), 6) end::double as silence,
    round(0.6 * least(2 * vo, 1) + 0.4 * least(3 * un, 1), 6)::double as crossing, round(fraction, 6) as fraction from (select vec_id, any_value(samples) as samples, avg(case when e > 0.000025 then 1.0 else 0 end) as loud, avg(case when z > 0.01 and z < 0.1 then 1.0 else 0 end) as vo,
    avg(case when z > 0.15 and z < 0.45 then 1.0 else 0 end) as un, avg(case when e > 0.0001 and z < 0.15 then 1.0 else 0 end) as fraction from (with {FRAMED} select fm.*, samples from fm join fr using (vec_id, i)) group by vec_id)"""
)
def content_cues(spark, sf_dir):
    x = F.col("samples")
    return _waves(spark, sf_dir).select("vec_id", F.round(voice.silence_score(x, 8, 4), 6).alias("silence"), F.round(voice.crossing_cue(x, 8, 4), 6).alias("crossing"), F.round(voice.speech_fraction(x, 8, 4), 6).alias("fraction"))


@query(f"select vec_id, round(least(1.0, coalesce(max(n), 0) * 100 / 300.0), 6)::double as continuity from (select vec_id, g, count(*) filter (where v) as n from (select *, i - row_number() over (partition by vec_id, v order by i) as g from (select vec_id, i, e > 0.0001 and z < 0.12 as v from (with {FRAMED} select * from fm))) group by vec_id, v, g) group by vec_id")
def voicing_continuity(spark, sf_dir):
    return _waves(spark, sf_dir).select("vec_id", F.round(voice.continuity_cue(F.col("samples"), 8, 4, 100.0), 6).alias("continuity"))


@query(
    """select file, tie, round(c, 6) as confidence, case when c >= 0.45 then 'speech' when nm < 0.4 and c < 0.35 then 'music' when s < 0.4 then 'silence' when c < 0.25 then 'noise' else 'mixed' end as content from (select *, round((1.5 * a + 2.5 * b + 1.5 * a + 1.5 * b + 1.0 * a + 2.0 * b + 1.0 * nm) / 11, 9) as c
    from (select file, tie, snr / 50 as a, clip * 60 as b, peak / 10 + 0.5 as nm, duration_s as s from results))""",
    "results",
)
def content_vote(spark, sf_dir):
    a, b, nm = F.col("snr") / 50, F.col("clip") * 60, F.col("peak") / 10 + 0.5
    cues = dict(zip(voice.CUE_WEIGHTS, (a, b, a, b, a, b, nm), strict=True))
    r = views.results(spark, sf_dir).withColumn("c", F.round(voice.confidence(cues), 9))
    return r.select("file", "tie", F.round("c", 6).alias("confidence"), voice.content_type(F.col("c"), nm, F.col("duration_s")).alias("content"))


@query(f"""with {FRAMES.replace("fr as", "unused as")}, q as (select vec_id, 100.0 + 37 * k as hz, abs(samples[k]) as amp, k from (select *, unnest(range(1, 9)) as k from ({WAVE_SQL}))), pr as (select a.vec_id, a.hz as l, b.hz as h, a.amp as la, b.amp as ha from q a join q b on a.vec_id = b.vec_id and a.k < b.k)
    select vec_id, round(sum(case when x > 0 then pow(la * ha, 0.1) * pow(2 * la * ha / (la * la + ha * ha + 1e-14), 3.11) * x * x * exp(-pow(x / 0.25, 2)) else 0 end), 5) as roughness, round(sum(la * ha * (exp(-3.5 * s * (h - l)) - exp(-5.75 * s * (h - l)))), 5) as dissonance
    from (select *, (h - l) / (25.0 + 75.0 * pow(1 + 1.4 * pow(l / 1000, 2), 0.69) + 1e-14) as x, 0.24 / (0.0207 * l + 18.96) as s from pr) group by vec_id""")
def partial_roughness(spark, sf_dir):
    w = _waves(spark, sf_dir).select("vec_id", F.posexplode(F.slice("samples", 1, 8)).alias("k", "v")).select("vec_id", "k", (137.0 + 37 * F.col("k")).alias("hz"), F.abs("v").alias("amp"))
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.vec_id") == F.col("b.vec_id")) & (F.col("a.k") < F.col("b.k")))
    args = (F.col("a.hz"), F.col("b.hz"), F.col("a.amp"), F.col("b.amp"))
    return pairs.groupBy("a.vec_id").agg(F.round(F.sum(voice.roughness(*args)), 5).alias("roughness"), F.round(F.sum(voice.dissonance(*args)), 5).alias("dissonance"))


SCALES = "select {0}, round(26.81 * {1} / (1960.0 + {1}) - 0.53, 6) as bark, round(2595 * log10(1 + {1} / 700.0), 5) as mel, round(case when {1} >= 1000 then 15 + ln({1} / 1000.0) / (ln(6.4) / 27) else {1} * 3 / 200.0 end, 6)::double as slaney, round(25 + 75 * pow(1 + 1.4 * pow({1} / 1000.0, 2), 0.69), 5) as width from part"


@query(SCALES.format("p_partkey", "p_retailprice::double"))
def frequency_scales(spark, sf_dir):
    hz = F.col("p_retailprice").cast("double")
    return views.table(spark, sf_dir, "part").select("p_partkey", F.round(voice.bark(hz), 6).alias("bark"), F.round(voice.mel(hz), 5).alias("mel"), F.round(voice.mel(hz, slaney=True), 6).alias("slaney"), F.round(voice.critical_bandwidth(hz), 5).alias("width"))


DELTA_SQL = " union all ".join(f"select file, tie, '{n}' as platform, round(lufs - ({t}), 2) as delta, case when abs(round(lufs - ({t}), 2)) > {w} then printf('%.1f', abs(round(lufs - ({t}), 2))) || case when lufs > {t} then ' LU above ' else ' LU below ' end || '{n} target' end as warning from results" for n, t, w in voice.LOUDNESS_TARGETS)


@query(DELTA_SQL, "results")
def loudness_deltas(spark, sf_dir):
    return views.results(spark, sf_dir).select("file", "tie", F.inline(voice.loudness_deltas(F.col("lufs"))))


@query("select file, tie, round(least(5, greatest(1, 0.75 * mos + 0.25 * coalesce(p, 3.0) / 4.5 * 5)), 2)::double as utmos, round(least(5, greatest(1, 0.6 * mos + 0.4 * coalesce(p, 3.0) / 4.5 * 5)), 2)::double as sheet, round(least(4.5, greatest(1, 4.5 - snr / 5)), 3)::double as pesq, round(least(1, greatest(0, (21 - snr) / 8)), 6)::double as breath from (select *, case when segment_index > 2 then snr / 12 end as p from results)", "results")
def blended_scores(spark, sf_dir):
    m = voice.blended_mos(F.col("mos"), F.when(F.col("segment_index") > 2, F.col("snr") / 12))
    return views.results(spark, sf_dir).select("file", "tie", m["utmos"].alias("utmos"), m["sheet"].alias("sheet"), voice.pesq_proxy(F.col("snr")).alias("pesq"), F.round(voice.breathiness(F.col("snr")), 6).alias("breath"))


@query(f"with {PAIR_SQL}, n as (select vec_id, samples, list_transform(range(1, 65), lambda i: other[i] - samples[i]) as d from pairs) select vec_id, round(10 * log10((list_dot_product(samples, samples) + 2.220446049250313e-16) / (list_dot_product(d, d) + 2.220446049250313e-16)), 4) as sdr from n")
def wave_sdr(spark, sf_dir):
    return wave_pairs(spark, sf_dir).select("vec_id", F.round(signal.sdr(F.col("samples"), F.col("other")), 4).alias("sdr"))
