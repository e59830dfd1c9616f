"""Trajectories, selection funnels, features and evidence-conditioned maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.ordered import PIECE, previous, with_piece
from evigrid.functions.quantiles import exact_quantiles
from evigrid.functions.scalars import micros, unit_interval_hash
from evigrid.operators import conditioning, pairing, ranking, rollup, trajectory
from evigrid.plans.bindings import DAY, ELIGIBILITY, POINTS, eligibility, points, table
from evigrid.plans.registry import query
from evigrid.session import materialise

O = "(greatest(1, n // 2) - 1)"  # noqa: E741 - origin index in SQL
ORIGINS = f"""{POINTS},
origins as (select segment_id, max(n) as n, {", ".join(f"max({s}) filter (where idx = {O} + ({o})) as {c}{t}" for o, t in ((-2, "_2"), (-1, "_1"), (0, "0"), (1, "1")) for c, s in (("x", "x"), ("y", "y"), ("t", "t_us")))}
            from points where n >= 4 group by segment_id)"""
VELOCITY = f"""{ORIGINS},
velocity as (select *, case when t_2 < t_1 and t_1 < t0 then (x0 - x_2) / ((t0 - t_2) / 1e6) end as vx,
             case when t_2 < t_1 and t_1 < t0 then (y0 - y_2) / ((t0 - t_2) / 1e6) end as vy from origins)"""
TRANSITIONS = f"""{ORIGINS}, fut as (select segment_id, x1 - x0 as dx, y1 - y0 as dy, (t1 - t0) / 1e6 as dt from origins)"""


@query("win6_segment_split", f"with {POINTS} select segment_id, event_id, idx, n, x, y from points")
def win6_segment_split(spark, sf):
    return points(spark, sf).select("segment_id", "event_id", "idx", "n", "x", "y")


@query(
    "win7_midpoint_window",
    f"with {POINTS} select segment_id, idx, case when idx <= {O} then 'history' else 'target' end as role from points where n >= 4",
)
def win7_midpoint_window(spark, sf):
    return trajectory.midpoint_window(points(spark, sf)).select("segment_id", "idx", "role")


@query("win8_secant_velocity", f"with {VELOCITY} select segment_id, round(vx, 10) as vx, round(vy, 10) as vy from velocity")
def win8_secant_velocity(spark, sf):
    v = trajectory.secant_velocity(trajectory.origin_states(points(spark, sf)))
    return v.select("segment_id", F.round("vx", 10).alias("vx"), F.round("vy", 10).alias("vy"))


@query("win9_first_transition", f"with {TRANSITIONS} select segment_id, round(dx, 6) as dx, round(dy, 6) as dy, dt from fut")
def win9_first_transition(spark, sf):
    f = trajectory.first_transition(trajectory.origin_states(points(spark, sf)))
    return f.select("segment_id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "dt")


U = "cast('0x' || substr(sha256('split-v1:' || {}), 1, 15) as bigint) / 1152921504606846976.0::double"


@query(
    "win10_hash_split",
    f"""with u as (select user_id, {U.format("user_id")} as u, count(*) as rows from events group by user_id)
    select user_id, rows, round(u, 12) as u, case when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'final_eval' end as split from u""",
)
def win10_hash_split(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    out = ranking.hash_split(per, "user_id", "split-v1:", [("train", 0.7), ("validation", 0.85)], "final_eval")
    return out.withColumn("u", F.round("u", 12))


@query(
    "win11_rank_fraction_split",
    """with h as (select source, doc_id, row_number() over (partition by source order by sha256('adapt-v1:' || doc_id), doc_id) as rank, count(*) over (partition by source) as size from documents)
    select source, doc_id, rank, size, case when rank <= round_even(0.8 * size, 0) then 'train' else 'validation' end as role from h""",
)
def win11_rank_fraction_split(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return ranking.rank_fraction_split(d, ["source"], "doc_id", "adapt-v1:", 0.8)


@query(
    "win12_heading_thirds",
    f"""with {TRANSITIONS}, h as (select segment_id, round(atan2(dy, dx), 9) as heading from fut where dx <> 0 or dy <> 0),
    r as (select *, row_number() over (order by heading, segment_id) - 1 as rank, count(*) over () as size from h)
    select segment_id, heading, rank, least(2, floor(3.0 * rank / size))::bigint as band from r""",
)
def win12_heading_thirds(spark, sf):
    f = trajectory.first_transition(trajectory.origin_states(points(spark, sf)))
    h = f.where((F.col("dx") != 0) | (F.col("dy") != 0)).select("segment_id", F.round(F.atan2("dy", "dx"), 9).alias("heading"))
    return ranking.rank_bands(h, [], "heading", "segment_id", 3).drop("size")


FLAGS = f"""fl as (select user_id, event_id, epoch_us(ts) as t_us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by event_id) as step from events),
flags as (select user_id, event_id, coalesce(step = 0, false) as duplicate, coalesce(step < 0, false) as backward, coalesce(step > {DAY * 1000000}, false) as long_gap from fl)"""


def flags(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", micros("ts").alias("t_us"))
    cut = with_piece(e, "event_id")
    return trajectory.clock_flags(cut, "user_id", [F.col("event_id")], F.col(PIECE), "t_us", DAY * 1000000).drop(PIECE)


@query("win14_clock_flags", f"with {FLAGS} select * from flags")
def win14_clock_flags(spark, sf):
    return flags(spark, sf).select("user_id", "event_id", "duplicate", "backward", "long_gap")


@query(
    "agg39_clock_anomalies",
    f"""with {FLAGS} select count(*) as points, count(*) filter (where duplicate) as duplicates, count(*) filter (where backward) as backwards,
        count(*) filter (where long_gap) as long_gaps, count(distinct user_id) filter (where long_gap) as tracks_with_long_gap from flags""",
)
def agg39_clock_anomalies(spark, sf):
    per = flags(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("duplicate").alias("d"), F.count_if("backward").alias("b"), F.count_if("long_gap").alias("g")
    )
    return per.agg(
        F.sum("points").alias("points"), F.sum("d").alias("duplicates"), F.sum("b").alias("backwards"), F.sum("g").alias("long_gaps"),
        F.count_if(F.col("g") > 0).alias("tracks_with_long_gap"),
    )


@query(
    "win15_mass_order",
    """with m as (select l_returnflag, l_suppkey, sum(l_quantity) as mass from lineitem group by all),
    c as (select *, row_number() over w as rank, sum(mass) over w as cumulative, sum(mass) over (partition by l_returnflag) as cumulative_total
          from m window w as (partition by l_returnflag order by mass desc, l_suppkey rows unbounded preceding))
    select *, cumulative - mass < 0.5 * cumulative_total as needed from (select l_returnflag, l_suppkey, mass, rank, cumulative,
           (select sum(mass) from m z where z.l_returnflag = c.l_returnflag) as cumulative_total from c)""",
)
def win15_mass_order(spark, sf):
    m = materialise(table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("mass")))
    return ranking.mass_order(m, ["l_returnflag"], "mass", ["l_suppkey"], 0.5)


# --- selection funnel -------------------------------------------------------------------------------------------

STAGE_SQL = "len(list_filter(reasons, lambda x: x like 'metadata%')) = 0"
TEMPORAL_SQL = "len(list_filter(reasons, lambda x: x like 'temporal%' or x like 'metadata%')) = 0"


@query(
    "agg21_selection_funnel",
    f"""with {ELIGIBILITY}, p as (select block_id, min(sample_id) as sample_id from eligibility where len(reasons) = 0 group by block_id order by sha256('order-v1' || block_id), block_id limit 12),
    s as (select e.block_id, true as released, {STAGE_SQL} as metadata_complete, {TEMPORAL_SQL} as temporal_support, len(reasons) = 0 as joint_validity,
          len(reasons) = 0 and p.sample_id is not null as selected_primary from eligibility e left join p on p.block_id = e.block_id and p.sample_id = e.sample_id),
    l as (select block_id, unnest(['released', 'metadata_complete', 'temporal_support', 'joint_validity', 'selected_primary']) as stage,
          unnest([released, metadata_complete, temporal_support, joint_validity, selected_primary]) as ok from s)
    select stage, count(*) filter (where ok) as windows, count(distinct block_id) filter (where ok) as blocks from l group by stage""",
)
def agg21_selection_funnel(spark, sf):
    def none_of(*names):
        return ~F.arrays_overlap("reasons", F.array(*[F.lit(n) for n in names]))

    stages = {
        "released": F.lit(True), "metadata_complete": none_of("metadata-short"),
        "temporal_support": none_of("metadata-short", "temporal-lang"),
        "joint_validity": none_of("metadata-short", "temporal-lang", "coverage-len"),
        "selected_primary": F.col("selected"),
    }
    windows = eligibility(spark, sf)
    # the outcome-blind choice: twelve rows at most, one window of each chosen block
    chosen = ranking.hash_ordered_selection(windows.where(F.size("reasons") == 0), "block_id", "sample_id", "order-v1", 12, 4)
    picked = F.broadcast(chosen.select("block_id", "sample_id", F.lit(True).alias("__chosen")))
    marked = windows.join(picked, ["block_id", "sample_id"], "left").withColumn(
        "selected", (F.size("reasons") == 0) & F.coalesce("__chosen", F.lit(False))
    )
    return rollup.stage_counts(marked, stages, "block_id")


@query(
    "agg22_reason_counts",
    f"""with {ELIGIBILITY} select 'first' as kind, reasons[1] as reason, count(*) as n from eligibility where len(reasons) > 0 group by all
    union all select 'overlapping', unnest(reasons) as r, count(*) from eligibility group by r
    union all select 'exclusive', case when list_contains(reasons, 'metadata-short') then 'metadata' when list_contains(reasons, 'temporal-lang') then 'temporal' else 'coverage_after_temporal' end as r, count(*)
    from eligibility where len(reasons) > 0 group by r""",
)
def agg22_reason_counts(spark, sf):
    """All three counts from one pass: each row emits its first, overlapping and exclusive reason."""
    r = F.col("reasons")
    exclusive = (
        F.when(F.array_contains(r, "metadata-short"), "metadata").when(F.array_contains(r, "temporal-lang"), "temporal")
        .otherwise("coverage_after_temporal")
    )
    tags = F.concat(
        F.array(F.struct(F.lit("first").alias("kind"), F.get(r, F.lit(0)).alias("reason"))),
        F.transform(r, lambda x: F.struct(F.lit("overlapping").alias("kind"), x.alias("reason"))),
        F.array(F.struct(F.lit("exclusive").alias("kind"), exclusive.alias("reason"))),
    )
    return eligibility(spark, sf).where(F.size(r) > 0).select(F.inline(tags)).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("trj6_eligibility_reasons", f"with {ELIGIBILITY} select sample_id, block_id, array_to_string(reasons, ';') as reasons from eligibility")
def trj6_eligibility_reasons(spark, sf):
    return eligibility(spark, sf).select("sample_id", "block_id", F.array_join("reasons", ";").alias("reasons"))


# --- windows ----------------------------------------------------------------------------------------------------

SPANS = f"""{POINTS}, e as (select segment_id, max(t_us) filter (where idx = 0) as a, max(t_us) filter (where idx = {O}) as o, max(t_us) filter (where idx = n - 1) as z from points where n >= 4 group by segment_id),
spans as (select segment_id, unnest(['visible', 'followup', 'whole']) as part, unnest([(o - a) / 1e6, (z - o) / 1e6, (z - a) / 1e6]) as seconds from e)"""


@query(
    "agg36_window_spans",
    f"""with {SPANS} select part, count(*) as windows, count(*) filter (where seconds >= 1800) as long_enough, round(min(seconds), 6) as minimum, round(quantile_cont(seconds, 0.25), 6) as q1,
        round(quantile_cont(seconds, 0.5), 6) as median, round(quantile_cont(seconds, 0.75), 6) as q3, round(max(seconds), 6) as maximum from spans group by part""",
)
def agg36_window_spans(spark, sf):
    spans = trajectory.window_spans(points(spark, sf))
    counts = spans.groupBy("part").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("seconds") >= 1800).alias("long_enough"))
    five = rollup.five_numbers(spans, ["part"], "seconds")
    return counts.join(five, "part").select(
        "part", "windows", "long_enough", *[F.round(c, 6).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")]
    )


@query(
    "agg37_window_speed",
    f"""with {POINTS}, m as (select segment_id, median(speed) as v from points group by segment_id)
    select count(*) as windows, round(min(v), 8) as minimum, round(quantile_cont(v, 0.25), 8) as q1, round(quantile_cont(v, 0.5), 8) as median, round(quantile_cont(v, 0.75), 8) as q3, round(max(v), 8) as maximum from m""",
)
def agg37_window_speed(spark, sf):
    """Median speed per window, then quartiles in which every window counts once."""
    med = exact_quantiles(points(spark, sf), ["segment_id"], "speed", {"v": 0.5}).withColumn("all", F.lit("all"))
    med = materialise(med)
    five = rollup.five_numbers(med, ["all"], "v")
    return five.withColumn("windows", med.agg(F.count(F.lit(1))).scalar()).select("windows", *[F.round(c, 8).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")])


@query(
    "agg38_prefix_spans",
    f"""with {ORIGINS}, s as (select (t0 - t_2) / 1e6 as span, (t0 - t_1) / 1e6 as last_gap from origins where t_2 is not null)
    select count(*) as windows, round(min(span), 6) as span_min, round(median(span), 6) as span_median, round(max(span), 6) as span_max, round(avg(span), 4) as span_mean,
           round(min(last_gap), 6) as gap_min, round(max(last_gap), 6) as gap_max, round(avg(last_gap), 4) as gap_mean from s""",
)
def agg38_prefix_spans(spark, sf):
    o = trajectory.origin_states(points(spark, sf)).where(F.col("t_2").isNotNull())
    s = o.select(
        ((F.col("t0") - F.col("t_2")) / 1e6).alias("span"), ((F.col("t0") - F.col("t_1")) / 1e6).alias("gap"), F.lit(1).alias("one")
    )
    stats = s.groupBy("one").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.min("span"), 6).alias("span_min"), F.round(F.max("span"), 6).alias("span_max"),
        F.round(F.avg("span"), 4).alias("span_mean"), F.round(F.min("gap"), 6).alias("gap_min"), F.round(F.max("gap"), 6).alias("gap_max"),
        F.round(F.avg("gap"), 4).alias("gap_mean"),
    )
    med = exact_quantiles(s, ["one"], "span", {"span_median": 0.5}).select(F.round("span_median", 6))
    return stats.withColumn("span_median", med.scalar()).drop("one")


@query(
    "agg40_task_sizes",
    """with t as (select l_orderkey, count(*) as size from lineitem group by l_orderkey) select size, count(*) as groups, size >= 3 as eligible from t group by size""",
)
def agg40_task_sizes(spark, sf):
    return rollup.histogram(table(spark, sf, "lineitem"), ["l_orderkey"]).withColumn("eligible", F.col("size") >= 3)


# --- joins over time and identity -------------------------------------------------------------------------------

@query(
    "jon23_interval_overlaps",
    """with a as (select event_id, epoch_us(ts) as a0, epoch_us(ts) + cast(round(value * 1000000) as bigint) as a1 from events where event_type = 'view'),
    b as (select epoch_us(ts) as b0, epoch_us(ts) + 3600000000 as b1 from events where event_type = 'error')
    select event_id, count(b0) as overlaps from a left join b on a0 < b1 and b0 < a1 group by event_id""",
)
def jon23_interval_overlaps(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", micros("ts").alias("t"), "value")
    spans = e.where(F.col("event_type") == "view").select(
        "event_id", F.col("t").alias("a0"), (F.col("t") + F.round(F.col("value") * 1000000).cast("bigint")).alias("a1")
    )
    sleeps = e.where(F.col("event_type") == "error").select(F.col("t").alias("b0"), (F.col("t") + 3600000000).alias("b1"))
    return pairing.overlap_counts(spans, sleeps, "event_id", ("a0", "a1"), ("b0", "b1"))


@query(
    "jon24_split_leakage",
    f"""with s as (select case when {U.format("doc_id")} < 0.7 then 'train' when {U.format("doc_id")} < 0.85 then 'validation' else 'final_eval' end as split, source, md5(text) as body from documents),
    i as (select distinct split, 'file' as kind, body as id from s union select distinct split, 'block', source from s)
    select a.kind, a.split as split_a, b.split as split_b, count(*) as shared from i a join i b on a.kind = b.kind and a.id = b.id and a.split < b.split group by all""",
)
def jon24_split_leakage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("body"))
    split = ranking.hash_split(d, "doc_id", "split-v1:", [("train", 0.7), ("validation", 0.85)], "final_eval")
    return pairing.split_leakage(split, "split", {"file": "body", "block": "source"})


@query(
    "jon25_equal_sequences",
    """with g as (select md5(text) as f, lang, count(*) as n from documents group by all),
    p as (select f, sum(n)::bigint as a, sum(n * (n - 1) // 2)::bigint as w from g group by f)
    select count(*) filter (where a > 1) as repeated_sequences, sum(w)::bigint as pairs_within, sum(a * (a - 1) // 2 - w)::bigint as pairs_across from p""",
)
def jon25_equal_sequences(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("fingerprint"))
    return pairing.equal_pair_counts(d, "lang")


PRINT = "cast('0x' || substr(md5(concat_ws(':', turn, role || '/' || text)), {}, 12) as bigint)"


@query(
    "trj4_sequence_fingerprint",
    f"""select conv_id, concat_ws('-', count(*), sum({PRINT.format(1)}), sum({PRINT.format(13)})) as fingerprint from conversations group by conv_id""",
)
def trj4_sequence_fingerprint(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("content", F.concat("role", F.lit("/"), "text"))
    return turns.groupBy("conv_id").agg(sequence_fingerprint(element_digest("turn", "content")).alias("fingerprint"))


@query(
    "trj4_equal_tracks",
    """with s as (select l_orderkey, string_agg(l_linenumber || ':' || l_quantity, ',' order by l_linenumber, l_quantity) as f, min(l_linestatus) as role from lineitem group by l_orderkey),
    g as (select f, role, count(*) as n from s group by all), p as (select f, sum(n)::bigint as a, sum(n * (n - 1) // 2)::bigint as w from g group by f)
    select count(*) filter (where a > 1) as repeated_sequences, sum(w)::bigint as pairs_within, sum(a * (a - 1) // 2 - w)::bigint as pairs_across from p""",
)
def trj4_equal_tracks(spark, sf):
    """Whole-sequence fingerprints of numeric tracks and the pairs of equal ones within and across roles."""
    li = table(spark, sf, "lineitem")
    roles = li.groupBy("l_orderkey").agg(F.min("l_linestatus").alias("role"))
    tracks = trajectory.track_fingerprints(li, ["l_orderkey"], "l_linenumber", ["l_quantity"]).join(roles, "l_orderkey")
    return pairing.equal_pair_counts(tracks, "role")


@query(
    "trj3_recording_block",
    "select doc_id, sha256(text || chr(0) || source || chr(0)) as block from documents",
)
def trj3_recording_block(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trajectory.recording_block("text", "source").alias("block"))


@query(
    "trj5_index_alignment",
    f"""with {POINTS} select segment_id, idx, case when speed < 0.5 then 'missing' when abs(x - (x + (idx % 5) * 1e-3)) <= 2.5e-3 then 'aligned' else 'moved' end as state from points""",
)
def trj5_index_alignment(spark, sf):
    """Release and source points by the same index: no nearest fallback, a tolerance on the coordinate."""
    released = points(spark, sf)
    source = released.where(F.col("speed") >= 0.5).select(
        "segment_id", "idx", (F.col("x") + (F.col("idx") % 5) * 1e-3).alias("sx")
    )
    state = F.when(F.col("sx").isNull(), "missing").when(F.abs(F.col("x") - F.col("sx")) <= 2.5e-3, "aligned").otherwise("moved")
    return released.select("segment_id", "idx", "x").join(source, ["segment_id", "idx"], "left").select("segment_id", "idx", state.alias("state"))


# --- frames and features ----------------------------------------------------------------------------------------

LONLAT = f"{POINTS}, geo as (select segment_id, idx, 2 + x / 100000 as lon, 45 + y / 100000 as lat from points)"


@query(
    "trj1_local_projection",
    f"""with {LONLAT}, c as (select segment_id, avg(lon) as lon0, avg(lat) as lat0 from geo group by segment_id)
    select segment_id, idx, round(6371000.0 * radians(lon - lon0) * cos(radians(lat0)), 4) as east, round(6371000.0 * radians(lat - lat0), 4) as north from geo join c using (segment_id)""",
)
def trj1_local_projection(spark, sf):
    geo = points(spark, sf).select("segment_id", "idx", (2 + F.col("x") / 100000).alias("lon"), (45 + F.col("y") / 100000).alias("lat"))
    out = trajectory.local_projection(geo, ["segment_id"], "lon", "lat")
    return out.select("segment_id", "idx", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))


@query(
    "trj2_origin_frame",
    f"""with {POINTS}, o as (select segment_id, x as x0, y as y0, t_us as t0 from points where n >= 4 and idx = {O})
    select segment_id, idx, round(x - x0, 6) as rx, round(y - y0, 6) as ry, (t_us - t0) / 1e6 as rt from points join o using (segment_id)""",
)
def trj2_origin_frame(spark, sf):
    return trajectory.origin_frame(points(spark, sf)).select("segment_id", "idx", F.round("rx", 6).alias("rx"), F.round("ry", 6).alias("ry"), "rt")


RESAMPLED = f"""{POINTS}, fb as (select segment_id, t_us // 43200000000 as bucket, arg_min(x, idx) as x, arg_min(y, idx) as y, arg_min(t_us, idx) as t from points group by all),
moves as (select segment_id, bucket, x - lag(x) over w as dx, y - lag(y) over w as dy, (t - lag(t) over w) / 1e6 as dt from fb window w as (partition by segment_id order by bucket)),
rs as (select segment_id, bucket, round(dx, 6) as dx, round(dy, 6) as dy, dt from moves where dt is not null)"""


def resampled(spark, sf):
    out = trajectory.resampled_transitions(points(spark, sf), 43200000000)
    return out.withColumn("dx", F.round("dx", 6)).withColumn("dy", F.round("dy", 6))


@query("trj7_resampled_transitions", f"with {RESAMPLED} select * from rs")
def trj7_resampled_transitions(spark, sf):
    return resampled(spark, sf)


@query(
    "trj8_scalar_transforms",
    f"""with {RESAMPLED}, d as (select *, sqrt(dx * dx + dy * dy) as d from rs)
    select segment_id, bucket, round(ln(1 + d), 8) as log_distance, round(dx / nullif(d, 0), 8) as ux, round(dy / nullif(d, 0), 8) as uy from d""",
)
def trj8_scalar_transforms(spark, sf):
    d = resampled(spark, sf).withColumn("d", F.hypot("dx", "dy"))
    return d.select(
        "segment_id", "bucket", F.round(F.log1p("d"), 8).alias("log_distance"), F.round(trajectory.unit("dx", "d"), 8).alias("ux"),
        F.round(trajectory.unit("dy", "d"), 8).alias("uy"),
    )


@query(
    "trj9_clipped_standardisation",
    f"""with {RESAMPLED}, u as (select *, {U.format("segment_id")} < 0.7 as train from rs),
    s as (select avg(dx) as mx, stddev_samp(dx) as sx, avg(dt) as mt, stddev_samp(dt) as st from u where train)
    select segment_id, bucket, round(greatest(-2.0, least(2.0, (dx - mx) / sx)), 8) as dx, round(greatest(-2.0, least(2.0, (dt - mt) / st)), 8) as dt from u, s""",
)
def trj9_clipped_standardisation(spark, sf):
    train = unit_interval_hash("split-v1:", "segment_id") < 0.7
    out = trajectory.clipped_standardisation(resampled(spark, sf), ["segment_id", "bucket"], ["dx", "dt"], train, 2.0)
    return out.withColumn("dx", F.round("dx", 8)).withColumn("dt", F.round("dt", 8))


@query(
    "trj10_visible_difference_rate",
    f"""with {POINTS}, l as (select segment_id, idx, n, speed - lag(speed) over w as dv, (t_us - lag(t_us) over w) / 1e6 as dt from points window w as (partition by segment_id order by idx))
    select segment_id, idx, round(dv / nullif(dt, 0), 10) as rate from l where n >= 4 and idx <= {O} and dt is not null""",
)
def trj10_visible_difference_rate(spark, sf):
    p = points(spark, sf).where((F.col("n") >= 4) & (F.col("idx") <= trajectory.origin_index()))
    linked = previous(p, ["segment_id"], [F.col("idx")], F.floor(F.col("idx") / 65536), {"pv": "speed", "pt": "t_us"})
    dt = (F.col("t_us") - F.col("pt")) / 1e6
    return linked.where(F.col("pt").isNotNull()).select(
        "segment_id", "idx", F.round((F.col("speed") - F.col("pv")) / F.nullif(dt, F.lit(0.0)), 10).alias("rate")
    )


@query(
    "trj11_relative_heading",
    f"""with {RESAMPLED}, d as (select *, dx / nullif(sqrt(dx * dx + dy * dy), 0) as ux, dy / nullif(sqrt(dx * dx + dy * dy), 0) as uy from rs),
    l as (select *, lag(ux) over w as px, lag(uy) over w as py from d window w as (partition by segment_id order by bucket))
    select segment_id, bucket, round(ux * px + uy * py, 8) as cosine, round(px * uy - py * ux, 8) as sine from l where px is not null""",
)
def trj11_relative_heading(spark, sf):
    d = resampled(spark, sf).withColumn("d", F.hypot("dx", "dy"))
    d = d.withColumn("ux", trajectory.unit("dx", "d")).withColumn("uy", trajectory.unit("dy", "d"))
    linked = previous(d, ["segment_id"], [F.col("bucket")], F.floor(F.col("bucket") / 64), {"px": "ux", "py": "uy"})
    return linked.where(F.col("px").isNotNull()).select(
        "segment_id", "bucket", F.round(F.col("ux") * F.col("px") + F.col("uy") * F.col("py"), 8).alias("cosine"),
        F.round(F.col("px") * F.col("uy") - F.col("py") * F.col("ux"), 8).alias("sine"),
    )


COVER = "cv as (select p_partkey, nullif(p_size // 5 * 10, 0) as code from part)"


def cover(spark, sf):
    code = (F.floor(F.col("p_size") / 5) * 10).cast("int")
    return table(spark, sf, "part").select("p_partkey", F.nullif(code, F.lit(0)).alias("code"))


@query(
    "trj12_cover_indicators",
    f"""with {COVER} select p_partkey, code, (code = 50)::int as built, (code in (10, 20, 30, 40, 95, 100))::int as vegetated, (code in (80, 90))::int as water,
        (code not in (50, 10, 20, 30, 40, 95, 100, 80, 90))::int as other from cv""",
)
def trj12_cover_indicators(spark, sf):
    return cover(spark, sf).select("p_partkey", "code", *[c.alias(n) for n, c in trajectory.cover_indicators("code").items()])


@query(
    "trj13_validity_masks",
    f"""with {VELOCITY} select segment_id, round(coalesce(vx, 0), 10) as vx, round(coalesce(vy, 0), 10) as vy, vx is not null as vx_valid, vy is not null as vy_valid from velocity""",
)
def trj13_validity_masks(spark, sf):
    v = trajectory.secant_velocity(trajectory.origin_states(points(spark, sf)))
    out = trajectory.with_masks(v, ["segment_id"], ["vx", "vy"])
    return out.withColumn("vx", F.round("vx", 10)).withColumn("vy", F.round("vy", 10))


@query(
    "trj14_compositions",
    """with b as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, ln(1 + l_quantity) as ld, cos(radians(l_discount * 3600)) as ux, sin(radians(l_discount * 3600)) as uy,
             l_tax * 100 as hx, 4 - l_tax * 100 as hy, case when l_linenumber <= 2 then 1 else 0 end as built from lineitem)
    select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(ld * ux, 8) as road_x, round(ld * uy, 8) as road_y, round(ld * built, 8) as cover, round(hx * ux + hy * uy, 8) as along, round(-hx * uy + hy * ux, 8) as across from b""",
)
def trj14_compositions(spark, sf):
    """Distance times direction, distance times cover, and history projected on a direction and its normal."""
    angle = F.radians(F.col("l_discount") * 3600)
    ld, ux, uy = F.log1p("l_quantity"), F.cos(angle), F.sin(angle)
    hx = F.col("l_tax") * 100
    hy = 4 - hx
    built = F.when(F.col("l_linenumber") <= 2, 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(ld * ux, 8).alias("road_x"), F.round(ld * uy, 8).alias("road_y"),
        F.round(ld * built, 8).alias("cover"), F.round(hx * ux + hy * uy, 8).alias("along"), F.round(-hx * uy + hy * ux, 8).alias("across"),
    )


FIT = """rows as (select l_returnflag as configuration, case when cast('0x' || substr(sha256('split-v1:' || l_suppkey), 1, 15) as bigint) / 1152921504606846976.0::double < 0.7 then 'train' else 'validation' end as role,
  l_quantity / 50 as a, l_discount * 10 as b, l_extendedprice / 10000 as y from lineitem),
g as (select configuration, count(*) as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as yb from rows where role = 'train' group by all),
th as (select configuration, n, ((bb + n * 0.001) * ay - ab * yb) / ((aa + n * 0.001) * (bb + n * 0.001) - ab * ab) as ta,
       ((aa + n * 0.001) * yb - ab * ay) / ((aa + n * 0.001) * (bb + n * 0.001) - ab * ab) as tb from g)"""


def fit_rows(spark, sf):
    role = F.when(unit_interval_hash("split-v1:", "l_suppkey") < 0.7, "train").otherwise("validation")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("configuration"), role.alias("role"), (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 10000).alias("y"),
    )


def fitted(spark, sf):
    train = fit_rows(spark, sf).where(F.col("role") == "train")
    return trajectory.ridge_fit(train, ["configuration"], ["a", "b"], ["y"], 0.001)


@query(
    "trj16_ridge_fit",
    f"""with {FIT} select configuration, n, feature, 'y' as target, round(theta, 8) as theta from (
        select configuration, n, unnest(['a', 'b']) as feature, unnest([ta, tb]) as theta from th)""",
)
def trj16_ridge_fit(spark, sf):
    return fitted(spark, sf).withColumn("theta", F.round("theta", 8))


@query(
    "trj15_fit_error",
    f"""with {FIT} select configuration, role, count(*) as rows, round(avg(pow(y - ta * a - tb * b, 2)), 8) as mse from rows join th using (configuration) group by all""",
)
def trj15_fit_error(spark, sf):
    # stored, so that the planner sees its size: else every row is shuffled to its configuration, of which there are few
    theta = materialise(
        fitted(spark, sf).groupBy("configuration").pivot("feature", ["a", "b"]).agg(F.max("theta")).select(
            "configuration", F.col("a").alias("ta"), F.col("b").alias("tb")
        )
    )
    joined = fit_rows(spark, sf).join(theta, "configuration")
    residual = F.col("y") - F.col("ta") * F.col("a") - F.col("tb") * F.col("b")
    return joined.groupBy("configuration", "role").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(residual * residual), 8).alias("mse"))


@query(
    "trj17_diffusion_moment",
    f"""with {RESAMPLED}, d as (select avg(dx / dt) as bx, avg(dy / dt) as cy from rs), e as (select dx - bx * dt as ex, dy - cy * dt as ey, dt from rs, d)
    select 'all' as fit, count(*) as n, round(avg(ex * ex / dt), 8) as qxx, round(avg(ex * ey / dt), 8) as qxy, round(avg(ey * ey / dt), 8) as qyy from e""",
)
def trj17_diffusion_moment(spark, sf):
    moves = materialise(resampled(spark, sf)).withColumn("fit", F.lit("all"))
    rate = [F.avg(F.col(c) / F.col("dt")).alias(n) for c, n in (("dx", "bx"), ("dy", "by"))]
    joined = moves.withColumn("b", moves.agg(F.struct(*rate).alias("b")).scalar()).select("*", "b.*")
    ex, ey = F.col("dx") - F.col("bx") * F.col("dt"), F.col("dy") - F.col("by") * F.col("dt")
    out = trajectory.diffusion_moment(joined, ["fit"], ex, ey, F.col("dt"))
    return out.select("fit", "n", *[F.round(c, 8).alias(c) for c in ("qxx", "qxy", "qyy")])


@query(
    "trj18_interval_bins",
    f"""with {TRANSITIONS}, b as (select case when dt > 0 and dt <= 3600 then '(0,3600]' when dt > 3600 and dt <= 21600 then '(3600,21600]' when dt > 21600 and dt <= 43200 then '(21600,43200]' when dt > 43200 and dt <= 86400 then '(43200,86400]' end as bin from fut)
    select bin, count(*) as transitions from b group by bin""",
)
def trj18_interval_bins(spark, sf):
    f = trajectory.first_transition(trajectory.origin_states(points(spark, sf)))
    return f.groupBy(trajectory.interval_bins(F.col("dt"), [0, 3600, 21600, 43200, 86400]).alias("bin")).agg(F.count(F.lit(1)).alias("transitions"))


@query(
    "ens15_constant_velocity",
    f"""with {VELOCITY} select segment_id, slot, round(x0 + u * vx, 6) as px, round(y0 + u * vy, 6) as py
        from velocity cross join (values (0, 450.0::double), (1, 900.0), (2, 1350.0), (3, 1800.0)) s(slot, u) where vx is not null""",
)
def ens15_constant_velocity(spark, sf):
    v = trajectory.secant_velocity(trajectory.origin_states(points(spark, sf)))
    out = trajectory.constant_velocity(v, [450, 900, 1350, 1800])
    return out.withColumn("px", F.round("px", 6)).withColumn("py", F.round("py", 6))


# --- evidence-conditioned maps ----------------------------------------------------------------------------------

PATHS = f"""{POINTS}, rel as (select *, (t_us - min(t_us) over (partition by segment_id)) / 1e6 as t_rel from points),
paths as (select segment_id, bool_or(x between 20 and 200 and y between -50 and 150 and t_rel between 3600 and 400000) as hit,
          min(t_rel) filter (where x between 20 and 200 and y between -50 and 150 and t_rel between 3600 and 400000) as first_hit,
          arg_max(x, idx) as end_x, arg_max(y, idx) as end_y, arg_max(x between 20 and 200 and y between -50 and 150, idx) as end_inside from rel group by segment_id),
sized as (select *, floor(end_x / 100)::bigint as cx, floor(end_y / 100)::bigint as cy, avg(hit::int) over () as prior, sum(hit::int) over () as h, count(*) over () as n from paths),
soft as (select *, 3.0 * prior / (3.0 * prior + 1 - prior) as posterior from sized),
weights as (select *, case when hit then posterior / h else (1 - posterior) / (n - h) end as weight from soft)"""


def paths(spark, sf):
    p = points(spark, sf)
    start = p.where(F.col("idx") == 0).select("segment_id", F.col("t_us").alias("__t0"))
    rel = p.join(start, "segment_id").withColumn("t_rel", (F.col("t_us") - F.col("__t0")) / 1e6)
    region = F.col("x").between(20, 200) & F.col("y").between(-50, 150)
    hits = conditioning.path_hits(rel, "segment_id", region, F.col("t_rel").between(3600, 400000), "t_rel", "x", "y", "idx")
    # one row per path: every map reads it for cells and for totals
    return materialise(hits)


@query("evd1_region_hits", f"with {PATHS} select segment_id, hit, first_hit, end_x, end_y, end_inside from paths")
def evd1_region_hits(spark, sf):
    return paths(spark, sf)


@query("evd2_exclusion_map", f"with {PATHS} select cx, cy, round(count(*) / any_value(n - h), 10) as mass from sized where not hit group by cx, cy")
def evd2_exclusion_map(spark, sf):
    kept = paths(spark, sf).where(~F.col("hit"))
    return conditioning.cell_mass(kept, 100, F.lit(1.0)).withColumn("mass", F.round("mass", 10))


@query(
    "evd3_terminal_control",
    f"""with {PATHS} select count(*) as paths, round(avg((not hit)::int), 10) as never_entered, round(avg((not end_inside)::int), 10) as not_inside_at_end,
        round(avg((hit and not end_inside)::int), 10) as shadow_mass from paths""",
)
def evd3_terminal_control(spark, sf):
    hit, end = F.col("hit"), F.col("end_inside")

    def share(c):
        return F.round(F.count_if(c) / F.count(F.lit(1)), 10)

    return paths(spark, sf).agg(
        F.count(F.lit(1)).alias("paths"), share(~hit).alias("never_entered"), share(~end).alias("not_inside_at_end"), share(hit & ~end).alias("shadow_mass")
    )


@query("evd4_presence_map", f"with {PATHS} select cx, cy, round(count(*) / any_value(h), 10) as mass from sized where hit group by cx, cy")
def evd4_presence_map(spark, sf):
    return conditioning.cell_mass(paths(spark, sf).where("hit"), 100, F.lit(1.0)).withColumn("mass", F.round("mass", 10))


@query("evd5_soft_weights", f"with {PATHS} select segment_id, hit, round(prior, 10) as prior, round(posterior, 10) as posterior, round(weight, 12) as weight from weights")
def evd5_soft_weights(spark, sf):
    return conditioning.class_weights(paths(spark, sf), 3.0).select(
        "segment_id", "hit", F.round("prior", 10).alias("prior"), F.round("posterior", 10).alias("posterior"), F.round("weight", 12).alias("weight")
    )


@query(
    "evd6_search_priority",
    f"""with {PATHS}, m as (select cx, cy, round(sum(weight), 10) as mass from weights group by cx, cy),
    r as (select *, row_number() over w as rank, sum(mass) over w as cum from m window w as (order by mass desc, cx, cy rows unbounded preceding))
    select cx, cy, mass, rank, round(cum, 10) as cumulative, cum - mass < 0.5 * (select sum(mass) from m) as needed from r""",
)
def evd6_search_priority(spark, sf):
    weighted = conditioning.class_weights(paths(spark, sf), 3.0)
    m = conditioning.cell_mass(weighted, 100, F.col("weight")).withColumn("mass", F.round("mass", 10))
    out = ranking.mass_order(m, [], "mass", ["cx", "cy"], 0.5)
    return out.select("cx", "cy", "mass", "rank", F.round("cumulative", 10).alias("cumulative"), "needed")


MAPS = f"""{PATHS}, p as (select cx, cy, count(*) / any_value(n) as mass from sized group by cx, cy), pe as (select cx, cy, count(*) / any_value(h) as mass from sized where hit group by cx, cy),
pc as (select cx, cy, count(*) / any_value(n - h) as mass from sized where not hit group by cx, cy)"""


@query(
    "evd7_total_variation",
    f"""with {MAPS} select round(0.5 * sum(abs(coalesce(p.mass, 0) - coalesce(pc.mass, 0))), 10) as distance from p full join pc using (cx, cy)""",
)
def evd7_total_variation(spark, sf):
    whole = paths(spark, sf)
    prior = conditioning.cell_mass(whole, 100, F.lit(1.0))
    excluded = conditioning.cell_mass(whole.where(~F.col("hit")), 100, F.lit(1.0))
    return conditioning.total_variation(prior, excluded).withColumn("distance", F.round("distance", 10))


@query(
    "evd8_mixture_identity",
    f"""with {MAPS} select count(*) as cells, round(sum(abs((select any_value(prior) from sized) * coalesce(pe.mass, 0) + (1 - (select any_value(prior) from sized)) * coalesce(pc.mass, 0) - p.mass)), 9) as l1
        from p left join pe using (cx, cy) left join pc using (cx, cy)""",
)
def evd8_mixture_identity(spark, sf):
    """Presence and absence maps, mixed by the prior, give back the prior map."""
    weighted = conditioning.class_weights(paths(spark, sf), 1.0)
    prior = conditioning.cell_mass(weighted, 100, F.lit(1.0)).withColumnRenamed("mass", "p")
    classes = conditioning.cell_mass(weighted, 100, F.lit(1.0), ["hit", "prior"])
    share = F.when(F.col("hit"), F.col("prior")).otherwise(1 - F.col("prior"))
    mixed = classes.groupBy("cx", "cy").agg(F.sum(share * F.col("mass")).alias("m"))
    return prior.join(mixed, ["cx", "cy"], "left").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum(F.abs(F.col("m") - F.col("p"))), 9).alias("l1")
    )


@query(
    "evd9_pattern_weights",
    f"""with {POINTS}, h as (select segment_id, bool_or(x > 50) as e0, bool_or(y > 50) as e1, bool_or(x < -50 and y < 0) as e2 from points group by segment_id),
    items as (select unnest([0, 1, 2]) as item, unnest([avg(e0::int), avg(e1::int), avg(e2::int)]) as prior, unnest([0.9, 0.8, 0.7])::double as l1, unnest([0.2, 0.3, 0.4])::double as l0 from h),
    b as (select p.pattern::integer as pattern, i.*, (p.pattern >> item) & 1 as bit from items i cross join (select unnest(range(8)) as pattern) p),
    w as (select pattern, sum(ln(case when bit = 1 then l1 * prior else l0 * (1 - prior) end)) as l, sum(case when bit = 1 then 0 else ln(l0 * (1 - prior)) - ln(l1 * prior) end) as r from b group by pattern)
    select pattern, round(exp(l) / sum(exp(l)) over (), 10) as weight, round(exp(r), 10) as ratio from w""",
)
def evd9_pattern_weights(spark, sf):
    hits = points(spark, sf).groupBy("segment_id").agg(
        F.bool_or(F.col("x") > 50).alias("e0"), F.bool_or(F.col("y") > 50).alias("e1"), F.bool_or((F.col("x") < -50) & (F.col("y") < 0)).alias("e2")
    )
    priors = hits.agg(*[(F.count_if(e) / F.count(F.lit(1))).alias(e) for e in ("e0", "e1", "e2")])
    rates = [(0.9, 0.2), (0.8, 0.3), (0.7, 0.4)]
    items = F.array(
        *[F.struct(F.lit(i).alias("item"), F.col(f"e{i}").alias("prior"), F.lit(a).alias("l1"), F.lit(b).alias("l0")) for i, (a, b) in enumerate(rates)]
    )
    out = conditioning.pattern_weights(priors.select(F.inline(items)), 3)
    return out.select("pattern", F.round("weight", 10).alias("weight"), F.round("ratio", 10).alias("ratio"))


