"""Driver tables -> canonical schemas. Each binding has the SQL common table expression which states the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.ordered import piece_width
from evigrid.functions.scalars import exact_part, micros, plain_part, seal
from evigrid.session import materialise

DAY = 86400
FORECAST_SIZE = 500
SLOTS = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- cells: one (arm, block, seed, horizon) execution -----------------------------------------------------------

CELLS = """cells as (
  select l_returnflag as arm_id, l_suppkey as block_id, l_linenumber as seed, l_linestatus as horizon,
         avg(l_extendedprice * (1 - l_discount)) as error, avg(l_quantity) as quantity,
         case when (l_suppkey * 31 + l_linenumber * 7 + ascii(l_returnflag)) % 41 = 0
              then 'FAILED' else 'SUCCEEDED' end as status,
         concat_ws('-', l_returnflag, l_suppkey, l_linenumber, l_linestatus) as attempt_id
  from lineitem group by l_returnflag, l_suppkey, l_linenumber, l_linestatus)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    failed = (F.col("block_id") * 31 + F.col("seed") * 7 + F.ascii("arm_id")) % 41 == 0
    return (
        li.groupBy(
            F.col("l_returnflag").alias("arm_id"),
            F.col("l_suppkey").alias("block_id"),
            F.col("l_linenumber").alias("seed"),
            F.col("l_linestatus").alias("horizon"),
        )
        .agg(
            F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("error"),
            F.avg("l_quantity").alias("quantity"),
        )
        .withColumn("status", F.when(failed, "FAILED").otherwise("SUCCEEDED"))
        .withColumn("attempt_id", F.concat_ws("-", "arm_id", "block_id", "seed", "horizon"))
    )


# --- attempts and cost events -----------------------------------------------------------------------------------

LEDGER = """ledger as (
  select event_id as attempt_id, user_id as cell_id, epoch_us(ts) as sequence, event_type,
         case when event_type = 'click' then 'RESERVE' else 'SETTLE' end as event_kind,
         cast(500 as bigint) as reserved_ms,
         case when event_type in ('purchase', 'signup') then cast(floor(value) as bigint) end as elapsed_ms,
         event_type <> 'click' as settled,
         case when event_type = 'error' then 'FAILED' when event_type = 'click' then 'RUNNING'
              else 'SUCCEEDED' end as state,
         cast(round(value * 1000) as bigint) as wall_ns, cast(round(value * 700) as bigint) as cpu_ns,
         case when event_type = 'view' then null else cast(round(value * 100) as bigint) end as peak_bytes
  from events)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One event per attempt: clicks are still reserved, errors and views settle without a measured time."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("cell_id"),
        micros("ts").alias("sequence"),
        kind,
        F.when(kind == "click", "RESERVE").otherwise("SETTLE").alias("event_kind"),
        F.lit(500).cast("bigint").alias("reserved_ms"),
        F.when(kind.isin("purchase", "signup"), F.floor("value")).alias("elapsed_ms"),
        (kind != "click").alias("settled"),
        F.when(kind == "error", "FAILED").when(kind == "click", "RUNNING").otherwise("SUCCEEDED").alias("state"),
        F.round(F.col("value") * 1000).cast("bigint").alias("wall_ns"),
        F.round(F.col("value") * 700).cast("bigint").alias("cpu_ns"),
        F.when(kind != "view", F.round(F.col("value") * 100).cast("bigint")).alias("peak_bytes"),
    )


# --- forecast ensembles -----------------------------------------------------------------------------------------

SAMPLES = f"""vectors as (
  select label, vec_id // {FORECAST_SIZE} as part, vec_id, embedding,
         max(vec_id) over (partition by label, vec_id // {FORECAST_SIZE}) as target_id
  from embeddings),
samples as (
  select m.method, concat_ws('-', v.label, v.part) as forecast_id, s.slot, v.vec_id as sample_idx,
         cast(v.embedding[2 * s.slot + 1] as double) * 1000 * m.scale as x,
         cast(v.embedding[2 * s.slot + 2] as double) * 1000 * m.scale as y,
         cast(g.embedding[2 * s.slot + 1] as double) * 1000 as tx,
         cast(g.embedding[2 * s.slot + 2] as double) * 1000 as ty
  from vectors v
  join vectors g on g.vec_id = v.target_id
  cross join (select unnest([0, 1, 2, 3]) as slot) s
  cross join (select unnest([{{'method': 'raw', 'scale': 1.0::double}}, {{'method': 'scaled', 'scale': 0.9::double}}], recursive := true)) m
  where v.vec_id <> v.target_id)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Long ensemble table: at most 500 particles per forecast, so more data means more forecasts."""
    e = table(spark, sf, "embeddings").select(
        F.concat_ws("-", "label", F.floor(F.col("vec_id") / FORECAST_SIZE)).alias("forecast_id"),
        F.col("vec_id").alias("sample_idx"),
        F.slice("embedding", 1, 2 * SLOTS).alias("v"),
    )
    # a forecast is bounded, so its window is too; later groupings by forecast need no further exchange
    whole = W.partitionBy("forecast_id")
    pair = e.select(
        "*", F.max("sample_idx").over(whole).alias("target_id"), F.max_by("v", "sample_idx").over(whole).alias("t")
    ).where(F.col("sample_idx") != F.col("target_id"))
    points = F.array(
        *[
            F.struct(
                F.lit(method).alias("method"),
                F.lit(slot).alias("slot"),
                *[
                    (F.col("v")[2 * slot + axis].cast("double") * 1000 * F.lit(scale)).alias(name)
                    for axis, name in ((0, "x"), (1, "y"))
                ],
                *[
                    (F.col("t")[2 * slot + axis].cast("double") * 1000).alias(name)
                    for axis, name in ((0, "tx"), (1, "ty"))
                ],
            )
            for method, scale in (("raw", 1.0), ("scaled", 0.9))
            for slot in range(SLOTS)
        ]
    )
    return pair.select("forecast_id", "sample_idx", F.inline(points)).select(
        "method", "forecast_id", "slot", "sample_idx", "x", "y", "tx", "ty"
    )


# --- trajectories -----------------------------------------------------------------------------------------------

POINTS = f"""steps as (
  select user_id, event_id, epoch_us(ts) as t_us, value as speed,
         value * cos(radians(3.6 * cast(json_extract_string(props, '$.k') as integer))) as dx,
         value * sin(radians(3.6 * cast(json_extract_string(props, '$.k') as integer))) as dy,
         lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as prev_us
  from events),
walk as (
  select *, sum(case when prev_us is null or t_us - prev_us > {DAY * 1000000} or t_us < prev_us then 1 else 0 end)
              over (partition by user_id order by t_us, event_id rows unbounded preceding) as seg,
         sum(dx) over (partition by user_id order by t_us, event_id rows unbounded preceding) as x,
         sum(dy) over (partition by user_id order by t_us, event_id rows unbounded preceding) as y
  from steps),
points as (
  select user_id, concat_ws('-', user_id, cast(seg as bigint)) as segment_id, event_id, t_us, speed,
         round(x, 6) as x, round(y, 6) as y,
         row_number() over (partition by user_id, seg order by t_us, event_id) - 1 as idx,
         count(*) over (partition by user_id, seg) as n
  from walk)"""


def time_chunk(micros: str = "t_us", seconds: int = DAY) -> Column:
    return F.floor(F.col(micros) / F.lit(seconds * 1000000))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.radians(F.lit(3.6) * F.get_json_object("props", "$.k").cast("int"))
    return table(spark, sf, "events").select(
        "user_id",
        "event_id",
        micros("ts").alias("t_us"),
        F.col("value").alias("speed"),
        (F.col("value") * F.cos(heading)).alias("dx"),
        (F.col("value") * F.sin(heading)).alias("dy"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    from evigrid.operators.trajectory import segment_points

    tracks = steps(spark, sf)
    widths = [seconds * 1000000 for seconds in (DAY, 3600, 60, 1)]
    width = piece_width(tracks, ["user_id"], F.col("t_us"), widths)
    walked = segment_points(
        tracks, "user_id", [F.col("t_us"), F.col("event_id")], F.floor(F.col("t_us") / F.lit(width)), "t_us",
        DAY * 1000000, {f"{c}_{part.__name__}": part(f"d{c}") for c in "xy" for part in (exact_part, plain_part)},
    )

    # positions are rounded, so they are added up as decimals: in doubles the sum depends on where the track is cut
    def position(name: str) -> Column:
        return F.col(f"{name}_exact_part").cast("double") + F.col(f"{name}_plain_part")

    # every trajectory operator reads this table more than once, so it is stored like any refined corpus
    return materialise(
        walked.select(
            "user_id",
            F.concat_ws("-", "user_id", "seg").alias("segment_id"),
            "event_id",
            "t_us",
            "speed",
            F.round(position("x"), 6).alias("x"),
            F.round(position("y"), 6).alias("y"),
            "idx",
            "n",
        )
    )


# --- eligibility ------------------------------------------------------------------------------------------------

ELIGIBILITY = """eligibility as (
  select doc_id as sample_id, source as block_id, n_chars,
         list_filter([case when n_chars < 200 then 'metadata-short' end,
                      case when lang <> 'en' then 'temporal-lang' end,
                      case when n_chars % 7 = 0 then 'coverage-len' end], lambda x: x is not null) as reasons
  from documents)"""


def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    from evigrid.operators.trajectory import reasons

    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("block_id"),
        "n_chars",
        reasons(
            {
                "metadata-short": F.col("n_chars") < 200,
                "temporal-lang": F.col("lang") != "en",
                "coverage-len": F.col("n_chars") % 7 == 0,
            }
        ).alias("reasons"),
    )


# --- captures ---------------------------------------------------------------------------------------------------

CAPTURES = """captures as (
  select 'earlier' as capture, o_orderpriority as matrix, o_orderstatus as disposition, count(*) as n
  from orders where o_orderdate < timestamp '1998-01-01' group by all
  union all
  select 'later', o_orderpriority, o_orderstatus, count(*) from orders group by all)"""


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """One scan: an order of before 1998 belongs to both captures."""
    o = table(spark, sf, "orders")
    both = F.when(
        F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.array(F.lit("earlier"), F.lit("later"))
    ).otherwise(F.array(F.lit("later")))
    return o.select(
        F.explode(both).alias("capture"),
        F.col("o_orderpriority").alias("matrix"),
        F.col("o_orderstatus").alias("disposition"),
    ).groupBy("capture", "matrix", "disposition").agg(F.count(F.lit(1)).alias("n"))


# --- gates ------------------------------------------------------------------------------------------------------

GATES = """gates as (
  select l_orderkey as record_id, l_linenumber as gate_no, l_quantity as value, cast(25 as double) as threshold,
         case when l_linenumber % 2 = 1 then 'ge' else 'le' end as operator,
         case when l_orderkey % 101 = 0
              then not (case when l_linenumber % 2 = 1 then l_quantity >= 25 else l_quantity <= 25 end)
              else (case when l_linenumber % 2 = 1 then l_quantity >= 25 else l_quantity <= 25 end) end as passed
  from lineitem)"""


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pass flags, some of them wrong."""
    from evigrid.operators.quality import gate_passes

    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        F.col("l_linenumber").alias("gate_no"),
        F.col("l_quantity").alias("value"),
        F.lit(25.0).alias("threshold"),
        F.when(F.col("l_linenumber") % 2 == 1, "ge").otherwise("le").alias("operator"),
    )
    right = gate_passes("operator", "value", "threshold")
    return li.withColumn("passed", F.when(F.col("record_id") % 101 == 0, ~right).otherwise(right))


# --- benchmark receipts and seed effects ------------------------------------------------------------------------

RECEIPTS = """receipts as (
  select p_brand as benchmark_id, p_size as seed, avg(p_retailprice) as metric, count(*) as n
  from part group by p_brand, p_size)"""


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("benchmark_id"), F.col("p_size").alias("seed"))
        .agg(F.avg("p_retailprice").alias("metric"), F.count(F.lit(1)).alias("n"))
    )


# --- runtime trials ---------------------------------------------------------------------------------------------

TRIALS = """trials as (
  select user_id % 15 as subject, event_id as trial_id,
         case when event_id % 11 < 5 then 'cold' when event_id % 11 = 5 then 'warmup' else 'warm' end as kind,
         case when event_type = 'error' then 'failed' else 'success' end as status,
         value as end_to_end_ms from events)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("event_id") % 11
    return table(spark, sf, "events").select(
        (F.col("user_id") % 15).alias("subject"),
        F.col("event_id").alias("trial_id"),
        F.when(turn < 5, "cold").when(turn == 5, "warmup").otherwise("warm").alias("kind"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("end_to_end_ms"),
    )


# --- sampler chunks ---------------------------------------------------------------------------------------------

CHUNKS = """chunks as (
  select l_returnflag as stream, l_suppkey as chunk, count(*) as n, count(*) filter (where l_quantity > 45) as hits,
         avg(l_quantity) as mean, sum(l_quantity) as total, sum(l_quantity * l_quantity) as squares,
         sum(exp(-l_discount)) as w, sum(exp(-2 * l_discount)) as w2,
         sum(exp(-l_discount)) filter (where l_quantity > 45) as w_event,
         sum(exp(-2 * l_discount)) filter (where l_quantity > 45) as w_event2
  from lineitem group by l_returnflag, l_suppkey)"""


def draws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("stream"),
        F.col("l_suppkey").alias("chunk"),
        F.col("l_quantity").alias("x"),
        (F.col("l_quantity") > 45).alias("hit"),
        (-F.col("l_discount")).alias("log_weight"),
    )


# --- lineage ----------------------------------------------------------------------------------------------------

EDGES = """edges as (
  select p_partkey as child, case when p_partkey > 0 then p_partkey // 2 end as parent,
         case when p_size > 45 then 'restricted' when p_size > 25 then 'shared' else 'public' end as visibility
  from part)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("child"),
        F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("parent"),
        F.when(size > 45, "restricted").when(size > 25, "shared").otherwise("public").alias("visibility"),
    )


def sealed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("hash", seal(*columns))


