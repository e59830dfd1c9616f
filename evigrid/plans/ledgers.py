"""Attempts, costs, resources, catalogs and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, previous, row_numbers, with_piece
from evigrid.operators import pairing, ranking, rollup, summaries
from evigrid.plans.bindings import EDGES, LEDGER, edges, ledger, table
from evigrid.plans.registry import query
from evigrid.session import materialise

COSTS = f"""{LEDGER},
priced as (select *, case when not settled then 0 else coalesce(elapsed_ms, reserved_ms) end as charged_ms from ledger
           where event_type <> 'error'),
costs as (
  select h.cell_id, count(*) as attempts, count(*) filter (where p.settled is null) as missing_attempts,
         count(*) filter (where p.settled and p.elapsed_ms is null) as unknown_attempts,
         count(*) filter (where not p.settled) as pending_attempts,
         case when count(*) filter (where p.settled is null) = 0
              then coalesce(sum(p.charged_ms) filter (where p.settled), 0) end::bigint as charged_ms,
         coalesce(sum(p.reserved_ms) filter (where not p.settled), 0)::bigint as reserved_ms,
         case when count(*) filter (where p.settled is null or not p.settled or p.elapsed_ms is null) = 0
              then coalesce(sum(p.elapsed_ms), 0) end::bigint as measured_ms
  from (select attempt_id, cell_id // 1 * 100 + extract(day from make_timestamp(sequence)) as cell_id from ledger) h
  left join priced p using (attempt_id) group by h.cell_id)"""


def day_cells(spark, sf):
    """Finer cells, one per user and day, so some of them are complete."""
    # days since the epoch, so the session time zone plays no part
    day = F.dayofmonth(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("sequence") / 86400000000).cast("int")))
    return ledger(spark, sf).withColumn("cell_id", F.col("cell_id") * 100 + day)


def costs(spark, sf):
    history = day_cells(spark, sf)
    return rollup.cell_costs(history, history.where(F.col("event_type") != "error"))


@query("agg24_cell_cost", f"with {COSTS} select * from costs")
def agg24_cell_cost(spark, sf):
    return costs(spark, sf)


@query(
    "agg23_null_poisoning_totals",
    f"""with {COSTS} select cell_id % 100 as day, count(*) as cells, cast(sum(missing_attempts) as bigint) as missing_attempts,
        case when count(charged_ms) = count(*) then sum(charged_ms) end::bigint as charged_ms,
        case when count(reserved_ms) = count(*) then sum(reserved_ms) end::bigint as reserved_ms,
        case when count(measured_ms) = count(*) then sum(measured_ms) end::bigint as measured_ms
        from costs group by all""",
)
def agg23_null_poisoning_totals(spark, sf):
    return costs(spark, sf).groupBy((F.col("cell_id") % 100).alias("day")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("missing_attempts").alias("missing_attempts"),
        *[rollup.poisoned_total(c, c) for c in ("charged_ms", "reserved_ms", "measured_ms")],
    )


@query(
    "agg25_resource_rollup",
    f"""with {LEDGER}, o as (select *, cell_id * 100 + extract(day from make_timestamp(sequence)) as day_cell,
             case when event_type = 'click' and elapsed_ms is null then 'UNAVAILABLE' else 'RECORDED' end as st from ledger),
    r as (select day_cell as cell_id, count(*) filter (where st = 'RECORDED') as observed_attempts,
            count(*) filter (where st <> 'RECORDED') as unavailable_attempts,
            count(*) filter (where st = 'RECORDED' and peak_bytes is null) as memory_unknown_attempts,
            (sum(wall_ns) filter (where st = 'RECORDED'))::bigint as observed_wall_ns,
            (sum(cpu_ns) filter (where st = 'RECORDED'))::bigint as observed_cpu_ns,
            max(peak_bytes) filter (where st = 'RECORDED') as maximum_peak_bytes from o group by day_cell)
    select *, observed_attempts > 0 and unavailable_attempts = 0 as duration_complete,
           maximum_peak_bytes is not null and unavailable_attempts = 0 and memory_unknown_attempts = 0 as memory_complete,
           case when observed_attempts > 0 and unavailable_attempts = 0 then observed_wall_ns end as wall_ns,
           case when observed_attempts > 0 and unavailable_attempts = 0 then observed_cpu_ns end as cpu_ns from r""",
)
def agg25_resource_rollup(spark, sf):
    observed = day_cells(spark, sf).withColumn(
        "resource_status", F.when(F.col("event_type") == "click", "UNAVAILABLE").otherwise("RECORDED")
    )
    return rollup.resource_rollup(observed, ["cell_id"])


RESOURCES = """cells as (select c_custkey as cell_id, c_nationkey as arm_id, c_mktsegment as stratum, c_custkey % 37 <> 3 as has_record from customer),
  a as (select o_custkey as cell_id, o_orderkey as attempt_id, case when o_orderkey % 97 = 5 then 'LOST' else 'RECORDED' end as resource_status,
        o_orderkey % 1000 * 1000 as wall_ns, o_orderkey % 700 * 900 as cpu_ns, case when o_orderkey % 89 <> 7 then o_orderkey % 4096 end as peak_bytes from orders),
  counted as (select cell_id, count(*) as n, count(*) filter (where resource_status = 'RECORDED') as obs, count(*) filter (where resource_status <> 'RECORDED') as una,
        count(*) filter (where resource_status = 'RECORDED' and peak_bytes is null) as mem, sum(wall_ns) filter (where resource_status = 'RECORDED') as wall,
        sum(cpu_ns) filter (where resource_status = 'RECORDED') as cpu, max(peak_bytes) filter (where resource_status = 'RECORDED') as peak from a group by cell_id)"""


def resource_cells(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("arm_id"), F.col("c_mktsegment").alias("stratum"),
        (F.col("c_custkey") % 37 != 3).alias("has_record"),
    )


def resource_attempts(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cell_id"), k.alias("attempt_id"), F.when(k % 97 == 5, "LOST").otherwise("RECORDED").alias("resource_status"),
        (k % 1000 * 1000).alias("wall_ns"), (k % 700 * 900).alias("cpu_ns"), F.when(k % 89 != 7, k % 4096).alias("peak_bytes"),
    )


@query(
    "agg25_resource_completeness",
    f"""with {RESOURCES}, g as (select arm_id, stratum, sum(case when has_record then 0 else 1 end)::bigint as legacy_cells,
        sum(case when has_record and n is null then 1 else 0 end)::bigint as unattempted_cells, coalesce(sum(obs) filter (where has_record), 0)::bigint as observed_attempts,
        coalesce(sum(una) filter (where has_record), 0)::bigint as unavailable_attempts, coalesce(sum(mem) filter (where has_record), 0)::bigint as memory_unknown_attempts,
        (sum(wall) filter (where has_record))::bigint as observed_wall_ns, (sum(cpu) filter (where has_record))::bigint as observed_cpu_ns,
        max(peak) filter (where has_record) as maximum_peak_bytes from cells left join counted using (cell_id) group by arm_id, stratum),
    f as (select *, legacy_cells = 0 and unavailable_attempts = 0 and observed_attempts > 0 as duration_complete,
        legacy_cells = 0 and unavailable_attempts = 0 and memory_unknown_attempts = 0 and maximum_peak_bytes is not null as memory_complete from g)
    select *, case when duration_complete then observed_wall_ns end as wall_ns, case when duration_complete then observed_cpu_ns end as cpu_ns from f""",
)
def agg25_resource_completeness(spark, sf):
    """Cells of all four kinds, rolled up by arm and stratum."""
    states = rollup.resource_states(resource_cells(spark, sf), resource_attempts(spark, sf))
    return rollup.resource_summary(rollup.merge_resources(states, ["arm_id", "stratum"]))


@query(
    "agg25_resource_unknowns",
    f"""with {RESOURCES} select attempt_id, case when resource_status <> 'RECORDED' then 'unavailable' else 'memory' end as unknown from a
        where resource_status <> 'RECORDED' or peak_bytes is null""",
)
def agg25_resource_unknowns(spark, sf):
    return rollup.resource_unknowns(resource_attempts(spark, sf))


@query(
    "agg26_shared_source_cost",
    """select o_custkey as source_id, count(*) as uses, count(distinct o_orderstatus) > 1 as conflict,
              case when count(distinct o_orderstatus) = 1 then cast(floor(min(o_totalprice)) as bigint) end as charged_ms
       from orders group by o_custkey""",
)
def agg26_shared_source_cost(spark, sf):
    """A shared source is charged once; users who disagree about it leave its cost unknown."""
    uses = table(spark, sf, "orders").withColumnRenamed("o_custkey", "source_id")
    return summaries.shared_source_cost(uses, "source_id", "o_orderstatus", F.floor("o_totalprice"))


@query(
    "jon16_attempt_cost_join",
    f"""with {LEDGER} select h.attempt_id, case when e.attempt_id is null then 'missing' when not e.settled then 'pending'
           when e.elapsed_ms is null then 'unknown' else 'measured' end as cost_state
        from ledger h left join (select * from ledger where event_type <> 'error') e using (attempt_id)""",
)
def jon16_attempt_cost_join(spark, sf):
    """Attempts and their events are rows of one table here, so they meet in one aggregate and the table is read once."""
    return rollup.attempt_cost_states(ledger(spark, sf), F.col("event_type") != "error")


@query(
    "jon17_observation_settlement_order",
    f"""with {LEDGER}, h as (select cell_id, attempt_id, row_number() over (partition by cell_id order by sequence, attempt_id) as history_position from ledger),
    s as (select cell_id, attempt_id, row_number() over (partition by cell_id order by attempt_id) as settlement_position from ledger where settled),
    o as (select attempt_id, wall_ns from ledger where peak_bytes is not null)
    select h.cell_id, h.attempt_id, history_position, settlement_position, wall_ns, history_position = settlement_position as in_order
    from h join s using (attempt_id) join o using (attempt_id)""",
)
def jon17_observation_settlement_order(spark, sf):
    """Both positions and the observation are attributes of one attempt: the second position is taken of the first one's rows."""
    base = ledger(spark, sf).select(
        "cell_id", "attempt_id", "sequence", F.coalesce("settled", F.lit(False)).alias("settled"), "wall_ns",
        F.col("peak_bytes").isNotNull().alias("observed"),
    )
    history = row_numbers(
        with_piece(base, "sequence", "attempt_id"), ["cell_id"], [F.col("sequence"), F.col("attempt_id")], F.col(PIECE),
        "history_position",
    ).drop("sequence", PIECE)
    settled = row_numbers(
        with_piece(materialise(history.where("settled")), "attempt_id"), ["cell_id"], [F.col("attempt_id")], F.col(PIECE),
        "settlement_position",
    )
    return settled.where("observed").select(
        "cell_id", "attempt_id", "history_position", "settlement_position", "wall_ns",
        (F.col("history_position") == F.col("settlement_position")).alias("in_order"),
    )


@query(
    "jon18_exact_cover",
    """with b as (select l_orderkey, count(*) as n from lineitem group by all)
       select coalesce(o_orderkey, l_orderkey) as cell_id, coalesce(n, 0) as packages,
              case when o_orderkey is null then 'not_executable' when n is null then 'uncovered' when n > 1 then 'duplicate' else 'covered' end as state
       from (select o_orderkey from orders where o_orderstatus <> 'P') full join b on l_orderkey = o_orderkey""",
)
def jon18_exact_cover(spark, sf):
    cells = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("cell_id"))
    packages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id"))
    return summaries.exact_cover(cells, packages, "cell_id")


@query(
    "jon19_catalog_join",
    """with v as (select s_nationkey, case when count(distinct s_acctbal > 2000) = 1 then min(case when s_acctbal > 5000 then 'accepted' else 'pending' end)
                  else 'ambiguous' end as status, count(*) as entries from supplier group by all)
       select c_custkey, coalesce(status, 'absent') as status, coalesce(entries, 0) as entries
       from customer left join v on s_nationkey = c_nationkey""",
)
def jon19_catalog_join(spark, sf):
    entries = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("c_nationkey"), (F.col("s_acctbal") > 2000).alias("payload"),
        F.when(F.col("s_acctbal") > 5000, "accepted").otherwise("pending").alias("status"),
    )
    catalog = pairing.ambiguous_versions(entries, ["c_nationkey"], ["payload"], "status")
    return table(spark, sf, "customer").join(catalog, "c_nationkey", "left").select(
        "c_custkey", F.coalesce("status", F.lit("absent")).alias("status"), F.coalesce("entries", F.lit(0)).alias("entries")
    )


@query(
    "jon20_exposure_history",
    """with d as (select doc_id, md5(text) as h, lang || source as dataset from documents),
    x as (select md5(d.text) as h, d.lang || d.source as dataset, toxic = 1 as unknown_hash
          from documents d join labels l using (doc_id) where l.quality = 0)
    select doc_id from d where h in (select h from x) or dataset in (select dataset from x where unknown_hash)""",
)
def jon20_exposure_history(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.concat("lang", "source").alias("dataset"))
    seen = table(spark, sf, "labels").where(F.col("quality") == 0).join(d, "doc_id").select(
        "h", "dataset", (F.col("toxic") == 1).alias("unknown_hash")
    )
    return pairing.exposed(d, seen, ["doc_id"], "h", "dataset", "unknown_hash")


@query(
    "jon21_retry_parent",
    f"""with {LEDGER}, p as (select attempt_id, cell_id, state, lag(attempt_id) over (partition by cell_id order by sequence, attempt_id) as parent_attempt_id from ledger)
    select c.attempt_id, c.parent_attempt_id, q.state as parent_state, coalesce(q.state = 'FAILED', false) as valid_retry
    from p c join ledger q on q.attempt_id = c.parent_attempt_id""",
)
def jon21_retry_parent(spark, sf):
    """The parent is the row before, so its state comes along with its id."""
    children = previous(
        with_piece(ledger(spark, sf).select("attempt_id", "cell_id", "state", "sequence"), "sequence", "attempt_id"), ["cell_id"],
        [F.col("sequence"), F.col("attempt_id")], F.col(PIECE),
        {"parent_attempt_id": "attempt_id", "parent_state": "state"},
    )
    return children.where(F.col("parent_attempt_id").isNotNull()).select(
        F.col("attempt_id"), "parent_attempt_id", "parent_state", (F.col("parent_state") == "FAILED").alias("valid_retry")
    )


@query(
    "jon22_lineage_closure",
    f"""with recursive {EDGES}, ranked as (select *, case visibility when 'restricted' then 2 when 'shared' then 1 else 0 end as rk from edges),
    walk as (select child as node, child as here, parent, rk, 0 as depth from ranked
             union all select w.node, r.child, r.parent, greatest(w.rk, r.rk), w.depth + 1 from walk w join ranked r on r.child = w.parent)
    select node, here as root, depth::bigint as depth, rk as strictest, true as resolved from walk where parent is null""",
)
def jon22_lineage_closure(spark, sf):
    rank = F.when(F.col("visibility") == "restricted", 2).when(F.col("visibility") == "shared", 1).otherwise(0)
    return pairing.ancestor_closure(edges(spark, sf), rank)


# a part refers to the half of its key, every third one to the third too; some refer to a key without a row, some back to a part
# that refers to them, and one block of 500 keys in seven is a chain from key to key
REFERENCES = """refs as (
  select distinct * from (
    select p_partkey as child, case when p_partkey // 500 % 7 = 3 and p_partkey % 500 > 0 then p_partkey - 1 else p_partkey // 2 end as parent
    from part where p_partkey > 1
    union all select p_partkey, p_partkey // 3 from part where p_partkey % 3 = 0 and not (p_partkey // 500 % 7 = 3)
    union all select p_partkey, -p_partkey from part where p_partkey % 101 = 57
    union all select p_partkey, 2 * p_partkey from part where p_partkey % 211 = 200) where parent <> 0)"""


@query(
    "jon22_lineage_states",
    f"""with recursive {EDGES}, {REFERENCES}, ranked as (select child as node, case visibility when 'restricted' then 2 when 'shared' then 1 else 0 end as rk from edges where child > 0),
    walk as (select node as start, node as at, [node] as path, 0 as steps, false as back from ranked
             union all select w.start, r.parent, list_append(w.path, r.parent), w.steps + 1, list_contains(w.path, r.parent)
             from walk w join refs r on r.child = w.at where not w.back and w.steps <= 32),
    s as (select start as node, bool_or(back and steps <= 32) as cyclic, bool_or(steps > 32) as deep, bool_or(rk is null) as dangling,
          max(steps) as depth, count(*) as visits, max(rk) as strictest from walk left join ranked k on k.node = walk.at group by start),
    t as (select *, case when cyclic then 'cycle' when deep then 'too_long' when dangling then 'dangling' when visits > 10000 then 'too_many' else 'resolved' end as state from s)
    select node, state, case when state = 'resolved' then depth end::bigint as depth, case when state = 'resolved' then visits end as visits,
           case when state = 'resolved' then strictest end::bigint as strictest from t""",
)
def jon22_lineage_states(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    chained = (F.floor(k / 500) % 7 == 3)
    half = F.when(chained & (k % 500 > 0), k - 1).otherwise(F.floor(k / 2))
    parents = F.array(
        F.when(k > 1, half), F.when((k % 3 == 0) & ~chained, F.floor(k / 3)), F.when(k % 101 == 57, -k), F.when(k % 211 == 200, 2 * k)
    )
    references = part.select(k.alias("child"), F.explode(F.filter(parents, lambda x: x.isNotNull() & (x != 0))).alias("parent"))
    rank = F.when(F.col("p_size") > 45, 2).when(F.col("p_size") > 25, 1).otherwise(0)
    return pairing.lineage_states(part.where(k > 0).select(k.alias("node"), "p_size"), references, rank)


@query(
    "win1_first_success",
    f"""with {LEDGER}, s as (select cell_id, attempt_id, sequence from ledger where state = 'SUCCEEDED')
    select cell_id, arg_min(attempt_id, sequence) as first_success, arg_max(attempt_id, sequence) as last_success, count(*) as successes,
           arg_min(attempt_id, sequence) = arg_max(attempt_id, sequence) as only_first_used from s group by cell_id""",
)
def win1_first_success(spark, sf):
    return ranking.first_success(ledger(spark, sf), ["cell_id"], "sequence", "attempt_id", F.col("state") == "SUCCEEDED")


@query(
    "win1_selected_attempt",
    f"""with {LEDGER}, s as (select cell_id, arg_min(attempt_id, sequence) filter (where state = 'SUCCEEDED') as first_success,
      arg_max(attempt_id, sequence) filter (where state = 'SUCCEEDED') as last_success,
      count(*) filter (where state = 'SUCCEEDED') as successes, count(*) filter (where event_type = 'signup') as uses,
      min(attempt_id) filter (where event_type = 'signup') as used from ledger group by cell_id)
    select cell_id, first_success, last_success, successes, uses, used,
           coalesce(uses = 1 and used = first_success, false) as only_first_used from s where successes > 0""",
)
def win1_selected_attempt(spark, sf):
    """The attempt a cell was judged by (its sign-up) must be its first success, and the only one used."""
    return ranking.first_success(
        ledger(spark, sf), ["cell_id"], "sequence", "attempt_id", F.col("state") == "SUCCEEDED", F.col("event_type") == "signup"
    )


@query(
    "win2_latest_event",
    f"""with {LEDGER} select cell_id, arg_max(attempt_id, sequence) as attempt_id, arg_max(event_kind, sequence) as event_kind,
        arg_max(state, sequence) as state from ledger group by cell_id""",
)
def win2_latest_event(spark, sf):
    return pairing.rank_latest(ledger(spark, sf), ["cell_id"], F.col("sequence"), ["attempt_id", "event_kind", "state"])


@query(
    "win13_retry_chains",
    f"""with {LEDGER}, p as (select *, lag(state) over (partition by cell_id order by sequence, attempt_id) as before from ledger),
    c as (select cell_id, sum(case when coalesce(before, '') <> 'FAILED' then 1 else 0 end) over (partition by cell_id order by sequence, attempt_id rows unbounded preceding)::bigint as chain from p)
    select cell_id, chain, count(*) as attempts, count(*) <= 3 as allowed from c group by all""",
)
def win13_retry_chains(spark, sf):
    attempts = ledger(spark, sf).select(
        "cell_id", "attempt_id", "sequence", (F.col("state") == "FAILED").alias("failed")
    )
    return ranking.retry_chains(
        with_piece(attempts, "sequence", "attempt_id"), ["cell_id"], [F.col("sequence"), F.col("attempt_id")], F.col(PIECE), "failed"
    )
