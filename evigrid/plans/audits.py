"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, with_piece
from evigrid.functions.scalars import micros, seal
from evigrid.operators import pairing, quality
from evigrid.plans.bindings import (
    CAPTURES, CELLS, GATES, LEDGER, RECEIPTS, captures, cells, gates, ledger, receipts, table,
)
from evigrid.plans.registry import query


@query(
    "dq1_row_constraints",
    """with v as (select o_orderkey, unnest([
          case when o_totalprice not between 2000 and 450000 then 'price_range' end,
          case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'priority_enum' end,
          case when o_orderstatus = 'F' and o_orderdate >= timestamp '1999-01-01' then 'finished_late' end,
          case when o_custkey is null then 'customer_required' end]) as rule from orders)
       select * from v where rule is not null""",
)
def dq1_row_constraints(spark, sf):
    late = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    return quality.row_violations(
        table(spark, sf, "orders"), ["o_orderkey"],
        {
            "price_range": ~F.col("o_totalprice").between(2000, 450000),
            "priority_enum": ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
            "finished_late": (F.col("o_orderstatus") == "F") & late,
            "customer_required": F.col("o_custkey").isNull(),
        },
    )


@query(
    "dq2_duplicate_keys",
    "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1",
)
def dq2_duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq3_grid_completeness",
    f"""with {RECEIPTS}, grid as (select benchmark_id, seed from (select distinct benchmark_id from receipts),
                                  (select unnest(range(1, 46))::integer as seed))
    select coalesce(g.benchmark_id, r.benchmark_id) as benchmark_id, coalesce(g.seed, r.seed) as seed,
           case when r.seed is null then 'missing' else 'unexpected' end as gap
    from grid g full join receipts r using (benchmark_id, seed) where g.seed is null or r.seed is null""",
)
def dq3_grid_completeness(spark, sf):
    seen = receipts(spark, sf).select("benchmark_id", "seed")
    grid = seen.select("benchmark_id").distinct().select(
        "benchmark_id", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("seed")
    )
    return pairing.grid_gaps(grid, seen, ["benchmark_id", "seed"])


@query(
    "dq4_single_valued_identity",
    """select o_custkey, count(distinct o_orderstatus) = 1 as o_orderstatus_single,
              count(distinct o_orderpriority) = 1 as o_orderpriority_single from orders group by o_custkey""",
)
def dq4_single_valued_identity(spark, sf):
    return quality.single_valued(table(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    "dq5_functional_dependency",
    """select l_partkey, count(distinct l_suppkey) as distinct_values, count(*) as rows from lineitem
       group by l_partkey having count(distinct l_suppkey) > 1""",
)
def dq5_functional_dependency(spark, sf):
    return quality.dependency_violations(table(spark, sf, "lineitem"), ["l_partkey"], "l_suppkey")


@query(
    "dq6_group_cardinality",
    """with contract(o_orderpriority, n) as (values ('1-URGENT', 3000), ('2-HIGH', 3000), ('6-NEW', 10)),
    counts as (select o_orderpriority, count(*) as n from orders group by all)
    select o_orderpriority, a.n::bigint as registered, b.n as observed,
           case when b.n is null then 'missing_right' when a.n is null then 'missing_left' else 'different' end as state
    from contract a full join counts b using (o_orderpriority) where a.n is distinct from b.n""",
)
def dq6_group_cardinality(spark, sf):
    contract = spark.createDataFrame(
        [("1-URGENT", 3000), ("2-HIGH", 3000), ("6-NEW", 10)], "o_orderpriority string, n bigint"
    )
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return quality.contract_mismatches(counts, contract, ["o_orderpriority"])


@query(
    "dq7_all_or_none",
    f"""with {LEDGER} select cell_id, count(elapsed_ms) as present, count(*) - count(elapsed_ms) as absent
        from ledger group by all having count(elapsed_ms) > 0 and count(elapsed_ms) < count(*)""",
)
def dq7_all_or_none(spark, sf):
    return quality.all_or_none(ledger(spark, sf), ["cell_id"], "elapsed_ms")


@query(
    "dq8_gate_reevaluation",
    f"""with {GATES} select record_id, gate_no, value, operator, passed, not passed as recomputed from gates
        where passed <> (case when operator = 'ge' then value >= threshold else value <= threshold end)""",
)
def dq8_gate_reevaluation(spark, sf):
    return quality.gate_mismatches(gates(spark, sf)).drop("threshold")


@query(
    "dq9_stage_sequence",
    "select p_partkey, p_name from part where string_split(p_name, ' ') <> ['red', 'widget']",
)
def dq9_stage_sequence(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    stages = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name"), F.lit("done").alias("status")))
    staged = parts.withColumn("stages", stages)
    names = F.transform("stages", lambda s: s["name"])
    return quality.stage_mismatches(staged, names, ["red", "widget"]).drop("stages")


@query(
    "dq10_number_check",
    """select c_custkey, 'c_acctbal' as column, 'negative' as rule from customer where c_acctbal < 0
       union all
       select c_custkey, 'ratio', case when c_acctbal = 0 then 'absent' else 'negative' end from customer
       where c_acctbal - 5000 < 0 or c_acctbal = 0""",
)
def dq10_number_check(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "ratio", F.when(F.col("c_acctbal") != 0, (F.col("c_acctbal") - 5000) / F.abs("c_acctbal"))
    )
    return quality.number_violations(c, ["c_custkey"], ["c_acctbal", "ratio"])


@query(
    "dq11_denominator_reconciliation",
    f"""with {CAPTURES}, w as (select capture, matrix, cast(sum(n) as bigint) as expected,
           coalesce(sum(n) filter (where disposition = 'F'), 0)::bigint as success,
           coalesce(sum(n) filter (where disposition = 'P'), 0)::bigint as failed,
           coalesce(sum(n) filter (where disposition = 'O'), 0)::bigint as missing from captures group by all)
    select *, expected = success + failed + missing as reconciled from w""",
)
def dq11_denominator_reconciliation(spark, sf):
    def of(code):
        return F.coalesce(F.sum(F.when(F.col("disposition") == code, F.col("n"))), F.lit(0))

    wide = captures(spark, sf).groupBy("capture", "matrix").agg(
        F.sum("n").alias("expected"), of("F").alias("success"), of("P").alias("failed"), of("O").alias("missing")
    )
    return wide.withColumn("reconciled", F.col("expected") == F.col("success") + F.col("failed") + F.col("missing"))


@query(
    "dq12_strictly_ordered",
    """with w as (select user_id, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as previous_value
                  from events) select * from w where value <= previous_value""",
)
def dq12_strictly_ordered(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", micros("ts").alias("t_us"), "value")
    return quality.not_increasing(
        with_piece(e, "t_us", "event_id"), ["user_id"], [F.col("t_us"), F.col("event_id")], F.col(PIECE), "value"
    ).drop("t_us", PIECE)


@query(
    "dq13_nested_level_monotonicity",
    f"""with {RECEIPTS}, w as (select benchmark_id, seed, round(metric, 6) as metric,
            round(lag(metric) over (partition by benchmark_id order by seed), 6) as previous_metric from receipts)
    select * from w where metric < previous_metric""",
)
def dq13_nested_level_monotonicity(spark, sf):
    """Levels per configuration are a short registered list, so a plain window is enough."""
    from pyspark.sql import Window as W

    level = W.partitionBy("benchmark_id").orderBy("seed")
    seen = receipts(spark, sf).withColumn("previous_metric", F.round(F.lag("metric").over(level), 6))
    return seen.withColumn("metric", F.round("metric", 6)).where(F.col("metric") < F.col("previous_metric")).drop("n")


@query(
    "dq14_jensen_area_bound",
    """select l_suppkey, round(avg(l_extendedprice / 40), 6) as mean_area, round(avg(l_quantity), 8) as mean_radius,
              avg(l_extendedprice / 40) >= pi() * avg(l_quantity) * avg(l_quantity) * (1 - 1e-9) as holds
       from lineitem group by l_suppkey""",
)
def dq14_jensen_area_bound(spark, sf):
    area, radius = F.avg(F.col("l_extendedprice") / 40), F.avg("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(area, 6).alias("mean_area"), F.round(radius, 8).alias("mean_radius"),
        (area >= F.pi() * radius * radius * (1 - 1e-9)).alias("holds"),
    )


@query(
    "dq15_interval_ends",
    """with i as (select event_id, case when event_type <> 'view' then value end as low,
            case when event_type <> 'click' then cast(json_extract_string(props, '$.k') as double) end as high from events)
       select event_id, case when (low is null) <> (high is null) then 'one_end_only' else 'reversed' end as rule
       from i where (low is null) <> (high is null) or low > high""",
)
def dq15_interval_ends(spark, sf):
    kind = F.col("event_type")
    ends = table(spark, sf, "events").select(
        "event_id", F.when(kind != "view", F.col("value")).alias("low"),
        F.when(kind != "click", F.get_json_object("props", "$.k").cast("double")).alias("high"),
    )
    return quality.interval_violations(ends, ["event_id"], "low", "high")


@query(
    "dq16_recomputed_summary",
    """with r as (select l_orderkey as o_orderkey, sum(l_extendedprice * (1 - l_discount)) as total from lineitem group by all)
       select o_orderkey, o_totalprice as stored, round(total, 4) as recomputed from orders full join r using (o_orderkey)
       where not coalesce(abs(o_totalprice - total) <= greatest(0.1 * greatest(abs(o_totalprice), abs(total)), 1.0), false)""",
)
def dq16_recomputed_summary(spark, sf):
    stored = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    again = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total")
    )
    out = quality.stored_value_mismatches(stored, again, ["o_orderkey"], "total", 0.1, 1.0)
    return out.withColumn("recomputed", F.round("recomputed", 4))


@query(
    "dq18_row_seal",
    """select event_id, user_id, event_type from events where sha256(concat_ws('|', event_id, user_id, event_type)) <>
       case when value < 1 then md5(concat_ws('|', event_id, user_id, event_type))
            else sha256(concat_ws('|', event_id, user_id, event_type)) end""",
)
def dq18_row_seal(spark, sf):
    """Rows of small value carry a seal of the wrong kind."""
    e = table(spark, sf, "events")
    sealed = e.withColumn(
        "hash",
        F.when(F.col("value") < 1, F.md5(F.concat_ws("|", "event_id", "user_id", "event_type")))
        .otherwise(seal("event_id", "user_id", "event_type")),
    )
    return quality.seal_mismatches(sealed, "hash", ["event_id", "user_id", "event_type"]).select(
        "event_id", "user_id", "event_type"
    )


@query(
    "dq19_identity_hash",
    """with f as (select l_suppkey, concat('f', lpad(l_partkey::varchar, 12, '0')) as path, sha256(concat_ws('|', l_suppkey, l_partkey)) as digest
                  from lineitem group by l_suppkey, l_partkey),
    b as (select l_suppkey, sha256('[' || string_agg('{"path":"' || path || '","sha256":"' || digest || '"}', ',' order by path) || ']') as bundle
          from f group by l_suppkey)
    select l_suppkey, bundle as bundle_sha256, sha256('{"runtime":"r1","source_bundle_sha256":"' || bundle || '"}') as identity_sha256 from b""",
)
def dq19_identity_hash(spark, sf):
    files = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().select(
        "l_suppkey", F.concat(F.lit("f"), F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("path"),
        seal("l_suppkey", "l_partkey").alias("digest"),
    )
    identity = F.concat(F.lit('{"runtime":"r1","source_bundle_sha256":"'), F.col("bundle_sha256"), F.lit('"}'))
    return quality.bundle_hashes(files, ["l_suppkey"], "path", "digest").withColumn(
        "identity_sha256", F.sha2(identity, 256)
    )


@query(
    "dq20_manifest_reconcile",
    """with m as (select distinct o_orderkey as id from orders), l as (select distinct l_orderkey as id from lineitem)
       select coalesce(m.id, l.id) as id, case when l.id is null then 'only_left' else 'only_right' end as side,
              1::bigint as copies
       from m full join l on m.id = l.id where m.id is null or l.id is null""",
)
def dq20_manifest_reconcile(spark, sf):
    listed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return pairing.two_way_difference(listed, present)


@query(
    "dq21_registered_spec_binding",
    """select coalesce(d.doc_id, l.doc_id) as doc_id, d.q as quality_left, l.quality as quality_right,
         case when l.doc_id is null then 'missing_right' when d.doc_id is null then 'missing_left'
              else 'different' end as state
       from (select doc_id, case when n_chars >= 500 then 1 else 0 end as q from documents) d
       full join labels l on d.doc_id = l.doc_id where d.q is distinct from l.quality""",
)
def dq21_registered_spec_binding(spark, sf):
    registered = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("quality")
    )
    return pairing.full_compare(registered, table(spark, sf, "labels"), ["doc_id"], ["quality"]).where(
        F.col("state") != "equal"
    )


# besides the fixed patterns: quoted hexadecimal tokens, addresses
TEXT_RULES = {
    **quality.SENSITIVE, "hex token": r'token = "[0-9a-f]{8,}', "mail address": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}",
}
TEXT_RULE_SQL = ",\n".join(
    f"case when regexp_matches(line, '{p}') then '{n}' end" for n, p in TEXT_RULES.items()
)


@query(
    "dq22_sensitive_text",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no
                   from documents),
    r as (select doc_id, no::bigint as line, unnest([{TEXT_RULE_SQL}]) as rule from l)
    select * from r where rule is not null""",
)
def dq22_sensitive_text(spark, sf):
    return quality.sensitive_lines(table(spark, sf, "documents"), ["doc_id"], "text", TEXT_RULES)


@query(
    "dq23_forbidden_fields",
    """select event_id as item, f as found from (select event_id, unnest(json_keys(props)) as f from events) where f in ('k', 'hostname')
       union all
       select page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) from pages
       where lower(regexp_extract(url, '(\\.[^./]+)$', 1)) in ('.com', '.html', '.zip', '.com/en', '.pdf')""",
)
def dq23_forbidden_fields(spark, sf):
    fields = quality.forbidden_fields(table(spark, sf, "events"), ["event_id"], "props", ["k", "hostname"])
    files = quality.forbidden_suffixes(
        table(spark, sf, "pages"), ["page_id"], "url", [".com", ".html", ".zip", ".com/en", ".pdf"]
    )
    return fields.select(F.col("event_id").alias("item"), F.col("field").alias("found")).unionByName(
        files.select(F.col("page_id").alias("item"), F.col("suffix").alias("found"))
    )


@query(
    "dq24_document_quota",
    """with m as (select doc_id, strlen(text)::bigint as bytes, len(string_split(text, chr(10)))::bigint as lines,
                list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::bigint as longest_line from documents)
       select *, bytes <= 20000 and lines <= 100 and longest_line <= 4000 as within from m""",
)
def dq24_document_quota(spark, sf):
    return quality.text_profile(
        table(spark, sf, "documents"), ["doc_id"], "text", {"bytes": 20000, "lines": 100, "longest_line": 4000}
    )


@query(
    "dq25_permission_filter",
    """select o_orderkey from orders where list_contains(string_split(o_orderpriority, '-'), 'LOW')
       and list_contains([o_orderkey % 100, 7], o_custkey % 100) and o_orderdate > timestamp '1996-06-01'
       and o_orderstatus <> 'P'""",
)
def dq25_permission_filter(spark, sf):
    grants = table(spark, sf, "orders").withColumn("purposes", F.split("o_orderpriority", "-")).withColumn(
        "blocks", F.array(F.col("o_orderkey") % 100, F.lit(7).cast("bigint"))
    )
    return quality.permitted(
        grants, "purposes", ["LOW"], "blocks", F.col("o_custkey") % 100, "o_orderdate",
        F.lit("1996-06-01").cast("timestamp_ntz"), F.col("o_orderstatus") != "P",
    ).select("o_orderkey")


@query(
    "dq26_event_order_chain",
    f"""with {LEDGER}, f as (select cell_id, min(sequence) filter (where event_type = 'click') as first_click,
           min(sequence) filter (where event_type = 'view') as first_view,
           min(sequence) filter (where event_type = 'purchase') as first_purchase from ledger group by cell_id)
    select *, coalesce(first_click < first_view, false) and coalesce(first_view < first_purchase, false) as ordered from f""",
)
def dq26_event_order_chain(spark, sf):
    return quality.chain_order(ledger(spark, sf), ["cell_id"], "event_type", "sequence", ["click", "view", "purchase"])


@query(
    "dq27_publication_before_read",
    """select o_orderkey, epoch_us(o_orderdate) as published, epoch_us(min(l_shipdate)) as first_read
       from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate
       having min(l_shipdate) <= o_orderdate""",
)
def dq27_publication_before_read(spark, sf):
    read = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first")
    )
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(read, "o_orderkey")
    return both.where(F.col("first") <= F.col("o_orderdate")).select(
        "o_orderkey", micros("o_orderdate").alias("published"), micros("first").alias("first_read")
    )


AXES = {"arm_id": ["A", "N", "R"], "horizon": ["F", "O"], "seed": [1, 2, 3, 4, 5, 6, 7, 8]}


@query(
    "dq28_matrix_product",
    f"""with {CELLS}, a as (select distinct arm_id, horizon, seed from cells),
    g as (select m.arm_id, h.horizon, s.seed::integer as seed, (m.o * 2 + h.o) * 8 + s.seed - 1 as ordinal
          from (values ('A', 0), ('N', 1), ('R', 2)) m(arm_id, o), (values ('F', 0), ('O', 1)) h(horizon, o),
               (select unnest(range(1, 9)) as seed) s)
    select g.arm_id, g.horizon, g.seed, g.ordinal::bigint as ordinal, a.seed is not null as observed
    from g left join a using (arm_id, horizon, seed)""",
)
def dq28_matrix_product(spark, sf):
    """Registered axes expand in their stable order; the ordinal is arithmetic, not a sort."""
    grid = spark.range(48).select(
        F.element_at(F.array(*[F.lit(x) for x in AXES["arm_id"]]), (F.floor(F.col("id") / 16) + 1).cast("int")).alias("arm_id"),
        F.element_at(F.array(*[F.lit(x) for x in AXES["horizon"]]), (F.floor(F.col("id") / 8) % 2 + 1).cast("int")).alias("horizon"),
        (F.col("id") % 8 + 1).cast("int").alias("seed"), F.col("id").alias("ordinal"),
    )
    seen = cells(spark, sf).select("arm_id", "horizon", "seed", F.lit(True).alias("seen")).distinct()
    return grid.join(seen, ["arm_id", "horizon", "seed"], "left").select(
        "arm_id", "horizon", "seed", "ordinal", F.col("seen").isNotNull().alias("observed")
    )


@query(
    "dq29_check_coverage",
    """with e as (select l_orderkey, l_linenumber, count(*) as n, bool_and(l_quantity >= 10 and l_returnflag <> 'R') as good
                  from lineitem group by all)
       select o_orderkey, c.check_no::integer as check_no, coalesce(n, 0) as rows, coalesce(n, 0) = 1 and coalesce(good, false) as covered
       from orders cross join (select unnest(range(1, 4)) as check_no) c
       left join e on l_orderkey = o_orderkey and l_linenumber = c.check_no""",
)
def dq29_check_coverage(spark, sf):
    required = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("check_no"))
    evidence = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("check_no"), "l_quantity", "l_returnflag"
    )
    return quality.check_coverage(
        required, evidence, ["o_orderkey", "check_no"], F.col("l_quantity") >= 10, F.col("l_returnflag") != "R"
    )


@query(
    "dq30_transport_counts",
    """with c(status, n) as (values ('F', 5000), ('P', 5000), ('rows', 15000)),
    o as (select o_orderstatus as status, count(*) as n from orders group by all union all select 'rows', count(*) from orders)
    select status, c.n::bigint as registered, o.n as observed,
           case when o.n is null then 'missing_right' when c.n is null then 'missing_left' else 'different' end as state
    from c full join o using (status) where c.n is distinct from o.n""",
)
def dq30_transport_counts(spark, sf):
    contract = spark.createDataFrame([("F", 5000), ("P", 5000), ("rows", 15000)], "status string, n bigint")
    counts = table(spark, sf, "orders").rollup("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").alias("is_total")
    ).select(F.when(F.col("is_total") == 1, "rows").otherwise(F.col("o_orderstatus")).alias("status"), "n")
    return quality.contract_mismatches(counts, contract, ["status"])


@query(
    "dq31_projection_agreement",
    """with a as (select l_suppkey, avg(l_quantity) as v from lineitem group by all),
            b as (select l_suppkey, avg(v) as v from (select l_suppkey, l_linenumber, avg(l_quantity) as v from lineitem group by all) group by all)
       select l_suppkey, round(a.v, 8) as stored, round(b.v, 8) as recomputed from a join b using (l_suppkey)
       where not (abs(a.v - b.v) <= greatest(0.005 * greatest(abs(a.v), abs(b.v)), 1e-9))""",
)
def dq31_projection_agreement(spark, sf):
    li = table(spark, sf, "lineitem")
    direct = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v"))
    nested = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("v")).groupBy("l_suppkey").agg(F.avg("v").alias("v"))
    out = quality.stored_value_mismatches(direct, nested, ["l_suppkey"], "v", 0.005, 1e-9)
    return out.select("l_suppkey", F.round("stored", 8).alias("stored"), F.round("recomputed", 8).alias("recomputed"))
