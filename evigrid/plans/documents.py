"""Documents: sources, sinks, projections and set operations.

Sources and sinks are checked by a round trip: rows are written to the shared folder, read back with the reader in
question, and must be the rows that went in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigrid.functions.scalars import canonical_map, stratum_id
from evigrid.operators import pairing, project, rollup
from evigrid.plans.bindings import CAPTURES, CELLS, RECEIPTS, TRIALS, captures, cells, receipts, table, trials
from evigrid.plans.evidence import BLOCKS, stored_blocks
from evigrid.plans.registry import query
from evigrid.session import job_folder, materialise
from evigrid.sources import readers, sinks


def fresh(spark):
    return f"{job_folder(spark)}/{uuid.uuid4().hex}"


def write_documents(df, path):
    """One JSON document per line, compressed; a file is read by one task, so it holds a bounded number of them."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", 200_000).json(path)


def records(spark, sf):
    """One run record per order; every nested value comes from the order's own row."""
    o = table(spark, sf, "orders")
    energy = F.round(F.col("o_totalprice") / 1000, 6)
    failed = F.col("o_orderstatus") == "P"
    gate = [
        F.struct(
            F.lit(n).alias("statistic"), v.alias("value"), F.lit(t).alias("threshold"), F.lit(op).alias("operator"),
            (v <= t if op == "le" else v >= t).alias("passed"), F.lit(10).alias("sample_size"),
        )
        for n, v, t, op in (("energy", energy, 200.0, "le"), ("key", (F.col("o_custkey") % 100).cast("double"), 50.0, "ge"))
    ]
    return o.select(
        F.lit("run-record-v1").alias("schema_version"), F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("result_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("arm_id"),
        F.col("o_orderstatus").alias("subconfig_id"), F.lit("g").alias("group"), F.when(failed, F.lit(None)).otherwise("main").alias("slot"),
        F.struct(
            F.array(F.concat(F.lit("i"), (F.col("o_custkey") % 7).cast("string")), F.concat(F.lit("j"), (F.col("o_custkey") % 3).cast("string"))).alias("idea_ids"),
            F.lit("primary").alias("role"), F.lit("high").alias("confidence"), F.array(F.lit("s")).alias("sources"),
        ).alias("lineage"),
        F.lit("implemented").alias("implementation_status"), F.when(failed, "failed").otherwise("succeeded").alias("run_status"),
        F.when(F.col("o_orderstatus") == "F", "supported").otherwise("open").alias("verdict"),
        F.struct(F.lit("d1").alias("dataset_id"), F.md5("o_orderpriority").alias("fingerprint"), F.create_map(F.lit("evaluation"), F.md5("o_orderstatus")).alias("selected_segment_ids_sha256")).alias("dataset"),
        F.create_map(F.lit("score"), F.lit("d2_mc")).alias("config"),
        F.struct(F.lit(100).alias("requested_prediction_samples"), F.when(~failed, F.lit(100)).alias("effective_prediction_samples")).alias("runtime"),
        F.lit(1).cast("bigint").alias("seed"), F.col("o_custkey").alias("replicate_seed"),
        F.array(F.struct(F.lit("fit").alias("name"), F.lit("done").alias("status"))).alias("stages"),
        F.create_map(F.lit("predictions"), F.struct(F.lit("p.json").alias("path"), F.lit(10).cast("bigint").alias("size_bytes"), F.md5("o_orderpriority").alias("sha256"))).alias("artifacts"),
        F.map_filter(F.create_map(F.lit("energy_score_d2"), energy, F.lit("cep50_error"), F.when(~failed, energy * 2)), lambda k, v: v.isNotNull()).alias("metrics"),
        F.array(*gate).alias("mechanism_gates"),
    )


FLAT = """select substr(o_orderpriority, 1, 1)::integer as arm_id, o_orderstatus as subconfig_id, 'g' as "group", case when o_orderstatus = 'P' then '' else 'main' end as slot,
  'i' || (o_custkey % 7) || ';j' || (o_custkey % 3) as idea_ids, 'primary' as lineage_role, 'high' as lineage_confidence, 'implemented' as implementation_status,
  case when o_orderstatus = 'P' then 'failed' else 'succeeded' end as run_status, case when o_orderstatus = 'F' then 'supported' else 'open' end as verdict, 'd1' as dataset_id,
  100 as requested_prediction_samples, case when o_orderstatus <> 'P' then 100 end as effective_prediction_samples, o_custkey as replicate_seed, 'r' || o_orderkey as result_id,
  round(o_totalprice / 1000, 6) as energy_score_d2, null::double as hdr90_coverage, case when o_orderstatus <> 'P' then round(o_totalprice / 1000, 6) * 2 end as cep50_error,
  'energy' as mechanism_statistic, round(o_totalprice / 1000, 6) as mechanism_value, 200.0::double as mechanism_threshold, round(o_totalprice / 1000, 6) <= 200 as mechanism_passed from orders"""


@query("prj1_process_rows", FLAT)
def prj1_process_rows(spark, sf):
    return project.process_rows(records(spark, sf))


@query("src1_run_records", FLAT)
def src1_run_records(spark, sf):
    path = fresh(spark)
    write_documents(records(spark, sf), path)
    return project.process_rows(readers.read_records(spark, path, multi_line=False))


@query(
    "src2_prediction_samples",
    """select vec_id, 'seg' || label as segment_id, s.i::integer as sample_idx, round(embedding[2 * s.i + 1]::double, 6) as x, round(embedding[2 * s.i + 2]::double, 6) as y
       from embeddings cross join (select unnest(range(32)) as i) s""",
)
def src2_prediction_samples(spark, sf):
    path = fresh(spark)
    sample = [F.array(F.col("embedding")[2 * i].cast("double"), F.col("embedding")[2 * i + 1].cast("double")) for i in range(32)]
    document = F.array(
        F.struct(F.concat(F.lit("seg"), "label").alias("segment_id"), sample[0].alias("target"), F.array(*sample).alias("samples"))
    )
    write_documents(table(spark, sf, "embeddings").select("vec_id", document.alias("predictions")), path)
    read = spark.read.schema(f"vec_id bigint, {readers.PREDICTIONS}").json(path)
    return readers.explode_predictions(read, ["vec_id"]).select(
        "vec_id", "segment_id", "sample_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


@query(
    "src3_evidence_bundle",
    "select s_suppkey::varchar as study_id, 'c' || s_suppkey as cell_hash, 'A' as arm_id, s_nationkey::varchar as block_id, round(s_acctbal, 6) as loss from supplier",
)
def src3_evidence_bundle(spark, sf):
    """One small bundle per supplier, read back as header, expected and observed cells."""
    path = fresh(spark)
    key = F.concat(F.lit("c"), "s_suppkey")
    ident = [key.alias("cell_hash"), F.lit("A").alias("arm_id"), F.col("s_nationkey").cast("string").alias("block_id"), F.lit(1).alias("seed")]
    cell = F.struct(*ident, F.lit("SUCCEEDED").alias("status"), F.create_map(F.lit("loss"), F.col("s_acctbal")).alias("metrics"))
    documents = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("study_id"), F.array(F.struct(*ident)).alias("expected_cells"), F.array(cell).alias("cells")
    )
    write_documents(documents, path)
    _, expected, observed = readers.read_bundle(spark, path, multi_line=False)
    return expected.join(observed.select("study_id", "cell_hash", "metrics"), ["study_id", "cell_hash"]).select(
        "study_id", "cell_hash", "arm_id", "block_id", F.round(F.col("metrics")["loss"], 6).alias("loss")
    )


@query(
    "src4_sharded_scan",
    "select n_regionkey as shard, n_name as name from nation where n_regionkey <> 2",
)
def src4_sharded_scan(spark, sf):
    """Shards named and pinned by an index; the index entry of shard 2 carries a stale hash, so its rows stay out."""
    root = fresh(spark)
    shard = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_regionkey").alias("shard"), F.col("n_name").alias("name"))))).alias("text")
    )
    shard.repartition("n_regionkey").select("n_regionkey", F.col("text").alias("value")).write.partitionBy("n_regionkey").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(root)
    named = F.substring_index("path", root + "/", -1)
    digest = F.when(F.col("path").contains("n_regionkey=2"), F.lit("stale")).otherwise(F.sha2("content", 256))
    rows, _ = readers.read_sharded(spark, root, files.select(named.alias("path"), digest.alias("sha256")), "shard int, name string")
    return rows.select("shard", "name")


@query(
    "src5_unique_versions",
    """with v as (select o_custkey, count(*) as versions from orders where o_orderstatus = 'F' group by all)
       select c_custkey as work_id, coalesce(versions, 0) as versions, case when versions is null then 'absent' when versions = 1 then 'unique' else 'ambiguous' end as state
       from customer left join v on o_custkey = c_custkey""",
)
def src5_unique_versions(spark, sf):
    items = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("work_id"), F.md5(F.lit("v1")).alias("digest"))
    path = fresh(spark)
    write_documents(items, path)
    bound = table(spark, sf, "customer").select(F.col("c_custkey").alias("work_id"), F.md5(F.lit("v1")).alias("digest"))
    return readers.unique_versions(readers.read_work_items(spark, path), bound, "work_id", "digest").drop("digest")


@query(
    "src6_strict_json",
    """with g as (select (s_suppkey % 25)::integer as part, count(*) as n from supplier group by all)
    select part, case when part = 7 then 'oversized' else 'ok' end as state, case when part <> 7 and part % 5 <> 1 then n end as n,
           part <> 7 and part % 5 <> 1 as accepted from g""",
)
def src6_strict_json(spark, sf):
    """One document per group of suppliers. One that repeats a key is refused (the usual parser would keep the last value), and
    one that is too large is listed, but not read.
    """
    path = fresh(spark)
    groups = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 25).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("part") % 5 == 1, F.lit(', "n": 0')).otherwise(F.lit(""))
    filler = F.when(F.col("part") == 7, F.repeat(F.lit(" "), 5000)).otherwise(F.lit(""))
    text = F.concat(F.lit('{"n": '), F.col("n").cast("string"), again, F.lit("}"), filler)
    groups.repartition("part").select("part", text.alias("value")).write.partitionBy("part").text(path)
    found = readers.read_pinned(spark, f"{path}/part=*", 4096)
    return found.select(
        F.regexp_extract("path", r"part=(\d+)/", 1).cast("int").alias("part"), "state",
        F.try_variant_get("document", "$.n", "bigint").alias("n"), F.col("document").isNotNull().alias("accepted"),
    )


@query(
    "src7_compressed_transport",
    "select event_type as status, count(*) as rows, round(sum(value), 4) as total, true as kept, false as kept_by_fewer from events group by all",
)
def src7_compressed_transport(spark, sf):
    """Read only under a contract of rows and decoded bytes; a contract of one row less is broken."""
    path = fresh(spark)
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    e.write.option("compression", "gzip").json(path)
    promised = e.count()
    kept = [readers.transport_contract(spark, path, rows, 200 * promised).select("kept").scalar() for rows in (promised, promised - 1)]
    back = readers.read_compressed(spark, path, "event_id bigint, event_type string, value double")
    out = back.groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("*", kept[0].alias("kept"), kept[1].alias("kept_by_fewer"))


@query("src8_csv_scan", f"with {RECEIPTS} select benchmark_id, seed, round(metric, 4) as metric, case when n > 1 then n end as n from receipts")
def src8_csv_scan(spark, sf):
    path = fresh(spark)
    rows = receipts(spark, sf).withColumn("metric", F.round("metric", 4)).withColumn("n", F.when(F.col("n") > 1, F.col("n")))
    sinks.write_ordered_csv(rows, path, ["benchmark_id", "seed"])
    return readers.read_csv(spark, path, "benchmark_id string, seed int, metric double, n bigint")


@query(
    "src9_batch_manifest",
    "select d.source as batch_id, d.doc_id as seed, case when quality = 1 then 'ok' when quality = 0 then 'weak' end as status, quality is not null as present from documents d left join labels l using (doc_id)",
)
def src9_batch_manifest(spark, sf):
    """Manifest documents of at most some hundred replicates each; the labels are the summaries they must find."""
    path = fresh(spark)
    entries = table(spark, sf, "documents").select(F.col("source").alias("batch_id"), "doc_id")
    # a source of any size is split over documents by its ids
    listed = entries.groupBy("batch_id", F.floor(F.col("doc_id") / 256).alias("part")).agg(
        F.collect_list(F.struct(F.col("doc_id").alias("seed"))).alias("replicates")
    )
    listed.drop("part").write.json(path)
    manifest = readers.read_manifest(spark, path)
    summaries = table(spark, sf, "labels").select(F.col("doc_id").alias("seed"), F.when(F.col("quality") == 1, "ok").otherwise("weak").alias("status"))
    return readers.replicate_inputs(manifest, summaries)


@query(
    "src10_document_family",
    """with r as (select p_brand as benchmark_id, avg(p_retailprice) as mean from part group by all)
       select 'receipts' as source, benchmark_id, round(mean, 4) as value from r union all select 'contrasts', benchmark_id, round(mean - 1000, 4) from r
       union all select 'uncertainties', benchmark_id, round(mean / 100, 4) from r""",
)
def src10_document_family(spark, sf):
    folder = fresh(spark)
    base = table(spark, sf, "part").groupBy(F.col("p_brand").alias("benchmark_id")).agg(F.avg("p_retailprice").alias("mean"))
    kinds = {"receipts": F.col("mean"), "contrasts": F.col("mean") - 1000, "uncertainties": F.col("mean") / 100}
    for kind, value in kinds.items():
        base.select("benchmark_id", F.round(value, 4).alias("value")).write.json(f"{folder}/{kind}")
    family = readers.read_family(spark, folder, {k: "benchmark_id string, value double" for k in kinds})
    out = family["receipts"]
    for kind in ("contrasts", "uncertainties"):
        out = out.unionByName(family[kind])
    return out.select("source", "benchmark_id", "value")


@query(
    "src11_test_report",
    "select 'suite::case' || doc_id as name, case when toxic = 1 then 'failure' when quality = 0 then 'skipped' else 'passed' end as state from labels",
)
def src11_test_report(spark, sf):
    path = fresh(spark)
    note = F.struct(F.lit("m").alias("_message"))
    table(spark, sf, "labels").select(
        F.lit("suite").alias("_classname"), F.concat(F.lit("case"), "doc_id").alias("_name"), F.when(F.col("toxic") == 1, note).alias("failure"),
        F.when((F.col("toxic") != 1) & (F.col("quality") == 0), note).alias("skipped"),
    ).write.format("xml").option("rowTag", "testcase").option("rootTag", "testsuite").save(path)
    return readers.read_test_report(spark, path)


@query(
    "src12_scope_policy",
    f"with {CELLS} select distinct arm_id, horizon, block_id from cells where arm_id not in ('R', 'Z')",
)
def src12_scope_policy(spark, sf):
    path = fresh(spark)
    spark.createDataFrame([('{"approved_excluded_arms": ["R", "Z"]}',)], "value string").coalesce(1).write.text(path)
    policy = readers.read_policy(spark, path)
    grid = cells(spark, sf).select("arm_id", "horizon", "block_id").distinct()
    return readers.expected_grid(policy, grid)


# --- sinks ------------------------------------------------------------------------------------------------------

@query("snk1_ordered_csv", f"with {BLOCKS} select arm_id, horizon, block_id, n_cells, complete, round(quantity, 8) as quantity from blocks")
def snk1_ordered_csv(spark, sf):
    path = fresh(spark)
    rows = stored_blocks(spark, sf).select("arm_id", "horizon", "block_id", "n_cells", "complete", F.round("quantity", 8).alias("quantity"))
    sinks.write_ordered_csv(rows, path, ["arm_id", "horizon", "block_id"])
    return readers.read_csv(spark, path, "arm_id string, horizon string, block_id bigint, n_cells bigint, complete boolean, quantity double")


@query(
    "snk2_nested_csv",
    """select o_orderkey, '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' as dimensions, case when o_orderstatus <> 'P' then '[' || o_custkey || ',' || o_orderkey || ']' end as ids from orders""",
)
def snk2_nested_csv(spark, sf):
    path = fresh(spark)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("dimensions"),
        F.when(F.col("o_orderstatus") != "P", F.array("o_custkey", "o_orderkey")).alias("ids"),
    )
    sinks.write_nested_csv(rows, path, ["o_orderkey"])
    return spark.read.schema("o_orderkey bigint, dimensions string, ids string").option("header", True).option("escape", '"').csv(path)


@query("snk3_write_once_package", f"with {BLOCKS} select arm_id, horizon, block_id, n_eligible, true as written, false as rewritten from blocks")
def snk3_write_once_package(spark, sf):
    path = fresh(spark)
    rows = stored_blocks(spark, sf).select("arm_id", "horizon", "block_id", "n_eligible")
    first, second = sinks.write_package(rows, path), sinks.write_package(rows, path)
    return sinks.read_package(spark, path).withColumn("written", F.lit(first)).withColumn("rewritten", F.lit(second))


@query(
    "snk4_output_manifest",
    """with k as (select o_orderkey % 4 as part, count(*) as n from orders group by all)
    select 'part=' || part as folder, n as rows, true as hashed, (select count(*) from orders) as total from k""",
)
def snk4_output_manifest(spark, sf):
    """A row per written file: its hash, its bytes, its rows; beside it the rows of the table."""
    path = fresh(spark)
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("part"), "o_orderkey")
    orders.repartition(4, "part").write.partitionBy("part").json(path)
    files = sinks.rows_per_file(spark, path, sinks.file_manifest(spark, path, "part-*"))
    total = sinks.table_manifest({"orders": spark.read.json(path)}).select("rows").scalar()
    return files.select(
        F.substring_index("name", "/", 1).alias("folder"), "rows", ((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("hashed"),
        total.alias("total"),
    )


@query("snk6_summary_document", "select 'study-1' as study_id, event_type as status, count(*) as n, (select count(*) from events) as total from events group by all")
def snk6_summary_document(spark, sf):
    """Written as one JSON document and read back as rows."""
    path = fresh(spark)
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.summary_document(counts, "event_type", "n", study_id="study-1").write.json(path)
    back = spark.read.schema("study_id string, counts map<string,bigint>, total bigint").json(path)
    return back.select("study_id", F.explode("counts").alias("status", "n"), "total")


@query(
    "dq17_artifact_integrity",
    """with k as (select distinct c_custkey % 6 as part from customer)
    select case part when 1 then 'outside' when 2 then 'missing' when 3 then 'size' when 4 then 'hash' else 'ok' end as state,
           count(*) as artifacts from k group by all""",
)
def dq17_artifact_integrity(spark, sf):
    """Written files against a register in which sizes, hashes and names of some entries are wrong."""
    path = fresh(spark)
    parts = table(spark, sf, "customer").withColumn("part", F.col("c_custkey") % 6)
    parts.repartition(6, "part").write.partitionBy("part").json(path)
    files = materialise(sinks.file_manifest(spark, path, "part-*"))
    part = F.regexp_extract("name", r"part=(\d+)/", 1).cast("int")
    register = files.select(
        F.when(part == 1, F.concat(F.lit("../"), "name")).when(part == 2, F.lit("gone.json")).otherwise(F.col("name")).alias("name"),
        F.when(part == 3, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(part == 4, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return readers.artifact_states(register, files).groupBy("state").agg(F.count(F.lit(1)).alias("artifacts"))


# --- projections ------------------------------------------------------------------------------------------------

def family_cards(spark, sf):
    """Nested cards: per part a map family -> comparison -> result, with inference present on some."""
    p = table(spark, sf, "part")
    number = F.struct(F.col("p_retailprice").alias("delta"), F.array(F.col("p_retailprice") - 1, F.col("p_retailprice") + 1).alias("interval"))
    result = F.struct(
        F.when(F.col("p_size") > 25, "beneficial").otherwise("inconclusive").alias("verdict"), F.when(F.col("p_size") > 10, number).alias("inference"),
        F.struct((F.col("p_retailprice") / 2).alias("delta")).alias("descriptive"),
    )
    return p.select("p_partkey", F.create_map(F.col("p_type"), F.create_map(F.col("p_brand"), result)).alias("families"))


@query(
    "prj2_comparison_rows",
    """select p_partkey, p_type as family_id, p_brand as comparison_id, case when p_size > 25 then 'beneficial' else 'inconclusive' end as verdict,
         case when p_size > 10 then p_retailprice else p_retailprice / 2 end as delta, case when p_size > 10 then p_retailprice - 1 end as lower, case when p_size > 10 then p_retailprice + 1 end as upper from part""",
)
def prj2_comparison_rows(spark, sf):
    return project.comparison_rows(family_cards(spark, sf), ["p_partkey"], "families")


def metric_cards(spark, sf):
    b = stored_blocks(spark, sf)
    done = F.col("complete")
    return b.select(
        "arm_id", "horizon", "block_id", F.when(done, "computed").otherwise("unavailable").alias("status"),
        F.struct(F.round("quantity", 8).alias("crps"), F.round(F.col("quantity") * 2, 8).alias("fde")).alias("means"),
        F.when(done, F.array(F.col("n_cells"), F.col("n_eligible"), F.col("block_id"))).alias("by_time"),
    )


@query(
    "prj3_gated_accuracy",
    f"with {BLOCKS} select arm_id, horizon, block_id, case when complete then 'computed' else 'unavailable' end as status, case when complete then round(quantity, 8) end as crps, case when complete then round(quantity * 2, 8) end as fde from blocks",
)
def prj3_gated_accuracy(spark, sf):
    return project.gated_metrics(metric_cards(spark, sf), ["arm_id", "horizon", "block_id"], "means", ["crps", "fde"])


@query(
    "prj4_slot_rows",
    f"""with {BLOCKS} select arm_id, horizon, block_id, s.slot::integer as slot, s.slot * 450.0::double + 450 as nominal,
        case when complete then case s.slot when 0 then n_cells when 1 then n_eligible when 2 then block_id end end as value
        from blocks cross join (select unnest(range(4)) as slot) s""",
)
def prj4_slot_rows(spark, sf):
    return project.slot_rows(metric_cards(spark, sf), ["arm_id", "horizon", "block_id"], "by_time", [450, 900, 1350, 1800])


@query(
    "prj5_entity_tables",
    """select 'method' as entity, p_partkey as card, p_brand as id, p_size as value from part union all select 'factor', p_partkey, p_type, length(p_name)::integer from part""",
)
def prj5_entity_tables(spark, sf):
    """Cards which nest several entities become one tagged table of entity rows."""
    p = table(spark, sf, "part")
    cards = p.select(
        F.col("p_partkey").alias("card"),
        F.array(
            F.struct(F.lit("method").alias("entity"), F.col("p_brand").alias("id"), F.col("p_size").alias("value")),
            F.struct(F.lit("factor").alias("entity"), F.col("p_type").alias("id"), F.length("p_name").alias("value")),
        ).alias("entities"),
    )
    return cards.select("card", F.inline("entities"))


@query(
    "prj6_ownership",
    "select p_name as name, min(p_brand) as owner, count(*) as documents, min(p_brand) <> max(p_brand) as conflict from part group by p_name",
)
def prj6_ownership(spark, sf):
    cards = table(spark, sf, "part").select(F.create_map("p_name", "p_brand").alias("owners"))
    return project.owners(cards, "owners")


@query(
    "prj7_witness_views",
    """select o_orderkey, 'mechanism' as view, w as witness from (select o_orderkey, unnest(list_sort(string_split(o_orderpriority, '-'))) as w from orders)
       union all select o_orderkey, 'variance', o_orderstatus || '/' || w from (select o_orderkey, o_orderstatus, unnest(list_sort(['b', 'a'])) as w from orders)""",
)
def prj7_witness_views(spark, sf):
    """Two witness maps per card, exploded to rows in sorted order."""
    cards = table(spark, sf, "orders").select(
        "o_orderkey",
        F.create_map(
            F.lit("mechanism"), F.array_sort(F.split("o_orderpriority", "-")),
            F.lit("variance"), F.transform(F.array_sort(F.array(F.lit("b"), F.lit("a"))), lambda w: F.concat_ws("/", "o_orderstatus", w)),
        ).alias("views"),
    )
    return cards.select("o_orderkey", F.explode("views").alias("view", "__w")).select("o_orderkey", "view", F.explode("__w").alias("witness"))


@query(
    "prj8_runtime_rows",
    f"with {TRIALS} select subject, trial_id, kind, status, end_to_end_ms, kind <> 'warmup' and status = 'success' and end_to_end_ms < 300 as included from trials",
)
def prj8_runtime_rows(spark, sf):
    use = (F.col("kind") != "warmup") & (F.col("status") == "success") & (F.col("end_to_end_ms") < 300)
    return trials(spark, sf).withColumn("included", use)


@query(
    "prj9_region_rows",
    """select s_suppkey, s.slot::integer as slot, l.level::double as level, case when l.level = 0.5 and s.slot = 0 then s_acctbal when l.level = 0.9 and s.slot < 2 then s_acctbal * 2 end as value
       from supplier cross join (select unnest(range(3)) as slot) s cross join (select unnest([0.5, 0.8, 0.9]) as level) l""",
)
def prj9_region_rows(spark, sf):
    """Slots and levels which were not reported stay in the table as null."""
    a = F.col("s_acctbal")
    reported = F.array(F.create_map(F.lit(0.5), a, F.lit(0.9), a * 2), F.create_map(F.lit(0.9), a * 2))
    cards = table(spark, sf, "supplier").select("s_suppkey", reported.alias("by_time"))
    return project.region_rows(cards, ["s_suppkey"], "by_time", 3, [0.5, 0.8, 0.9])


@query(
    "prj10_dimension_normalisation",
    """with d as (select o_orderkey, case when o_orderstatus = 'P' then 'reserved_key' when o_orderpriority = '1-URGENT' and o_orderstatus <> 'F' then 'conflict' else 'ok' end as state,
         '{"horizon":"' || o_orderstatus || '","scenario":"' || lower(o_orderpriority) || '"}' as text from orders)
    select o_orderkey, state, case when state = 'ok' then text end as dimensions, case when state = 'ok' then sha256(text) end as stratum_id from d""",
)
def prj10_dimension_normalisation(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    extra = F.when(status == "P", F.create_map(F.lit("seed"), F.lit("1"))).when(
        F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("scenario"), F.lower("o_orderpriority"), F.lit("horizon"), F.lit("F"))
    ).otherwise(F.create_map(F.lit("scenario"), F.lower("o_orderpriority")))
    rows = o.select("o_orderkey", extra.alias("dims"), status.alias("horizon"))
    out = project.normal_dimensions(rows, ["o_orderkey"], "dims", ["horizon"])
    return out.select("o_orderkey", "state", canonical_map("dimensions").alias("dimensions"), F.when(F.col("state") == "ok", stratum_id("dimensions")).alias("stratum_id"))


@query(
    "prj11_output_eligibility",
    """with s as (select event_id, case when event_type = 'error' then 'FAILED' else 'SUCCEEDED' end as status,
         case when event_type in ('view', 'click') then case when value > 60 then 'PASSED' when value > 30 then 'FAILED' else 'UNRESOLVED' end end as output from events)
    select *, status = 'SUCCEEDED' and (output is null or output = 'PASSED') as eligible from s""",
)
def prj11_output_eligibility(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    word = F.when(v > 60, "PASSED").when(v > 30, "FAILED").otherwise("pending")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(kind == "error", "FAILED").otherwise("SUCCEEDED").alias("status"), project.output_status(kind.isin("view", "click"), word).alias("output")
    )
    return rows.withColumn("eligible", project.comparison_eligible("status", F.col("output")))


@query(
    "prj12_scope_filter",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW' and o_totalprice >= 100000",
)
def prj12_scope_filter(spark, sf):
    scope = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") >= 100000)
    return table(spark, sf, "orders").where(scope).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "prj13_display_selection",
    f"""with {BLOCKS} select 'primary' as view, arm_id, horizon, block_id, round(quantity, 8) as quantity from blocks where horizon = 'F' and complete
        union all select 'reference', arm_id, horizon, block_id, round(quantity, 8) from blocks where arm_id = 'A'""",
)
def prj13_display_selection(spark, sf):
    """A row may belong to several named views; it is tagged with each in one pass."""
    views = F.array_compact(
        F.array(F.when((F.col("horizon") == "F") & F.col("complete"), "primary"), F.when(F.col("arm_id") == "A", "reference"))
    )
    return rollup.block_means(cells(spark, sf), ["quantity"]).select(
        F.explode(views).alias("view"), "arm_id", "horizon", "block_id", F.round("quantity", 8).alias("quantity")
    )


@query(
    "prj14_anonymous_view",
    "select conv_id, turn, role, length(text)::bigint as chars from conversations",
)
def prj14_anonymous_view(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.array(F.struct("role", "text", F.length("text").cast("bigint").alias("chars"))).alias("items")
    )
    public = project.anonymous(rows, ["text"], {"items": ["text"]})
    return public.select("conv_id", "turn", F.inline("items"))


@query(
    "prj15_display_names",
    """with v as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, lpad(l_linenumber::varchar, 2, '0') as arm, case l_linenumber when 1 then 'full' when 2 then 'dt30' when 3 then 'crn' when 4 then 'qmle' when 5 then 'em' else 'unknown' end as variant from lineitem)
    select l_orderkey, l_linenumber, l_suppkey, l_partkey, case variant when 'full' then 'HSM-' || arm when 'dt30' then 'Obs 30 s' when 'crn' then 'CRN' when 'qmle' then 'QMLE label' when 'em' then 'Euler-M.' end as name from v""",
)
def prj15_display_names(spark, sf):
    n = F.col("l_linenumber")
    variant = F.when(n == 1, "full").when(n == 2, "dt30").when(n == 3, "crn").when(n == 4, "qmle").when(n == 5, "em").otherwise("unknown")
    arm = F.lpad(n.cast("string"), 2, "0")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", project.method_name(arm, variant).alias("name"))


# --- joins of projected tables ----------------------------------------------------------------------------------

@query(
    "jon14_tradeoff",
    f"""with {RECEIPTS}, c as (select benchmark_id, avg(metric) as es, min(metric) as fde from receipts group by all)
    select a.benchmark_id as candidate, b.benchmark_id as control, round(a.es - b.es, 6) as delta_es, round(a.fde - b.fde, 6) as delta_fde
    from c a join (values ('Brand#2', 'Brand#1'), ('Brand#3', 'Brand#1'), ('Brand#4', 'Brand#3'), ('Brand#5', 'Brand#3')) k(x, y) on a.benchmark_id = x join c b on b.benchmark_id = y""",
)
def jon14_tradeoff(spark, sf):
    c = receipts(spark, sf).groupBy("benchmark_id").agg(F.avg("metric").alias("es"), F.min("metric").alias("fde"))
    pairs = spark.createDataFrame(
        [("Brand#2", "Brand#1"), ("Brand#3", "Brand#1"), ("Brand#4", "Brand#3"), ("Brand#5", "Brand#3")], "candidate string, control string"
    )
    a = c.select(F.col("benchmark_id").alias("candidate"), F.col("es").alias("ae"), F.col("fde").alias("af"))
    b = c.select(F.col("benchmark_id").alias("control"), F.col("es").alias("be"), F.col("fde").alias("bf"))
    return pairs.join(a, "candidate").join(b, "control").select(
        "candidate", "control", F.round(F.col("ae") - F.col("be"), 6).alias("delta_es"), F.round(F.col("af") - F.col("bf"), 6).alias("delta_fde")
    )


@query(
    "jon15_parent_denominator",
    """with parent as (select o_custkey, count(*) as available from orders group by all)
       select o_orderkey, o_custkey, available, o_orderstatus <> 'P' as same_status from orders join parent using (o_custkey)""",
)
def jon15_parent_denominator(spark, sf):
    """Child rows take the recorded denominator of their table; nothing is inferred from the children that succeeded."""
    o = table(spark, sf, "orders")
    parent = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("available"))
    return o.join(parent, "o_custkey").select("o_orderkey", "o_custkey", "available", (F.col("o_orderstatus") != "P").alias("same_status"))


# --- set operations ---------------------------------------------------------------------------------------------

@query("set1_difference", "select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def set1_difference(spark, sf):
    used = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query(
    "set2_equality",
    """with a as (select distinct l_suppkey as id from lineitem), b as (select s_suppkey as id from supplier)
       select 'suppliers' as sets, (select count(*) from (select * from a except select * from b)) + (select count(*) from (select * from b except select * from a)) = 0 as equal""",
)
def set2_equality(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return pairing.two_way_difference(a, b).agg((F.count(F.lit(1)) == 0).alias("equal")).select(F.lit("suppliers").alias("sets"), "equal")


@query(
    "set3_intersection",
    f"""with {BLOCKS} select block_id from blocks where complete group by block_id having count(*) = 6""",
)
def set3_intersection(spark, sf):
    """Blocks complete in every arm and stratum: an intersection over six sets as one division."""
    return pairing.complete_units(rollup.block_means(cells(spark, sf), ["quantity"]), ["block_id"], ["arm_id", "horizon"], 6, F.col("complete"))


@query(
    "set4_new_failures",
    """with b as (select doc_id, case when toxic = 1 then 'failure' else 'error' end as state from labels where toxic = 1 or quality = 0),
    c as (select doc_id, case when n_chars < 300 then 'failure' else 'error' end as state from documents where n_chars < 300 or lang = 'de')
    select * from c except select * from b""",
)
def set4_new_failures(spark, sf):
    before = table(spark, sf, "labels").where((F.col("toxic") == 1) | (F.col("quality") == 0)).select(
        "doc_id", F.when(F.col("toxic") == 1, "failure").otherwise("error").alias("state")
    )
    now = table(spark, sf, "documents").where((F.col("n_chars") < 300) | (F.col("lang") == "de")).select(
        "doc_id", F.when(F.col("n_chars") < 300, "failure").otherwise("error").alias("state")
    )
    return now.join(before, ["doc_id", "state"], "left_anti").distinct()


@query(
    "set5_union",
    f"""with {BLOCKS} select arm_id, horizon, 'arm' as kind, count(*) as n, null::varchar as side from blocks group by all
        union all (with {CAPTURES} select null, null, 'capture', n, capture from captures)""",
)
def set5_union(spark, sf):
    arms = rollup.block_means(cells(spark, sf), ["quantity"]).groupBy("arm_id", "horizon").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("arm"))
    sides = captures(spark, sf).select(F.lit("capture").alias("kind"), "n", F.col("capture").alias("side"))
    return arms.unionByName(sides, allowMissingColumns=True)


@query(
    "set6_subset",
    "select o_orderkey, list_has_all(string_split(o_orderpriority, '-'), ['LOW']) as has_required from orders",
)
def set6_subset(spark, sf):
    missing = F.array_except(F.array(F.lit("LOW")), F.split("o_orderpriority", "-"))
    return table(spark, sf, "orders").select("o_orderkey", (F.size(missing) == 0).alias("has_required"))


@query("win5_sink_order", "select c_custkey, row_number() over (order by c_acctbal, c_custkey) as position from customer")
def win5_sink_order(spark, sf):
    """Global order at the sink: a range exchange gives ordered partitions, and their sizes give the positions."""
    from evigrid.functions.ordered import PIECE, row_numbers, with_piece

    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    numbered = row_numbers(
        with_piece(c, "c_acctbal", "c_custkey"), [], [F.col("c_acctbal"), F.col("c_custkey")], F.col(PIECE), "position"
    )
    return numbered.orderBy("c_acctbal", "c_custkey").select("c_custkey", "position")
