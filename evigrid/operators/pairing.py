"""Joins which pair rows of evidence, and the set operations around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, running_sums, with_piece
from evigrid.session import materialise


def reference_and_candidates(df: DataFrame, arm: str = "arm_id", reference: str | None = None):
    """Split by arm. Without a registered reference the smallest arm id is the reference."""
    if reference is not None:
        return df.where(F.col(arm) == reference), df.where(F.col(arm) != reference)
    smallest = df.agg(F.min(arm)).scalar()
    return df.where(F.col(arm) == smallest), df.where(F.col(arm) != smallest)


def arms_together(
    df: DataFrame, keys: Sequence[str], arm: str, reference: str, columns: Sequence[str]
) -> DataFrame:
    """Reference and candidate rows of the same key side by side as structs ``ref`` and ``cand``, from one pass.

    A key has one row per arm and arms are registered, so what one aggregate brings together is short; the input is
    not read a second time as a self-join would. A second row of an arm would be a choice or a product, so it stops the query.
    """
    side = F.struct(F.col(arm).alias("arm"), *[F.col(c) for c in columns])
    here = F.col(arm) == reference
    met = df.groupBy(*keys).agg(
        F.max(F.when(here, side)).alias("ref"), F.count_if(here).alias("__refs"), F.collect_list(F.when(~here, side)).alias("__cands")
    )
    arms = F.transform("__cands", lambda c: c["arm"])
    repeated = (F.col("__refs") > 1) | (F.size(F.array_distinct(arms)) < F.size(arms))
    message = F.concat(F.lit("an arm has several rows at key "), F.to_json(F.struct(*keys)))
    once = F.when(repeated, F.raise_error(message)).otherwise(F.col("__cands"))
    return met.where(F.col("ref").isNotNull()).select(*keys, "ref", F.explode(once).alias("cand"))


def paired_blocks(
    blocks: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("horizon", "block_id"),
    arm: str = "arm_id", reference: str | None = None,
) -> DataFrame:
    """Candidate minus reference on blocks complete for both, inside one stratum.

    With a registered reference the blocks are computed once; the default reference needs a look at all arms first.
    """
    complete = blocks.where("complete")
    if reference is not None:
        met = arms_together(complete, keys, arm, reference, metrics)
        return met.select(
            F.lit(reference).alias("reference"), F.col("cand.arm").alias("candidate"), *keys,
            *[(F.col(f"cand.{m}") - F.col(f"ref.{m}")).alias(m) for m in metrics],
        )
    ref, cand = reference_and_candidates(complete, arm, reference)
    ref = ref.select(*keys, F.col(arm).alias("reference"), *[F.col(m).alias(f"__r_{m}") for m in metrics])
    return cand.join(ref, list(keys)).select(
        "reference", F.col(arm).alias("candidate"), *keys, *[(F.col(m) - F.col(f"__r_{m}")).alias(m) for m in metrics]
    )


def complete_units(
    df: DataFrame, unit: Sequence[str], member: Sequence[str], required: int, good: Column | None = None
) -> DataFrame:
    """Relational division: units which have all ``required`` members (all of them good)."""
    rows = df if good is None else df.where(good)
    distinct = rows.select(*unit, *member).distinct()
    return distinct.groupBy(*unit).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") == required).drop("__k")


def full_compare(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Full outer join of two projections of the same facts, with presence and null-safe equality per row."""
    a = left.select(*keys, F.lit(True).alias("in_left"), *[F.col(v).alias(f"{v}_left") for v in values])
    b = right.select(*keys, F.lit(True).alias("in_right"), *[F.col(v).alias(f"{v}_right") for v in values])
    joined = a.join(b, list(keys), "full_outer")
    equal = reduce(
        lambda x, y: x & y, [F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right")) for v in values], F.lit(True)
    )
    state = (
        F.when(F.col("in_right").isNull(), "missing_right").when(F.col("in_left").isNull(), "missing_left")
        .when(equal, "equal").otherwise("different")
    )
    return joined.withColumn("state", state).drop("in_left", "in_right")


def grid_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and unexpected keys of a registered grid."""
    tagged = full_compare(expected.select(*keys).distinct(), observed.select(*keys).distinct(), keys, [])
    return tagged.where(F.col("state") != "equal").select(
        *keys, F.when(F.col("state") == "missing_right", "missing").otherwise("unexpected").alias("gap")
    )


def nearest_match(
    targets: DataFrame, observations: DataFrame, key: str, target_time: str, time: str, tolerance: int,
    target_columns: Sequence[str], carry: Sequence[str],
) -> DataFrame:
    """Nearest observation within ``tolerance`` of each target; the earlier one wins a tie.

    Time is cut into buckets as wide as the tolerance, so the match is an equi-join on (key, bucket) over three
    neighbouring buckets. The best candidate is a ``min_by`` and combines before the shuffle.
    """
    width = F.lit(tolerance)
    wide = targets.withColumn(
        "__b", F.explode(F.array(*[F.floor(F.col(target_time) / width) + i for i in (-1, 0, 1)]))
    )
    obs = observations.select(key, time, *carry).withColumn("__b", F.floor(F.col(time) / width))
    near = wide.join(obs, [key, "__b"]).where(F.abs(F.col(time) - F.col(target_time)) <= tolerance)
    rank = F.struct(F.abs(F.col(time) - F.col(target_time)), F.col(time), *[F.col(c) for c in carry])
    best = near.groupBy(*target_columns).agg(F.min_by(F.struct(time, *carry), rank).alias("__m"))
    return best.select(*target_columns, F.col(f"__m.{time}"), *[F.col(f"__m.{c}") for c in carry])


def overlap_counts(
    left: DataFrame, right: DataFrame, left_id: str, left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """How many right spans overlap each left span (``a.start < b.end and b.start < a.end``).

    Equals the spans begun before the left end minus those over by the left start, so the answer comes from running
    counts over one ordered timeline and no pair is produced. Right spans must have positive length. The timeline is cut
    where its marks are, so a dense hour spreads over many tasks and the carry has one row per piece.
    """
    a0, a1 = left_span
    b0, b1 = right_span

    def marks(df: DataFrame, identity: Column, entries: Sequence[tuple[str, str, int]]) -> DataFrame:
        rows = F.array(
            *[F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(o).alias("o")) for t, kind, o in entries]
        )
        return df.select(identity.alias(left_id), F.inline(rows))

    kind_of = dict(left.dtypes)[left_id]
    # at equal times: a left end is read before right starts, a left start after right ends
    timeline = marks(left, F.col(left_id), [(a1, "read_end", 0), (a0, "read_start", 2)]).unionByName(
        marks(right, F.lit(None).cast(kind_of), [(b0, "start", 1), (b1, "end", 1)])
    )
    counted = running_sums(
        with_piece(timeline, "t", "o"), [], [F.col("t"), F.col("o")], F.col(PIECE),
        {"begun": (F.col("kind") == "start").cast("bigint"), "over": (F.col("kind") == "end").cast("bigint")},
    )
    return counted.where(F.col("kind").isin("read_end", "read_start")).groupBy(left_id).agg(
        (F.max(F.when(F.col("kind") == "read_end", F.col("begun")))
         - F.max(F.when(F.col("kind") == "read_start", F.col("over")))).alias("overlaps")
    )


def exposed(
    left: DataFrame, history: DataFrame, identity: Sequence[str], first: str, second: str, second_applies: str
) -> DataFrame:
    """Rows of ``left`` with a history row equal on ``first``, or equal on ``second`` where ``second_applies``.

    The disjunction becomes two joins to distinct keys, which never multiply rows, instead of a nested loop over pairs.
    """
    one = history.select(first).distinct().withColumn("__one", F.lit(True))
    two = history.where(second_applies).select(second).distinct().withColumn("__two", F.lit(True))
    marked = left.join(one, first, "left").join(two, second, "left")
    return marked.where(F.col("__one").isNotNull() | F.col("__two").isNotNull()).select(*identity)


def alignment(df: DataFrame, arm: str, reference: str, keys: Sequence[str], target: str) -> DataFrame:
    """Whether each arm has exactly the reference's keys with equal targets.

    A key gathers its few arms once; counting matches against both sizes replaces a full outer join per arm.
    """
    side = F.struct(F.col(arm).alias("arm"), F.col(target).alias("target"))
    met = df.groupBy(*keys).agg(F.max(F.when(F.col(arm) == reference, side)).alias("ref"), F.collect_list(side).alias("__arms"))
    rows = met.select(F.explode("__arms").alias("a"), "ref")
    same = F.col("ref").isNotNull() & F.col("a.target").eqNullSafe(F.col("ref.target"))
    per = rows.groupBy(F.col("a.arm").alias(arm)).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(same).alias("matched"))
    # one row per arm
    wanted = F.max(F.when(F.col(arm) == reference, F.col("n_keys"))).over(W.partitionBy(F.lit(0)))
    return per.withColumn(
        "aligned", F.coalesce((F.col("matched") == F.col("n_keys")) & (F.col("matched") == wanted), F.lit(False))
    )


def reference_lookup(
    records: DataFrame, references: DataFrame, key: Sequence[str], metrics: Sequence[str], status: str,
    coverage: str | None = None,
) -> DataFrame:
    """Self-join each record to its registered reference and state what the comparison is worth.

    ``references`` is a small registered table ``(*key, ref_<key>, matched_coverage)``; a record without a row there
    has no registered reference. Where ``matched_coverage`` is set, both evaluation sets must be the same.
    """
    ref_keys = [f"ref_{k}" for k in key]
    other = records.select(
        *[F.col(k).alias(f"ref_{k}") for k in key], F.col(status).alias("__rs"),
        *[F.col(m).alias(f"reference_{m}") for m in metrics],
        *([F.col(coverage).alias("__rc")] if coverage else [F.lit("").alias("__rc")]),
    )
    joined = records.join(references, list(key), "left").join(other, ref_keys, "left")
    own = F.col(coverage) if coverage else F.lit("")
    itself = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"ref_{k}") for k in key])
    state = (
        F.when(F.col(status) != "succeeded", "data_unavailable")
        .when(F.col(ref_keys[0]).isNull(), "no_registered_reference")
        .when(F.coalesce(F.col("__rs") != "succeeded", F.lit(True)), "reference_unavailable")
        .when(F.coalesce("matched_coverage", F.lit(False)) & ~F.coalesce(own == F.col("__rc"), F.lit(False)), "requires_coverage_matched_reference")
        .when(itself, "reference")
        .otherwise("exploratory_point_estimate")
    )
    comparable = state.isin("reference", "exploratory_point_estimate")
    return joined.select(
        *key, *ref_keys, state.alias("comparison_status"),
        *[F.when(comparable, F.col(m) - F.col(f"reference_{m}")).alias(f"delta_{m}") for m in metrics],
    )


def ancestor_closure(edges: DataFrame, rank: Column, max_depth: int = 32) -> DataFrame:
    """Root, depth and strictest rank above every node of a parent chain.

    Jumps double each round, so a chain of 32 takes five joins. ``resolved`` is false where no root is reached
    within ``max_depth`` (a cycle or a chain which is too long) and where a parent has no row of its own. Each round is written to the shared folder, so the
    plan does not grow.
    """
    node = edges.select(
        F.col("child").alias("node"), F.col("parent").alias("jump"), rank.alias("strictest"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.coalesce("parent", "child").alias("top"), F.lit(False).alias("dangling"),
    )
    reach = 1
    while reach <= max_depth:
        step = node.select(
            F.col("node").alias("jump"), F.col("jump").alias("__next"), F.col("strictest").alias("__rank"),
            F.col("depth").alias("__depth"), F.col("top").alias("__top"), F.col("dangling").alias("__dangling"),
        )
        hop = node.where(F.col("jump").isNotNull()).join(step, "jump", "left").select(
            "node", F.col("__next").alias("jump"), F.greatest("strictest", "__rank").alias("strictest"),
            (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.coalesce("__top", "top").alias("top"),
            (F.col("dangling") | F.coalesce("__dangling", F.lit(True))).alias("dangling"),
        )
        node = materialise(hop.unionByName(node.where(F.col("jump").isNull())))
        reach *= 2
        if node.where(F.col("jump").isNotNull()).isEmpty():
            break
    resolved = F.col("jump").isNull() & ~F.col("dangling") & (F.col("depth") <= max_depth)
    return node.select(
        "node", F.when(resolved, F.col("top")).alias("root"), F.when(resolved, F.col("depth")).alias("depth"),
        F.when(resolved, F.col("strictest")).alias("strictest"), resolved.alias("resolved"),
    )


def lineage_states(
    objects: DataFrame, references: DataFrame, rank: Column, max_depth: int = 32, max_visits: int = 10_000
) -> DataFrame:
    """State, depth, visits and strictest rank of every object that may refer to several others.

    ``objects`` has one row per ``node``, ``references`` the pairs ``child``, ``parent``; repeated pairs count once. Per node:

    * ``state``: ``cycle`` if a walk of at most ``max_depth`` references comes back to an object it has met; else ``too_long`` if one goes
      on beyond that; else ``dangling`` if one ends at an object without a row; else ``too_many`` beyond ``max_visits`` visits; else ``resolved``
    * of resolved nodes ``depth`` (references of the longest walk), ``visits`` (objects met, on each walk again) and ``strictest``, the
      highest rank met.

    Levels are peeled from the ends: a round takes the nodes all of whose references are known and hands their values to
    those who refer to them, so each reference is joined once and a round reads only the last level. What is left after
    ``max_depth`` rounds lies above a cycle or too deep; only from there walks are followed, to tell the two apart.
    """
    node = objects.select("node", rank.cast("bigint").alias("own"))
    pairs = references.where(F.col("parent").isNotNull()).select("child", "parent").distinct()
    known = node.select(F.col("node").alias("__seen"))
    pairs = materialise(
        pairs.join(known, F.col("child") == F.col("__seen"), "left_semi").join(known, F.col("parent") == F.col("__seen"), "left")
        .select("child", "parent", F.col("__seen").isNull().alias("missing"))
    )
    counts = pairs.groupBy("child").agg(F.count(F.lit(1)).alias("open"), F.bool_or("missing").alias("dangling"))
    unmet = pairs.where("missing").groupBy("child").agg(F.count(F.lit(1)).alias("gone"))
    zero = F.lit(0).cast("bigint")
    waiting = materialise(
        node.join(counts, F.col("node") == counts["child"], "left").drop("child").join(unmet, F.col("node") == unmet["child"], "left")
        .select(
            "node", F.coalesce(F.col("open") - F.coalesce("gone", zero), zero).alias("open"), F.coalesce("dangling", F.lit(False)).alias("dangling"),
            "own", F.when(F.col("gone") > 0, 1).otherwise(0).cast("bigint").alias("depth"), (1 + F.coalesce("gone", zero)).alias("visits"),
        )
    )
    inner = pairs.where("not missing").select("child", "parent")
    done: DataFrame | None = None
    for _ in range(max_depth + 1):
        level = waiting.where("open = 0")
        level = materialise(level)
        if level.isEmpty():
            break
        done = level if done is None else done.unionByName(level)
        told = inner.join(level.withColumnRenamed("node", "parent"), "parent").groupBy("child").agg(
            F.count(F.lit(1)).alias("__n"), F.bool_or("dangling").alias("__dangling"), F.max("own").alias("__own"),
            F.max("depth").alias("__depth"), F.sum("visits").alias("__visits"),
        )
        waiting = materialise(
            waiting.where("open > 0").join(told, F.col("node") == F.col("child"), "left").select(
                "node", (F.col("open") - F.coalesce("__n", zero)).alias("open"),
                (F.col("dangling") | F.coalesce("__dangling", F.lit(False))).alias("dangling"), F.greatest("own", "__own").alias("own"),
                F.greatest("depth", F.col("__depth") + 1).alias("depth"),
                # beyond the bound the number no longer matters
                F.least(F.col("visits") + F.coalesce("__visits", zero), F.lit(max_visits + 1).cast("bigint")).alias("visits"),
            )
        )
    state = (
        F.when(F.col("depth") > max_depth, "too_long").when(F.col("dangling"), "dangling").when(F.col("visits") > max_visits, "too_many")
        .otherwise("resolved")
    )
    peeled = waiting.where("false").withColumn("state", F.lit("")) if done is None else done.withColumn("state", state)
    left = waiting.select("node").where("open > 0") if done is None else waiting.join(done.select("node"), "node", "left_anti").select("node")
    left = materialise(left)
    cyclic = _short_cycles(left, inner, max_depth)
    stuck = left.join(cyclic, "node", "left").select("node", F.when(F.col("cyclic"), "cycle").otherwise("too_long").alias("state"))
    whole = F.col("state") == "resolved"
    return peeled.select(
        "node", "state", F.when(whole, F.col("depth")).alias("depth"), F.when(whole, F.col("visits")).alias("visits"),
        F.when(whole, F.col("own")).alias("strictest"),
    ).unionByName(stuck, allowMissingColumns=True)


def _short_cycles(nodes: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """The ``node`` s of which a walk of at most ``max_depth`` references meets an object again, with ``cyclic``."""
    empty = nodes.select("node", F.lit(True).alias("cyclic"))
    if nodes.isEmpty():
        return empty
    inside = materialise(
        pairs.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
        .join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent")
    )
    rings = _rings(inside, max_depth)
    if rings is None:
        return empty.where("false")
    # from the rings against the references: a node enters once, with the most references that its walks may still have
    active: DataFrame | None = None
    met: DataFrame | None = None
    shortest = rings.agg(F.min("ring")).first()[0]
    for left in range(max_depth - shortest, -1, -1):
        entering = rings.where(F.col("ring") == max_depth - left).select("node")
        if active is not None:
            entering = entering.union(inside.join(active.withColumnRenamed("node", "parent"), "parent").select("child")).distinct()
        if met is not None:
            entering = entering.join(met, "node", "left_anti")
        active = materialise(entering)
        met = active if met is None else met.unionByName(active)
    return met.withColumn("cyclic", F.lit(True))


def _rings(pairs: DataFrame, max_depth: int) -> DataFrame | None:
    """``node`` and ``ring``, the references of the shortest way from the node back to it, up to ``max_depth``; None without any.

    Each ring has one highest node, and a reference from a lower node enters it there. Ways are followed only from nodes which such a
    reference enters, over lower ones: forward first, then back over what was met. If most references go upwards, the order
    is turned round. So objects that merely lead to a ring, or lie in long chains, start no way.
    """
    loops = pairs.where("child = parent").select(F.col("child").alias("node"), F.lit(1).alias("ring"))
    edges = pairs.where("child <> parent")
    ups, all_edges = edges.agg(F.count_if(F.col("parent") > F.col("child")), F.count(F.lit(1))).first()
    turned = 2 * ups > all_edges

    def lower(a: str, b: str) -> Column:
        return F.col(a) > F.col(b) if turned else F.col(a) < F.col(b)

    heads = edges.where(lower("child", "parent")).select(F.col("parent").alias("head")).distinct()
    frontier = materialise(
        edges.join(heads, F.col("child") == F.col("head")).where(lower("parent", "head"))
        .select("head", F.col("parent").alias("at"), F.lit(1).alias("there"))
    )
    met = frontier
    for steps in range(2, max_depth):
        if frontier.isEmpty():
            break
        further = (
            frontier.select("head", "at").join(edges.withColumnRenamed("child", "at"), "at").where(lower("parent", "head"))
            .select("head", F.col("parent").alias("at")).distinct()
        )
        frontier = materialise(further.join(met.select("head", "at"), ["head", "at"], "left_anti").withColumn("there", F.lit(steps)))
        met = met.unionByName(frontier)
    met = materialise(met)
    frontier = materialise(
        edges.withColumnsRenamed({"parent": "head", "child": "at"}).join(met, ["head", "at"]).where(F.col("there") < max_depth)
        .select("head", "at", "there", F.lit(1).alias("back"))
    )
    closed = frontier
    for steps in range(2, max_depth):
        if frontier.isEmpty():
            break
        further = (
            frontier.select("head", F.col("at").alias("parent")).join(edges, "parent").select("head", F.col("child").alias("at")).distinct()
            .join(met, ["head", "at"]).where(F.col("there") + steps <= max_depth)
        )
        frontier = materialise(
            further.join(closed.select("head", "at"), ["head", "at"], "left_anti").select("head", "at", "there", F.lit(steps).alias("back"))
        )
        closed = closed.unionByName(frontier)
    ways = closed.select(F.col("at").alias("node"), (F.col("there") + F.col("back")).alias("ring"))
    tops = closed.where("back = 1").select(F.col("head").alias("node"), (F.col("there") + 1).alias("ring"))
    found = materialise(loops.union(ways).union(tops).groupBy("node").agg(F.min("ring").alias("ring")))
    return None if found.isEmpty() else found


def equal_pair_counts(fingerprints: DataFrame, role: str | None = None, fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs of equal sequences within and across roles from group sizes alone: no pair is ever produced."""
    keys = [role] if role else []
    sizes = fingerprints.groupBy(fingerprint, *keys).agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy(fingerprint).agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("within")
    )
    every = (F.col("all") * (F.col("all") - 1) / 2).cast("bigint")
    return per.agg(
        F.count_if(F.col("all") > 1).alias("repeated_sequences"),
        F.coalesce(F.sum("within"), F.lit(0)).alias("pairs_within"),
        F.coalesce(F.sum(every - F.col("within")), F.lit(0)).alias("pairs_across"),
    )


def split_leakage(df: DataFrame, split: str, identities: Mapping[str, str]) -> DataFrame:
    """Distinct identities shared by each pair of splits, per kind of identity.

    An identity first becomes one row with the set of splits it occurs in, so the pairing is over splits, of which
    there are a handful, and never over the rows of an identity.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in identities.items()])
    sets = df.select(split, F.inline(kinds)).groupBy("kind", "id").agg(
        F.array_sort(F.collect_set(split)).alias("s")
    )
    pairs = F.flatten(
        F.transform(
            "s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))
        )
    )
    return sets.where(F.size("s") > 1).select("kind", F.inline(pairs)).groupBy("kind", "split_a", "split_b").agg(
        F.count(F.lit(1)).alias("shared")
    )


def two_way_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side without a partner, duplicates counted; empty means equal as multisets.

    One union and one aggregate: both directions come out of the same shuffle.
    """
    columns = left.columns
    tagged = left.select(*columns, F.lit(1).alias("__d")).unionByName(right.select(*columns, F.lit(-1).alias("__d")))
    net = tagged.groupBy(*columns).agg(F.sum("__d").alias("__d")).where(F.col("__d") != 0)
    return net.select(
        *columns, F.when(F.col("__d") > 0, "only_left").otherwise("only_right").alias("side"), F.abs("__d").alias("copies")
    )


def ambiguous_versions(entries: DataFrame, version: Sequence[str], payload: Sequence[str], status: str) -> DataFrame:
    """One row per version tuple; a version with differing payloads is demoted to ``ambiguous``."""
    content = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in payload])
    return entries.groupBy(*version).agg(
        F.when(F.min(content) == F.max(content), F.min(status)).otherwise("ambiguous").alias("status"),
        F.count(F.lit(1)).alias("entries"),
    )


def rank_latest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by aggregate instead of a sorted window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, "__r.*")


