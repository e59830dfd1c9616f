"""SimHash near-duplicates by covering locality-sensitive hashing.

A text is lower-cased over A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; every ``width``-word shingle, repeats included, is
hashed with XXH64 (seed 42), and a fingerprint bit is set where more than half of the hashes have it. Two fingerprints are
linked when at most two bits differ.

The candidate search is a covering family: each bit gets a nonzero vector of three bits, and for each of the seven nonzero
three-bit masks a table keeps the bits whose vector has an odd product with the mask. Whatever two bits differ, some mask is
orthogonal to both vectors, so every pair within the radius shares a bucket in some table: no pair is lost. A bucket holds no
pairs of its own. Its members write the fingerprints at most one of the *unkept* bits away, and members that write the same one
are at most two bits apart. A written fingerprint has at most one writer per unkept bit and one more, so no group here grows
with the data, however many near copies one bucket holds.

Components come from minimum labels over the links with hooking and shortcuts, one stored table per round.

Defined cases: null and wordless texts have fingerprint zero, which links like any other; fewer words than ``width`` hash as
one shingle; copies share one fingerprint and one class; a null doc_id takes part in its class, but does not name it (a
class of nulls only has a null component_id); an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import binary_column, id_and_text, map_batches, ship, text_function, whole_text
from evigrid.llm.components import smallest_labels
from evigrid.session import materialise

WIDTH = 3
SEED = 42
RADIUS = 2
BITS = 64
#: near copies of the pipeline: MinHash bands of the search and rows of each, shingle width and similarity of the verification;
#: a pair of similarity s shares a band with probability 1 - (1 - s**BAND_ROWS)**BANDS, 0.9996 at 0.8
BANDS = 20
BAND_ROWS = 5
#: rounds in which each unresolved bucket compares all its members with one of them, before all that is left is searched exactly
STAR_ROUNDS = 2
FAMILIES = 4
VERIFIED_WIDTH = 5
SIMILARITY = 0.8
SLOTS = 1 << 20
#: smallest hashes kept of a shingle set, and how far an estimate may lie under the similarity
SKETCH = 64
SLACK = 0.25
_NO_SHINGLES = np.empty(0, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = np.array([xxhash.xxh64_intdigest(b"row %d" % i) | 1 for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)
_SEEDS = [np.uint64(xxhash.xxh64_intdigest(b"family %d" % i) | 1) for i in range(64)]


class _Words(dict):
    """Hashes of recent words; emptied when it grows over a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_WORDS = _Words()


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    found = text.lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    count = max(1, len(found) - width + 1)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    stops = np.cumsum(sizes)
    begin = (stops - sizes)[:count].tolist()
    end = (stops[min(width, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(begin, end, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.nonzero(2 * ones > count)[0].tolist())


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict:
        values = [fingerprint(t, width) for t in binary_column(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(values, dtype=np.uint64).view(np.int64)}

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bits kept by each of the ``2**(radius+1)-1`` tables. Any ``radius`` bits are left out together by some table."""
    vectors = [1 + b % (2 ** (radius + 1) - 1) for b in range(bits)]
    return [
        sum(1 << b for b, vector in enumerate(vectors) if (vector & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints in column ``fp`` that differ in one or two bits, within ``by``.

    Not every such pair is a row, but any two such fingerprints are joined through one smaller fingerprint that is
    within the radius of both or equal to one of them, so the components are those of all pairs.
    """
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    keyed = points.select(*by, "fp", F.explode(tables).alias("t")).select(
        *by, "fp", F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")
    )
    # a bucket with one member has no pair in its table
    shared = materialise(
        keyed.groupBy(*by, "table", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where(F.col("low") != F.col("high")).select(*by, "table", "key")
    )
    members = keyed.join(shared, [*by, "table", "key"]).select(*by, "table", "fp")
    free: Column = F.lit(None)
    for i, mask in enumerate(masks):
        flips = [0, *[1 << b for b in range(BITS) if not mask >> b & 1]]
        free = F.when(F.col("table") == i, F.array(*[F.lit(_signed(x)) for x in flips])).otherwise(free)
    written = members.select(*by, "table", "fp", F.explode(free).alias("flip")).select(
        *by, "table", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")
    )
    # at most one writer per unkept bit and one more: the list is bounded
    groups = written.groupBy(*by, "table", "near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return (
        groups.select(*by, F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where(F.col("a") != F.col("b")).distinct()
    )


def classes(points: DataFrame) -> DataFrame:
    """``fp``, ``label`` (one of the fingerprints of its class) and ``component_id`` for a table of distinct fingerprints
    with the ``smallest`` id of each.
    """
    labels = smallest_labels(materialise(links(points.select("fp"))))
    named = materialise(
        points.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "smallest", F.coalesce("label", "fp").alias("label"))
    )
    smallest = materialise(named.groupBy("label").agg(F.min("smallest").alias("component_id")))
    return materialise(named.select("fp", "label").join(smallest, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest id that its links reach."""
    marked = materialise(fingerprints(docs, width, id_col, text_col))
    found = classes(materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))))
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def word_fingerprints(text: bytes, families: int = FAMILIES) -> list[int]:
    """Signed 64-bit SimHashes of the bag of words, one per hash family."""
    found = text.lower().split()
    if not found:
        return [0] * families
    codes = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=len(found))
    values, counts = np.unique(codes, return_counts=True)
    weights = counts.astype(np.float32)
    out = np.empty(families, dtype=np.uint64)
    for family in range(families):
        mixed = (values ^ _SEEDS[family]) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _SEEDS[family]
        bits = np.unpackbits((mixed ^ (mixed >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[family] = np.packbits(2 * (weights @ bits.astype(np.float32)) > len(found), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64).tolist()


def shingle_set(text: bytes, width: int = VERIFIED_WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles."""
    found = text.lower().split()
    spans = (b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in spans), dtype=np.uint64)) if found else _NO_SHINGLES


def bands(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key per MinHash band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.empty(len(_MIXERS), dtype=np.uint64)
    for i, mixer in enumerate(_MIXERS):
        mixed = (shingles ^ mixer) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * mixer
        least[i] = (mixed ^ (mixed >> np.uint64(29))).min()
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh3_64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _slots(numbers: Column) -> Column:
    return F.pmod(F.xxhash64(numbers), F.lit(SLOTS)).cast("int")


def verified_links(texts: DataFrame, firsts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` between ``row`` numbers of different texts whose five-word similarity is 0.8 or more.

    ``texts`` is a stored table of ``row`` and ``text``, ``firsts`` names one row of each different text. Candidates are texts that
    share a MinHash band of their shingle sets; a candidate becomes a link only after the Jaccard similarity of the two
    sets is counted. Texts are not shuffled: a bitmap of a fixed number of slots tells each task which of its rows may be
    candidates, and only their shingle sets move.

    Not every link is a row, but the components are those of all candidates that reach the similarity. In a star round each
    bucket compares its members with one of them: first the one with the most neighbours in its buckets, then the one with
    the most links, which is the original among its copies. Buckets within one component are settled. The members of the others
    are searched by ``across_components``, which loses no link between two components and compares no bucket with itself.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column("row"), "keys": [bands(shingle_set(t)) for t in binary_column(batch, "text")]}

    keyed = map_batches(texts.select("row", "text"), cut, "row bigint, keys array<bigint>")
    points = materialise(keyed.join(firsts, "row", "left_semi")).select("row", F.explode("keys").alias("bucket"))
    shared = points.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(points.join(shared, "bucket"))
    weights = members.groupBy("row").agg(F.sum("size").alias("weight"))
    sets = _candidate_sets(texts, materialise(weights.select("row")))

    live = members.select("bucket", "row", F.col("row").alias("label"))
    found: DataFrame | None = None
    tested: DataFrame | None = None
    used: DataFrame | None = None
    for last in [False] * STAR_ROUNDS + [True]:
        if last:
            pairs = across_components(live.select("row", "label").distinct(), sets, similarity)
        else:
            free = live if used is None else live.join(used, ["bucket", "row"], "left_anti")
            rank = F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), F.xxhash64("row", "bucket").alias("h"), "row", "label")
            hubs = materialise(
                free.join(weights, "row", "left").groupBy("bucket").agg(F.max(rank).alias("hub")).select("bucket", "hub.row", "hub.label")
            )
            used = hubs.select("bucket", "row") if used is None else used.unionByName(hubs.select("bucket", "row"))
            pairs = live.toDF("bucket", "x", "lx").join(hubs.toDF("bucket", "y", "ly"), "bucket").where("lx <> ly")
        candidates = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        if tested is not None:
            candidates = candidates.join(tested, ["x", "y"], "left_anti")
        candidates = materialise(candidates)
        tested = candidates if tested is None else tested.unionByName(candidates)
        kept = materialise(_similar(candidates, sets, similarity))
        found = kept if found is None else found.unionByName(kept)
        if last:
            break
        labels = smallest_labels(found)
        placed = members.select("bucket", "row").join(labels.toDF("row", "wide"), "row", "left").select(
            "bucket", "row", F.coalesce("wide", "row").alias("label")
        )
        placed = materialise(placed)
        open_buckets = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        live = materialise(placed.join(open_buckets.select("bucket"), "bucket", "left_semi"))
        if live.isEmpty():
            break
        ends = found.select(F.col("a").alias("row")).unionAll(found.select("b"))
        weights = materialise(ends.groupBy("row").agg(F.count("*").alias("weight")))
    return found


def _size_parts(longest: int = 1 << 40) -> list[int]:
    """The smallest set size of each part: single sizes, then steps of a twentieth."""
    lows = [1]
    while lows[-1] < longest:
        lows.append(max(lows[-1] + 1, lows[-1] * 21 // 20))
    return lows


_PARTS = _size_parts()


def least_common(one: int, two: int, similarity: float) -> int:
    """How many elements two sets of these sizes must share to reach the similarity; rounding never asks for more."""
    return math.ceil(similarity / (1 + similarity) * (one + two) - 1e-6)


def prefix_parts(n: int, similarity: float) -> tuple[int, list[tuple[int, int]]]:
    """How many first elements a set of ``n`` shows to sets as large or larger, and to each part of smaller or equal ones."""
    lowest = max(1, math.ceil(similarity * n - 1e-6))
    parts = range(bisect.bisect_right(_PARTS, lowest) - 1, bisect.bisect_right(_PARTS, n))
    shown = [(part, n - least_common(n, max(lowest, _PARTS[part]), similarity) + 1) for part in parts]
    return n - least_common(n, n, similarity) + 1, shown


def across_components(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``x``, ``y`` of ``rows`` (``row``, ``label``) with different labels, among them all that reach the similarity.

    Prefix filtering: all sets are sorted alike, rarest shingles first. Two sets that share ``o`` shingles share one among the first
    ``n - o + 1`` of each, so only these are keys, with the part of sizes in which the smaller set lies; the place of a common
    shingle also bounds how many can follow. What all copies of a text have in common comes last and is no key, so a group of
    near copies under the similarity makes few pairs. Of each key the label with the most rows is set against the others only.
    """
    chosen = sets.select("row", "n", "shingles").join(rows, "row")

    def spell(batch: pa.RecordBatch) -> dict:
        parts = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
        taken = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
        out = {name: batch.column(name).take(taken) for name in ("row", "label", "n")}
        return out | {"shingle": np.concatenate(parts)}

    spelled = map_batches(chosen, spell, "row bigint, label bigint, n bigint, shingle bigint")
    again = spelled.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    # a list is bounded by its document; shingles of one set alone come before it and are no keys
    ordered = spelled.join(again, "shingle").groupBy("row", "label", "n").agg(
        F.array_sort(F.collect_list(F.struct("sets", "shingle"))).getField("shingle").alias("shared")
    )

    def cut(batch: pa.RecordBatch) -> dict:
        sizes, origin, part, place, shingle, larger = batch.column("n").to_pylist(), [], [], [], [], []
        for i, (n, shared) in enumerate(zip(sizes, batch.column("shared"), strict=True)):
            values = shared.values.to_numpy()
            alone = n - len(values)
            own, others = prefix_parts(n, similarity)
            for is_larger, at, count in [(False, others[-1][0], own), *((True, *x) for x in others)]:
                count = max(0, count - alone)
                origin.append(np.full(count, i))
                part.append(np.full(count, at))
                place.append(np.arange(alone, alone + count))
                shingle.append(values[:count])
                larger.append(np.full(count, is_larger))
        taken = pa.array(np.concatenate(origin))
        out = {name: batch.column(name).take(taken) for name in ("row", "label", "n")}
        names = {"part": part, "place": place, "shingle": shingle, "larger": larger}
        return out | {name: np.concatenate(x) for name, x in names.items()}

    keys = materialise(
        map_batches(ordered, cut, "row bigint, label bigint, n bigint, part int, place bigint, shingle bigint, larger boolean")
    )
    counts = keys.groupBy("shingle", "part", "label").agg(F.count("*").alias("rows"))
    mixed = counts.groupBy("shingle", "part").agg(
        F.max(F.struct("rows", "label"))["label"].alias("main"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("shingle", "part", "main")
    met = materialise(keys.join(mixed, ["shingle", "part"]))
    columns = ["shingle", "part", "label", "row", "n", "place"]
    small, large = (
        met.where(side).select(*columns, (F.col("label") == F.col("main")).alias("main")) for side in ("not larger", "larger")
    )
    small, large = small.toDF("shingle", "part", "lx", "x", "nx", "px", "mx"), large.toDF("shingle", "part", "ly", "y", "ny", "py", "my")
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("nx") + F.col("ny")) - F.lit(1e-6))
    may_link = (
        (F.col("lx") != F.col("ly")) & (F.struct("nx", "x") < F.struct(F.col("ny").alias("nx"), F.col("y").alias("x")))
        & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= least)
    )
    beside = small.where("not mx").join(large, ["shingle", "part"]).where(may_link)
    within = small.where("mx").join(large.where("not my"), ["shingle", "part"]).where(may_link)
    return beside.select("x", "y").unionByName(within.select("x", "y"))


def _candidate_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row``, ``n``, ``sketch`` and ``shingles`` of the wanted rows, stored."""
    # at most SLOTS numbers, whatever the input
    bitmap = np.zeros(SLOTS, dtype=bool)
    bitmap[[r.slot for r in wanted.select(_slots(F.col("row")).alias("slot")).distinct().collect()]] = True
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def sign(batch: pa.RecordBatch) -> dict:
        taken = pa.array(np.nonzero(shared.value[batch.column("slot").to_numpy(zero_copy_only=False)])[0])
        chosen = batch.take(taken)
        sets = [shingle_set(t) for t in binary_column(chosen, "text")]
        # the smallest hashes of a set: two sets' sketches tell how alike they can be
        return {
            "row": chosen.column("row"), "n": [len(x) for x in sets], "sketch": [x[:SKETCH].tobytes() for x in sets],
            "shingles": [x.tobytes() for x in sets],
        }

    signed = map_batches(
        texts.select("row", "text", _slots(F.col("row")).alias("slot")), sign, "row bigint, n bigint, sketch binary, shingles binary"
    )
    return materialise(signed.join(wanted, "row", "left_semi"))


def _similar(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates ``x``, ``y`` whose sets reach the similarity, as ``a``, ``b``."""
    small = sets.select("row", "n", "sketch")
    rough = candidates.join(small.toDF("x", "nx", "kx"), "x").join(small.toDF("y", "ny", "ky"), "y").where(
        F.least("nx", "ny") >= similarity * F.greatest("nx", "ny")
    )

    def estimate(batch: pa.RecordBatch) -> dict:
        kept = []
        for left, right in zip(batch.column("kx").to_pylist(), batch.column("ky").to_pylist(), strict=True):
            one, two = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            joined = np.union1d(one, two)[:SKETCH]
            common = len(np.intersect1d(np.intersect1d(one, two, assume_unique=True), joined, assume_unique=True))
            kept.append(len(joined) > 0 and common >= (similarity - SLACK) * len(joined))
        return {"x": batch.column("x"), "y": batch.column("y"), "kept": kept}

    likely = materialise(map_batches(rough, estimate, "x bigint, y bigint, kept boolean").where("kept").drop("kept"))
    whole = sets.select("row", "shingles")
    met = likely.join(whole.toDF("x", "sx"), "x").join(whole.toDF("y", "sy"), "y")

    def verify(batch: pa.RecordBatch) -> dict:
        kept = []
        for left, right in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
            one, two = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            total = len(one) + len(two) - common
            kept.append(total > 0 and common >= similarity * total)
        return {"a": batch.column("x"), "b": batch.column("y"), "kept": kept}

    return map_batches(met, verify, "a bigint, b bigint, kept boolean").where("kept").select("a", "b")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float | None = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the smallest id, of repeated ids any one.

    Classes join documents whose fingerprints are linked, and documents that ``verified_links`` joins: at 64 bits, two bits
    are far above a similarity of 0.8, and looser near copies share shingles. Without ``similarity`` only the fingerprints count.
    """
    ship(docs.sparkSession)

    marks = text_function(lambda texts: [_signed(fingerprint(t, width)) for t in texts], "bigint")
    stored = materialise(
        docs.select(
            F.struct("*").alias("document"), marks(whole_text()).alias("fp"), F.monotonically_increasing_id().alias("row"),
            F.md5(F.coalesce("text", F.lit(""))).alias("content"),
        )
    )
    slim = stored.select("fp", "row", "content", F.col("document.doc_id").alias("doc_id"))
    found = classes(materialise(slim.groupBy("fp").agg(F.min("doc_id").alias("smallest"))))
    placed = materialise(slim.join(found, "fp").select("row", "doc_id", "content", "label"))
    joined = placed.withColumn("class", F.col("label"))
    if similarity is not None:
        # copies are one text: the search sees each once
        firsts = placed.groupBy("content").agg(F.min("row").alias("row")).select("row")
        texts = stored.select("row", F.coalesce("document.text", F.lit("")).alias("text"))
        pairs = verified_links(texts, firsts, similarity)
        names = placed.select("row", "label")
        met = pairs.join(names.toDF("a", "la"), "a").join(names.toDF("b", "lb"), "b").where(F.col("la") != F.col("lb"))
        wider = smallest_labels(materialise(met.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()))
        joined = placed.join(wider.toDF("node", "wide"), F.col("label") == F.col("node"), "left").withColumn(
            "class", F.coalesce("wide", "label")
        )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    best = joined.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    dropped = materialise(placed.select("row").join(best, "row", "left_anti"))
    # slots of dropped rows, at most SLOTS: rows in other slots stay without a shuffle of their texts
    slots = F.broadcast(materialise(dropped.select(_slots(F.col("row")).alias("slot")).distinct()))
    slotted = stored.withColumn("slot", _slots(F.col("row")))
    unsure = slotted.join(slots, "slot", "left_semi").join(dropped, "row", "left_anti")
    return slotted.join(slots, "slot", "left_anti").select("document.*").unionByName(unsure.select("document.*"))


def as_hex(fp: str = "fp") -> Column:
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
