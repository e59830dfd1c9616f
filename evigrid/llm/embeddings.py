"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Each vector gets a sketch, one sign bit per random hyperplane. Table t of ``tables`` keys a vector by ``width`` of these bits. ``width`` grows
with the logarithm of the number of vectors, so a bucket keeps about ``bucket_rows`` of them, and ``tables`` follows from it: a pair exactly at
the threshold meets in no table with a probability of at most ``miss``; closer pairs are missed far more rarely. A pair belongs to the first table it
meets in, so nothing is counted twice and no pairs are stored.

1. Equal vectors become one node with a weight.
2. Sketches (not vectors) are dealt to their buckets. Members of a bucket whose sketches differ in few enough bits are *active* there.
3. Vectors go only to the buckets where they are active. There the cosines are counted in double precision, tile by tile; a tile
   returns one row per member: the weight of its partners, and the smallest node of its own component within the tile.
4. Weights are summed, and the components of all tiles are joined by minimum labels.

A bucket of more than twice ``bucket_rows`` is dealt as pairs of tiles, each a group of its own, so a dense cloud of vectors never meets in one task;
its cosines are the square of its size, its rows are not.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths are not linked; repeated ids are vectors of their own; a null id takes part, but does not name a component; an
empty table gives no rows. The length of a vector does not matter for its cosine.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import map_batches, ship
from evigrid.llm.components import smallest_labels
from evigrid.session import materialise

THRESHOLD = 0.9
BUCKET_ROWS = 2_048
#: probability that a pair exactly at the threshold meets in no table, and that its sketches differ in more bits than allowed
MISS = 1e-4
MISS_BITS = 1e-6
SEED = 42
ROWS_AT_A_TIME = 512
_WORD = 64
#: most words of a sketch; beyond them the keys of the tables share bits
MOST_WORDS = 8


class Plan(NamedTuple):
    """Bits of a key, number of tables, words of a sketch, most differing bits in the first word and in all."""

    width: int
    tables: int
    words: int
    first_bits: int
    all_bits: int


def _differing(bits: int, share: float) -> np.ndarray:
    """Probability of each number of differing bits."""
    d = np.arange(bits + 1)
    fold = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in d])
    return np.exp(fold + d * math.log(share) + (bits - d) * math.log1p(-share))


def _most_bits(bits: int, share: float, miss: float) -> int:
    """Smallest number of differing bits that a pair exceeds with a probability of at most ``miss``."""
    return int(np.nonzero(1 - np.cumsum(_differing(bits, share)) <= miss)[0][0])


def missed(p: Plan, share: float) -> float:
    """Probability that a pair whose signs differ with probability ``share`` meets in no table."""
    bits = p.words * _WORD
    if p.width * p.tables <= bits:
        return (1 - (1 - share) ** p.width) ** p.tables
    # keys are drawn from one pool of bits: a pair that differs in d of them meets in a table if all drawn bits are among the others
    d = np.arange(bits + 1)
    meet = np.ones(bits + 1)
    for i in range(p.width):
        meet *= np.maximum(bits - d - i, 0) / (bits - i)
    return float((_differing(bits, share) * (1 - meet) ** p.tables).sum())


def plan(rows: int, threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS, miss: float = MISS) -> Plan:
    share = math.acos(threshold) / math.pi
    width = max(1, math.ceil(math.log2(rows / bucket_rows))) if rows > bucket_rows else 1
    tables = 1
    while True:
        words = min(MOST_WORDS, max(2, -(-width * tables // _WORD)))
        found = Plan(width, tables, words, 0, 0)
        if missed(found, share) <= miss:
            break
        tables += 1
    return found._replace(first_bits=_most_bits(_WORD, share, MISS_BITS), all_bits=_most_bits(words * _WORD, share, MISS_BITS))


@functools.lru_cache(maxsize=8)
def _places(width: int, tables: int, bits: int) -> np.ndarray:
    """Bits of each table's key: bits of its own as long as they last, else drawn from the sketch."""
    if width * tables <= bits:
        return np.arange(width * tables).reshape(tables, width)
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(tables)])


@functools.lru_cache(maxsize=8)
def _planes(size: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, bits))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so very large and very small components do no harm."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def keys_of(sketches: np.ndarray, p: Plan) -> np.ndarray:
    """Keys of each table, from sketches as rows of bytes."""
    bits = np.unpackbits(sketches, axis=1, bitorder="little")[:, _places(p.width, p.tables, p.words * _WORD)]
    return bits.astype(np.int64) @ (1 << np.arange(p.width, dtype=np.int64))


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _marked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row, vec_id, vector, digest``, stored; the vector is null where it cannot be compared."""
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )

    def read(batch: pa.RecordBatch) -> dict:
        out: dict = {"row": batch.column("row"), "vec_id": batch.column("vec_id"), "vector": [], "digest": []}
        for values in batch.column("vector"):
            data = None
            if values.is_valid and len(values.values) and not values.values.null_count:
                one = values.values.to_numpy() + 0.0
                if np.isfinite(one).all() and one.any():
                    small = one.astype(np.float32)
                    # most embeddings are single precision: half the bytes, the same numbers
                    data = (b"f" + small.tobytes()) if np.array_equal(small, one) else (b"d" + one.tobytes())
            out["vector"].append(data)
            out["digest"].append(None if data is None else xxhash.xxh3_128_digest(data))
        return out

    kind = source.schema["vec_id"].dataType.simpleString()
    return materialise(map_batches(source, read, f"row bigint, vec_id {kind}, vector binary, digest binary"))


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype=np.float32 if data[:1] == b"f" else np.float64)


def _sketched(batch: pa.RecordBatch, p: Plan) -> np.ndarray:
    """Sketches of the vectors of a batch as rows of bytes."""
    vectors = [_numbers(v) for v in batch.column("vector").to_pylist()]
    out = np.zeros((len(vectors), p.words * _WORD // 8), dtype=np.uint8)
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes).tolist():
        at = np.nonzero(sizes == size)[0]
        out[at] = np.packbits(units(np.stack([vectors[i] for i in at])) @ _planes(size, p.words * _WORD) >= 0, axis=1, bitorder="little")
    return out


def _member_tiles(size: Column, bucket_rows: int) -> Column:
    """Pairs of tiles that a member of a bucket goes to: number of tiles, lower and higher tile in one number."""
    count = F.when(size > 2 * bucket_rows, F.ceil(size / bucket_rows)).otherwise(1).cast("bigint")
    own = F.pmod(F.col("node"), count)

    def pair(other: Column) -> Column:
        low, high = F.least(own, other), F.greatest(own, other)
        return count * F.lit(1 << 42) + low * F.lit(1 << 21) + high

    return F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), pair)


def _sides(nodes: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Members of the lower and of the higher tile of a pair; no higher one where a tile meets itself."""
    count, low, high = tile >> 42, tile >> 21 & 0x1FFFFF, tile & 0x1FFFFF
    own = nodes % count
    return np.nonzero(own == low)[0], None if low == high else np.nonzero(own == high)[0]


def _first_here(keys: np.ndarray, one: np.ndarray, two: np.ndarray, table: int) -> np.ndarray:
    """Of pairs that share a bucket of ``table``, those that share none of an earlier one."""
    earlier = np.zeros(len(one), dtype=bool)
    for t in range(table):
        earlier |= keys[one, t] == keys[two, t]
    return ~earlier


def _blocks(nodes: np.ndarray, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index ranges whose pairs are a tile's pairs; True where only pairs above the diagonal count."""
    low, high = _sides(nodes, tile)
    for start in range(0, len(low), ROWS_AT_A_TIME):
        rows = low[start : start + ROWS_AT_A_TIME]
        yield rows, low[start:] if high is None else high, high is None


def _upper(hit: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    r, c = np.nonzero(hit)
    if diagonal:
        above = c > r
        r, c = r[above], c[above]
    return r, c


def active_members(nodes: np.ndarray, sketches: np.ndarray, table: int, tile: int, p: Plan) -> np.ndarray:
    """Members that have a candidate partner in a tile pair of a bucket."""
    words = sketches.view(np.uint64)
    keys = keys_of(sketches, p)
    active = np.zeros(len(nodes), dtype=bool)
    for rows, columns, diagonal in _blocks(nodes, tile):
        near = np.bitwise_count(words[rows, None, 0] ^ words[None, columns, 0]) <= p.first_bits
        r, c = _upper(near, diagonal)
        one, two = rows[r], columns[c]
        differing = np.bitwise_count(words[one] ^ words[two]).sum(axis=1, dtype=np.int64)
        kept = differing <= p.all_bits
        one, two = one[kept], two[kept]
        here = _first_here(keys, one, two, table)
        active[one[here]] = True
        active[two[here]] = True
    return nodes[active]


def linked_members(
    nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, sketches: np.ndarray, table: int, tile: int, p: Plan, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each member's partners in a tile pair, and the smallest node of its component there."""
    keys = keys_of(sketches, p)
    links = np.zeros(len(nodes), dtype=np.int64)
    root = nodes.copy()
    for rows, columns, diagonal in _blocks(nodes, tile):
        r, c = _upper(vectors[rows] @ vectors[columns].T >= threshold, diagonal)
        one, two = rows[r], columns[c]
        here = _first_here(keys, one, two, table)
        one, two = one[here], two[here]
        np.add.at(links, one, weights[two])
        np.add.at(links, two, weights[one])
        # labels fall until the pairs of this block agree; rows of one root fall together
        while True:
            low = np.minimum(root[one], root[two])
            if not (np.any(root[one] != low) or np.any(root[two] != low)):
                break
            names, where = np.unique(root, return_inverse=True)
            best = names.copy()
            np.minimum.at(best, where[one], low)
            np.minimum.at(best, where[two], low)
            root = best[where]
    return links, root


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    bucket_rows: int = BUCKET_ROWS,
    miss: float = MISS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors with a cosine of ``threshold`` or more), ``component_id`` (smallest id
    that links reach), ``kept`` (whether it is that one).
    """
    spark = vectors.sparkSession
    ship(spark)
    marked = _marked(vectors, id_col, vector_col)
    equal = marked.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("weight"))
    copies = materialise(
        marked.select("row", "digest").join(equal.where("weight > 1"), "digest").select("row", "node", "weight")
    )
    # Spark broadcasts the copies where their stored size allows it
    others = copies.where("row <> node").select("row")
    points = marked.where("vector is not null").join(others, "row", "left_anti").select(F.col("row").alias("node"), "vector")
    p = plan(points.count(), threshold, bucket_rows, miss)

    def sketch(batch: pa.RecordBatch) -> dict:
        found = _sketched(batch, p)
        return {"node": batch.column("node"), "sketch": [s.tobytes() for s in found], "keys": keys_of(found, p).tolist()}

    # stored once: a second reckoning might round a sign another way
    sketches = materialise(map_batches(points, sketch, "node bigint, sketch binary, keys array<bigint>"))
    cells = sketches.select("node", "sketch", F.posexplode("keys").alias("table", "key"))
    cells = cells.select("node", "sketch", (F.col("table").cast("bigint") * F.lit(1 << 48) + F.col("key")).alias("cell"))
    large = materialise(cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 2 * bucket_rows))
    dealt = cells.join(large, "cell", "left").select(
        "cell", "node", "sketch", F.explode(_member_tiles(F.coalesce("size", F.lit(0)), bucket_rows)).alias("tile")
    )
    width = p.words * _WORD // 8

    def find(key: tuple, group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        kept = active_members(nodes, _bytes(group.column("sketch"), width), key[0].as_py() >> 48, key[1].as_py(), p)
        return pa.table({
            "cell": pa.array([key[0].as_py()] * len(kept), pa.int64()), "tile": pa.array([key[1].as_py()] * len(kept), pa.int64()),
            "node": pa.array(kept, pa.int64()),
        })

    active = materialise(dealt.groupBy("cell", "tile").applyInArrow(find, "cell bigint, tile bigint, node bigint"))
    weights = copies.where("row = node").select("node", "weight")
    wanted = materialise(active.select("node").distinct().join(weights, "node", "left").select("node", F.coalesce("weight", F.lit(1)).alias("weight")))
    moved = active.join(points.join(wanted, "node").join(sketches.select("node", "sketch"), "node"), "node")

    def count(key: tuple, group: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found = [_numbers(v) for v in group.column("vector").to_pylist()]
        sizes = np.array([len(v) for v in found])
        nodes, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        signs = _bytes(group.column("sketch"), width)
        for size in np.unique(sizes).tolist():
            at = np.nonzero(sizes == size)[0]
            one = units(np.stack([found[i] for i in at]))
            links, root = linked_members(
                nodes[at], weight[at], one, signs[at], key[0].as_py() >> 48, key[1].as_py(), p, threshold
            )
            has = links > 0
            out.append((nodes[at][has], links[has], root[has]))
        return pa.table({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(("node", "links", "root"))})

    tiles = materialise(moved.groupBy("cell", "tile").applyInArrow(count, "node bigint, links bigint, root bigint"))
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    edges = tiles.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    labels = smallest_labels(edges)
    named = (
        marked.select("row", "vec_id").join(copies, "row", "left").withColumn("node", F.coalesce("node", "row"))
        .join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    others = (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("bigint")
    named = materialise(named.select("vec_id", "label", others.alias("n_links")))
    smallest = named.where("n_links > 0").groupBy("label").agg(F.min("vec_id").alias("low"))
    component = F.when(F.col("n_links") > 0, F.col("low")).otherwise(F.col("vec_id"))
    return named.join(smallest, "label", "left").select(
        "vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
