"""Removal of long repeated byte strings: every byte covered by a ``length``-byte string that also starts elsewhere.

*Sampling.* A string of ``length`` bytes contains ``length-gram+1`` grams; the one with the smallest hash (the leftmost of equals) is its
anchor. Equal strings have the same anchor at the same offset, so strings can only be equal inside a group of equal anchor
grams. The strings of one anchor start in one contiguous range; all of them together are its *context* (at most two lengths).

*Equal contexts.* Anchors carry a digest of their context. A context that occurs twice is repeated as a whole, which settles copies and
the inner part of every shared passage by counting digests: no text moves, hot groups combine before the shuffle.

*Different contexts of one anchor*, the edges of shared passages, are compared exactly. One context of each digest goes
to its anchor's task, where the suffixes that start at the anchor, and the reversed prefixes before it, are sorted by
deep-shallow sorting: multikey quicksort to a shallow depth, blind tries on the groups with long common prefixes. The prefix
order gives a tree of classes with ``i`` equal bytes before the anchor; in each class the neighbours in suffix order tell
how many equal bytes can follow. Groups with more than ``group_limit`` different contexts are settled by counting digests of
their single strings instead, spread over all tasks; the rows are the same.

Sampling sorts a sparse suffix array (about one suffix in 160, and of those only repeated ones) and not that of every byte, which
would have to move each text several hundred times.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; all copies of a text of ``length``
bytes or more lose every byte; repeated documents each get their row; strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import binary_column, id_and_text, map_batches, ship
from evigrid.llm.suffixes import deep_shallow
from evigrid.session import materialise

LENGTH = 400
GRAM = 80
GROUP_LIMIT = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, 1 << 17)
        _POWERS.clear()
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def string_hashes(data: bytes, length: int) -> np.ndarray:
    """Hash of the string of ``length`` bytes at each start."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    values ^= values >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(data)], dtype=np.uint64)])
    mixed = (sums[length:] - sums[:-length]) * down[:n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their gram hashes, and the first and last start of the strings which they are the anchor of."""
    grams = string_hashes(data, gram)
    starts = len(data) - length + 1
    if starts <= 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, np.empty(0, dtype=np.uint64), empty, empty
    # leftmost minimum over a sliding window: by doubling, then one overlapping pair
    window = length - gram + 1
    value, place, span = grams, np.arange(len(grams), dtype=np.int32), 1
    while span * 2 <= window:
        value, place = _smaller(value[:-span], place[:-span], value[span:], place[span:])
        span *= 2
    rest = window - span
    if rest:
        value, place = _smaller(value[:-rest], place[:-rest], value[rest:], place[rest:])
    first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    at = place[first].astype(np.int64)
    return at, grams[at], first, last


def _smaller(v1: np.ndarray, p1: np.ndarray, v2: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right = v2 < v1
    return np.where(right, v2, v1), np.where(right, p2, p1)


def repeated_offsets(
    contexts: list[bytes], anchor: list[int], low: list[int], length: int = LENGTH
) -> list[list[tuple[int, int]]]:
    """For different contexts of one anchor gram: offsets ``i`` (anchor minus start) of strings that another context holds.

    ``anchor`` is the anchor's place in its context and the largest offset, ``low`` the smallest.
    """
    suffixes = [c[a:] for c, a in zip(contexts, anchor, strict=True)]
    prefixes = [c[:a][::-1] for c, a in zip(contexts, anchor, strict=True)]
    order, shared = deep_shallow(suffixes)
    rank = [0] * len(order)
    for r, member in enumerate(order):
        rank[member] = r
    rank_shared = np.array(shared, dtype=np.int64)
    by_prefix, depth = deep_shallow(prefixes)
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    # classes of equal prefixes: ranges of the prefix order between smaller depths
    stack: list[tuple[int, int, int]] = [(0, len(by_prefix), -1)]
    while stack:
        begin, end, above = stack.pop()
        if end - begin < 2:
            continue
        inner = depth[begin + 1 : end]
        level = min(inner)
        members = by_prefix[begin:end]
        ranks = np.array(sorted(rank[m] for m in members), dtype=np.int64)
        # equal bytes after the anchor between neighbours of this class
        steps = np.minimum.reduceat(np.append(rank_shared, 0), np.stack([ranks[:-1] + 1, ranks[1:] + 1], 1).ravel())[::2]
        best = np.maximum(np.append(steps, 0), np.insert(steps, 0, 0)).tolist()
        useful = False
        for r, most in zip(ranks.tolist(), best, strict=True):
            member = order[r]
            first, last = max(above + 1, length - most, low[member]), min(level, anchor[member])
            if first <= last:
                found[member].append((first, last))
            useful = useful or length - most <= anchor[member]
        if not useful:
            # deeper classes are smaller, their neighbours share no more
            continue
        cut = begin
        for i, value in enumerate(inner, begin + 1):
            if value == level:
                stack.append((cut, i, level))
                cut = i
        stack.append((cut, end, level))
    return found


_PLACE = "doc string, at int, low int, high int"


def _key() -> Column:
    """Content digest: equal texts are one text here."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def repeated_starts(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``key``, ``first``, ``last``: ranges of starts, in the text with digest ``key``, of strings that occur elsewhere.

    ``docs`` has ``doc_id`` and ``text``, not null.
    """
    keyed = docs.select(_key().alias("key"), F.col("doc_id").cast("string").alias("doc"), "text")

    def sample(batch: pa.RecordBatch) -> dict:
        origin: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, ...]] = []
        digests: list[np.ndarray] = []
        for i, data in enumerate(binary_column(batch, "text")):
            at, code, first, last = anchors(data, length, gram)
            if len(at):
                origin.append(np.full(len(at), i, dtype=np.int64))
                parts.append((at, code, at - last, at - first))
                spans = zip(first.tolist(), (last + length).tolist(), at.tolist(), strict=True)
                digests.append(
                    np.array([xxhash.xxh3_64_intdigest(data[s:e], seed=a - s) for s, e, a in spans], dtype=np.uint64)
                )
        taken = pa.array(np.concatenate(origin) if origin else np.empty(0, dtype=np.int64))
        at, code, low, high = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0),) * 4
        context = np.concatenate(digests) if digests else np.empty(0)
        return {
            "key": batch.column("key").take(taken), "doc": batch.column("doc").take(taken), "at": at.astype(np.int32),
            "low": low.astype(np.int32), "high": high.astype(np.int32), "gram": code.astype(np.uint64).view(np.int64),
            "context": context.astype(np.uint64).view(np.int64),
        }

    sampled = materialise(map_batches(keyed, sample, f"key binary, {_PLACE}, gram bigint, context bigint"))
    counted = materialise(
        sampled.groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "doc", "at", "low", "high")).alias("one")
        )
    )
    again = materialise(counted.where(F.col("n") > 1).select("gram", "context"))
    whole = sampled.join(again, ["gram", "context"]).select(
        "key", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last")
    )
    groups = materialise(
        counted.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > 1)
    )
    wanted = counted.join(groups, "gram").select("gram", "n", "contexts", "one.*")
    # the anchors of one document are bounded by its length
    lists = materialise(
        wanted.groupBy("key", "doc").agg(F.collect_list(F.struct("gram", "n", "contexts", "at", "low", "high")).alias("wanted"))
    )
    met = keyed.withColumnRenamed("doc", "d").join(lists.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("d").eqNullSafe(F.col("doc")))

    def cut_contexts(batch: pa.RecordBatch) -> dict:
        names = ("gram", "n", "contexts", "at", "low", "high")
        out: dict[str, list] = {x: [] for x in (*names, "key", "data")}
        lists = batch.column("wanted").to_pylist()
        for key, data, items in zip(batch.column("key").to_pylist(), binary_column(batch, "text"), lists, strict=True):
            for item in items:
                for name in names:
                    out[name].append(item[name])
                out["key"].append(key)
                out["data"].append(data[item["at"] - item["high"] : item["at"] - item["low"] + length])
        return out

    shipped = materialise(
        map_batches(
            met.select("key", "text", "wanted"), cut_contexts,
            "gram bigint, n bigint, contexts bigint, key binary, at int, low int, high int, data binary",
        )
    )
    small = shipped.where(F.col("contexts") <= group_limit).drop("contexts")
    edges = _compared(small, length).unionByName(_counted(shipped.where(F.col("contexts") > group_limit), length))
    return whole.unionByName(edges)


def _compared(shipped: DataFrame, length: int) -> DataFrame:
    """Groups of bounded size: each is sorted where its anchor's rows meet."""
    ship(shipped.sparkSession)
    schema = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])

    def settle(group: list[dict]) -> Iterator[tuple[bytes, int, int]]:
        # a repeated row of the input may have sent a context twice
        unique = {(r["key"], r["at"]): r for r in group}
        rows = list(unique.values())
        if len(rows) < 2 or all(r["n"] > 1 for r in rows):
            return
        offsets = repeated_offsets([r["data"] for r in rows], [r["high"] for r in rows], [r["low"] for r in rows], length)
        for row, spans in zip(rows, offsets, strict=True):
            if row["n"] == 1:
                for low, high in spans:
                    yield row["key"], row["at"] - high, row["at"] - low

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if group and group[0]["gram"] != row["gram"]:
                    out.extend(settle(group))
                    group = []
                group.append(row)
            if out:
                yield _batch(out, schema)
        out = list(settle(group)) if group else []
        if out:
            yield _batch(out, schema)

    together = shipped.repartition("gram").sortWithinPartitions("gram")
    return together.mapInArrow(walk, "key binary, first int, last int")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _counted(shipped: DataFrame, length: int) -> DataFrame:
    """Groups too large for one task: digests of their single strings are counted over all tasks."""

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("gram", "offset", "digest", "n", "key", "start")}
        for row in batch.to_pylist():
            for i in range(row["low"], row["high"] + 1):
                begin = row["high"] - i
                out["gram"].append(row["gram"])
                out["offset"].append(i)
                out["digest"].append(xxhash.xxh3_128_digest(row["data"][begin : begin + length]))
                out["n"].append(row["n"])
                out["key"].append(row["key"])
                out["start"].append(row["at"] - i)
        return out

    single = map_batches(shipped, cut, "gram bigint, offset int, digest binary, n bigint, key binary, start int").distinct()
    stored = materialise(single)
    again = materialise(
        stored.groupBy("gram", "offset", "digest").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).drop("m")
    )
    hit = stored.where(F.col("n") == 1).join(again, ["gram", "offset", "digest"])
    return hit.select("key", F.col("start").alias("first"), F.col("start").alias("last"))


def removed_runs(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in the given ranges."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    group_limit: int = GROUP_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = True,
) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, spans`` (byte offsets), ``kept`` (the remaining bytes, unless
    ``with_kept`` is false) and ``kept_sha256``.
    """
    source = id_and_text(docs, id_col, text_col)
    ranges = repeated_starts(source, length, gram, group_limit)
    lists = materialise(ranges.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("ranges")))
    met = source.withColumn("key", _key()).join(lists, "key", "left").select("doc_id", "text", "ranges")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
        for data, found in zip(binary_column(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
            runs = removed_runs([(r["first"], r["last"]) for r in found or ()], length)
            edges = [0, *[x for run in runs for x in run], len(data)]
            kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(runs))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(kept if with_kept else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out | {"doc_id": batch.column("doc_id")}

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:int,end:int>>, "
        "kept binary, kept_sha256 string"
    )
    out = map_batches(met, cut, schema)
    return out if with_kept else out.drop("kept")
