"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased over A-Z and cut into words at ASCII signs and white space. Anchors are the common words of ``ANCHORS``, the
start of the text, and, so that prose without common words is covered too, content words whose hash is divisible by
``SPARSE``. Each anchor's signature is its own hash mixed with the next ``CHAIN`` content words; the distinct signatures are the
document's set, and a digest of the sorted set is its fingerprint. Likeness is the Jaccard similarity of two sets; with a
threshold, set lengths alone rule a pair out where min/max is under it.

``search`` finds the documents near a stated set of queries. Query sets are partitioned by set length, so that only the partition of a
document's own length and its neighbours can hold a match; inside a partition an inverted index over each query's rarest
signatures (as many as any match must share one of) names the candidates, and Jaccard similarity is counted for those whose
lengths allow it.

Every document is also compared with the next one and with its edited text (its second half replaced by the beginning of the next
document). "Next" needs the order of all ids: ids alone give range edges, texts go once to their range and are walked there in order, and
the first document of a range is sent to the range before it as well.

Defined cases: a null or empty text, like any wordless one, has the empty set; two empty sets are alike (1.0); rows with equal ids
are ordered by their text, null ids come first; the last document is followed by the first, a single one by itself; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import arrow_schema, id_and_text, map_batches, ship
from evigrid.llm.decontaminate import words
from evigrid.session import materialise

#: common words of English, French, German and Spanish prose: fixed values
ANCHORS = frozenset(
    """
    a an and are as at be but by for from had has have he her his in is it not of on or she that the their they this to was
    were which will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui se son sur un une
    aber als auch auf aus bei das dem den der die ein eine einen er es für hat ich im ist mit nach nicht noch sich sie sind
    so und von vor war wie wird zu zum zur
    al como con del el esta este lo los las más muy no o para pero por si sin su sus también una uno y ya
    """.split()
)
CHAIN = 2
SPARSE = 16
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Codes(dict):
    """Hash of a word with its lowest bit set for a common word; emptied when it grows over a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        code = xxhash.xxh3_64_intdigest(word) & ~1 | (word.decode("utf-8", "replace") in ANCHORS)
        self[word] = code
        return code


_CODES = _Codes()


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signatures."""
    found = words(text.encode("utf-8", "replace"))
    if not found:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, found), dtype=np.uint64, count=len(found))
    common = (codes & np.uint64(1)).astype(bool)
    content = codes[~common]
    rare = ~common & ((codes >> np.uint64(8)) % np.uint64(SPARSE) == 0)
    at = np.nonzero(common | rare)[0]
    # content words up to and including each anchor: where its chain begins
    begin = np.concatenate([[0], np.cumsum(~common)[at]])
    anchor = np.concatenate([np.zeros(1, dtype=np.uint64), codes[at]])
    padded = np.concatenate([content, np.zeros(chain, dtype=np.uint64)])
    mixed = anchor * _ODD[0]
    for step in range(chain):
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ padded[begin + step]) * _ODD[1 + step % 2]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def digest(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.astype("<u8").tobytes())


def likeness(left: np.ndarray, right: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 without counting where the lengths alone keep it under ``at_least``."""
    low, high = sorted((len(left), len(right)))
    if high == 0:
        return 1.0
    if low < at_least * high or low == 0:
        return 0.0
    common = len(np.intersect1d(left, right, assume_unique=True))
    value = common / (low + high - common)
    return value if value >= at_least else 0.0


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


QUERY_BLOCK = 20_000


def partition_of(size: int, threshold: float) -> int:
    """Length partition: sets that are alike by ``threshold`` lie in the same partition or in neighbouring ones."""
    return int(np.floor(np.log(size) / -np.log(threshold) + 1e-9))


def build_index(sets: list[np.ndarray], threshold: float) -> dict[int, dict[int, list[int]]]:
    """Length partition -> signature -> query numbers, over the rarest signatures of each query."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0), np.empty(0))
    index: dict[int, dict[int, list[int]]] = {}
    for number, found in enumerate(sets):
        if not len(found):
            continue
        rarity = counts[np.searchsorted(values, found)]
        # whatever is alike shares ceil(t*n) signatures, so one of any n - ceil(t*n) + 1
        needed = len(found) - int(np.ceil(threshold * len(found) - 1e-9)) + 1
        part = index.setdefault(partition_of(len(found), threshold), {})
        for signature in found[np.argsort(rarity, kind="stable")[:needed]].tolist():
            part.setdefault(signature, []).append(number)
    return index


def matches(
    found: np.ndarray, sets: list[np.ndarray], index: dict[int, dict[int, list[int]]], threshold: float
) -> list[tuple[int, float]]:
    """Query numbers whose set is alike by ``threshold``, with the likeness."""
    if not len(found):
        return []
    own = partition_of(len(found), threshold)
    signatures_ = found.tolist()
    candidates = {
        number
        for part in (own - 1, own, own + 1)
        if part in index
        for signature in signatures_
        for number in index[part].get(signature, ())
    }
    pairs = ((number, likeness(found, sets[number], threshold)) for number in sorted(candidates))
    return [(number, value) for number, value in pairs if value >= threshold]


def search(docs: DataFrame, queries: DataFrame, threshold: float = 0.8, block: int = QUERY_BLOCK) -> DataFrame:
    """``doc_id``, ``query_id``, ``likeness`` for every document near a query (itself included, if it is one).

    Equal query texts are one set; the sets go to every task in blocks of a stated size, and each block's pass reads all
    documents once. Wordless texts match nothing.
    """
    ship(docs.sparkSession)
    source = id_and_text(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> dict:
        found = [signatures(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"), "fingerprint": [digest(f) for f in found],
            "signatures": [f.view(np.int64) for f in found],
        }

    signed = materialise(map_batches(id_and_text(queries), sign, f"doc_id {kind}, fingerprint string, signatures array<bigint>"))
    distinct = signed.where(F.size("signatures") > 0).groupBy("fingerprint").agg(F.first("signatures").alias("signatures"))
    blocks = max(1, -(-distinct.count() // block))
    cut = materialise(distinct.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.lit(blocks))))
    out = None
    for number in range(blocks):
        # about ``block`` sets: bounded by the parameter
        rows = cut.where(F.col("block") == number).collect()
        sets = [np.array(r.signatures, dtype=np.int64).view(np.uint64) for r in rows]
        shared = docs.sparkSession.sparkContext.broadcast(([r.fingerprint for r in rows], sets, build_index(sets, threshold)))

        def look(batch: pa.RecordBatch, shared=shared) -> dict:
            names, sets, index = shared.value
            rows = [
                (i, names[k], value)
                for i, text in enumerate(batch.column("text").to_pylist())
                for k, value in matches(signatures(text), sets, index, threshold)
            ]
            taken = pa.array([i for i, _, _ in rows], type=pa.int64())
            return {
                "doc_id": batch.column("doc_id").take(taken), "fingerprint": [f for _, f, _ in rows],
                "likeness": [v for _, _, v in rows],
            }

        part = map_batches(source, look, f"doc_id {kind}, fingerprint string, likeness double")
        out = part if out is None else out.unionByName(part)
    members = signed.select(F.col("doc_id").alias("query_id"), "fingerprint")
    return out.join(members, "fingerprint").select("doc_id", "query_id", "likeness")


def _in_order(source: DataFrame, pieces: int) -> DataFrame:
    """``doc_id``, ``text`` with ``piece`` (a range of ids) and ``carry`` (a copy of the next range's first row)."""
    ranged = source.select("doc_id").repartitionByRange(pieces, F.col("doc_id").asc_nulls_first())
    # one row per range: bounded by the number of ranges
    ranges = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    edges = sorted(r.low for r in ranges if r.low is not None)
    any_null = any(r.nulls for r in ranges)
    kind = source.schema["doc_id"].dataType
    piece = _range_of(F.col("doc_id"), edges, kind)
    placed = source.select("doc_id", "text", piece.alias("piece"), F.lit(False).alias("carry"))
    starts = F.col("doc_id").isNull() if any_null else F.lit(False)
    later = edges[1:] if any_null else edges
    if later:
        starts = F.coalesce(F.col("doc_id").isin(later), F.lit(False)) | starts
    firsts = source.where(starts).groupBy("doc_id").agg(F.min("text").alias("text"))
    last = max(0, len(edges) - 1)
    before = F.when(_range_of(F.col("doc_id"), edges, kind) == 0, last).otherwise(_range_of(F.col("doc_id"), edges, kind) - 1)
    carried = firsts.select("doc_id", "text", before.cast("int").alias("piece"), F.lit(True).alias("carry"))
    return placed.unionByName(carried)


def _range_of(value: Column, edges: list, kind) -> Column:
    """Number of the range that holds ``value``: two steps over about the square root of the number of edges each."""
    later = edges[1:]
    if not later:
        return F.lit(0)
    width = max(1, int(len(later) ** 0.5))
    every = F.lit(later).cast(f"array<{kind.simpleString()}>")
    coarse = F.lit(later[width - 1 :: width]).cast(f"array<{kind.simpleString()}>")
    passed = F.size(F.filter(coarse, lambda e: e <= value)) * F.lit(width)
    rest = F.size(F.filter(F.slice(every, passed + 1, F.lit(width)), lambda e: e <= value))
    return F.when(value.isNull(), 0).otherwise(passed + rest).cast("int")


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, n_signatures, near_edited, near_next``."""
    source = id_and_text(docs, id_col, text_col)
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_order(source, 8 * partitions).repartition(partitions, "piece")
    ordered = placed.sortWithinPartitions("piece", "carry", F.col("doc_id").asc_nulls_first(), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "n_signatures bigint, near_edited double, near_next double"
    )
    ship(docs.sparkSession)
    spark_schema, arrow = arrow_schema(docs.sparkSession, schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows: list[tuple] = []
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "text", "carry"))
            for doc_id, text, carry in zip(*columns, strict=True):
                own = signatures(text)
                if waiting is not None:
                    rows.append(_compared(*waiting, text, own))
                # the copied first row of the next range only ends this one
                waiting = None if carry else (doc_id, text, own)
            if rows:
                arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return ordered.mapInArrow(walk, spark_schema)


def _compared(doc_id, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_own = signatures(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), digest(own), digest(changed_own),
        len(own), likeness(own, changed_own), likeness(own, next_own),
    )
