"""Periodic runs of words by scale-tiled distribution.

A text is cut into words ``[^\\x20\\x09-\\x0D]+``. A *run* is a stretch of words with smallest period q that is at least
``max(6, 4 q)`` words long and that no neighbouring word extends keeping period q.

Periods are searched by octave: for P = 1, 2, 4, ... the periods P <= p < 2P. A document is cut into tiles, one for each boundary b
that is a multiple of 2P: the words from b - 2P to b + 4P. A run of such a period spans [b, b + p] for some boundary, and its part in
that tile is at least 2p long. A tile is solved on its own: two Z-functions at the boundary, of the right side and of the reversed
left side, say how far a shift by p agrees to both sides, for all periods of the octave at once. Only primitive periods give a fragment, and
only stretches that are long enough or reach the edge of their tile.
Tiles are tried only where half a period agrees on one side of the boundary, which a rolling hash of the whole batch tells (equal
words always have equal hashes, so none is missed).

Tiles of documents over ``long_words`` words are rows of their own and are solved wherever Spark puts them. Fragments are shuffled by
document and period and stitched: the fragments of one run overlap by a period or more, two runs of a period by less.

Defined cases: a null, empty or white text has no words and no runs; a null id stays null; repeated documents each get their row;
two runs of different periods may share words; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.llm.common import binary_column, id_and_text, map_batches
from evigrid.session import materialise

#: words of a document whose tiles are still solved where the document is read
LONG_WORDS = 65_536
#: words whose hashes a worker holds at a time, at document granularity
BATCH_WORDS = 200_000
LEAST_WORDS = 6
LEAST_PERIODS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

Fragment = tuple[int, int, int]
_FRAGMENTS = "array<struct<period:int,start:int,end:int>>"


def z_function(word: Sequence[int]) -> list[int]:
    """Length of the longest common prefix of ``word`` and each of its suffixes; 0 for the whole."""
    size = len(word)
    out = [0] * size
    left = right = 0
    for i in range(1, size):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < size and word[k] == word[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


@functools.lru_cache(maxsize=65_536)
def _parts(period: int) -> tuple[int, ...]:
    """``period / r`` for each prime r that divides it."""
    out, rest, r = [], period, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(period // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return (*out, *([period // rest] if rest > 1 else []))


def solve_tile(word: Sequence[int], left: int, octave: int, at: int) -> list[Fragment]:
    """Fragments ``(period, start, end)`` around the boundary that has ``left`` words of the tile before it and number ``at``."""
    right = len(word) - left
    reach = min(2 * octave - 1, right)
    ahead = z_function(word[left:])
    before = word[:left][::-1]
    behind = z_function([*before, -1, *word[: left + reach][::-1]])
    out = []
    for p in range(octave, reach + 1):
        after = ahead[p] if p < right else 0
        back = behind[left + 1 + reach - p]
        if back + after < p or any(ahead[q] >= p - q for q in _parts(p)):
            continue
        # a stretch that ends inside the tile is whole: shorter than a run, it is none
        whole = (back < left or back == at) and p + after < right
        if not whole or back + p + after >= max(LEAST_WORDS, LEAST_PERIODS * p):
            out.append((p, at - back, at + p + after))
    return out


def tiles(code: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(document, octave, boundary)`` of the tiles that may hold a fragment; ``bounds`` are the documents' ends in ``code``."""
    starts = np.concatenate([[0], bounds[:-1]])
    sizes = bounds - starts
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code), _STEP)]), dtype=np.uint64)
    unpower = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code), _BACK)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:-1], dtype=np.uint64)])
    octave = 1
    while len(sizes) and LEAST_PERIODS * octave <= sizes.max():
        half = (octave + 1) // 2
        window = (sums[half:] - sums[:-half]) * unpower[: len(code) - half + 1]
        docs = np.nonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * octave))[0]
        counts = (sizes[docs] - octave) // (2 * octave) + 1
        doc = np.repeat(docs, counts)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[doc] + 2 * octave * number
        hit = np.zeros(len(at), dtype=bool)
        last = len(window) - 1
        here, back = window[np.minimum(at, last)], window[np.maximum(at - half, 0)]
        has_left = at - half >= starts[doc]
        for p in range(octave, 2 * octave):
            inside = at + p <= bounds[doc]
            hit |= (at + p + half <= bounds[doc]) & (window[np.minimum(at + p, last)] == here)
            hit |= has_left & inside & (window[np.minimum(at + p - half, last)] == back)
        for i in np.nonzero(hit)[0].tolist():
            yield int(doc[i]), octave, int(at[i])
        octave *= 2


def _cut(code: np.ndarray, first: int, end: int, octave: int, at: int) -> tuple[list[int], int]:
    """Words of a tile and how many of them lie before its boundary."""
    low = max(first, at - 2 * octave)
    return code[low : min(end, at + 4 * octave)].tolist(), at - low


def search(documents: Sequence[list[bytes]], long_words: int) -> Iterator[tuple[list[Fragment], list[tuple[int, int, int, bytes]]]]:
    """Per document its fragments and, if it is long, the tiles still to be solved: octave, boundary, words before it, words."""
    names: dict[bytes, int] = {}
    code = np.fromiter((names.setdefault(x, len(names)) for words in documents for x in words), dtype=np.int32)
    bounds = np.cumsum([len(words) for words in documents])
    found: list[list[Fragment]] = [[] for _ in documents]
    open_tiles: list[list[tuple[int, int, int, bytes]]] = [[] for _ in documents]
    for doc, octave, at in tiles(code, bounds):
        end = int(bounds[doc])
        first = end - len(documents[doc])
        word, left = _cut(code, first, end, octave, at)
        if len(documents[doc]) > long_words:
            open_tiles[doc].append((octave, at - first, left, np.array(word, dtype=np.int32).tobytes()))
        else:
            found[doc] += solve_tile(word, left, octave, at - first)
    return zip(found, open_tiles, strict=True)


def _groups(documents: list[list[bytes]], limit: int) -> Iterator[list[list[bytes]]]:
    group, total = [], 0
    for words in documents:
        if group and total + len(words) > limit:
            yield group
            group, total = [], 0
        group.append(words)
        total += len(words)
    if group:
        yield group


def _collapsed(words: list[bytes], runs: Sequence[dict]) -> bytes:
    """The words outside what any run repeats after its first period, joined by spaces."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for run in runs:
        change[run["start"] + run["period"]] += 1
        change[run["start"] + run["length"]] -= 1
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()])


def find_runs(
    docs: DataFrame,
    outputs: Sequence[str] = ("runs", "collapsed"),
    long_words: int = LONG_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words`` and what ``outputs`` names: ``runs`` (start, length, period; by start, then period),
    ``collapsed`` (the words that no run repeats, joined by spaces), ``digests`` (SHA-256 of both, runs as lines
    ``start,length,period``).
    """
    source = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = source.schema["doc_id"].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> dict:
        split = [t.split() for t in binary_column(batch, "text")]
        out: dict[str, list] = {"fragments": [], "tiles": [], "body": []}
        for group in _groups(split, BATCH_WORDS):
            for words, (found, left) in zip(group, search(group, long_words), strict=True):
                out["fragments"].append([{"period": p, "start": s, "end": e} for p, s, e in found])
                out["tiles"].append([{"octave": o, "at": a, "before": b, "words": w} for o, a, b, w in left])
                out["body"].append(b" ".join(words))
        ends = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": [len(w) for w in split]}
        return ends | out

    scanned = f"row bigint, doc_id {kind}, n_words bigint, fragments {_FRAGMENTS}, tiles array<struct<octave:int,at:int,before:int,words:binary>>"
    marked = map_batches(source, scan, f"{scanned}, body binary")
    # a document without fragments or tiles is finished: it keeps its result, the others their words
    open_ = (F.size("fragments") > 0) | (F.size("tiles") > 0)
    spaces = F.col("body").cast("string")
    empty = F.expr("cast(array() as array<struct<start:int,length:int,period:int>>)")
    done = {
        "runs": [empty.alias("runs")],
        "collapsed": [spaces.alias("collapsed")],
        "digests": [F.sha2(F.lit(""), 256).alias("runs_sha256"), F.sha2("body", 256).alias("collapsed_sha256")],
    }
    results = [c for o in outputs for c in done[o]]
    stored = materialise(
        marked.select(
            "row", "doc_id", "n_words", "fragments", "tiles", open_.alias("is_open"), F.when(open_, F.col("body")).alias("body"),
            F.when(~open_, F.struct(*results)).alias("result"),
        )
    )

    def solve(batch: pa.RecordBatch) -> dict:
        rows = batch.to_pydict()
        solved = [
            [{"period": p, "start": s, "end": e} for p, s, e in solve_tile(np.frombuffer(w, dtype=np.int32).tolist(), b, o, a)]
            for w, b, o, a in zip(rows["words"], rows["before"], rows["octave"], rows["at"], strict=True)
        ]
        return {"row": batch.column("row"), "fragments": solved}

    spread = stored.select("row", F.explode("tiles").alias("t")).select("row", "t.*").repartition("row", "octave", "at")
    fragments = stored.select("row", F.explode("fragments").alias("f")).unionByName(
        map_batches(spread, solve, f"row bigint, fragments {_FRAGMENTS}").select("row", F.explode("fragments").alias("f"))
    )
    runs = stitched(fragments.select("row", "f.*"))
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    def finish(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"runs": [], "collapsed": [], "runs_sha256": [], "collapsed_sha256": []}
        for body, own in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            kept = _collapsed(body.split(), own)
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in own)
            out["runs"].append(own)
            out["collapsed"].append(kept.decode())
            out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(kept).hexdigest())
        return {n: batch.column(n) for n in ("doc_id", "n_words")} | out

    ends = stored.where("is_open").select("row", "doc_id", "n_words", "body").join(listed, "row", "left")
    head = stored.where("not is_open").select("doc_id", "n_words", "result.*")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head.schema.fields)
    tail = map_batches(ends.select("doc_id", "n_words", "body", F.coalesce("runs", empty).alias("runs")), finish, shape)
    return head.unionByName(tail)


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs ``row, start, length, period`` from fragments ``row, period, start, end``."""
    order = W.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1)
    numbered = fragments.withColumn("fresh", fresh).withColumn("number", F.sum("fresh").over(order))
    whole = numbered.groupBy("row", "period", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = (F.col("end") - F.col("start")).alias("length")
    enough = F.greatest(F.lit(LEAST_WORDS), F.lit(LEAST_PERIODS) * F.col("period"))
    return whole.select("row", "start", length, "period").where(F.col("length") >= enough)
