"""Alignment of two tokenizers by pointer jumping.

Every text, with a space before it, is encoded by a byte-level BPE file (A) and by a sentence piece model (B, which adds the space). The tokens of
both are intervals of the same bytes. Each token points to its farthest-right overlapping token of the other side, a token at whose end
both sides end points to itself, and successor doubling (``next = next[next]``, over all tokens of a batch of texts at once) takes
every token to the last one of its connected group. A step that changes nothing ends it, after about log2 of the longest chain.

Two tokens are linked where their bytes overlap. The ends of both sides cut the text into elementary pieces, and each linked pair of
occurrences holds exactly one, so the links of a text are as many as its different ends. How often each pair of ids is linked is
counted over the whole corpus: workers add up what they see, Spark sums the rest. The counted table returns to the texts in slices of at
most ``slice_pairs`` pairs, each broadcast as packed arrays and used up in one pass over the stored pairs of the texts (in order of
their codes, so that each pass reads only what is left). One slice is enough until the table grows over it.

Defined cases: texts that are null or empty, or whose tokens of either side do not add up to the bytes of the space and the text, have no
tokens: zeros and an empty digest; special tokens written out in a text are plain text; repeated documents each get their row and
each count; of ties for the highest count of a B id all are best; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigrid.llm.bpe import codec
from evigrid.llm.common import arrow_schema, id_and_text, map_batches, ship
from evigrid.session import materialise

#: pairs of ids that a worker adds up before it hands them on
HELD_PAIRS = 400_000
#: pairs of the counted table that go to the workers at a time, 16 MB
SLICE_PAIRS = 1_000_000
#: an A id times this plus a B id is the code of a pair
SHIFT = 1 << 31
#: bytes of text that are aligned together
BATCH_BYTES = 4_000_000
_BLANK = "▁"


class Pieces(NamedTuple):
    model: object
    data: list[bytes]
    sizes: np.ndarray
    decimals: list[bytes]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The sentence piece model with the bytes of each id, once per worker process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    data = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        data.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace(_BLANK, " ").encode())
    return Pieces(model, data, np.array([len(d) for d in data], dtype=np.int64), [b"%d" % i for i in range(len(data))])


def last_of_group(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token, A's before B's, the number of the last token of its group; ends rise on each side and agree at the last."""
    n_a = len(end_a)
    to_b = n_a + np.searchsorted(end_b, end_a, side="left")
    to_a = np.searchsorted(end_a, end_b, side="left")
    ends = np.concatenate([end_a, end_b])
    own = np.arange(len(ends))
    following = np.concatenate([to_b, to_a])
    # where both sides end together the B token is the last one
    following[n_a:] = np.where(ends[to_a] == end_b, own[n_a:], to_a)
    while True:
        jumped = following[following]
        if np.array_equal(jumped, following):
            return following
        following = jumped


def _digest(a: np.ndarray, b: np.ndarray, last: np.ndarray, name_a: list[bytes], name_b: list[bytes]) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: ids of each group in order."""
    group_a, group_b = last[: len(a)], last[len(a) :]
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    close_a = np.append(group_a[1:] != group_a[:-1], True)
    close_b = np.append(group_b[1:] != group_b[:-1], True)
    words = [name_a[i] for i in a.tolist()] + [name_b[i] for i in b.tolist()]
    marks = np.concatenate([np.where(close_a, 1, 0), np.where(close_b, 2, 0)])[order].tolist()
    out: list[bytes] = []
    for i, mark in zip(order.tolist(), marks, strict=True):
        out.append(words[i])
        out.append((b",", b"|", b";")[mark])
    return hashlib.sha256(b"".join(out[:-1])).hexdigest()


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    codes: np.ndarray
    digest: str
    groups: list[dict]


_NOTHING = Aligned(0, 0, 0, np.empty(0, dtype=np.int64), "", [])


def align(texts: Sequence[str], path_a: str, path_b: str, with_groups: bool = False) -> list[Aligned]:
    """The alignment of each text; ``codes`` has the pair of ids of each link."""
    one, two = codec(path_a), pieces(path_b)
    ids_a: list[np.ndarray] = []
    ids_b: list[np.ndarray] = []
    sizes: list[int] = []
    for text, b in zip(texts, two.model.encode(list(texts), num_threads=1), strict=True):
        data = b" " + text.encode()
        if not text or b"".join(map(two.data.__getitem__, b)) != data:
            sizes.append(0)
            continue
        a = one.engine.encode_ordinary(" " + text)
        if b"".join(map(one.pieces.__getitem__, a)) != data:
            sizes.append(0)
            continue
        ids_a.append(np.array(a, dtype=np.int64))
        ids_b.append(np.array(b, dtype=np.int64))
        sizes.append(len(data))
    if not ids_a:
        return [_NOTHING] * len(sizes)
    # one line of bytes for the whole batch: a text ends both sides, so no group crosses it
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    end_a, end_b = np.cumsum(one.sizes[all_a]), np.cumsum(two.sizes[all_b])
    last = last_of_group(end_a, end_b)
    cut = np.union1d(end_a, end_b)
    codes = all_a[np.searchsorted(end_a, cut, side="left")] * SHIFT + all_b[np.searchsorted(end_b, cut, side="left")]
    closing = end_b[last[len(all_a) :] == np.arange(len(all_a), len(all_a) + len(all_b))]
    out = []
    at_a = at_b = begin = 0
    filled = iter(zip(ids_a, ids_b, strict=True))
    for size in sizes:
        if not size:
            out.append(_NOTHING)
            continue
        a, b = next(filled)
        own = np.concatenate([last[at_a : at_a + len(a)], last[len(all_a) + at_b : len(all_a) + at_b + len(b)]])
        low, high = np.searchsorted(cut, [begin, begin + size], side="right").tolist()
        n_groups = int(np.diff(np.searchsorted(closing, [begin, begin + size], side="right"))[0])
        groups = []
        if with_groups:
            names, where = np.unique(own, return_inverse=True)
            stop_a = np.searchsorted(own[: len(a)], names, side="right")
            stop_b = np.searchsorted(own[len(a) :], names, side="right")
            for k in range(len(names)):
                groups.append({
                    "a": a[stop_a[k - 1] if k else 0 : stop_a[k]].tolist(), "b": b[stop_b[k - 1] if k else 0 : stop_b[k]].tolist(),
                })
        out.append(Aligned(len(a), len(b), n_groups, codes[low:high], _digest(a, b, own, one.decimals, two.decimals), groups))
        at_a, at_b, begin = at_a + len(a), at_b + len(b), begin + size
    return out


def _batches(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > BATCH_BYTES:
            yield texts[start:i]
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield texts[start:]


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising codes and their counts, compressed."""
    steps = np.diff(codes, prepend=0)
    return pa.compress(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 12 * size, "zstd", asbytes=True), dtype=np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view("<i8").ravel()
    return np.cumsum(steps), np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<u4").ravel().astype(np.int64)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``code``, ``n`` (how many links of the corpus) and ``is_best`` (no pair of its B id has more)."""
    spark_schema, schema = arrow_schema(stored.sparkSession, "code bigint, n bigint")
    ship(stored.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if size:
                    parts.append(unpacked(data, size))
                    held += size
                if held > HELD_PAIRS:
                    codes, counts = sums()
                    if len(codes) > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], schema=schema)
                        parts, held = [], 0
                    else:
                        parts, held = [(codes, counts)], len(codes)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums()], schema=schema)

    counted = materialise(stored.select("size", "pairs").mapInArrow(add, spark_schema).groupBy("code").agg(F.sum("n").alias("n")))
    b = F.col("code").bitwiseAND(F.lit(SHIFT - 1))
    # a row for each B id: bounded by the vocabulary
    best = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(best), b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("is_best"))


def _slices(counted: DataFrame, size: int) -> list[DataFrame]:
    total = counted.count()
    number = max(1, -(-total // size))
    if number == 1:
        return [counted]
    # equal shares of the codes; a slice may be a little larger, never many times
    edges = counted.approxQuantile("code", [i / number for i in range(1, number)], 0.1 / number)
    edges = [-1, *sorted({int(e) for e in edges}), 1 << 62]
    return [counted.where((F.col("code") > low) & (F.col("code") <= high)) for low, high in zip(edges, edges[1:], strict=False)]


class Slice(NamedTuple):
    codes: np.ndarray
    counts: np.ndarray
    best: np.ndarray


def _with_counts(stored: DataFrame, counted: DataFrame, slice_pairs: int) -> DataFrame:
    """``stored`` with ``n_best`` and ``count_sum`` from all slices of the table."""
    counted = materialise(counted)
    names = [f.name for f in stored.schema.fields if f.name not in ("size", "pairs", "n_best", "count_sum")]
    schema = StructType(stored.schema.fields)
    for part in _slices(counted, slice_pairs):
        table = part.toArrow()
        order = np.argsort(codes := table.column("code").to_numpy())
        whole = Slice(codes[order], table.column("n").to_numpy()[order], table.column("is_best").to_numpy(zero_copy_only=False)[order])
        shared = stored.sparkSession.sparkContext.broadcast(whole)

        def score(batch: pa.RecordBatch, shared=shared) -> dict:
            codes, counts, best = shared.value
            out = {n: batch.column(n) for n in names} | {"size": [], "pairs": [], "n_best": [], "count_sum": []}
            rows = batch.select(["size", "pairs", "n_best", "count_sum"]).to_pydict()
            for size, data, n_best, total in zip(*rows.values(), strict=True):
                if size:
                    own, links = unpacked(data, size)
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    here = codes[at] == own
                    n_best += int(links[here & best[at]].sum())
                    total += int((links * counts[at])[here].sum())
                    rest = ~here
                    size = int(rest.sum())
                    data = packed(own[rest], links[rest]) if size else b""
                out["size"].append(size)
                out["pairs"].append(data)
                out["n_best"].append(n_best)
                out["count_sum"].append(total)
            return out

        after = map_batches(stored, score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))
        after = after.select(*stored.columns)
        stored = after if part is counted else materialise(after)
    return stored


def align_documents(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    with_groups: bool = False,
    slice_pairs: int = SLICE_PAIRS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair no other pair of its B
    id exceeds), ``count_sum`` (over links, of the pair's count in the corpus), ``groups_sha256``; ``with_groups`` adds ``groups``, the ids of
    both sides in each group.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, "
        "size int, pairs binary" + (", groups array<struct<a:array<int>,b:array<int>>>" if with_groups else "")
    )

    def encode(batch: pa.RecordBatch) -> dict:
        found = [x for part in _batches(batch.column("text").to_pylist()) for x in align(part, path_a, path_b, with_groups)]
        pairs = [np.unique(x.codes, return_counts=True) for x in found]
        nothing = [0] * len(found)
        out = {
            "doc_id": batch.column("doc_id"), "n_a": [x.n_a for x in found], "n_b": [x.n_b for x in found],
            "n_groups": [x.n_groups for x in found], "n_links": [len(x.codes) for x in found], "n_best": nothing, "count_sum": nothing,
            "groups_sha256": [x.digest for x in found], "size": [len(c) for c, _ in pairs],
            "pairs": [packed(c, n) if len(c) else b"" for c, n in pairs], "groups": [x.groups for x in found],
        }
        return out

    stored = materialise(map_batches(source, encode, shape))
    return _with_counts(stored, pair_counts(stored), slice_pairs).drop("size", "pairs")
