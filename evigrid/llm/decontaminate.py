"""Benchmark decontamination: which words of a document lie inside a test item's word window.

Both sides are lower-cased over A-Z and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A test item gives every window
of ``width`` consecutive words; an item with fewer words, but not none, is one window. The windows form a hash set. Its size is
counted first: up to ``broadcast_windows`` it goes to every task once and each document is scanned in one pass; beyond, document
windows and test windows meet in a shuffled join on a 128-bit digest. Both ways give the same rows. A hash hit counts only
after its word numbers have been compared.

Defined cases: a null or empty text has no words and is never contaminated; repeated documents each get their row; an
empty benchmark gives rows without hits; a null item id still marks words, but is not counted as an item; two items
with equal text are both reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import binary_column, id_and_text, map_batches, ship, text_function, whole_text
from evigrid.session import materialise

WIDTH = 13
BROADCAST_WINDOWS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_bytes() -> bytes:
    """Translation of a UTF-8 byte: letters to lower case, digits and bytes over 0x7F kept, all else a space."""
    table = bytearray(b" " * 256)
    for byte in range(256):
        lower = byte + 32 if 0x41 <= byte <= 0x5A else byte
        if 0x30 <= lower <= 0x39 or 0x61 <= lower <= 0x7A or lower >= 0x80:
            table[byte] = lower
    return bytes(table)


_WORDS = _word_bytes()


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item and distinct window: ``item``, ``n`` words, the words joined by spaces."""

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "n": [], "window": []}
        for item, text in zip(batch.column("item").to_pylist(), binary_column(batch, "text"), strict=True):
            found = words(text)
            n = min(width, len(found))
            spans = {b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()
            for window in sorted(spans):
                out["item"].append(item)
                out["n"].append(n)
                out["window"].append(window.decode())
        return out

    source = benchmark.select(F.col(id_col).cast("string").alias("item"), whole_text(text_col).alias("text"))
    return map_batches(source, cut, "item string, n int, window string").distinct()


class WindowIndex(NamedTuple):
    """Windows as word numbers; ``by_length`` maps a length to (sorted hashes, word numbers, item lists)."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]]


def _window_hash(columns: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of word numbers."""
    out = np.zeros(len(columns), dtype=np.uint64)
    for j in range(columns.shape[1]):
        out = (out + columns[:, j].astype(np.uint64)) * _MULTIPLIER
    return out ^ (out >> np.uint64(29))


def build_index(rows: list[tuple[str | None, int, str]]) -> WindowIndex:
    vocabulary: dict[bytes, int] = {}
    grouped: dict[int, dict[tuple[int, ...], list[str]]] = {}
    for item, n, window in rows:
        numbers = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in window.encode().split(b" "))
        items = grouped.setdefault(n, {}).setdefault(numbers, [])
        if item is not None:
            items.append(item)
    by_length = {}
    for n, windows in grouped.items():
        matrix = np.array(list(windows), dtype=np.int32).reshape(-1, n)
        hashes = _window_hash(matrix)
        order = np.argsort(hashes, kind="stable")
        lists = list(windows.values())
        by_length[n] = (hashes[order], matrix[order], [lists[i] for i in order])
    return WindowIndex(vocabulary, by_length)


def scan(index: WindowIndex, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, its hit word spans (merged, end exclusive), the items found."""
    get = index.vocabulary.get
    numbers: list[int] = []
    bounds = [0]
    for text in texts:
        numbers.extend([get(w, 0) for w in words(text)])
        bounds.append(len(numbers))
    ids = np.array(numbers, dtype=np.int32)
    ends = np.array(bounds[1:], dtype=np.int64)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    # unknown words before each position: a window can only match where it holds none
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    for n, (hashes, matrix, lists) in index.by_length.items():
        if len(ids) < n:
            continue
        starts = np.nonzero(unknown[n:] == unknown[:-n])[0]
        owner = np.searchsorted(ends, starts, side="right")
        inside = starts + n <= ends[owner]
        starts, owner = starts[inside], owner[inside]
        if not len(starts):
            continue
        window = ids[starts[:, None] + np.arange(n)]
        code = _window_hash(window)
        low = np.searchsorted(hashes, code, side="left")
        for k in np.nonzero(hashes[np.minimum(low, len(hashes) - 1)] == code)[0].tolist():
            at = int(low[k])
            while at < len(hashes) and hashes[at] == code[k]:
                if np.array_equal(matrix[at], window[k]):
                    doc = int(owner[k])
                    start = int(starts[k]) - bounds[doc]
                    hits.setdefault(doc, []).append((start, start + n))
                    items.setdefault(doc, set()).update(lists[at])
                at += 1
    for doc in range(len(texts)):
        yield bounds[doc + 1] - bounds[doc], merged(hits.get(doc, [])), items.get(doc, set())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _windows(benchmark: DataFrame, width: int, broadcast_windows: int) -> tuple[DataFrame, Broadcast | None]:
    """The windows of the test items, and their index at the workers where there are few enough."""
    windows = item_windows(benchmark, width)
    head = windows.limit(broadcast_windows + 1).collect()
    if len(head) > broadcast_windows:
        return windows, None
    return windows, benchmark.sparkSession.sparkContext.broadcast(build_index([(r.item, r.n, r.window) for r in head]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    broadcast_windows: int = BROADCAST_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_row: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, items`` (ids of occurring items, as text), ``spans`` (hit words, by number).

    ``with_row`` keeps the whole document beside the result, as the structure ``document``. The number of windows decides the way they reach the documents,
    not the rows.
    """
    windows, shared = _windows(benchmark, width, broadcast_windows)
    source = id_and_text(docs, id_col, text_col)
    if with_row:
        source = docs.select(
            F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.struct("*").alias("document")
        )
    if shared is None:
        return _joined(source, windows, with_row)

    def mark(batch: pa.RecordBatch) -> dict:
        texts = binary_column(batch, "text")
        found = []
        for at in range(0, len(texts), 256):
            found.extend(scan(shared.value, texts[at : at + 256]))
        out = {
            "doc_id": batch.column("doc_id"),
            "n_words": [n for n, _, _ in found],
            "n_hit": [sum(e - s for s, e in spans) for _, spans, _ in found],
            "items": [sorted(items) for _, _, items in found],
            "spans": [[{"start": s, "end": e} for s, e in spans] for _, spans, _ in found],
        }
        if with_row:
            out["document"] = batch.column("document")
        return out

    carried = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in ("doc_id", "document") if n in source.columns)
    return map_batches(source, mark, carried + _RESULT)


def _joined(source: DataFrame, windows: DataFrame, with_row: bool) -> DataFrame:
    """The way for a test set too large to send to every task: windows of both sides meet in a shuffled join."""
    lengths = [r.n for r in windows.select("n").distinct().collect()]
    base = materialise(source.withColumn("row", F.monotonically_increasing_id()))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"row": [], "at": [], "n": [], "digest": []}
        for row, text in zip(batch.column("row").to_pylist(), binary_column(batch, "text"), strict=True):
            found = words(text)
            for n in lengths:
                for i in range(len(found) - n + 1):
                    out["row"].append(row)
                    out["at"].append(i)
                    out["n"].append(n)
                    out["digest"].append(xxhash.xxh3_128_digest(b" ".join(found[i : i + n])))
        return out

    def count(batch: pa.RecordBatch) -> dict:
        return {
            "row": batch.column("row"),
            "n_words": [len(words(t)) for t in binary_column(batch, "text")],
        }

    def digests(batch: pa.RecordBatch) -> dict:
        return {
            "item": batch.column("item"),
            "digest": [xxhash.xxh3_128_digest(w) for w in binary_column(batch, "window")],
        }

    wanted = map_batches(windows, digests, "item string, digest binary")
    pieces = map_batches(base.select("row", "text"), cut, "row bigint, at int, n int, digest binary")
    met = pieces.join(wanted, "digest")
    # the spans and items of one document are bounded by its own length
    found = met.groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", "n")).alias("hits")
    )
    step = F.aggregate(
        F.array_sort("hits"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= h["at"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], h["at"] + h["n"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(h["at"].alias("start"), (h["at"] + h["n"]).alias("end"))))),
    )
    spans = found.select("row", "items", step.alias("spans"))
    counted = map_batches(base.select("row", "text"), count, "row bigint, n_words bigint")
    out = base.join(counted, "row").join(spans, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]).cast("bigint"))
    return out.select(
        "doc_id",
        *(["document"] if with_row else []),
        "n_words",
        F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
    )


def is_contaminated(share: int = 20):
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def clean(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Only texts go to the workers, one bit each comes back."""
    ship(docs.sparkSession)
    _, shared = _windows(benchmark, width, broadcast_windows)
    if shared is None:
        found = contamination(docs, benchmark, width, broadcast_windows, with_row=True)
        return found.where(~is_contaminated(share)).select("document.*")

    def judge(texts: list[bytes]) -> list[bool]:
        kept = []
        for n_words, spans, _ in scan(shared.value, texts):
            n_hit = sum(e - s for s, e in spans)
            kept.append(not (n_hit > 0 and share * n_hit >= n_words))
        return kept

    stays = text_function(judge, "boolean")
    return docs.where(stays(whole_text()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``text`` of all documents, without their hit words and what separates these.

    A removed run leaves one space between what stands before and behind it.
    """

    def strip(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, spans in zip(binary_column(batch, "text"), batch.column("spans").to_pylist(), strict=True):
            if spans:
                places, at = [], 0
                flat = text.translate(_WORDS)
                for word in flat.split():
                    at = flat.index(word, at)
                    places.append((at, at + len(word)))
                    at += len(word)
                kept, last = [], 0
                for span in spans:
                    kept.append(text[last : places[span["start"]][0]].rstrip())
                    last = places[span["end"] - 1][1]
                text = b" ".join(p for p in [*kept, text[last:].lstrip()] if p)
            texts.append(text.decode())
        return {"doc_id": batch.column("doc_id"), "text": texts}

    marked = contamination(docs, benchmark, width, with_row=True)
    kind = marked.schema["doc_id"].dataType.simpleString()
    return map_batches(
        marked.select("doc_id", whole_text("document.text").alias("text"), "spans"), strip, f"doc_id {kind}, text string"
    )
