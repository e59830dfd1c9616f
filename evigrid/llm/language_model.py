"""Cross-entropy difference of two matched n-gram models.

A target model and a background model are counted over the corpus with the same vocabulary: words and word pairs, each under a
64-bit hash of its own. A pair's probability is interpolated with the word's, and the word's with a uniform one over the
words of the corpus, so both models give every token a finite loss. A document's score is its mean loss under the background
model minus its mean loss under the target model, over all its tokens: higher means closer to the target.

Counting runs over all documents. They are packed into slices of about a million tokens. A slice sends each range of hashes one row with
its sorted words or pairs and their counts, the range adds up what all slices sent and returns the corpus counts in the same
order, and the slice judges its documents by them. A word or pair of every document is one entry a slice, so nothing is hot; the
number of ranges grows with the tokens, so a range holds about a million entries at every size. No task or driver holds all counts.

``fit`` and ``score`` hash words and pairs into ``WORDS`` and ``PAIRS`` buckets instead, for corpora of a few MB whose table fits a
task. The query uses ``differences``.

Losses leave out the counts of the document that is scored.

The target is whatever a boolean column marks (in the query: documents labelled good and not toxic); null marks are
background. Every document belongs to the background.

Defined cases: null, empty and wordless texts have no token and score 0.0 with null losses; without any target text the
target model is uniform; repeated documents are counted and scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import SLICE, arrow_schema, binary_column, map_batches, release, ship, whole_text
from evigrid.llm.decontaminate import words
from evigrid.session import materialise

WORDS = 1 << 18
PAIRS = 1 << 20
#: tokens of a slice of documents, and of the corpus for each range of hashes
SLICE_TOKENS = RANGE_TOKENS = 1 << 20
#: weight of the pair and of the word model; the rest is uniform
PAIR_WEIGHT, WORD_WEIGHT = 0.4, 0.55
_BEGIN = 0x2545F4914F6CDD1D


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def codes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of each token's word, of its pair and of the word before it (the begin mark first)."""
    found = words(text)
    word = np.fromiter(map(_CODES.__getitem__, found), dtype=np.uint64, count=len(found))
    before = np.concatenate([np.array([_BEGIN], dtype=np.uint64), word[:-1]]) if len(word) else word
    return word, pair_codes(before, word), before


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ word * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(32))


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, pair buckets (from ``WORDS`` on) and the word bucket before each token (the begin mark first)."""
    word, pair, before = codes(text)
    bucket = (pair % np.uint64(PAIRS)).astype(np.int64) + WORDS
    return (word % np.uint64(WORDS)).astype(np.int64), bucket, (before % np.uint64(WORDS)).astype(np.int64)


def marked(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents with ``is_target``, true where the id is in ``ids`` (distinct, not null).

    The list of ids grows with the corpus, so it is never broadcast: both sides are sorted at every size.
    """
    wanted = ids.select(F.col(id_col).alias("target_id"), F.lit(True).alias("is_target")).hint("merge")
    return docs.join(wanted, F.col(id_col) == F.col("target_id"), "left").drop("target_id")


class Models(NamedTuple):
    """Counts by bucket (words, then pairs), background and target."""

    background: np.ndarray
    target: np.ndarray


def count(docs: DataFrame, target: Column, text_col: str = "text") -> DataFrame:
    """``bucket``, ``background``, ``target`` counts over all documents."""
    source = docs.select(whole_text(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    ship(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("background", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, WORDS + PAIRS), dtype=np.int64)
        for batch in batches:
            for text, wanted in zip(binary_column(batch, "text"), batch.column("target").to_pylist(), strict=True):
                word, pair, before = tokens(text)
                # the begin mark is counted once a text, as the context of its first pair
                both = np.concatenate([word, pair, before[:1]])
                np.add.at(sums[0], both, 1)
                if wanted:
                    np.add.at(sums[1], both, 1)
        seen = np.nonzero(sums[0])[0]
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            arrays = [pa.array(part.astype(np.int32)), pa.array(sums[0][part]), pa.array(sums[1][part])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    partial = source.mapInArrow(run, "bucket int, background bigint, target bigint")
    return partial.groupBy("bucket").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target: Column, text_col: str = "text") -> Models:
    """Both models. The table has a fixed number of buckets, so bringing it to the driver is bounded."""
    rows = count(docs, target, text_col).toArrow()
    bucket = rows.column("bucket").to_numpy()
    sums = np.zeros((2, WORDS + PAIRS), dtype=np.float32)
    sums[0][bucket] = rows.column("background").to_numpy()
    sums[1][bucket] = rows.column("target").to_numpy()
    return Models(sums[0], sums[1])


def own_counts(word: np.ndarray, pair: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a document itself holds the word, the pair and the context of each of its tokens."""
    n = len(word)
    bucket, place, times = np.unique(np.concatenate([word, pair, before[:1]]), return_inverse=True, return_counts=True)
    return times[place[:n]], times[place[n : 2 * n]], times[np.searchsorted(bucket, before)]


def losses(counts: np.ndarray, total: float, where: tuple[np.ndarray, ...], own: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """Loss of each token in nats under one model, without what the document itself has added to it (``own``)."""
    word, pair, context = (counts[w].astype(np.float64) for w in where)
    if own is not None:
        word, pair, context, total = word - own[0], pair - own[1], context - own[2], total - len(word) - 1
    after = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    single = word / total if total > 0 else np.zeros(len(word))
    uniform = (1 - PAIR_WEIGHT - WORD_WEIGHT) / WORDS
    return -np.log(PAIR_WEIGHT * np.minimum(after, 1.0) + WORD_WEIGHT * single + uniform)


def score(docs: DataFrame, models: Models, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` (means), ``score``.

    A document is judged by models without its own counts, so being part of the target or not is no advantage in itself.
    """
    totals = [float(m[:WORDS].sum(dtype=np.float64)) for m in models]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "target_loss": [], "background_loss": [], "score": []}
        texts = binary_column(batch, "text")
        for text, is_target in zip(texts, batch.column("target").to_pylist(), strict=True):
            where = tokens(text)
            out["n_tokens"].append(len(where[0]))
            if not len(where[0]):
                for name, value in (("target_loss", None), ("background_loss", None), ("score", 0.0)):
                    out[name].append(value)
                continue
            own = own_counts(*where)
            background = losses(shared.value.background, totals[0], where, own)
            target = losses(shared.value.target, totals[1], where, own if is_target else None)
            out["target_loss"].append(float(target.mean()))
            out["background_loss"].append(float(background.mean()))
            # the mean of the per-token differences
            out["score"].append(float((background - target).mean()))
        return {"doc_id": batch.column("doc_id")} | out

    source = docs.select(
        F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(
        source, run, f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    )


def _packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, the bytes of equal rank together."""
    flat = np.ascontiguousarray(values)
    return zstandard.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _packed_sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def slices(texts: DataFrame) -> DataFrame:
    """Documents in slices of about ``SLICE_TOKENS`` tokens, packed: ids, marks, lengths, the slice's words, and its tokens as
    positions among them. A slice holds one document at least, so a longer text is a slice of its own.
    """
    ship(texts.sparkSession)
    id_kind = texts.schema["doc_id"].dataType.simpleString()
    ddl = f"slice bigint, n_tokens bigint, ids array<{id_kind}>, target array<boolean>, lengths binary, vocabulary binary, tokens binary"
    kind, schema = arrow_schema(texts.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, found = [], [], []
        size = number = 0

        def full() -> pa.RecordBatch:
            nonlocal size, number
            slot = TaskContext.get().partitionId() * (1 << 32) + number
            lengths = np.array([len(f) for f in found], dtype=np.int64)
            vocabulary, place = np.unique(np.concatenate(found), return_inverse=True)
            row = [slot, size, list(ids), list(marks), _packed(lengths), _packed_sorted(vocabulary), _packed(place.astype(np.uint32))]
            number, size = number + 1, 0
            for kept in (ids, marks, found):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                marked_ids = zip(batch.column("doc_id").to_pylist(), batch.column("target").to_pylist(), strict=True)
                for text, (name, mark) in zip(binary_column(batch, "text"), marked_ids, strict=True):
                    ids.append(name)
                    marks.append(mark)
                    found.append(codes(text)[0])
                    size += len(found[-1])
                    if size >= SLICE_TOKENS:
                        yield full()
        if ids:
            yield full()
        release()

    return texts.select("doc_id", "text", "target").mapInArrow(run, kind)


class _Slice:
    """A slice's tokens: their documents, words and words before, and the sorted words and pairs they are positions of."""

    def __init__(self, row: dict):
        self.target = np.array(row["target"], dtype=bool)
        self.lengths = _unpacked(row["lengths"], np.int64)
        words_only, place = _unpacked_sorted(row["vocabulary"]), _unpacked(row["tokens"], np.uint32)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.words = np.union1d(words_only, np.array([_BEGIN], dtype=np.uint64)) if len(place) else words_only
        self.word = np.searchsorted(self.words, words_only)[place]
        self.begin = int(np.searchsorted(self.words, np.uint64(_BEGIN)))
        self.before = np.roll(self.word, 1)
        # the documents that have tokens; each starts with the begin mark
        self.filled = np.nonzero(self.lengths)[0]
        self.before[np.cumsum(self.lengths)[self.filled] - self.lengths[self.filled]] = self.begin
        self.pairs, self.pair = np.unique(pair_codes(self.words[self.before], self.words[self.word]), return_inverse=True)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys and their background and target counts, of words (with the begin mark) and of pairs."""
        begins = [len(self.filled), int(self.target[self.filled].sum())]
        out = []
        for keys, place in ((self.words, self.word), (self.pairs, self.pair)):
            both = [np.bincount(p, minlength=len(keys)) for p in (place, place[self.target[self.doc]])]
            if keys is self.words and len(keys):
                for counted, n in zip(both, begins, strict=True):
                    counted[self.begin] += n
            out.append((keys, *both))
        return out

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often its document holds the word, the pair and the context of each token."""
        size = len(self.words)
        held = np.concatenate([self.doc * size + self.word, self.filled * size + self.begin])
        keys, place, times = np.unique(held, return_inverse=True, return_counts=True)
        context = times[np.searchsorted(keys, self.doc * size + self.before)]
        _, pair, pair_times = np.unique(self.doc * len(self.pairs) + self.pair, return_inverse=True, return_counts=True)
        return times[place[: len(self.word)]], pair_times[pair], context


def _sent(stored: DataFrame, ranges: int) -> DataFrame:
    """Per slice, range of hashes and kind (0: words, 1: pairs) one row: the sorted keys and their counts in the slice."""
    kind, schema = arrow_schema(stored.sparkSession, "range bigint, slice bigint, kind int, keys binary, background binary, target binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for what, (keys, background, target) in enumerate(_Slice(row).counts()):
                    where = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                    edges = np.flatnonzero(np.diff(where, prepend=np.uint64(ranges)))
                    for low, high in zip(edges, [*edges[1:], len(keys)], strict=True):
                        part = [int(where[low]), row["slice"], what, _packed_sorted(keys[low:high])]
                        part += [_packed(c[low:high].astype(np.uint32)) for c in (background, target)]
                        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(part, schema, strict=True)], schema=schema)
        release()

    return stored.select("slice", "target", "lengths", "vocabulary", "tokens").mapInArrow(run, kind)


def _corpus_counts(sent: DataFrame) -> DataFrame:
    """For every row sent the counts of its keys in the whole corpus, in the order of the keys; ``words`` adds up to the vocabulary's size."""
    ddl = "slice bigint, range bigint, kind int, background binary, target binary, words bigint"
    kind, schema = arrow_schema(sent.sparkSession, ddl)

    def run(group: pa.Table) -> pa.Table:
        out = []
        for what in (0, 1):
            rows = [r for r in group.to_pylist() if r["kind"] == what]
            if not rows:
                continue
            parts = [_unpacked_sorted(r["keys"]) for r in rows]
            keys, place = np.unique(np.concatenate(parts), return_inverse=True)
            sums = []
            for name in ("background", "target"):
                counted = np.concatenate([_unpacked(r[name], np.uint32) for r in rows])
                sums.append(np.bincount(place, weights=counted, minlength=len(keys)).astype(np.uint64))
            words = int((keys != np.uint64(_BEGIN)).sum()) if what == 0 else 0
            at = 0
            for row, part in zip(rows, parts, strict=True):
                here = place[at : at + len(part)]
                out.append([row["slice"], row["range"], what, *[_packed(s[here]) for s in sums], words])
                at, words = at + len(part), 0
        release()
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return sent.groupBy("range").applyInArrow(run, kind)


def _judged(stored: DataFrame, counts: DataFrame, totals: dict[str, float], words: int) -> DataFrame:
    """The documents of each slice with their mean losses, from the corpus counts of the slice's words and pairs."""
    id_kind = stored.schema["ids"].dataType.elementType.simpleString()
    ddl = f"doc_id {id_kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    kind, schema = arrow_schema(stored.sparkSession, ddl)
    uniform = (1 - PAIR_WEIGHT - WORD_WEIGHT) / (words or 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        here = left.to_pylist()[0]
        rows = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["range"]))
        part, n = _Slice(here), _unpacked(here["lengths"], np.int64)
        own = part.own() if len(part.word) else (np.zeros(0),) * 3
        sums = {}
        for model in ("background", "target"):
            word, pair = (
                np.concatenate([np.zeros(0), *[_unpacked(r[model], np.uint64).astype(np.float64) for r in rows if r["kind"] == what]])
                for what in (0, 1)
            )
            # the document's own counts are left out where they were counted
            share = np.ones(len(part.doc)) if model == "background" else part.target[part.doc].astype(np.float64)
            if not len(part.word):
                sums[model] = np.zeros(len(n))
                continue
            rest_word, rest_pair = word[part.word] - share * own[0], pair[part.pair] - share * own[1]
            rest_context, left_tokens = word[part.before] - share * own[2], totals[model] - share * (n[part.doc] + 1)
            after = np.divide(rest_pair, rest_context, out=np.zeros(len(own[0])), where=rest_context > 0)
            single = np.divide(rest_word, left_tokens, out=np.zeros(len(own[0])), where=left_tokens > 0)
            loss = -np.log(PAIR_WEIGHT * np.minimum(after, 1.0) + WORD_WEIGHT * single + uniform)
            sums[model] = np.bincount(part.doc, weights=loss, minlength=len(n))
        means = {m: [float(s) / int(k) if k else None for s, k in zip(sums[m], n, strict=True)] for m in sums}
        score = [b - t if t is not None else 0.0 for b, t in zip(means["background"], means["target"], strict=True)]
        columns = [here["ids"], n, means["target"], means["background"], score]
        release()
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return stored.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(run, kind)


def _totals(stored: DataFrame) -> dict[str, float]:
    """Tokens and begin marks of each model: both are counted, as contexts are."""
    kind, schema = arrow_schema(stored.sparkSession, "background double, target double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = _unpacked(row["lengths"], np.int64)
                counted = n + (n > 0)
                sums = [float(counted.sum()), float(counted[np.array(row["target"], dtype=bool)].sum())]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], schema=schema)

    row = stored.select("lengths", "target").mapInArrow(run, kind).agg(F.sum("background").alias("b"), F.sum("target").alias("t")).first()
    return {"background": row.b or 0.0, "target": row.t or 0.0}


def differences(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` (means), ``score``, from exact counts.

    A document is judged by models without its own counts, so being part of the target or not is no advantage in itself.
    """
    stored = materialise(
        slices(
            docs.select(
                F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target")
            )
        )
    )
    sizes = stored.agg(F.sum("n_tokens").alias("n")).first().n or 0
    counts = materialise(_corpus_counts(_sent(stored, max(1, -(-sizes // RANGE_TOKENS)))))
    words = counts.agg(F.sum("words").alias("n")).first().n or 0
    return _judged(stored, counts, _totals(stored), words)
