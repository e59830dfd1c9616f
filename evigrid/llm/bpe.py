"""Byte-level BPE encoding and decoding by tree concatenation.

The vocabulary is read from a tokenizer file (its path is a parameter). A text over ``leaf_chars`` code points is cut into
leaves, the leaves are encoded as rows of their own in parallel, and the token lists are concatenated pairwise up a tree.

A cut is *closed* where the pre-tokenizer splits whatever stands around: between two characters of different kinds
(letter, number, other) or before white space. Lists at a closed cut are simply appended. Where a long run of one kind of character
leaves no such place, the cut is *open*: a window around the join, a few tokens wide, is encoded again and grows until its first
token agrees with the left list and its last token with the right list. A token list is the encoding of its bytes exactly
when every pair of neighbours is the encoding of its own bytes; all neighbours in the joined list stand together in one
of the three lists, so agreement at one token on each side proves the join exact.

Defined cases: a null or empty text has no tokens; special tokens written out in a text become their ids; repeated
documents each get their row; decoding gives back the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import id_and_text, map_batches

LEAF_CHARS = 16_384
#: the pre-tokenizer's pattern of byte-level BPE files: a fixed value
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec(NamedTuple):
    engine: tiktoken.Encoding
    pieces: list[bytes]
    sizes: np.ndarray
    decimals: list[bytes]
    specials: dict[str, int]
    literal: re.Pattern[str] | None


def _byte_letters() -> dict[str, int]:
    """Byte-level files write a byte as a printable letter: itself where printable, else a letter from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a byte-level BPE file, once per worker process."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in specials}
    ranks = {bytes(letters[c] for c in token): number for token, number in vocabulary.items()}
    pieces = [b""] * (max([*ranks.values(), *specials.values()]) + 1)
    for token, number in ranks.items():
        pieces[number] = token
    for token, number in specials.items():
        pieces[number] = token.encode()
    engine = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    literal = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
    return Codec(engine, pieces, sizes, [b"%d" % i for i in range(len(pieces))], specials, literal)


def encode_text(c: Codec, text: str) -> list[int]:
    if c.literal is None or not c.literal.search(text):
        return c.engine.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for found in c.literal.finditer(text):
        out += c.engine.encode_ordinary(text[at : found.start()])
        out.append(c.specials[found.group()])
        at = found.end()
    return out + c.engine.encode_ordinary(text[at:])


def decode_ids(c: Codec, ids: Sequence[int]) -> str:
    return b"".join(map(c.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


def _kind(char: str) -> str:
    """``L``etter, ``N``umber, ``O``ther or ``Z`` for white space; empty where Unicode versions may differ."""
    group = unicodedata.category(char)[0]
    if char.isspace() or group == "Z":
        return "Z" if char in " \n\t\r" or group == "Z" else ""
    return {"L": "L", "N": "N", "P": "O", "S": "O", "M": "O"}.get(group, "")


def _closed(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits before ``text[at]`` whatever stands farther away."""
    left, right = _kind(text[at - 1]), _kind(text[at])
    if not left or not right or left == "Z":
        return False
    if right == "Z":
        return True
    return left != right and not (text[at - 1] == "'" and right == "L")


def leaves(text: str, leaf_chars: int = LEAF_CHARS, literal: re.Pattern[str] | None = None) -> list[tuple[str, bool]]:
    """Pieces of about ``leaf_chars`` code points, each with whether the cut behind it is open."""
    if len(text) <= leaf_chars:
        return [(text, False)]
    guarded = [m.span() for m in literal.finditer(text)] if literal else []
    out = []
    start = 0
    while len(text) - start > leaf_chars + leaf_chars // 2:
        goal = start + leaf_chars
        best, is_open = 0, False
        for at in range(goal, min(goal + leaf_chars // 2, len(text))):
            if _closed(text, at) and not any(s < at < e for s, e in guarded):
                best = at
                break
        if not best:
            best, is_open = _open_cut(text, goal)
            if any(s < best < e for s, e in guarded) or not best:
                break
        out.append((text[start:best], is_open))
        start = best
    return [*out, (text[start:], False)]


def _open_cut(text: str, goal: int) -> tuple[int, bool]:
    """A cut inside a run of one kind, four characters from its ends at least; 0 if there is none near ``goal``."""
    for at in range(goal, min(goal + 64, len(text) - 4)):
        if len({_kind(ch) for ch in text[at - 4 : at + 4]}) == 1 and _kind(text[at]):
            return at, True
    return 0, False


def _same_kind(data: bytes) -> bool:
    text = data.decode()
    kinds = {_kind(ch) for ch in text}
    return len(kinds) == 1 and "" not in kinds


def concatenate(c: Codec, left: list[int], right: list[int]) -> list[int]:
    """Encoding of the joined text of two encodings that meet at an open cut."""
    width = 4
    while width < len(left) and width < len(right):
        head, tail = left[-width:], right[:width]
        data = b"".join(map(c.pieces.__getitem__, head + tail))
        # a window starts and ends between characters, inside the run which was cut
        after = c.pieces[right[width]][0]
        if data[0] & 0xC0 != 0x80 and after & 0xC0 != 0x80:
            if not _same_kind(data):
                break
            again = c.engine.encode_ordinary(data.decode())
            if again[0] == head[0] and again[-1] == tail[-1] and len(again) > 1:
                return left[:-width] + again + right[width:]
        width *= 2
    # the whole of both sides
    return encode_text(c, b"".join(map(c.pieces.__getitem__, left + right)).decode())


def join_tree(c: Codec, parts: list[tuple[list[int], bool]]) -> list[int]:
    """Concatenate neighbouring lists, pair by pair, until one is left."""
    while len(parts) > 1:
        level = []
        for i in range(0, len(parts) - 1, 2):
            (left, is_open), (right, next_open) = parts[i], parts[i + 1]
            level.append((concatenate(c, left, right) if is_open and left and right else left + right, next_open))
        if len(parts) % 2:
            level.append(parts[-1])
        parts = level
    return parts[0][0] if parts else []


_OUTPUT = {
    "ids": "ids array<int>",
    "decoded": "decoded string",
    "digests": "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def _finish(c: Codec, ids: list[int], outputs: Sequence[str]) -> dict:
    row: dict = {}
    if "ids" in outputs:
        row["ids"] = ids
    if "decoded" in outputs:
        row["decoded"] = decode_ids(c, ids)
    if "digests" in outputs:
        row["n_tokens"] = len(ids)
        row["ids_sha256"] = hashlib.sha256(b",".join(map(c.decimals.__getitem__, ids))).hexdigest()
        row["decoded_sha256"] = hashlib.sha256(decode_ids(c, ids).encode()).hexdigest()
    return row


def encode_documents(
    docs: DataFrame,
    path: str,
    outputs: Sequence[str] = ("ids", "decoded"),
    leaf_chars: int = LEAF_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``doc_id`` and what ``outputs`` names: ``ids``, ``decoded`` (the text decoded from the ids),
    ``digests`` (number of tokens, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text).
    """
    source = id_and_text(docs, id_col, text_col)
    doc_id = f"doc_id {source.schema['doc_id'].dataType.simpleString()}"
    names = [d.split()[0] for o in outputs for d in _OUTPUT[o].split(", ")]
    schema = f"{doc_id}, " + ", ".join(_OUTPUT[o] for o in outputs)

    def columns(rows: list[dict], doc_ids: pa.Array) -> dict:
        return {"doc_id": doc_ids} | {n: [r[n] for r in rows] for n in names}

    def whole(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return columns(
            [_finish(c, encode_text(c, t), outputs) for t in batch.column("text").to_pylist()], batch.column("doc_id")
        )

    def cut(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        origin: list[int] = []
        out: dict[str, list] = {"at": [], "piece": [], "is_open": []}
        for i, text in enumerate(batch.column("text").to_pylist()):
            for at, (piece, is_open) in enumerate(leaves(text, leaf_chars, c.literal)):
                origin.append(i)
                out["at"].append(at)
                out["piece"].append(piece)
                out["is_open"].append(is_open)
        taken = pa.array(origin, type=pa.int64())
        return out | {"row": batch.column("row").take(taken), "doc_id": batch.column("doc_id").take(taken)}

    def encode(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [np.array(encode_text(c, t), dtype=np.int32).tobytes() for t in batch.column("piece").to_pylist()]
        return {n: batch.column(n) for n in ("row", "doc_id", "at", "is_open")} | {"ids": ids}

    def join(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        rows = []
        for pieces in batch.column("leaves").to_pylist():
            ordered = sorted(pieces, key=lambda p: p["at"])
            parts = [(np.frombuffer(p["ids"], dtype=np.int32).tolist(), p["is_open"]) for p in ordered]
            rows.append(_finish(c, join_tree(c, parts), outputs))
        return columns(rows, batch.column("doc_id"))

    is_short = F.length("text") <= leaf_chars
    short = map_batches(source.where(is_short), whole, schema)
    long = source.where(~is_short).withColumn("row", F.monotonically_increasing_id())
    leaf = f"row bigint, {doc_id}, at int, is_open boolean"
    pieces = map_batches(long, cut, f"{leaf}, piece string").repartition("row", "at")
    encoded = map_batches(pieces, encode, f"{leaf}, ids binary")
    # the leaves of one document are bounded by its own length
    gathered = encoded.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "is_open", "ids")).alias("leaves")
    )
    return short.unionByName(map_batches(gathered, join, schema))
