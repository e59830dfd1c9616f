"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate spans in every whole text. The digest of each candidate's value is counted over the whole corpus by distinct
owners and repositories: a value in three or more of both is a copied example, one which stays with fewer looks live. Base
spans (``assign``, ``access``, ``hex``) are always reported, with that verdict beside them; spans of the further kinds
(``pem``, ``bearer``, ``prefixed``, ``login``) are added where the verdict is ``live``.

Hot values (one example may sit in a third of all documents) are counted with map-side combining, per value, owner and repository
first. No value is gathered; only its digest travels.

Defined cases: a null or empty text has no span; a null owner or repository is one more, unknown, owner or repository;
repeated documents each get their row; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import map_batches, ship, whole_text
from evigrid.session import materialise

#: base kinds first, then the added ones: the order of equal starts
KINDS = ("assign", "access", "hex", "pem", "bearer", "prefixed", "login")
BASE = 3
#: values with at most so many owners, or at most so many repositories, look live: more of both means widely copied
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 2

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: runs of hexadecimal digits are maximal, so a minimum length may stand in the pattern
_HEX = re.compile(r"[0-9a-f]{16,}")
#: runs are possessive or end at a sign outside of them, so they need no bound to be linear
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END [A-Z ]*PRIVATE KEY-----")
_BEARER = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]|glpat|sk_live|rk_live|xox[abprs])[_-][A-Za-z0-9-]{16,}")
_LOGIN = re.compile(r"://[^\s:/@]++:([^\s:/@]{6,}+)@")


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, digest of the value), by start and then kind."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 12:
            found.append((m.start(), 0, m.end(), m.group(1)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end(), m.group(1)) for m in _PEM.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end(), m.group()) for m in _BEARER.finditer(text)]
    if "_" in text or "-" in text:
        found += [(m.start(), 5, m.end(), m.group()) for m in _PREFIXED.finditer(text)]
    if "://" in text:
        found += [(m.start(), 6, m.end(), m.group(1)) for m in _LOGIN.finditer(text)]
    found.sort(key=lambda s: s[:2])
    return [(kind, start, end, xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)) for start, kind, end, value in found]


_SPAN = "array<struct<kind:int,start:int,end:int,digest:bigint>>"


def scan(
    docs: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    live_owners: int = LIVE_OWNERS,
    live_repositories: int = LIVE_REPOSITORIES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``row``, ``doc_id`` and ``spans``, an array of ``kind``, ``start``, ``end``, ``base``, ``owners``,
    ``repositories``, ``verdict`` (``live`` or ``example``).
    """
    unknown = F.lit(None).cast("string")
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        whole_text(text_col).alias("text"),
        (unknown if owner is None else owner.cast("string")).alias("owner"),
        (unknown if repository is None else repository.cast("string")).alias("repository"),
    ).withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> dict:
        names = ("kind", "start", "end", "digest")
        spans = [[dict(zip(names, s, strict=True)) for s in candidates(t)] for t in batch.column("text").to_pylist()]
        return {n: batch.column(n) for n in ("row", "doc_id", "owner", "repository")} | {"spans": spans}

    kind = source.schema["doc_id"].dataType.simpleString()
    # stored without the texts, so that both uses read one set of row numbers
    stored = materialise(
        map_batches(source, run, f"row bigint, doc_id {kind}, owner string, repository string, spans {_SPAN}")
    )
    each = stored.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("span"))
    each = each.select("row", "owner", "repository", "span.*")
    held = each.select("digest", *[F.coalesce(c, F.lit("")).alias(c) for c in ("owner", "repository")])
    per_owner = held.groupBy("digest", "owner", "repository").count().groupBy("digest", "owner").agg(F.count("*").alias("n"))
    frequency = materialise(
        per_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    judged = each.join(frequency, "digest").select(
        "row",
        F.struct(
            "start",
            "kind",
            F.col("end"),
            F.col("owners"),
            F.col("repositories"),
            F.when((F.col("owners") <= live_owners) | (F.col("repositories") <= live_repositories), "live")
            .otherwise("example").alias("verdict"),
        ).alias("s"),
    )
    shown = judged.where((F.col("s.kind") < BASE) | (F.col("s.verdict") == "live"))
    # the spans of one document are bounded by its length
    gathered = shown.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    spans = F.transform(
        "s",
        lambda s: F.struct(
            names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (s["kind"] < BASE).alias("base"), s["owners"].alias("owners"), s["repositories"].alias("repositories"),
            s["verdict"].alias("verdict"),
        ),
    )
    out = gathered.select("row", spans.alias("spans"))
    nothing = F.filter(F.array(F.lit(None).cast(out.schema["spans"].dataType.elementType)), lambda s: s.isNotNull())
    return stored.select("row", "doc_id").join(out, "row", "left").select(
        "row", "doc_id", F.coalesce("spans", nothing).alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(
    docs: DataFrame, owner: Sequence[str] = ("source",), repository: Sequence[str] = ("source", "lang"), mark: str = "[SECRET]"
) -> DataFrame:
    """The documents with every reported span of their text replaced by ``mark``; spans which overlap become one mark.

    ``owner`` and ``repository`` name the columns that make them up. ``n_chars``, where there is one, follows the text; other
    columns stay as they are.
    """
    numbered = materialise(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("number")))
    view = numbered.select(
        F.col("number").alias("doc_id"),
        F.col("document.text").alias("text"),
        F.concat_ws("/", *[F.col("document")[c] for c in owner]).alias("owner"),
        F.concat_ws("/", *[F.col("document")[c] for c in repository]).alias("repository"),
    )
    found = scan(view, owner=F.col("owner"), repository=F.col("repository")).where(F.size("spans") > 0)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    met = numbered.join(
        materialise(found.select(F.col("doc_id").alias("number"), spans.alias("spans"))), "number", "left"
    )
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts, lists):
        return texts.combine(lists, lambda t, s: t if t is None or s is None else _cleaned(t, s, mark))

    text = F.when(F.col("spans").isNull(), F.col("document.text")).otherwise(clean(F.col("document.text"), F.col("spans")))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kept = F.col("document.n_chars")
        changed["n_chars"] = F.when(F.col("spans").isNull(), kept).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return met.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def _cleaned(text: str, spans, mark: str) -> str:
    out, last = [], 0
    for span in spans:
        if span["start"] >= last:
            out += [text[last : span["start"]], mark]
        last = max(last, span["end"])
    return "".join([*out, text[last:]])
