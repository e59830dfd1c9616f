"""Personal data by weak supervision, with DataFrame functions only.

Patterns give candidate spans in every whole text. Four labelers vote on each candidate (for, against, or not at all): its form, a
gazetteer of its kind, words in its surroundings, and its boundaries. The votes of the whole corpus are counted by kind and
pattern of votes, which is a table of bounded size; expectation-maximisation on it estimates each labeler's reliability and each
kind's rate, and a logistic span classifier is trained on the resulting probabilities. Spark then applies it as a column expression.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are always reported as their rules say. The further kinds (``local``: a telephone
number without country code, ``account``: an IBAN, ``ssn``) are added where the classifier says so.

A match's place is not known to Spark's functions, so a text is both split at a pattern and searched for it: a start is the sum of
the pieces and matches before it, in code points. The patterns have no step that backs off over an unbounded text: possessive
repeats and look-behinds give the leftmost matches of the plain patterns in linear time.

Defined cases: a null or empty text has no span; repeated documents each get their row; a corpus without candidates has no model
and no added span.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.llm.common import id_and_text
from evigrid.session import materialise


class Kind(NamedTuple):
    """``test`` is a cheap condition without which ``pattern`` has no match."""

    name: str
    pattern: str
    test: str
    gazetteer: str
    context: str


#: base kinds first; the order of equal starts. Patterns and word lists are fixed values.
KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
        r"\.(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at)$", r"mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]",
        r"^(?!0|10\.|127\.|192\.168\.|2[4-9][0-9]\.)", r"\bip\b|server|host|address|adresse|login",
    ),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}",
        r"^(?:4|5[\x20-]?[1-5]|3[\x20-]?[47]|6[\x20-]?0|35|2[\x20-]?[2-7])", r"card|visa|credit|pay|karte|tarjeta|carte",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
        r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"call|tel|phone|fax|mobil|handy|teléfono",
    ),
    Kind(
        "local", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}",
        r"^\(?[2-9]", r"call|tel|phone|fax|mobil|handy|teléfono",
    ),
    Kind(
        "account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
        r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", r"iban|account|bank|konto|cuenta|compte",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"\bssn\b|social|security",
    ),
)
BASE = 4
AROUND = 48
_AGAINST = r"version|build|order|invoice|isbn|example|ref(?:erence)?\b|serial"
VOTERS = ("form", "gazetteer", "context", "boundary")


def _matches(kind: Kind) -> Column:
    """Matches of a kind: the characters before each since the last one, its value, its surroundings."""
    text = F.col("text")
    present = text.contains(kind.test) if len(kind.test) == 1 else text.rlike(kind.test)
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # the pieces are named once, so that the text is split once
    both = F.struct(pieces.alias("pieces"), found.alias("found"))
    placed = F.transform(
        F.array(both),
        lambda b: F.transform(
            b["found"],
            lambda value, i: F.struct(
                F.length(b["pieces"][i]).alias("gap"), value.alias("value"), F.right(b["pieces"][i], F.lit(AROUND)).alias("before"),
                F.left(b["pieces"][i + 1], F.lit(AROUND)).alias("after"),
            ),
        ),
    )[0]
    return F.when(present, placed)


def _digits(value: str = "value") -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn() -> Column:
    """Whether a short string of digits passes the check sum."""
    turned = F.reverse(_digits())
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(turned)),
        lambda i: F.when(i % 2 == 1, F.substr(turned, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(turned, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(turned, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _rule() -> Column:
    """The rule that a base match must meet; further kinds have none."""
    part = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
    size = F.length(_digits())
    return (
        F.when(F.col("kind") == 1, F.col("value").rlike(part))
        .when(F.col("kind") == 2, F.when(size.between(12, 19), _luhn()).otherwise(False))
        .when(F.col("kind") == 3, size.between(9, 15))
        .otherwise(True)
    )


def _by_kind(attribute: str, function) -> Column:
    out = F.lit(None)
    for i, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == i, function(getattr(kind, attribute))).otherwise(out)
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes() -> list[Column]:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    around = F.lower(F.concat_ws(" ", "before", "after"))
    one_digit = _digits().rlike(r"^([0-9])\1*$")
    glued = F.col("before").rlike(r"[\p{L}0-9_]$") | F.col("after").rlike(r"^[\p{L}0-9_]")
    return [
        _vote(F.col("value").rlike(r"[0-9@]") & ~one_digit, one_digit).alias("form"),
        _vote(_by_kind("gazetteer", lambda p: F.col("value").rlike(p)), ~_by_kind("gazetteer", lambda p: F.col("value").rlike(p))).alias("gazetteer"),
        _vote(_by_kind("context", lambda p: around.rlike(p)), around.rlike(_AGAINST)).alias("context"),
        _vote(~glued, glued).alias("boundary"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per match that meets its rule: ``row, kind, start, end`` and the labelers' votes."""
    nothing = F.array().cast("array<struct<kind:int,at:int,m:struct<gap:int,value:string,before:string,after:string>>>")

    def numbered(kind: int) -> Column:
        return F.transform(
            F.col(f"m{kind}"), lambda m, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), m.alias("m"))
        )

    listed = F.concat(*[F.coalesce(numbered(i), nothing) for i in range(len(KINDS))])
    each = docs.select("row", F.explode(listed).alias("x")).select("row", "x.kind", "x.at", "x.m.*")
    # the matches of one kind in one document: bounded by its length
    so_far = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(_rule()).select("row", "kind", F.col("start"), F.col("end"), *_votes())


class Reliability(NamedTuple):
    """``rate[kind]``: share of true candidates; ``says[truth][voter][vote + 1]``: probability of a vote."""

    rate: list[float]
    says: list[list[list[float]]]


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[Reliability, list[float]]:
    """Expectation-maximisation over (kind, votes, count) rows; also each row's probability of being true.

    Labelers start better than chance, which settles which class is which; every estimate is smoothed by one pseudo count.
    """
    voters = len(VOTERS)
    rate = [0.5] * len(KINDS)
    says = [[[0.5, 0.3, 0.2]] * voters, [[0.1, 0.3, 0.6]] * voters]
    truth = [0.5] * len(patterns)
    for _ in range(rounds):
        for r, (kind, votes, _count) in enumerate(patterns):
            odds = math.log(rate[kind] / (1 - rate[kind]))
            odds += sum(math.log(says[1][v][x + 1] / says[0][v][x + 1]) for v, x in enumerate(votes))
            truth[r] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        size, true = [2.0] * len(KINDS), [1.0] * len(KINDS)
        tally = [[[1.0, 1.0, 1.0] for _ in range(voters)] for _ in range(2)]
        for r, (kind, votes, count) in enumerate(patterns):
            size[kind] += count
            true[kind] += count * truth[r]
            for v, x in enumerate(votes):
                tally[1][v][x + 1] += count * truth[r]
                tally[0][v][x + 1] += count * (1 - truth[r])
        rate = [t / s for t, s in zip(true, size, strict=True)]
        says = [[[c / sum(row) for c in row] for row in side] for side in tally]
    return Reliability(rate, says), truth


def train(patterns: list[tuple[int, tuple[int, ...], int]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights (kinds, then votes for and against of each labeler) fitted to the estimated truth."""
    _, truth = estimate(patterns)
    weights = [0.0] * (len(KINDS) + 2 * len(VOTERS))
    total = sum(count for *_, count in patterns) or 1
    for _ in range(steps):
        slope = [0.001 * w for w in weights]
        for (kind, votes, count), wanted in zip(patterns, truth, strict=True):
            active = [kind, *[len(KINDS) + 2 * v + (x > 0) for v, x in enumerate(votes) if x]]
            value = sum(weights[i] for i in active)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, value)))) - wanted) * count / total
            for i in active:
                slope[i] += error
        weights = [w - rate * s * 4 for w, s in zip(weights, slope, strict=True)]
    return weights


def _probability(weights: list[float]) -> Column:
    value = F.element_at(F.array(*[F.lit(w) for w in weights[: len(KINDS)]]), F.col("kind") + 1)
    for v, name in enumerate(VOTERS):
        against, favour = weights[len(KINDS) + 2 * v : len(KINDS) + 2 * v + 2]
        value = value + F.when(F.col(name) > 0, favour).when(F.col(name) < 0, against).otherwise(0.0)
    return 1 / (1 + F.exp(-value))


def find(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``row``, ``doc_id`` and ``spans``, an array of ``kind, start, end, base, probability`` in order."""
    source = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # stored without the texts, so that all uses read one set of row numbers
    stored = materialise(source.select("row", "doc_id", *[_matches(k).alias(f"m{i}") for i, k in enumerate(KINDS)]))
    found = materialise(candidates(stored))
    # at most 7 kinds times 3^4 patterns of votes
    counted = found.groupBy("kind", *VOTERS).count().collect()
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTERS), r["count"]) for r in counted)
    probability = _probability(train(patterns))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    shown = found.withColumn("probability", probability).where((F.col("kind") < BASE) | (F.col("probability") >= threshold))
    gathered = shown.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "probability"))).alias("s")
    )
    # an added span inside a base one says nothing new
    base = F.filter("s", lambda s: s["kind"] < BASE)
    apart = F.filter(
        "s",
        lambda s: (s["kind"] < BASE) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    spans = F.transform(
        apart,
        lambda s: F.struct(
            names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < BASE).alias("base"),
            s["probability"].alias("probability"),
        ),
    )
    out = gathered.select("row", spans.alias("spans"))
    nothing = F.filter(F.array(F.lit(None).cast(out.schema["spans"].dataType.elementType)), lambda s: s.isNotNull())
    return stored.select("row", "doc_id").join(out, "row", "left").select(
        "row", "doc_id", F.coalesce("spans", nothing).alias("spans")
    )
