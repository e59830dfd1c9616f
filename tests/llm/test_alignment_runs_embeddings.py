"""Token alignment, periodic runs and embedding near-duplicates against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from evigrid.llm import alignment, bpe, embeddings, periodic, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


# --- periodic runs


def plain_runs(words):
    """Every period in turn; a run found under several periods has the smallest."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_collapsed(words, runs):
    repeated = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in repeated)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repetitive(rng):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 9]))) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 8:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, min(len(words), a + p * rng.randint(3, 7) + rng.randint(0, p))):
                words[i] = words[a + (i - a) % p]
    return " ".join(words)


@pytest.fixture(scope="module")
def run_rows(rows):
    rng = random.Random(13)
    return rows + [(1000 + i, repetitive(rng)) for i in range(150)] + [(2000, "a " * 400), (2001, "é \t x  " * 60), (2001, "b b b b b b")]


@pytest.mark.parametrize("long_words", [periodic.LONG_WORDS, 20])
def test_runs_equal_every_period_in_turn(make_docs, run_rows, long_words):
    found = periodic.find_runs(make_docs(run_rows).repartition(3), ("runs", "collapsed", "digests"), long_words).collect()
    expected = []
    for i, text in run_rows:
        words = split(text)
        runs = plain_runs(words) if len(words) < 5000 else []
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = plain_collapsed(words, runs)
        expected.append((str(i), len(words), runs, kept, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    got = [
        (str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed, r.runs_sha256, r.collapsed_sha256)
        for r in found
    ]
    assert sorted(got) == sorted(expected)
    assert sum(len(r.runs) for r in found) > 100


def test_runs_of_an_empty_table(no_docs):
    assert periodic.find_runs(no_docs, ("digests",)).columns == ["doc_id", "n_words", "runs_sha256", "collapsed_sha256"]
    assert periodic.find_runs(no_docs).count() == 0


def test_query_edits_one_document_in_ten(make_docs, rows):
    some = rows + [(i, " ".join(str(k) for k in range(i % 37))) for i in range(200, 400)]
    got = collections.Counter(
        (str(r.doc_id), tuple(split(r.text))) for r in queries.periodic_texts(make_docs(some)).collect()
    )
    expected = collections.Counter()
    for i, text in some:
        words = split(text)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        expected[str(i), tuple(words)] += 1
    assert got == expected


def test_query_of_runs_equals_plain_version(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = queries.periodic_texts(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(docs) == len(got)
    for row in docs:
        words = split(row.text)
        if len(words) > 3000:
            continue
        runs = plain_runs(words)
        r = got[row.doc_id]
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], math.floor(1000 * -best[0] / best[2]))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *top)
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()


# --- token alignment


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows, paths):
    """Both sides walked together, the counts in one dictionary."""
    tokenizers = pytest.importorskip("tokenizers")
    import sentencepiece

    one = tokenizers.Tokenizer.from_file(paths[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    pieces = bpe.codec(paths[0]).pieces
    out, counts = [], collections.Counter()
    for i, text in rows:
        data = (" " + (text or "")).encode()
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        bytes_a = [pieces[x] for x in a]
        bytes_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append((str(i), 0, 0, 0, [], ""))
            continue
        j = k = 0
        left, right = len(bytes_a[0]), len(bytes_b[0])
        links, groups, group = [], [], ([a[0]], [b[0]])
        while True:
            links.append((a[j], b[k]))
            if left == right:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                j, k = j + 1, k + 1
                if j == len(a):
                    break
                group = ([a[j]], [b[k]])
                left, right = left + len(bytes_a[j]), right + len(bytes_b[k])
            elif left < right:
                j += 1
                group[0].append(a[j])
                left += len(bytes_a[j])
            else:
                k += 1
                group[1].append(b[k])
                right += len(bytes_b[k])
        counts.update(links)
        out.append((str(i), len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (i, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for i, n_a, n_b, n_groups, links, digest in out
    )


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 300])
def test_alignment_equals_walk(docs, rows, paths, slice_pairs):
    found = alignment.align_documents(docs, *paths, slice_pairs=slice_pairs)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain_alignment(rows, paths)


def test_alignment_groups_and_workers_that_hand_on_early(make_docs, paths, monkeypatch):
    rows = [(1, "an unbelievable café, l'été <|endoftext|>"), (2, "  two  spaces"), (3, "\x00"), (None, "tab\tand\nline")]
    got = alignment.align_documents(make_docs(rows), *paths, with_groups=True).collect()
    assert sorted((str(r[0]), *r[1:8]) for r in got) == plain_alignment(rows, paths)
    for r in got:
        flat = ";".join("|".join(",".join(map(str, side)) for side in (g.a, g.b)) for g in r.groups)
        assert r.groups_sha256 == (hashlib.sha256(flat.encode()).hexdigest() if r.n_a else "")


def test_alignment_of_empty_tables(make_docs, no_docs, paths):
    assert alignment.align_documents(no_docs, *paths).count() == 0
    assert [r.n_links for r in alignment.align_documents(make_docs([(1, ""), (2, None)]), *paths).collect()] == [0, 0]


def test_pointer_jumping_on_long_chains():
    a = np.append(np.arange(2, 4001, 2), 4001)
    b = np.append(np.arange(1, 4001, 2), 4001)
    assert set(alignment.last_of_group(a, b).tolist()) == {len(a) + len(b) - 1}


def test_packed_pairs_come_back():
    codes = np.array([0, 5, 1 << 40, (1 << 47) + 3], dtype=np.int64)
    counts = np.array([1, 2, 3, 70_000], dtype=np.int64)
    again = alignment.unpacked(alignment.packed(codes, counts), 4)
    assert again[0].tolist() == codes.tolist() and again[1].tolist() == counts.tolist()


# --- embeddings


def plain_links(rows, threshold=0.9):
    def valid(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = []
    for _, v in rows:
        if valid(v):
            one = np.array(v, dtype=float)
            one /= np.abs(one).max()
            units.append(one / np.linalg.norm(one))
        else:
            units.append(None)
    near = [
        [j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= threshold]
        for i, u in enumerate(units)
    ]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        members, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        seen |= members
        low = min((rows[j][0] for j in members if rows[j][0] is not None), default=None)
        for j in members:
            out[j] = (str(rows[j][0]), len(near[j]), str(low), rows[j][0] is not None and rows[j][0] == low)
    return sorted(out)


def vectors_with_groups(rng, n, size=16):
    rows = [(i, rng.standard_normal(size).tolist()) for i in range(n)]
    for g in range(6):
        base = rng.standard_normal(size)
        rows += [(1000 * (g + 1) + i, (base + rng.standard_normal(size) * 0.08 * g).tolist()) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(5)
    rows = vectors_with_groups(rng, 150)
    base = rows[200][1]
    rows += [(9000 + i, base) for i in range(40)] + [(9100, [2 * x for x in base]), (9101, [1e300 * x for x in base]), (9102, [-x for x in base])]
    rows += [(9200, None), (9201, []), (9202, [0.0] * 16), (9203, [1.0, None] * 8), (9204, [math.nan] * 16), (9205, [math.inf] * 16)]
    rows += [(9206, base[:8]), (9207, base[:8]), (None, base), (9208, [0.0] * 15 + [1e-300]), (9209, [-0.0] * 15 + [1e-300]), (9000, base)]
    return rows


@pytest.mark.parametrize("bucket_rows", [embeddings.BUCKET_ROWS, 16])
def test_embedding_links_equal_all_pairs(spark, vector_rows, bucket_rows):
    data = spark.createDataFrame([(i, v, 1, "n", 5) for i, v in vector_rows], "vec_id bigint, embedding array<double>, label int, node string, row int")
    got = embeddings.near_duplicates(data.repartition(4), bucket_rows=bucket_rows, miss=1e-9).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == plain_links(vector_rows)


def test_embedding_recall_of_production_parameters(spark):
    rng = np.random.default_rng(8)
    size, found = 64, []
    for i in range(600):
        one = rng.standard_normal(size)
        one /= np.linalg.norm(one)
        other = rng.standard_normal(size)
        other -= (other @ one) * one
        # just over the threshold, where a pair is missed most easily
        found += [(2 * i, one.tolist()), (2 * i + 1, (0.901 * one + math.sqrt(1 - 0.901**2) * other / np.linalg.norm(other)).tolist())]
    data = spark.createDataFrame(found, "vec_id bigint, embedding array<double>")
    got = embeddings.near_duplicates(data, bucket_rows=64).collect()
    assert sum(r.n_links for r in got) >= 1190
    assert all(r.component_id == r.vec_id - (r.vec_id % 2 if r.n_links else 0) for r in got)


def test_embedding_tables_without_links(spark):
    schema = "vec_id int, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    nothing = embeddings.near_duplicates(spark.createDataFrame([(1, None), (1, [0.0])], schema)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in nothing] == [(1, 0, 1, True)] * 2


def test_embedding_plan_meets_at_the_threshold():
    share = math.acos(0.9) / math.pi
    for rows in (10, 5_000, 1_000_000, 10**9):
        p = embeddings.plan(rows)
        assert embeddings.missed(p, share) <= embeddings.MISS
        assert rows / 2**p.width <= embeddings.BUCKET_ROWS
    # keys that share bits, by trial
    p = embeddings.Plan(12, 60, 2, 0, 0)
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 2, (4_000, 128), dtype=np.uint8)
    one = embeddings.keys_of(np.packbits(signs, axis=1, bitorder="little"), p)
    two = embeddings.keys_of(np.packbits(signs ^ (rng.random(signs.shape) < share), axis=1, bitorder="little"), p)
    assert abs((~(one == two).any(axis=1)).mean() - embeddings.missed(p, share)) < 0.02
