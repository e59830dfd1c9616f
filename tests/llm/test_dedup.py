"""SimHash classes, repeated byte strings and SpotSigs against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from evigrid.llm import components, queries, simhash, spotsigs, substrings, suffixes


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(pairs):
    """Smallest id reachable over fingerprints at most two bits apart."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    smallest = {}
    for i, f in pairs:
        if i is not None:
            smallest[root(f)] = min(i, smallest.get(root(f), i))
    plain_classes.count = len({root(f) for f in fps})
    return {f: smallest.get(root(f)) for f in fps}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a, b in itertools.combinations(range(64), 2))


def test_classes_equal_all_pairs(docs, rows):
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = plain_classes(pairs)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex().alias("h"), "component_id").collect()
    assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in got) == sorted(
        (str(i), f"{f:016x}", str(expected[f])) for i, f in pairs
    )


def test_links_of_dense_and_chained_fingerprints(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {centre}
    chain = {rng.getrandbits(64)}
    for step in range(20):
        chain.add(max(chain, key=lambda f: f) ^ (1 << step) ^ (1 << (step + 30)))
    fps = sorted(near | chain | {rng.getrandbits(64) for _ in range(60)})
    points = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp bigint, smallest bigint")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.classes(points).collect()}
    assert got == plain_classes([(k, f) for k, f in enumerate(fps)])


def test_one_of_each_class_stays(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = plain_classes([(i, plain_fingerprint(t)) for i, t in rows])
    # looser near copies may join classes, and every pair of kept documents is apart by the fingerprints
    fps = [plain_fingerprint(r.text) for r in kept.collect()]
    assert 0 < len(fps) <= plain_classes.count and len(expected) >= len(fps)
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(fps, 2))
    assert sum(r.text == rows[6][1] for r in kept.collect()) <= 1


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    assert substrings.remove_repeats(no_docs).count() == 0
    assert spotsigs.fingerprints_with_next(no_docs).count() == 0


@pytest.mark.parametrize("size", [2, 50])
def test_components_of_a_path(spark, size):
    order = list(range(size))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a bigint, b bigint")
    assert {r.label for r in components.smallest_labels(links).collect()} == {0}


def test_deep_shallow_order_and_prefixes():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([b"a", b"ab", b"abc\x00"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([5, 60])))) for _ in range(rng.randint(1, 14))]
        order, shared = suffixes.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        for k in range(1, len(order)):
            assert shared[k] == suffixes.common_prefix(strings[order[k - 1]], strings[order[k]])


def plain_removal(texts, length):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mark[i : i + length] = b"\x01" * length
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), len(t) - len(kept), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def removal(frame):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()]


def test_repeats_of_awkward_documents(docs, rows):
    got = removal(substrings.remove_repeats(docs))
    assert sorted(got) == sorted(plain_removal([(t or "").encode() for _, t in rows], 400))


@pytest.mark.parametrize(("length", "gram", "limit"), [(20, 5, 20_000), (20, 5, 1), (33, 8, 3)])
def test_repeats_of_small_alphabets(make_docs, length, gram, limit):
    """Also with groups too large for one task, which are settled by counting."""
    rng = random.Random(length + limit)
    passages = ["".join(rng.choice("abc") for _ in range(rng.randint(15, 90))) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[rng.randint(0, 9) :] + parts[2])
    texts += texts[:3] + ["a" * 100, "é" * 40]
    got = removal(substrings.remove_repeats(make_docs(list(enumerate(texts))), length, gram, limit))
    assert sorted(got) == sorted(plain_removal([t.encode() for t in texts], length))


def test_query_returns_what_is_left_of_each_text(spark, make_docs, tmp_path):
    """A shared passage of 400 bytes goes, one of 399 stays with its 57 words; a character cut in two leaves its mark."""
    rng = random.Random(8)
    long, short = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(58))[:n].ljust(n, ".") for n in (400, 399))
    texts = {1: f"A {long} B", 2: f"C {long} D", 3: f"E\n{short}\tF", 4: f"G\t{short}\nH", 5: f"I_{long}é", 6: f"J-{long}è", 7: None, 8: long}
    make_docs(list(texts.items())).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op3_suffix_array_dedup"](spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    left = {1: "AB", 2: "CD", 3: texts[3], 4: texts[4], 5: "I_\ufffd", 6: "J-\ufffd", 7: "", 8: ""}
    assert {r.doc_id: r.text for r in found.collect()} == left


def test_next_document_and_edited_text(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in ordered]
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in spotsigs.fingerprints_with_next(docs).collect())
    expected = collections.Counter()
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        digest = spotsigs.digest(spotsigs.signatures(text))
        expected[(ordered[k][0], len(text), hashlib.sha256(changed.encode()).hexdigest(), digest)] += 1
    assert got == expected


def test_likeness(make_docs):
    one = "the cat sat on a mat and the dog ran to the wood with an old hat of the king"
    same, other = spotsigs.signatures(one), spotsigs.signatures("das ist ein ganz anderer Text mit der Zeit und den Worten")
    assert spotsigs.likeness(same, same) == 1.0 and spotsigs.likeness(same, other) == 0.0
    assert spotsigs.likeness(same, same[: len(same) // 2], at_least=0.8) == 0.0
    single = spotsigs.fingerprints_with_next(make_docs([(5, one)])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    empties = spotsigs.fingerprints_with_next(make_docs([(1, None), (2, "")])).collect()
    assert {r.near_next for r in empties} == {1.0} and len({r.fingerprint for r in empties}) == 1


@pytest.mark.parametrize(("threshold", "block"), [(0.8, 20_000), (0.4, 5)])
def test_search_finds_all_that_brute_force_finds(docs, rows, threshold, block):
    sets = [(i, spotsigs.signatures(t or "")) for i, t in rows]
    queries = docs.where("doc_id % 2 = 0")
    expected = collections.Counter(
        (str(a), str(b), round(spotsigs.likeness(x, y), 9))
        for a, x in sets for b, y in sets
        if b is not None and b % 2 == 0 and len(x) and len(y) and spotsigs.likeness(x, y) >= threshold
    )
    got = spotsigs.search(docs, queries, threshold, block).collect()
    assert collections.Counter((str(r.doc_id), str(r.query_id), round(r.likeness, 9)) for r in got) == expected
    assert spotsigs.search(docs, queries.limit(0)).count() == 0


def test_verified_links(spark, make_docs):
    """Near copies with a few changed words are found, and nothing under the similarity."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(120, 300))]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 25):
            copy = list(base)
            for _ in range(changed):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "one", "a b c d", "a b c d e"]
    marked = [(i, t, simhash.word_fingerprints(t.encode())) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(marked, "row bigint, text string, fps array<bigint>")
    got = {(r.a, r.b) for r in simhash.verified_links(frame, frame.select("row")).collect()}
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]

    def similar(a, b):
        return bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    assert all(similar(a, b) for a, b in got)
    linked = {x for pair in got for x in pair}
    wanted = {x for a, b in itertools.combinations(range(len(texts)), 2) if similar(a, b) for x in (a, b)}
    assert linked <= wanted and len(linked) >= 0.9 * len(wanted)
    kept = simhash.keep_one(make_docs(list(enumerate(texts)))).count()
    assert 80 <= kept <= len(texts) - 0.9 * 80


def similar_pairs(texts, similarity=0.8):
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    return {
        (b, a) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] | sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    }


@pytest.mark.parametrize("edit", ["cut", "appended"])
def test_copies_with_one_contiguous_edit_are_found(spark, edit):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(120, 300))]
        more = [rng.choice(words) for _ in range(len(base) * 18 // 100)]
        texts += [" ".join(base), " ".join(base + more if edit == "appended" else base[: len(base) * 83 // 100])]
    marked = [(i, t, simhash.word_fingerprints(t.encode())) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(marked, "row bigint, text string, fps array<bigint>")
    got = {(r.a, r.b) for r in simhash.verified_links(frame, frame.select("row")).collect()}
    wanted = similar_pairs(texts)
    assert len(wanted) >= 55 and got <= wanted and len(got) >= 0.98 * len(wanted)


def test_an_outlying_smallest_row_loses_no_component(spark):
    """Copies that are alike only through their original, which has the largest row number."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(11):  # six changed words each, far apart and elsewhere in each copy
            copy = list(base)
            for at in range(6):
                copy[at * 50 + 4 * k] += "x"
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    frame = spark.createDataFrame([(i, t, simhash.word_fingerprints(t.encode())) for i, t in enumerate(texts)], "row bigint, text string, fps array<bigint>")
    wanted = similar_pairs(texts)
    # no copy is linked to another but those through the original
    assert wanted == {(i // 12 * 12 + 11, i) for i in range(len(texts)) if i % 12 != 11}
    got = {(r.a, r.b) for r in simhash.verified_links(frame, frame.select("row")).collect()}
    assert got == wanted


def copies_under_the_similarity(count, rng, changes=8):
    """An original of 300 words, and copies with that many changed words at places of their own: no two reach 0.8."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(count):
        copy = list(base)
        for at in rng.sample(range(0, 300, 6), changes):
            copy[at] += f"{k}x"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("count", [100, 400])
def test_copies_under_the_similarity_are_not_compared_in_pairs(spark, monkeypatch, count):
    texts = copies_under_the_similarity(count, random.Random(12))
    assert similar_pairs(texts) == set()
    frame = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    compared, plain = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    assert simhash.verified_links(frame, frame.select("row")).count() == 0
    # before, all pairs that share a band: 3,374 and 62,141
    assert len(compared) == simhash.STAR_ROUNDS + 1 and compared[-1] <= count


@pytest.mark.parametrize("seed", range(3))
def test_across_components_loses_no_pair(spark, seed):
    """Sets of many sizes, the similarity met exactly too, with labels of a few large and many small components."""
    rng = random.Random(seed)
    numbers = [rng.getrandbits(63) for _ in range(400)]
    sets = [set(numbers[:5]), set(numbers[:4])]
    for _ in range(40):
        one = set(rng.sample(numbers, rng.choice([1, 2, 5, 10, 40, 150])))
        sets.append(one)
        for _ in range(4):
            dropped = rng.sample(sorted(one), rng.randint(0, len(one) // 5))
            sets.append((one - set(dropped)) | set(rng.sample(numbers, rng.randint(0, max(1, len(one) // 8)))))
    labels = [-i if i < 2 or rng.random() < 0.5 else rng.choice([1, 2, 3]) for i in range(len(sets))]
    stored = [(i, len(s), bytearray(np.array(sorted(s), dtype=np.uint64).tobytes())) for i, s in enumerate(sets)]
    found = simhash.across_components(
        spark.createDataFrame(list(enumerate(labels)), "row bigint, label bigint"),
        spark.createDataFrame(stored, "row bigint, n bigint, shingles binary"), 0.8,
    )
    got = {(max(r.x, r.y), min(r.x, r.y)) for r in found.collect()}
    wanted = {
        (b, a) for a, b in itertools.combinations(range(len(sets)), 2)
        if labels[a] != labels[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert len(wanted) > 50 and (1, 0) in wanted and wanted <= got
    assert all(labels[a] != labels[b] for a, b in got)
