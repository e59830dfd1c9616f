"""Contamination, secrets, personal data and tokens against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evigrid.llm import bpe, decontaminate, pii, secret_scan

PATH = public_tokenizers.path("byte_bpe_50k.json")
ITEMS = "item_id bigint, text string, doc_id string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((str(doc), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(rows):
    texts = dict(rows)
    return [
        (1, texts[72][300:420]), (2, "Word"), (3, None), (4, ""), (5, texts[50][:200].upper()), (6, texts[50][:200]),
        (None, texts[70]), (9, "the of"),
    ]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination_both_ways(spark, docs, rows, items, limit):
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    found = decontaminate.contamination(docs, bench, broadcast_windows=limit)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found.collect())
    assert got == plain_contamination(rows, items)
    spans = {(str(r.doc_id), r.n_hit, sum(s["end"] - s["start"] for s in r.spans)) for r in found.collect()}
    assert all(n == covered for _, n, covered in spans)


def test_clean_documents_stay(spark, docs, rows, items):
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    kept = decontaminate.clean(docs, bench)
    plain = plain_contamination(rows, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not (hit and 20 * hit >= n) for _, n, hit, _ in plain)
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_spans_are_removed(spark, make_docs):
    text = "Before it. " + " ".join(f"w{i}" for i in range(20)) + "; after."
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(3, 18)), "x")], ITEMS)
    out = decontaminate.remove_spans(make_docs([(1, text), (2, None)]), bench).collect()
    assert {r.doc_id: r.text for r in out} == {1: "Before it. w0 w1 w2 w18 w19; after.", 2: ""}


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return written(out)


def random_texts():
    rng = random.Random(8)
    parts = ["a@b.co", "_x@c.de.fr", "a@b.c@d.e", "1.2.3.4", "255.256.1.1", "0001.2.3.4", ".5.6", "+1 (2) 3", "+4912345678", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "12", " ", ".", "é", "日", "378282246310005", "+", "-", "@", "x", "\n", "password: abcdef123456", "AKIA", "ABCDEFGH12345678",
             "0123456789abcdef", "token='", "API_KEY=", "secret", " = ", "\"", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def base_spans(frame):
    return sorted(
        (str(r.doc_id), ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans if s["base"])) for r in frame.collect()
    )


def test_personal_data(docs, rows, make_docs):
    assert base_spans(pii.find(docs)) == sorted((str(i), plain_pii(t or "")) for i, t in rows)
    texts = list(enumerate(random_texts()))
    assert base_spans(pii.find(make_docs(texts))) == sorted((str(i), plain_pii(t)) for i, t in texts)


def test_personal_data_of_long_runs(make_docs):
    """Neither deep recursion nor quadratic search on runs of one kind."""
    texts = [(1, "a" * 200_000), (2, "1 " * 100_000), (3, "1." * 100_000), (4, "a." * 60_000 + "@" + "b." * 60_000 + "c"), (5, "+1" + "(" * 200_000)]
    assert base_spans(pii.find(make_docs(texts))) == sorted((str(i), plain_pii(t) if i > 1 else "") for i, t in texts)


def test_added_spans_are_learned(make_docs):
    texts = [(i, f"please call my phone {200 + i}-555-{1000 + i} today") for i in range(60)]
    texts += [(100 + i, f"order ref {i}00-111-{2000 + i}x") for i in range(9)]
    found = pii.find(make_docs(texts)).collect()
    assert all([s["kind"] for s in r.spans] == ["local"] for r in found if r.doc_id < 100)
    assert pii.find(make_docs([])).count() == 0


def plain_secrets(text):
    out = []
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.ASCII):
        if len(m.group(1)) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 18:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m.group()) >= 16:
            out.append((m.start(), 2, m.end(), "hex"))
    return written(out)


def test_secrets(docs, rows, make_docs):
    assert base_spans(secret_scan.scan(docs)) == sorted((str(i), plain_secrets(t or "")) for i, t in rows)
    texts = list(enumerate(random_texts()))
    assert base_spans(secret_scan.scan(make_docs(texts))) == sorted((str(i), plain_secrets(t)) for i, t in texts)


def test_ownership_separates_examples_from_live_values(spark, docs):
    from pyspark.sql import functions as F

    found = secret_scan.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    verdicts = {(s["kind"], s["verdict"], s["owners"]) for r in found.where("doc_id = 75").collect() for s in r.spans}
    # three owners hold the same text: examples, so the login span is not added
    assert verdicts == {("assign", "example", 3), ("access", "example", 3), ("hex", "example", 3)}
    alone = secret_scan.scan(docs.where("doc_id = 75"), owner=F.col("source"), repository=F.col("lang"))
    assert {(s["kind"], s["verdict"]) for r in alone.collect() for s in r.spans} == {
        (k, "live") for k in ("assign", "access", "hex", "login")
    }


def test_redaction(docs, rows, no_docs):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[81][0] == "[SECRET]' [SECRET]" and texts[81][1] == 18 and texts[1] == (None, 0)
    assert texts[4] == ("word", 4)
    assert secret_scan.redact(no_docs).count() == 0


def test_tokens_equal_the_library(docs, rows, no_docs):
    library = Tokenizer.from_file(PATH)
    expected = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    for leaf in (64, 1000, bpe.LEAF_CHARS):
        got = bpe.encode_documents(docs, PATH, leaf_chars=leaf).collect()
        assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == expected
    digests = bpe.encode_documents(docs, PATH, outputs=("digests",)).where("doc_id = 72").first()
    ids = next(i for d, i, _ in expected if d == "72")
    assert digests.n_tokens == len(ids) and digests.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_open_joins():
    """Long runs without a place to split are joined through windows."""
    library, c, rng = Tokenizer.from_file(PATH), bpe.codec(PATH), random.Random(3)
    opened = 0
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(["ab", "日本", "=-", "01", " ", "the's ", "é́", "😀"])) for _ in range(9)) * rng.randint(5, 60)
        pieces = bpe.leaves(text, rng.choice([16, 50]), c.literal)
        opened += sum(o for _, o in pieces)
        assert bpe.join_tree(c, [(bpe.encode_text(c, p), o) for p, o in pieces]) == library.encode(text, add_special_tokens=False).ids
        run = rng.choice(["a", "ab", "日", "=", " ", "7"]) * rng.randint(100, 900)
        pieces = bpe.leaves(run, 16, c.literal)
        opened += sum(o for _, o in pieces)
        assert bpe.join_tree(c, [(bpe.encode_text(c, p), o) for p, o in pieces]) == library.encode(run, add_special_tokens=False).ids
    assert opened > 1000


def test_two_copies_of_a_key_are_no_example(make_docs):
    key = "-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 20 + "\n-----END PRIVATE KEY-----"
    # make_docs deals ids to three sources: the first key has two owners, the second three
    texts = [(0, f"a {key} b"), (1, f"c {key} d"), *[(3 + i, f"e {key.replace('QUJD', 'REVG')} f") for i in range(3)]]
    out = {r.doc_id: r.text for r in secret_scan.redact(make_docs(texts)).collect()}
    assert out[0] == "a [SECRET] b" and out[1] == "c [SECRET] d"
    assert [out[3 + i] for i in range(3)] == [t for _, t in texts[2:]]


def test_long_logins_and_key_labels_are_found():
    """Runs have no bound, and texts that almost match stay linear."""
    login = "https://" + "u" * 500 + ":" + "p" * 5_000 + "@host"
    assert [(k, end - start) for k, start, end, _ in secret_scan.candidates(login)] == [(6, 3 + 500 + 1 + 5_000 + 1)]
    label = "VERY LONG " * 20
    key = f"-----BEGIN {label}PRIVATE KEY-----\nMIIE+/=\n-----END {label}PRIVATE KEY-----"
    assert [(k, start, end) for k, start, end, _ in secret_scan.candidates(key)] == [(3, 0, len(key))]
    assert secret_scan.candidates("http://u:short@h") == []
    for almost in ("://" + "u" * 300_000, "://u:" + "p" * 300_000, "-----BEGIN " + "A " * 150_000 + "PRIVATE KEY-----" + "Z" * 300_000):
        assert [s for s in secret_scan.candidates(almost) if s[0] in (3, 6)] == []
