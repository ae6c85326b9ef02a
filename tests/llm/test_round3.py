"""Fingerprints, collocations and the audit of filters against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genospark.llm import collocations, filter_audit, gru_lm, multiset_hash, queries, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n bigint, look string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents() -> list:
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["Été", "naïve", "x\x00y", "$5"]
    plain = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \t ", "one", "\n", "a\nb", "b\na", "🎉é\nx", "new york city. New  York\tCity, new york! " * 30, plain(30_000), plain(300), plain(300).upper()]
    texts += ["\n".join(plain(9) for _ in range(k)) for k in range(12)] + [texts[10]] * 3 + ["| " + plain(250)] * 2
    rows = [(3 * k - 5, t, None if k % 7 == 6 else "en" if k % 2 else "fr", None if k % 5 == 4 else f"s{k % 2}", 1, "clash") for k, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], rows[10], (None, "no id", "en", "s1", None, None), (None, "no id", "en", "s1", None, None), (4, "another text of id 4", None, None, 2, "c")]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "look", "text")


def grams(text: str) -> Counter:
    found = Counter()
    for p in text.encode().split(b"\n"):
        p = p + b"\0" * (multiset_hash.GRAM - 1)
        found.update(p[k : k + multiset_hash.GRAM] for k in range(len(p) - multiset_hash.GRAM + 1))
    return found


def alike(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    size = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 1 - sum((x[g] - y[g]) ** 2 for g in x.keys() | y.keys()) / size if size else 1.0


def test_fingerprints(spark, docs, rows):
    found = multiset_hash.compared(docs).collect()
    assert len(found) == len(rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    records = sorted({(d is not None, d or 0, hashes[t], t or "") for d, t, *_ in rows}, reverse=True)
    by_id, prints = defaultdict(list), defaultdict(set)
    for r in found:
        by_id[r.doc_id].append(r)
    for k, (known, d, _, text) in enumerate(records):
        after = records[(k + 1) % len(records)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        mine = [r for r in by_id[d if known else None] if r.edited_sha256 == sha and r.n_chars == len(text)]
        assert len(mine) == sum(1 for x in rows if (x[0] is not None, x[0] or 0, x[1] or "") == (known, d, text))
        own, then, other = (multiset_hash.packed(multiset_hash.vector(x)) for x in (text, edited, after))
        for r in mine:
            assert (r.fingerprint, r.edited_fingerprint, r.n_paragraphs) == (own, then, text.count("\n") + 1)
            assert abs(r.near_edited - alike(text, edited)) < 0.25 and abs(r.near_next - alike(text, after)) < 0.25
            assert (r.near_edited == 1.0) == (own == then) or sorted(text) == sorted(edited)
            assert r.near_next == multiset_hash.likeness(multiset_hash.unpacked(own), multiset_hash.unpacked(other))
            prints[r.fingerprint].add("\n".join(sorted(text.split("\n"))))
    assert all(len(x) == 1 for x in prints.values())
    assert multiset_hash.compared(docs.limit(0)).count() == 0


def test_fingerprints_of_repeated_rows_and_many_ranges(spark):
    """A record that holds a third of 3,000 rows; a doc_id that holds as many texts; ranges with few keys."""
    rows = [(k, f"text {k}\nof some words") for k in range(1000)] + [(500, "again and again")] * 1000 + [(700, f"of one id {k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {p: Counter(map(tuple, multiset_hash.compared(df.repartition(p)).drop("near_edited", "near_next").collect())) for p in (1, 5)}
    assert found[1] == found[5] and sum(found[1].values()) == len(rows)
    assert max(found[1].values()) == 1000
    one = multiset_hash.compared(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_vectors_add_up():
    rnd = random.Random(1)
    for _ in range(20):
        lines = ["".join(rnd.choice("abcé \0") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(1, 9))]
        more = ["".join(rnd.choice("abcé ") for _ in range(rnd.randrange(40))) for _ in range(3)]
        v = multiset_hash.vector("\n".join(lines))
        mixed = lines + more
        rnd.shuffle(mixed)
        w = multiset_hash.changed(v, inserted="\n".join(more))
        assert multiset_hash.packed(w) == multiset_hash.packed(multiset_hash.vector("\n".join(mixed)))
        assert multiset_hash.packed(multiset_hash.changed(w, deleted="\n".join(more))) == multiset_hash.packed(v)
        if len(lines) > 1:
            assert multiset_hash.packed(multiset_hash.vector("\n".join(lines[1:]))) != multiset_hash.packed(v)


def mined(rows, most=3, least=10, top=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            s, _, le, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), le, r))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("most,least,top,inside,chunk", [(3, 10, 2000, 50, 400_000), (4, 3, 25, 60, 1000), (2, 2, 7, 50, 400_000)])
def test_collocations(docs, rows, most, least, top, inside, chunk, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    few = [r for r in rows if r[1] is None or len(r[1]) < 50_000]
    got = collocations.collocations(docs.filter("text IS NULL OR length(text) < 50000"), most, least, top, inside).collect()
    assert sorted(map(tuple, got)) == mined(few, most, least, top, inside)


def test_collocations_of_one_piece_and_none(spark, docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    rows = [(1, "of the people", "en")] * 5000 + [(2, f"of the x{k} by the people", "en") for k in range(200)]
    got = collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, got)) == mined([(*r, None) for r in rows])


def test_scores_beyond_64_bits(spark):
    rows = [(9 * 10**14, 9 * 10**14 + 7, 9 * 10**14 + 1), (10**14 + 3, 10**15 - 1, 10**15 - 2), (10, 11, 12)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("*", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_audit(spark, docs, rows):
    labels = [(d, k % 2, int(k % 3 == 0)) for k, (d, *_) in enumerate(rows) if k % 4] + [(None, 1, 1), (10_000, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(filter_audit.failures(docs, table))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    items = []
    for d, text, _, source, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        lower = any(e is not None and d is not None and e < d and (u or "") == t for e, u, *_ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": lower}
        items.append((source or "", {f for f, x in fails.items() if x}, d in good and d is not None, d in toxic and d is not None))
    want = {}
    shapley = Counter()
    for part in {p for p, *_ in items}:
        mine = [x[1:] for x in items if x[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                left = [x for x in mine if not x[0] & set(order[: step - 1])]
                gone = [x for x in left if f in x[0]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    found = {(r.part, r.filter_order, r.step): [*r[3:]] for r in got.collect()}
    assert found == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    assert filter_audit.audited(filter_audit.failures(docs.limit(0), table)).count() == 0
    assert len({k[0] for k in found}) == 3


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    kinds = {
        "op11_multiset_hash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    }
    for name, columns in kinds.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.dtypes[: columns.count(",") + 1] == [tuple(c.split()) for c in columns.split(", ")], name
        assert np.all([x is not None for x in df.first()])


def test_language_model_does_not_depend_on_partitions(spark):
    """One and seven input partitions, eighteen streams, a record that holds a third of all rows: equal scores but for rounding."""
    rnd = random.Random(2)
    vocabulary = [f"w{int(rnd.expovariate(0.05))}" for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60)))) for k in range(1200)] + [(5, "the very same text again and again")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = gru_lm.Settings(head=64, members=8, buckets=4, hidden=8, rounds=2, known=100, stream=1000)
    found = []
    for p in (1, 7):
        got = gru_lm.scored(df.repartition(p, F.rand(p)), s).collect()
        found.append(sorted((r.doc_id, r.n_tokens, r.held_out, round(r.base_score, 6), round(r.score, 2)) for r in got))
        assert len(got) == len(rows)
    assert [r[:4] for r in found[0]] == [r[:4] for r in found[1]]
    assert np.allclose([r[4] for r in found[0]], [r[4] for r in found[1]], atol=0.05)


def test_copies_are_dealt_out(spark):
    rows = [(k, 0, bytearray(b"ab")) for k in range(2000)] + [(7, 1, bytearray(b"cdcd"))] * 1000
    df = spark.createDataFrame(rows, "doc_id long, round int, codes binary")
    got = [gru_lm.dealt(df.repartition(p), 6).groupBy("round", "stream").agg(F.sum("copies").alias("n")).collect() for p in (1, 5)]
    assert sorted(got[0]) == sorted(got[1]) and sum(r.n for r in got[0]) == 3000
    assert {r.n for r in got[0] if r.round == 1} == {166, 167}


def test_passages_whose_halves_occur_apart(spark):
    """A passage of 80 words stands in one document, its halves apart in two earlier ones: a later document loses it, whichever of its
    grams are picked."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], {}
    for k in range(40):
        passage = [word() for _ in range(80)]
        first, second = " ".join(passage[:40]), " ".join(passage[40:])
        for at, text in enumerate((f"{some(20)} {first} {some(30)}", f"{some(30)} {second} {some(20)}", f"{some(25)} {first} {second} {some(25)}", f"{some(15)} {first} {second} {some(35)}")):
            rows.append((4 * k + at, text))
        passages[4 * k + 3] = f"{first} {second}"
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [sum(w in got[d].split() for w in passage.split()) for d, passage in passages.items()]
    assert max(left) < 3
    assert all(got[d] == text for d, text in rows if d % 4 < 3)


def test_lanes_where_documents_begin():
    rng = np.random.default_rng(3)
    for fresh in (rng.random((6, 5)) < 0.3, np.zeros((4, 3), bool), np.ones((1, 4), bool)):
        assert [x.tolist() for x in gru_lm._firsts(fresh)] == [np.flatnonzero(f).tolist() for f in fresh]


def test_tokens_are_cut_from_one_piece():
    words = [b"", b"a", "é\x00".encode(), b"", b"\xed\xa0\x80", b"b" * 300]
    for some in (words, words[:1], words[1:2]):
        assert gru_lm.split(pa.array(some, pa.binary())) == some
    assert gru_lm.split(pa.array(words, pa.binary())[2:5]) == words[2:5]
    assert gru_lm.split(pa.array(words, pa.binary()).dictionary_encode().dictionary) == list(dict.fromkeys(words))
