"""Corpus operators against brute force, with nulls, ties, repeated rows, long and empty texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.llm import components, gru_lm, jaccard_join, langid, media_png, mixing, quality, sharding, sp_tokens, substring_dedup, token_counts
from genospark.plans.batches import runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the of and to in that it was for on with as his they be at one have this from".split()
FR = "le la les des une est dans que qui pour pas sur avec plus par très être même où".split()


def texts() -> list:
    rnd = random.Random(3)
    plain = lambda words, n: " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "x", "ing"]) for _ in range(n))
    base = plain(EN, 120)
    passage = "A passage that " + plain(EN, 60) + " ends here."
    near = [" ".join(w if k != 7 * i + 3 else "changed" for k, w in enumerate(base.split())) for i in range(12)]
    out = [base, base, base, *near, None, "", "   \n\t ", "one", "two words", "a b c d", "a b c d", "### $$$ " * 40]
    out += [plain(EN, 80) + ". " + passage + " " + plain(EN, 30) + "." for _ in range(3)]
    out += [plain(FR, n) for n in (30, 60, 90, 200)] + [plain(EN, n) for n in (25, 50, 100, 400)]
    out += ["same line of seven words here now\n" * 9, plain(EN, 20_000), "123 456 !!", "<s> ▁ <0x0A>  café 🎉\x00 x", base.upper()]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, None if k == 5 else "fr" if t and "très" in t else "en", None if k % 9 == 4 else f"s{k % 3}", None, "clash") for k, t in enumerate(texts())]
    return [*out, out[0], out[0], (None, "a text without an id, of some nine words", "en", "s1", 1, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_quality_counts(docs, rows, empty):
    found = defaultdict(list)
    for r in quality.judged(docs).collect():
        found[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(8)}
        for r in found[doc_id]:
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
            assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
            assert not (r.base_failed and r.kept)
    assert sum(map(len, found.values())) == len(rows)
    assert quality.judged(empty).count() == 0


def test_quantile_sketch(spark):
    values = [*range(300), 10**6, 2**40 + 7]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    got = df.select("v", "b", quality.bucket_top(F.col("b")).alias("top")).collect()
    assert all(r.v <= r.top <= r.v * (1 + 1 / 32) for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_thresholds_follow_groups(spark):
    rows = [(k, " ".join(["word"] * 0 + [f"w{k}x{i}" for i in range(40)]) + (" | |" * (20 if k == 0 else 0)), "en", "s", None, None) for k in range(120)]
    out = quality.judged(spark.createDataFrame(rows, SCHEMA)).filter("NOT kept").collect()
    assert [r.doc_id for r in out] == [0]


def _dealt(sizes, old, shards):
    """Slots to shards by hand: each shard keeps its largest up to an even share, the rest goes, largest first, to the least one."""
    total, loads, out, moving = sum(sizes), [0] * shards, {}, []
    for shard in sorted(set(old)):
        had = 0
        for s in sorted((s for s in range(len(old)) if old[s] == shard), key=lambda s: (-sizes[s], s)):
            had += sizes[s]
            if shard < shards and had * shards <= total:
                out[s] = shard
                loads[shard] += sizes[s]
            else:
                moving.append(s)
    for s in sorted(moving, key=lambda s: (-sizes[s], s)):
        out[s] = loads.index(min(loads))
        loads[out[s]] += sizes[s]
    return [out[s] for s in range(len(old))]


def _slots(rows, n_slots):
    """The virtual slots of each record's rows, by hand."""
    out = []
    for (doc_id, crc, size), n in Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows).items():
        first = int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{crc}".encode()).hexdigest()[:8], 16)
        out += [(doc_id, size, crc, (first + k) % n_slots) for k in range(n)]
    return out


def _check_sharding(spark, rows, got, slot_map, old, shards, n_slots):
    want = _slots(rows, n_slots)
    sizes = [0] * n_slots
    for _, size, _, slot in want:
        sizes[slot] += size
    to = _dealt(sizes, old, shards)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.vslot, r.shard) for r in got) == Counter((*w, to[w[3]]) for w in want)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {r.vslot: r.shard for r in sharding.current(slot_map).collect()} == dict(enumerate(to))
    return to


def test_sharding_grows_and_shrinks(spark, docs, rows, empty):
    n_slots, slot_map, old = 64, None, [s % 4 for s in range(64)]
    many = rows + [rows[7]] * 300
    for shards, some in ((4, rows), (6, rows), (6, many), (3, many), (5, rows)):
        df = spark.createDataFrame(some, SCHEMA).repartition(3)
        versions = set() if slot_map is None else {r.version for r in slot_map.collect()}
        out, slot_map = sharding.sharded(df, shards, n_slots, slot_map)
        old = _check_sharding(spark, some, out.collect(), slot_map, old, shards, n_slots)
        assert len({r.version for r in slot_map.collect()} - versions) <= 2
    out, later = sharding.sharded(docs, 5, n_slots, slot_map)
    assert later.filter(F.col("version") > slot_map.agg(F.max("version")).first()[0]).isEmpty()
    assert sharding.sharded(empty, 4, 64)[0].count() == 0


def test_shards_of_repeats_are_even(spark, tmp_path):
    from genospark.llm import queries

    same = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("one record repeated").alias("text"))
    docs = same.unionByName(spark.range(2000).select((F.col("id") + 5).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_virtual_slots(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.filter("law <> 'bytes' OR grown_shard IS NOT NULL").isEmpty() and out.count() == 4000
    sizes = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 60


def test_sharding_balances(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = [r[1] for r in sharding.sharded(docs, 8)[0].groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 60


def test_targets_by_brute_force(spark):
    rnd = random.Random(5)
    for _ in range(6):
        sizes = [rnd.choice([0, 1, 5, 40, 1000, 30_000]) for _ in range(rnd.randint(1, 9))]
        df = spark.createDataFrame([(f"0s{k}", n) for k, n in enumerate(sizes)], "__s string, source_size long")
        got = {r["__s"]: r.target for r in mixing.targets(df).collect()}
        weights, total = [k % 3 + 1 for k in range(len(sizes))], sum(sizes)
        capped: set = set()
        while True:
            free = [k for k in range(len(sizes)) if k not in capped]
            left = total - sum(3 * sizes[k] for k in capped)
            share = left / sum(weights[k] for k in free) if free else 0
            over = [k for k in free if share * weights[k] > 3 * sizes[k]]
            if not over:
                break
            capped.update(over)
        want = [3 * sizes[k] if k in capped else share * weights[k] for k in range(len(sizes))]
        assert np.allclose([got[f"0s{k}"] for k in range(len(sizes))], want)


def test_mixture(docs, rows, empty):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    again = mixing.mixture(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    by = defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= max(r.size for r in got) for (_, t), n in by.items())
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixture(empty).count() == 0


def test_edited_counts(docs, rows, empty):
    import regex

    ranks = token_counts.read_ranks()
    counts, split = token_counts.Counts(ranks), regex.compile(token_counts.PATTERN)
    got = token_counts.edited_counts(token_counts.revision(docs), ranks).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r.n_tokens == len(counts._encode(text[r.doc_id])) and r.n_tokens_edited == len(counts._encode(r.text_edited))
        assert r.n_chars_edited == len(r.text_edited) and r.n_reencoded < 200
    rnd = random.Random(1)
    for _ in range(150):
        tree = token_counts.Tree("".join(rnd.choice(["a", "b ", " ", "  ", "\n", "'s", "'", "12", ".", "é"]) for _ in range(rnd.randint(0, 900))), split, counts)
        for _ in range(6):
            a = rnd.randint(0, len(tree.text))
            tree.edit(a, a + rnd.choice([0, 1, 5, 300]), rnd.choice(["", " ", "x", "'s", "  \n", "r"]))
            pieces = split.findall(tree.text)
            assert [n for b, _ in tree.blocks for n in b] == list(map(len, pieces))
            assert tree.total == sum(counts[p] for p in pieces) == tree.count(0, len(tree.text) + 1)
    assert token_counts.edited_counts(token_counts.revision(empty), ranks).count() == 0


def test_units_cover_words():
    for t in [x or "" for x in texts()] + ["a b\n\n \nc\nd e\n\n\nf", "one. two\nthree! four?\n\nfive"]:
        for unit in ("line", "paragraph", "sentence"):
            spans = substring_dedup.units(t, unit)
            assert [w for a, b in spans for w in words(t[a:b])] == words(t)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        lines, paragraphs = (substring_dedup.units(t, u) for u in ("line", "paragraph"))
        assert substring_dedup.units(t, "block") == lines + [p for p in paragraphs if sum(p[0] <= a < p[1] for a, _ in lines) > 1]
    assert substring_dedup.units("a\n b \n\t\nc", "paragraph") == [(0, 6), (8, 9)]


def test_units_of_long_runs():
    import time

    start = time.time()
    for t in ("." * 300_000 + " x", '."' * 150_000, "!?" * 150_000 + "\n", " " * 300_000 + "x", "x\n" * 150_000, "word. " * 50_000):
        for unit in substring_dedup.UNITS:
            assert substring_dedup.units(t, unit)
    assert time.time() - start < 20


@pytest.mark.parametrize("unit", substring_dedup.UNITS)
def test_dedup_by_brute_force(docs, rows, empty, unit):
    seen, gone = {}, defaultdict(list)
    unique = sorted({(r[0] is None, r[0], r[1]) for r in rows if r[1] is not None}, key=str)
    for none, doc_id, text in sorted(unique, key=lambda r: (r[0], r[1] or 0)):
        for a, b in substring_dedup.units(text, unit):
            key = " ".join(text[a:b].lower().split())
            if len(key.split()) >= 6:
                if seen.setdefault(key, (doc_id, a, b)) != (doc_id, a, b):
                    gone[doc_id].append((a, b))
    for k, spans in gone.items():
        ends = substring_dedup.joint(spans)
        gone[k] = list(zip(ends[::2], ends[1::2], strict=True))
    got = substring_dedup.deduplicated(docs, unit, passages=False).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert [tuple(s) for s in r.spans] == gone[r.doc_id] and r.n_removed == len(r.spans)
        left, at = "", 0
        for a, b in gone[r.doc_id]:
            left, at = left + text[r.doc_id][at:a], b
        assert r.text == (None if text[r.doc_id] is None else left + text[r.doc_id][at:])
    if unit != "sentence":
        return
    passage = [r for r in got if r.text and "A passage that" in text[r.doc_id]]
    assert sum("ends here" in r.text for r in passage) == 1


def test_dedup_of_nothing(empty):
    assert substring_dedup.deduplicated(empty).count() == 0


def _later_windows(texts):
    """Of each text the places of words in runs of 50 that an earlier place has too."""
    seen, out = {}, []
    for k, t in enumerate(texts):
        w, gone = [x.lower() for x in words(t)], set()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), (k, i)) != (k, i):
                gone.update(range(i, i + 50))
        out.append(gone)
    return out


def test_passages_by_windows(spark):
    rnd = random.Random(8)
    some = lambda n, tag: [f"{tag}{rnd.randrange(10**6)}" for _ in range(n)]
    three = ". ".join(" ".join(some(20, "p")) for _ in range(3)) + "."
    long, lines = " ".join(some(55, "q")), "\n".join(" ".join(some(5, "r")) for _ in range(12))
    lone = " ".join(some(50, "t"))
    texts = []
    for k in range(3):
        for x in (three, long, lines, lone):
            texts += [" ".join(some(7 + k, "h")) + " " + x + " " + " ".join(some(9, "h")) + " end."]
    texts += [three, long.upper(), lines, " ".join(some(49, "u")), " ".join(some(300, "v"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.deduplicated(df).collect()}
    for k, want in enumerate(_later_windows(texts)):
        stay = [w for i, w in enumerate(words(texts[k])) if i not in want]
        assert words(got[k].text) == stay
        assert got[k].n_removed == len(got[k].spans) == (1 if want else 0)


def test_passages_without_spaces(spark):
    passage = "".join(chr(0x4E00 + 37 * k) for k in range(80))
    df = spark.createDataFrame([(0, passage), (1, "vorher " + passage + " nachher"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(df).collect()}
    assert got == {0: passage, 1: "vorher nachher", 2: None}


def _sets(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_by_brute_force(docs, rows, empty):
    classes = defaultdict(list)
    for doc_id, text, *_ in rows:
        classes[_sets(text)].append(doc_id)
    sets = [s for s in classes if s]
    links = {a: [b for b in sets if a != b and len(a & b) >= 0.8 * len(a | b)] for a in sets}
    group = {s: s for s in sets}
    for a in sets:
        for b in links[a]:
            old, new = group[a], group[b]
            group = {s: new if g == old else g for s, g in group.items()}
    least = lambda ids: min((i is None, i or 0) for i in ids)
    got = defaultdict(list)
    for r in jaccard_join.similar(docs, block=4).collect():
        got[r.doc_id].append(r)
    for s in sets:
        members = [i for t in sets if group[t] == group[s] for i in classes[t]]
        for i in classes[s]:
            for r in got[i]:
                assert (r.n_links, r.n_copies) == (len(links[s]), len(classes[s]))
                assert (r.class_id is None, r.class_id or 0) == least(members)
    for i in classes[frozenset()]:
        assert [(r.class_id, r.n_links) for r in got[i]] == [(i, 0)]
    kept = jaccard_join.one_of_each(docs).collect()
    assert len(kept) == len({group[s] for s in sets}) + len(classes[frozenset()])
    assert jaccard_join.similar(empty).count() == 0


def test_components_by_brute_force(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(190)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(480, 560)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}


def test_prefixes_shorten_until_the_recall(spark, docs):
    """Near copies alone need no shortening; a text at the threshold's edge does; none found shortens to the last."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]

    def near(n, tag):  # n words changed, 10 apart: each takes 5 of 396 shingles
        return " ".join(f"{tag}{k}" if k % 10 == 5 and k // 10 < n else w for k, w in enumerate(base))

    def at(texts, recall):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = jaccard_join.signatures(df).select("cls", "sig").distinct()
        links, depth, had = jaccard_join.shortened(rows, 24, 6, 0.8, recall, 128)
        return links.count(), depth, had

    close = [near(1, f"c{k}x") for k in range(20)]
    n, depth, _ = at(close, 0.9999)
    assert n >= 19 and depth == 6
    edge = [near(7, f"e{k}x") for k in range(6)]  # similarity about 0.83 to base, less to each other
    n, depth, had = at([" ".join(base), *edge], 0.99999)
    assert depth < 6 and had >= 0.99999 and n >= 6
    assert at([f"text number {k} of its own, with w{k}a w{k}b w{k}c" for k in range(9)], 0.99999)[:2] == (0, jaccard_join.depth_for(0.99999))


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_recall_on_the_table(spark):
    """All links of a table's texts, by an inverted index, are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    classes, index = defaultdict(list), defaultdict(list)
    for r in docs.collect():
        classes[_sets(r.text)].append(r.doc_id)
    sets = [s for s in classes if s]
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    links = Counter()
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in index[x] if j != k)
        links[k] = sum(n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9 for j, n in shared.items())
    want = {i: links[k] for k, s in enumerate(sets) for i in classes[s]}
    got = {r.doc_id: r.n_links for r in jaccard_join.similar(docs).collect()}
    assert sum(want.values()) > 0 and {i: got[i] for i in want} == want


def test_recall_depth():
    k = jaccard_join.depth_for(jaccard_join.RECALL)
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES


def test_runs_keep_groups_whole():
    import pyarrow as pa

    keys = [1] * 5 + [2] + [3] * 9 + [4, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 4]), pa.array(range(a, min(a + 4, len(keys))))], names=["k", "v"]) for a in range(0, len(keys), 4)]
    out = [t.column("k").to_pylist() for t in runs(batches, 1)]
    assert [k for t in out for k in t] == keys
    assert all(not set(a) & set(b) for a, b in zip(out, out[1:], strict=False))


def test_png_all_filters():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (17, 192), (40, 7, 3), (9, 4, 4), (5, 6, 2)):
        x = rng.integers(0, 256, shape, np.uint8)
        assert (media_png.decode(media_png.encode(x)).reshape(shape) == x).all()
    for c in (1, 3):
        h, w = 12, 9
        x = rng.integers(0, 256, (h, w * c), np.uint8).astype(int)
        lines = np.zeros((h, w * c + 1), np.uint8)
        for y in range(h):
            kind = y % 5
            for k in range(w * c):
                a = x[y, k - c] if k >= c else 0
                b = x[y - 1, k] if y else 0
                e = x[y - 1, k - c] if y and k >= c else 0
                p = a + b - e
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - e), 2, e))[2]
                lines[y, k + 1] = (x[y, k] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
            lines[y, 0] = kind
        assert (media_png.unfiltered(lines, c) == x).all()
    png = bytearray(media_png.encode(np.zeros((4, 4), np.uint8)))
    png[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media_png.decode(bytes(png))


def test_media(docs, rows, empty):
    text = {r[0]: r[1] for r in rows}
    for r in media_png.stored(docs).collect():
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert media_png.decode(bytes(r.media)).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert len(r.phash) == 8
    assert media_png.stored(empty).count() == 0


def test_low_frequencies_ignore_noise():
    picture = np.kron(np.random.default_rng(4).integers(20, 230, (8, 8)), np.ones((8, 8), int)).astype(np.uint8)
    noisy = np.clip(picture + np.random.default_rng(0).integers(-6, 7, picture.shape), 0, 255).astype(np.uint8)
    b = media_png.cosine_basis()
    near, far = (bin(int.from_bytes(media_png.low_frequency_hash(picture, b)) ^ int.from_bytes(media_png.low_frequency_hash(z, b))).count("1") for z in (noisy, picture[::-1].T))
    assert near < 20 and near < far


def test_sentencepiece_parity(docs, rows, empty):
    import sentencepiece

    with open(sp_tokens.MODEL, "rb") as f:
        model = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = {r[0]: r[1] for r in rows}
    got = sp_tokens.encoded(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if text[r.doc_id] is None:
            assert r.ids is None and r.parity is None
            continue
        assert r.ids == library.encode(text[r.doc_id]) and r.parity
        assert (text[r.doc_id] if r.round_trip else r.decoded) == library.decode(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, np.int32).tobytes())
    whole = sp_tokens.tokenizer(model)
    for t in [x for x in texts() if x][:30]:
        assert whole.encode(t, add_special_tokens=False).ids == library.encode(t)
    assert sp_tokens.encoded(empty, model).count() == 0


def test_language_model(docs, rows, empty, spark):
    s = gru_lm.Settings(head=64, members=8, buckets=4, hidden=8, rounds=2, known=100)
    got = gru_lm.scored(docs, s).collect()
    assert len(got) == len(rows)
    lower = lambda t: [w.encode().lower() for w in words(t)] + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in lower(t))
    n = sum(c.values())
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w = lower(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert np.isclose(r.base_score, sum(np.log10((c[x] + 1) / (n + len(c) + 1)) for x in w))
        assert r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert gru_lm.scored(empty, s).count() == 0


def test_language_model_is_a_distribution_and_has_right_gradients():
    s = gru_lm.Settings(head=6, members=3, buckets=2, hidden=3, known=10)
    v = gru_lm.Vocabulary([b"", b"a", b"b", b"c", b"d", b"e"], [9, 8, 7, 6, 5, 4], 60, 10, {0: (12, 2), 1: (9, 2)}, s)
    g = gru_lm.Gru(v)
    rng = np.random.default_rng(0)
    g.parts = [p.astype(np.float64) + rng.normal(0, 0.2, p.shape) for p in g.parts]
    g.emb, g.rec, g.wc, g.bc, g.ww, g.bw = g.parts
    states = rng.normal(0, 1, (8, 3))
    assert np.allclose(sum(np.exp(g.log_probs(states, np.full(8, k))) for k in range(8)), 1)
    x, fresh, real = rng.integers(0, 8, (5, 4)), np.zeros((5, 4), bool), np.ones((5, 4), bool)
    fresh[0], fresh[3, 1], real[4, 2] = True, True, False
    h = np.zeros((3, 4))
    grads, _, loss = g.gradients(x, fresh, real, h)
    for p, d in zip(g.parts, grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-3
            up = g.gradients(x, fresh, real, h)[2]
            p[at] = old - 1e-3
            down = g.gradients(x, fresh, real, h)[2]
            p[at] = old
            assert abs((up - down) / 2e-3 - d[at]) < 2e-3
    codes = [rng.integers(0, 8, n) for n in (1, 40, 7, 100, 3)]
    one = [gru_lm.scores(g, [c])[0] for c in codes]
    assert np.allclose(gru_lm.scores(g, codes), one, atol=1e-3)


def test_languages(spark, docs, rows, empty):
    got = langid.predicted(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = text[r.doc_id]
        if not t or not any(ch.isalpha() for ch in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
            assert len(t.split()) < 20 or r.lang_pred == ("fr" if "très" in t else "en")
    assert langid.predicted(empty).count() == 0
    langs, table = ["en", "fr"], np.full((1 << 16, 2), 1e-5, np.float32)
    letters = langid.letter_table()
    for k, ws in enumerate((EN, FR)):
        bins = langid.trigrams(" ".join(ws * 5), letters)
        table[:, k] += np.bincount(bins, minlength=1 << 16) / len(bins)
    both = langid.mixture(langid.trigrams(" ".join((EN + FR) * 3), letters), table)
    assert set(both) == {0, 1} and 0.3 < both[0] < 0.7
    assert set(langid.mixture(langid.trigrams(" ".join(EN * 3), letters), table)) == {0}
    assert langs


def test_pipeline_by_brute_force(spark, tmp_path, docs):
    import corpus_pipeline as p

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, step) in enumerate(p.STAGES):
        after = step(spark, at, str(tmp_path))
        after.write.parquet(str(tmp_path / f"stage{k}"))
        before, after = at, spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert after.columns == before.columns
            if k == 0:
                want = quality.judged(before).filter("kept").select("doc_id", "text")
                assert Counter(map(tuple, want.collect())) == Counter(map(tuple, after.select("doc_id", "text").collect()))
            if k == 1:
                assert after.count() == jaccard_join.similar(before).select("keeper").distinct().count()
            if k == 2:
                assert after.count() == before.count()
            if k == 3:
                taken = sum(len(words(r.text)) for r in after.collect())
                assert taken == mixing.mixture(before).agg(F.sum("taken")).first()[0]
        at = after
    assert at.count() and found == {r.doc_id for r in at.collect()}
    assert all(r.parity for r in at.collect())


#: Names that operators use within, results' names, and some that need quoting.
CLASHES = ("th", "__id", "my col", "a.b", "target", "source_size", "lo_symbols", "__lang", "__w", "__rk", "spans", "n_words", "kept", "__bin", "size", "n", "m", "rk", "round", "row", "edits", "cls", "_c1_", "Spans", "vslot", "__th", "n_removed", "root", "digest")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The documents with columns of such names."""
    names = [n for n in CLASHES if n not in docs.columns and n != "Spans"]
    return docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])


def _rows(df, columns=None):
    return Counter(tuple(str(x) for x in r) for r in (df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])).collect())


OPERATORS = {
    1: lambda d: token_counts.edited_counts(token_counts.revision(d), token_counts.read_ranks()),
    2: lambda d: substring_dedup.deduplicated(d).select("doc_id", "text", "spans", "n_removed"),
    3: lambda d: quality.judged(d).select("doc_id", *quality.RESULTS),
    4: lambda d: sharding.sharded(d, 4, 64)[0],
    5: lambda d: media_png.stored(d),
    6: lambda d: sp_tokens.encoded(d, open(sp_tokens.MODEL, "rb").read()),
    7: lambda d: mixing.mixture(d),
    8: lambda d: jaccard_join.similar(d),
    9: lambda d: gru_lm.scored(d, gru_lm.Settings(head=64, members=8, buckets=4, hidden=8, rounds=1, known=100)).drop("score", "base_score"),
    10: lambda d: langid.predicted(d),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_clashing_names_change_nothing(docs, odd, empty, n):
    assert _rows(OPERATORS[n](odd)) == _rows(OPERATORS[n](docs))
    assert OPERATORS[n](empty).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_carry_clashing_names(spark, docs, odd, empty, k):
    import corpus_pipeline as p

    step = p.STAGES[k][1]
    got, plain = step(spark, odd, ""), step(spark, docs, "")
    if k == 4:
        assert _rows(got) == _rows(plain)
    else:
        assert got.columns == odd.columns and plain.columns == docs.columns
        assert _rows(got, docs.columns) == _rows(plain)
        kept = {r.doc_id for r in plain.select("doc_id").collect()}
        extra = [c for c in odd.columns if c not in docs.columns]
        want = {(str(r.doc_id), *(f"{c}{'-' if r.doc_id is None else r.doc_id}" for c in extra)) for r in odd.select("doc_id").collect() if r.doc_id in kept}
        assert set(_rows(got, ["doc_id", *extra])) == want
    nothing = step(spark, empty, "")
    assert nothing.count() == 0 and (k == 4 or nothing.columns == empty.columns)


def test_pipeline_of_nothing(spark, tmp_path, empty):
    import corpus_pipeline as p

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_half_of_all_rows_one_record(spark):
    """Half of the rows are one record, and one class has most texts: what tasks get stays even, results stay right."""
    same = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("one boiler plate text of some ten words that repeats everywhere").alias("text"))
    rest = spark.range(1000).select((F.col("id") + 10).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("one boiler plate text of some ten words that repeats everywhere")).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(12)])).alias("text"))
    docs = same.unionByName(rest)
    got = jaccard_join.similar(docs).groupBy("class_id").agg(F.count("*").alias("n"), F.min("n_copies").alias("c"), F.max("n_links").alias("l")).orderBy(F.desc("n")).collect()
    assert tuple(got[0]) == (7, 3500, 3500, 0) and len(got) == 501
    left = substring_dedup.deduplicated(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("t")).collect()
    assert {r.doc_id: r.t for r in left if r.doc_id != 7 and r.doc_id % 2 == 0} == {k: 0 for k in range(10, 1010, 2)}
    assert [(r.n, r.t) for r in left if r.doc_id == 7] == [(3000, 63)]


def test_hub_and_large_component(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(5000, k) for k in range(2000, 4000)] + [(k, 9000) for k in range(6000, 8000)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.root: r["count"] for r in got.groupBy("root").count().collect()} == {0: 4001, 6000: 2001}


def test_tables_are_deleted(spark, docs):
    import os

    from genospark.plans.tables import shared_dir

    def tables():
        return set(os.listdir(shared_dir(spark).removeprefix("file://")))

    before = tables()
    out = jaccard_join.similar(docs)
    out.count()
    assert len(tables() - before) <= 3
    before = tables()
    sharding.sharded(docs, 4, 64)
    assert len(tables() - before) <= 3


def test_trees_serve_one_revision_after_another(spark, docs, rows, empty):
    """States stored beside the texts: the second revision encodes what its edits touch, and nothing else."""
    import regex

    ranks = token_counts.read_ranks()
    counts, split = token_counts.Counts(ranks), regex.compile(token_counts.PATTERN)
    state = token_counts.trees(docs, ranks)
    text = {r[0]: r[1] or "" for r in rows}
    for k in range(3):
        edits = spark.createDataFrame([(i, n, 3 * k + 40 * n, 3 * k + 40 * n + 5, new) for i in text if i is not None for n, new in ((0, " seen"), (1, ""))], "doc_id long, number int, start long, stop long, new string")
        revision = token_counts.revised(token_counts.with_edits(state, edits), ranks)
        revision.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/revision-{k}-{random.random()}")
        got = spark.read.parquet(path).collect()
        assert len(got) == len(rows)
        for r in got:
            want = text[r.doc_id]
            assert (r.n_chars, r.n_tokens, r.n_pretokens) == (len(want), len(counts._encode(want)), len(split.findall(want)))
            for n, new in ((0, " seen"), (1, "")) if r.doc_id is not None else ():
                a, b = (min(3 * k + 40 * n + x, len(want)) for x in (0, 5))
                want = want[:a] + new + want[b:]
            assert r.text_edited == want and r.n_tokens_edited == len(counts._encode(want)) and r.n_reencoded < 60
            assert token_counts.Tree(want, split, counts, bytes(r.tree_edited)).encoded == 0
        text = {r.doc_id: r.text_edited for r in got}
        state = token_counts.next_state(spark.read.parquet(path))
    assert token_counts.revised(token_counts.with_edits(token_counts.trees(empty, ranks), edits), ranks).count() == 0


def test_packed_numbers():
    columns = [0, 254, 255, 256, 10**9, 3], [1, 2, 3, 255, 5, 70_000]
    assert token_counts._unpacked(token_counts._packed(*columns)) == list(columns)
    assert token_counts._unpacked(token_counts._packed([], [])) == [[], []]


def test_hash_by_brute_force(docs, rows):
    """Areas, transform and median again, cell by cell."""
    text = {r[0]: r[1] or "" for r in rows}
    for r in media_png.stored(docs).collect():
        raw = text[r.doc_id].encode()
        if len(raw) > 60_000:
            continue
        m = np.frombuffer(raw + b" " * (-len(raw) % 192 or (0 if raw else 192)), np.uint8).reshape(-1, 192).astype(float)
        h, small = len(m), np.zeros((32, 32))
        for y in range(32):
            weight = np.clip(np.minimum(np.arange(1, h + 1), (y + 1) * h / 32) - np.maximum(np.arange(h), y * h / 32), 0, None)
            small[y] = (weight @ m / weight.sum()).reshape(32, 6).mean(axis=1)
        k, n = np.arange(8)[:, None], np.arange(32)
        c = np.cos(np.pi * k * (2 * n + 1) / 64)
        low = np.round(c @ small @ c.T, 6).ravel()
        want = [int(v > np.median(low[1:])) for v in low]
        want[0] = 0
        assert bytes(r.phash) == int("".join(map(str, want)), 2).to_bytes(8)


def test_scores_by_brute_force(spark, docs, rows):
    """Whole documents, token by token, with the recurrence spelled out."""
    s = gru_lm.Settings(head=40, members=8, buckets=8, hidden=5, rounds=1, known=60)
    v = gru_lm.vocabulary(gru_lm.token_counts(docs), s)
    g, index = gru_lm.Gru(v), v.index()
    rng = np.random.default_rng(0)
    g.parts = [p + rng.normal(0, 0.3, p.shape).astype(np.float32) for p in g.parts]
    g.emb, g.rec, g.wc, g.bc, g.ww, g.bw = g.parts
    codes = [np.array([v.code[k] if k >= 0 else s.head - 1 - k for k in v.places(gru_lm.tokens(r[1]), index)]) for r in rows if len(r[1] or "") < 5000]
    got = gru_lm.scores(g, codes)
    sig = lambda a: 1 / (1 + np.exp(-a))
    for one, want in zip(codes, got, strict=True):
        h, total = np.zeros(5), 0.0
        for c in one.tolist():
            kind, place, size = (c // 8, c % 8, 8) if c < s.head else (g.classes + (c - s.head) // 2, (c - s.head) % 2, 2)
            a = h @ g.wc + g.bc
            b = (h @ g.ww[kind] + g.bw[kind])[:size]
            total += a[kind] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum())
            e, u = g.emb[c], g.rec.T @ h
            z, r = sig(u[:5] + e[:5]), sig(u[5:10] + e[5:10])
            h = z * h + (1 - z) * np.tanh(r * u[10:] + e[10:])
        assert abs(total - want) < 1e-3 * max(1, abs(total))
    g.wc *= 1000  # logits far beyond what exp takes
    assert np.isfinite(gru_lm.scores(g, codes)).all()


def test_tokens_in_arrays():
    import pyarrow as pa

    rnd = random.Random(4)
    some = ["".join(rnd.choice(["a", "B", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "É", "İ", "\x00"]) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + ["", None, "  "]
    words, ends = gru_lm.tokenised(pa.array(some, pa.string()))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [gru_lm.tokens(t) for t in some]


def test_lanes_of_one_long_text():
    codes = [np.zeros(200_000, np.int16), *[np.ones(5, np.int16)] * 40]
    seen = np.zeros(41, int)
    for x, fresh, real, doc in gru_lm.windows(codes, 41, 32):
        assert x.shape == fresh.shape == real.shape == doc.shape and (doc[real] >= 0).all() and (doc[~real] == -1).all()
        seen += np.bincount(doc[real], minlength=41)
    assert seen.tolist() == [len(c) for c in codes]


def test_mixtures_by_brute_force():
    """Expectation-maximisation and the choice of languages again, by plain loops."""
    rng = np.random.default_rng(3)
    table = rng.dirichlet(np.full(64, 0.4), 3).T.astype(np.float32) + 1e-6
    for share in ([1, 0, 0], [0.6, 0.4, 0], [0.3, 0.3, 0.4], [0, 0.05, 0.95]):
        bins = np.concatenate([rng.choice(64, int(400 * w), p=table[:, k] / table[:, k].sum()) for k, w in enumerate(share) if w])

        def fit(langs):
            p = dict.fromkeys(langs, 1 / len(langs))
            for _ in range(300):
                new = dict.fromkeys(langs, 0.0)
                for b in bins:
                    total = sum(p[k] * table[b, k] for k in langs)
                    for k in langs:
                        new[k] += p[k] * table[b, k] / total / len(bins)
                p = new
            return p, sum(np.log(sum(p[k] * table[b, k] for k in langs)) for b in bins)

        langs = [0, 1, 2]
        p, best = fit(langs)
        while len(langs) > 1:
            fewer = [k for k in langs if k != min(langs, key=p.get)]
            q, less = fit(fewer)
            if best - less >= 0.5 * np.log(len(bins)):
                break
            langs, p, best = fewer, q, less
        got = langid.mixture(bins, table)
        assert set(got) == set(langs) and all(abs(got[k] - p[k]) < 0.02 for k in langs)


def test_many_languages_take_fewer_bins(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"word{k % 7} plus some {'abcdefg'[k % 7] * 9} text", f"l{k % 7}") for k in range(70)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MODEL_BYTES", 7 * 4 * 1024)
    langs, table = langid.profile(df)
    assert len(langs) == 7 and table.shape == (1024, 7) and np.allclose(table.sum(axis=0), 1, atol=1e-4)
    right = {r.doc_id: r.lang_pred for r in langid.predicted(df).collect()}
    assert sum(right[k] == f"l{k % 7}" for k in range(70)) > 60
    monkeypatch.setattr(langid, "MODEL_BYTES", 1024)
    with pytest.raises(ValueError, match="too many"):
        langid.profile(df)


def test_very_long_texts(spark, empty):
    """A million marks and a text of 300,000 words, by every operator."""
    rnd = random.Random(2)
    texts = ["." * 1_000_000 + " end", " ".join(rnd.choice(EN) + str(rnd.randrange(99)) for _ in range(300_000)), "short text of some six words"]
    df = spark.createDataFrame([(k, t, "en", "s1", None, None) for k, t in enumerate(texts)], SCHEMA)
    for n, f in OPERATORS.items():
        assert f(df).count() == 3, n


def test_unigram_model_by_its_file():
    """A small unigram model, laid down field by field: scores, byte fallback, unknowns and markers, against the library."""
    import struct as st

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, bytes):
            return varint(number << 3 | 2) + varint(len(value)) + value
        return varint(number << 3 | 5) + st.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    words = ["▁", "▁the", "▁a", "the", "he", "t", "h", "e", "r", "▁there", "re", "s", "▁s", "ing", "i", "n", "g", "▁sing", "er", "a", "é"]
    pieces += [(w, -float(k + 1) * 0.7 - 1, 1) for k, w in enumerate(words)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = sp_tokens.Model(data)
    assert model.kind == sp_tokens.UNIGRAM and model.byte_fallback and len(model.pieces) == library.get_piece_size()
    coder = sp_tokens.Coder(data)
    assert not coder.by_word
    texts = ["the singer sings there", "there", "a theréa", "zebra 12", "  the   ring ", "", "the 🎉"]
    ids, agree, back = coder.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t) for t in texts] and all(agree)
    assert back == [library.decode(library.encode(t)) for t in texts]
