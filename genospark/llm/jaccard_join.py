"""Joining texts whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

Texts with equal sets form a class, and one text stands for it from there on. Its MinHash
signature is cut into trees of `deepest` values. Sorted prefixes of a tree's values are its
trie; texts that share a prefix are compared by all values of their signatures, longest
prefixes first. Matching starts at the depth that finds pairs a quarter of the way from the threshold to 1 with the target
recall: each match found tells, by its own similarity s, with which chance 1 - (1 - s^k)^trees a prefix of k values finds a pair like it, and so how many such pairs there are and which
share of them shorter prefixes would find. Prefixes are shortened to the longest at which that share reaches the target
recall, and again if the matches found then say so, at the latest to where any pair at the threshold is found
with that chance. What compares well enough is joined into
clusters, and within a cluster every pair is verified on its whole sets, in blocks of bounded size, which report links
counted and a spanning tree rather than pairs. Verified links, closed transitively, give the groups.

Clusters of any size are dealt out as pairs of chunks with `block` texts each, and buckets, of which only signatures
are compared, with 8 * `block`, so a task holds two chunks at most; the time to verify a cluster grows with the square of its
distinct texts, and that is not shortened by leaving anything out.

Defined results: a text of 1 to 4 words has one shingle, all of its words; a null or blank text
has none, links to nothing and is a class of its own; copies share class and links;
rows that agree in doc_id and text are one record; a null doc_id counts last; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import joined_by_key, kept_in_process, numbered, record_key, restored, small_batches, text_digest
from genospark.llm.components import components
from genospark.plans.batches import runs
from genospark.plans.tables import collected, removed, tidy, written

TREES, DEEPEST, N_WORDS, THRESHOLD, RECALL, BLOCK = 24, 6, 5, 0.8, 0.99999, 128


def depth_for(recall: float, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix that finds any pair at the threshold with the recall asked for."""
    for k in range(deepest, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def recalls(links: DataFrame, depth: int, threshold: float, trees: int) -> list[float]:
    """For prefixes of 1 value, 2 and so on to depth: the share found of the links there are. Each link found at depth, of
    similarity s (the share of values in which its signatures agree), stands for 1 / (1 - (1 - s^depth)^trees) of its
    kind. All 0 where none is at the threshold or above, as nothing is known then."""
    s = F.col("agree")
    chance = lambda k: 1 - F.pow(1 - F.pow(s, k), trees)
    row = links.filter(s >= threshold).agg(F.sum(1 / chance(depth)), *[F.sum(chance(k) / chance(depth)) for k in range(1, depth + 1)]).first()
    return [(found or 0.0) / (row[0] or 1.0) for found in row[1:]]


class _Hashes(dict):
    """8 bytes for each word; keeps up to `most`."""

    def __init__(self, most: int = 150_000):
        self._most = most

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        h = xxhash.xxh3_64_digest(word)
        if len(self) < self._most:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def shingles(text: str | None, hashes: dict, n_words: int = N_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word n-grams, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces only
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64)
    if not len(h):
        return h
    n = min(n_words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _mixed((out + h[k : len(h) - n + 1 + k]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * k))
    return np.unique(out)


def _seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, values, np.uint32), rng.integers(0, 2**31, values, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(x: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of each hash function over a set that is not empty: uint32."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(seeds[0]), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, ((low[at : at + 1024, None] ^ seeds[0]) * seeds[1]).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, n_words: int = N_WORDS, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, th, cls, sig): cls, 16 bytes, is the digest of a text's set, null if that is empty;
    sig holds trees * deepest values."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds = kept_in_process("shingle_words", _Hashes), _seeds(trees * deepest)
        for batch in batches:
            cls, sig = [], []
            for text in batch.column("text").to_pylist():
                x = shingles(text, hashes, n_words)
                cls.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sig.append(signature(x, seeds).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "th", "cls", "sig"])

    return docs.select("doc_id", text_digest(F.col("text")).alias("th"), "text").mapInArrow(run, "doc_id long, th long, cls binary, sig binary")


def _keys(texts: DataFrame, trees: int, deepest: int, depth: int) -> DataFrame:
    """(tree, key, cls): a text's prefix of `depth` values in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, trees, deepest)
            key = np.zeros((n, trees), np.uint64)
            for k in range(depth):
                key = _mixed((key + sig[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F))
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(n), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(key.view(np.int64).ravel()), cls], names=["tree", "key", "cls"])

    return texts.select("cls", "sig").mapInArrow(run, "tree int, key long, cls binary")


def _chunked(df: DataFrame, n: str, block: int) -> DataFrame:
    """Each row once for every pair of chunks that its own one is in: i <= j, and which it is (0: i, 1: j)."""
    chunks = F.ceil(F.col(n) / block).cast("int")
    mine = F.when(chunks == 1, 0).otherwise(F.pmod(F.xxhash64("cls"), chunks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__c") - 1))
    out = df.withColumns({"__c": chunks, "__m": mine}).withColumn("__o", other)
    return out.withColumns({"i": F.least("__m", "__o"), "j": F.greatest("__m", "__o"), "side": (F.col("__m") > F.col("__o")).cast("int")}).drop("__c", "__m", "__o", n)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each of some small groups."""
    a, b = [], []
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(m, 1)
        s = starts[sizes == m][:, None]
        a.append((s + i).ravel())
        b.append((s + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _descend(sig: np.ndarray, tree: int, depth: int, deepest: int, least: int) -> list[tuple[int, int, int]]:
    """Links (x, y, values in which they agree) that join all texts of one bucket which hang together by agreeing in `least`
    values or more: prefixes of the tree's trie from the longest to the one that all share; texts joined before are
    not compared, and a bucket that is all joined is done."""
    m = len(sig)
    root, links = np.arange(m), []
    for k in range(deepest, depth - 1, -1):
        prefix = np.ascontiguousarray(sig[:, tree * deepest : tree * deepest + k])
        node = np.unique(prefix, axis=0, return_inverse=True)[1].ravel()
        for x in range(m - 1):
            y = np.flatnonzero((node[x + 1 :] == node[x]) & (root[x + 1 :] != root[x])) + x + 1
            if not len(y):
                continue
            agree = (sig[y] == sig[x]).sum(axis=1)
            for z, n in zip(y[agree >= least].tolist(), agree[agree >= least].tolist(), strict=True):
                if root[z] != root[x]:
                    lo, hi = sorted((root[x], root[z]))
                    root[root == hi] = lo
                    links.append((x, z, n))
        if not root.any():
            break
    return links


def candidate_links(texts: DataFrame, trees: int, deepest: int, depth: int, threshold: float, block: int) -> DataFrame:
    """(a, b, agree): links that join those that may be similar, with the share of values in which their signatures agree. texts:
    (cls, sig), one row for each class."""
    keys = written(_keys(texts, trees, deepest, depth), "keys")
    shared = keys.groupBy("tree", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("m", F.col("n"))
    rows = _chunked(joined_by_key(keys, shared, ["tree", "key"], "n"), "m", 8 * block)
    rows = rows.join(texts, "cls").select("tree", "key", "i", "j", "cls", "sig")
    values = trees * deepest
    share = threshold - 5.5 * (threshold * (1 - threshold) / values) ** 0.5  # a true link agrees in fewer values once in 10^7
    least = int(np.floor(share * values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 4):
            n = t.num_rows
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(n, values)
            keyed = np.stack([t.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            starts = np.flatnonzero(np.r_[True, (keyed[1:] != keyed[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, n])
            small = sizes <= 3
            a, b = _pairs(starts[small], sizes[small])
            agree = np.zeros(len(a), np.int64)
            for at in range(0, len(a), 20_000):
                agree[at : at + 20_000] = (sig[a[at : at + 20_000]] == sig[b[at : at + 20_000]]).sum(axis=1)
            ok = agree >= least
            found = [(a[ok], b[ok], agree[ok])]
            for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
                links = _descend(sig[s : s + m], int(keyed[s, 0]), depth, deepest, least)
                if links:
                    x, y, n = np.array(links).T
                    found.append((x + s, y + s, n))
            a, b, agree = (np.concatenate([f[k] for f in found]) for k in range(3))
            cls = t.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(a)), cls.take(pa.array(b)), pa.array(agree / values)], names=["a", "b", "agree"])

    dealt = rows.repartition("tree", "key", "i", "j").sortWithinPartitions("tree", "key", "i", "j", "cls")
    links = dealt.mapInArrow(run, "a binary, b binary, agree double")
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return links.groupBy(a, b).agg(F.max("agree").alias("agree"))


def shortened(texts: DataFrame, trees: int, deepest: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, int, float]:
    """Links of candidate_links() at the depth at which shortening ends, that depth, and the recall estimated there."""
    spark, last = texts.sparkSession, depth_for(recall, threshold, trees, deepest)
    depth = depth_for(recall, threshold + (1 - threshold) / 4, trees, deepest)
    while True:
        with collected() as made:
            links = written(candidate_links(texts, trees, deepest, depth, threshold, block), "candidates")
        had = recalls(links, depth, threshold, trees)
        if had[-1] >= recall or depth <= last:
            return links, depth, had[-1]
        removed(spark, made)
        depth = max([last, *[k for k in range(last, depth) if had[k - 1] >= recall]])


def _overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each two of the sets share."""
    m = len(sets)
    if m == 2:
        out = np.diag([len(x) for x in sets])
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    often = np.bincount(ids, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    use = often[ids]
    ids, owner = place[ids[use]], owner[use]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, columns):
        lo, hi = np.searchsorted(ids, [at, at + columns])
        grid = np.zeros((m, columns), np.float32)
        grid[owner[lo:hi], ids[lo:hi] - at] = 1
        out += grid @ grid.T
    return np.rint(out).astype(np.int64)


def verified_links(members: DataFrame, threshold: float, n_words: int, block: int) -> DataFrame:
    """(a, b, n) from (cluster, n, cls, text): rows without b count links of a within one block, rows
    with b join a to the first text of those it is linked to, over others too, in the block."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_in_process("shingle_words", _Hashes)
        for batch in batches:
            sets = [shingles(x, hashes, n_words).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["cluster", "n", "cls", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            n = t.num_rows
            cluster, i, j = t.column(0).to_pylist(), t.column(1).to_numpy(), t.column(2).to_numpy()
            side, cls, sets = t.column(3).to_numpy(), t.column(4).to_pylist(), t.column(5).to_pylist()
            out: list[tuple] = []
            s = 0
            while s < n:
                e = s + 1
                while e < n and cluster[e] == cluster[s] and i[e] == i[s] and j[e] == j[s]:
                    e += 1
                if e - s > 1:
                    own = [np.frombuffer(x, np.uint64) for x in sets[s:e]]
                    size = np.array([len(x) for x in own])
                    both = _overlaps(own)
                    linked = both >= threshold * (size[:, None] + size - both) - 1e-9
                    np.fill_diagonal(linked, False)
                    if i[s] != j[s]:
                        linked &= side[s:e, None] != side[None, s:e]
                    counts = linked.sum(axis=1)
                    out += [(cls[s + k], None, int(counts[k])) for k in np.flatnonzero(counts)]
                    root = np.arange(e - s)
                    for x in np.flatnonzero(counts).tolist():
                        near = np.r_[x, np.flatnonzero(linked[x])]
                        if (root[near] != root[near[0]]).any():
                            root[np.isin(root, root[near])] = root[near].min()
                    out += [(cls[s + root[k]], cls[s + k], 0) for k in np.flatnonzero(root != np.arange(e - s)).tolist()]
                s = e
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["a", "b", "n"])

    ready = members.select("cluster", "n", "cls", "text").mapInArrow(hashed, "cluster binary, n long, cls binary, sets binary")
    dealt = _chunked(ready, "n", block).select("cluster", "i", "j", "side", "cls", "sets")
    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "cls").mapInArrow(run, "a binary, b binary, n long")


@tidy
def similar(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = N_WORDS, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """For each row of docs: doc_id, th (with doc_id, the record), class_id (least doc_id of its group of
    linked texts), copy_id (least doc_id with its set of shingles), n_copies (rows with that set),
    n_links (other sets it is similar to) and keeper (record_key of the group's first record)."""
    rows = written(signatures(docs, n_words, trees, deepest), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(first.alias("rep"), F.count("*").alias("n_copies"), F.min("sig").alias("sig"))
    classes = written(classes, "classes")

    links, _, _ = shortened(classes.select("cls", "sig"), trees, deepest, threshold, recall, block)
    clusters = components(links.select("a", "b"))
    sized = joined_by_key(clusters.withColumnRenamed("root", "cluster"), clusters.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "cluster").withColumn("m", F.col("n")), ["cluster"], "n").withColumnRenamed("m", "n")
    wanted = sized.join(classes, F.col("node") == F.col("cls")).select("cluster", "n", "cls", record_key(F.col("rep.doc_id"), F.col("rep.th")).alias("rk"))
    texts = docs.select(record_key(F.col("doc_id"), text_digest(F.col("text"))).alias("rk"), "text")
    members = written(wanted.join(texts.dropDuplicates(["rk"]), "rk").drop("rk"), "members")
    checked = written(verified_links(members, threshold, n_words, block), "checked")

    counts = checked.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    groups = components(checked.filter("b IS NOT NULL").select("a", "b"))
    info = classes.drop("sig").join(counts, F.col("cls") == F.col("a"), "left").drop("a").join(groups, F.col("cls") == F.col("node"), "left").drop("node")
    info = written(info.withColumn("root", F.coalesce("root", "cls")), "class_info")
    top = info.groupBy("root").agg(F.min("rep").alias("top"), F.count("*").alias("n"))
    info = joined_by_key(info, top, ["root"], "n").drop("root", "sig").withColumn("n", F.col("n_copies"))
    empty = rows.filter("cls IS NULL").drop("sig")
    known = joined_by_key(rows.filter("cls IS NOT NULL").drop("sig"), info, ["cls"], "n")
    out = known.unionByName(empty, allowMissingColumns=True)
    mine = record_key(F.col("doc_id"), F.col("th"))
    return out.select(
        "doc_id",
        "th",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("cls").isNull(), mine).otherwise(record_key(F.col("top.doc_id"), F.col("top.th"))).alias("keeper"),
    )


@tidy
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first record of each group, once, all columns its own."""
    plain = docs.select("doc_id", "text")
    keepers = similar(plain, **options).select(F.col("keeper").alias("__rk")).distinct()
    numbers, at = numbered(docs)
    keyed = numbers.withColumn("__rk", record_key(F.col(at["doc_id"]), text_digest(F.col(at["text"]))))
    return restored(keyed.dropDuplicates(["__rk"]).join(keepers, "__rk", "left_semi"), docs, {})
