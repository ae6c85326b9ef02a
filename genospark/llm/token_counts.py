"""Token counts that follow edits.

A document is held as its pre-tokens (what the splitting pattern yields), each with its
length and number of tokens, in blocks under a segment tree of sums. trees() makes that state once, as a
binary column beside the text; revised() takes it, with edits, and gives the next state: kept as a table, it
serves one revision after another, and nothing is encoded but what edits touch. An edit re-splits the
text from the last pre-token that could not see it, until a boundary after the edit falls on
an old one; only the pre-tokens between are encoded, and sums change on the path above
their blocks. Where a match begins, what it takes depends on the text from there on alone,
and no match of the pattern looks further than LOOKAHEAD characters past its end.

Defined results: a null text counts as empty and has 0 tokens; an edit reaches no further
than the text, and a null replacement is empty; the edited text of a null one is the edits' alone; edits of a document apply in order of their
number; edits without a document are dropped; documents without edits keep their counts;
repeated rows are counted each for itself; extra columns are not read.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import hashed, joined_by_key, kept_in_process, small_batches

LOOKAHEAD = 2
BLOCK = 256
#: Fixed value: the public splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = RANKS) -> bytes:
    """The rank file; the driver reads it and sends it along, executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


class Counts(dict):
    """Tokens of a pre-token, kept for up to `most` of them."""

    def __init__(self, ranks: bytes, most: int = 300_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._most = most

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece))
        if len(piece) < 32:
            if len(self) < self._most:
                self[piece] = n
        return n


def _packed(*columns: list[int]) -> bytes:
    """A byte for each number; those of 255 or more stand whole at the end of their column."""
    out = [struct.pack("<q", len(columns[0]))]
    for column in columns:
        x = np.array(column, np.int64)
        out += np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype("<i8").tobytes()
    return b"".join(out)


def _unpacked(data: bytes) -> list[list[int]]:
    """The two columns of _packed()."""
    (n,), at, out = struct.unpack_from("<q", data), 8, []
    for _ in range(2):
        x = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        large = np.flatnonzero(x == 255)
        x[large] = np.frombuffer(data, "<i8", len(large), at + n)
        at += n + 8 * len(large)
        out.append(x.tolist())
    return out


class Tree:
    """Pre-tokens of one text with sums of their characters and tokens."""

    def __init__(self, text: str, split: Callable, counts: Counts, state: bytes | None = None):
        """From the state of this text, or else by encoding all of it."""
        self.text, self.split, self.counts = text, split, counts
        self.encoded = 0
        if state is None:
            pieces = split.findall(text)
            self._build(list(map(len, pieces)), self._encode(pieces))
        else:
            self._build(*_unpacked(state))

    @property
    def state(self) -> bytes:
        """Lengths and tokens of all pre-tokens."""
        return _packed([x for a, _ in self.blocks for x in a], [x for _, a in self.blocks for x in a])

    def _encode(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return list(map(self.counts.__getitem__, pieces))

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        cuts = range(0, max(len(lengths), 1), BLOCK)
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in cuts]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (a, b) in enumerate(self.blocks):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(a), sum(b)
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(len(a) for a, _ in self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` and the position where the block starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k] and at < start + self.chars[k] + self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return min(k - self.width, len(self.blocks) - 1), start

    def count(self, start: int, stop: int) -> int:
        """Tokens of the pre-tokens that begin in [start, stop)."""
        return self._before(stop) - self._before(start)

    def _before(self, at: int) -> int:
        if at >= self.chars[1]:
            return self.tokens[1]
        b, pos = self._find(at)
        n, k = 0, b + self.width
        while k > 1:
            n += self.tokens[k - 1] if k & 1 else 0
            k //= 2
        for length, tokens in zip(*self.blocks[b], strict=True):
            if pos >= at:
                break
            pos, n = pos + length, n + tokens
        return n

    def edit(self, start: int, stop: int, new: str) -> None:
        """text[start:stop] = new."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        text, shift = self.text[:start] + new + self.text[stop:], len(new) - (stop - start)
        # The first pre-token whose match may have looked at what changes.
        b, at = self._find(max(0, start - LOOKAHEAD - 1))
        i, lengths = 0, self.blocks[b][0]
        while i < len(lengths) and at + lengths[i] + LOOKAHEAD <= start:
            at, i = at + lengths[i], i + 1
        if i == len(lengths) and b + 1 < len(self.blocks):
            b, i = b + 1, 0
        # Old boundaries from there on, block by block, and new matches until both meet after the edit.
        e, j, old = b, i, at
        found, pos = [], at
        while True:
            while old < stop or old + shift < pos:
                while e < len(self.blocks) - 1 and j >= len(self.blocks[e][0]):
                    e, j = e + 1, 0
                if j >= len(self.blocks[e][0]):
                    break
                old, j = old + self.blocks[e][0][j], j + 1
            if pos == old + shift and old >= stop or pos >= len(text):
                break
            m = self.split.match(text, pos)
            found.append(m.group())
            pos = m.end()
        if pos >= len(text):
            e, j = len(self.blocks) - 1, len(self.blocks[-1][0])
        head, tail = self.blocks[b], self.blocks[e]
        fresh = (head[0][:i] + list(map(len, found)) + tail[0][j:], head[1][:i] + self._encode(found) + tail[1][j:])
        self.text = text
        self.blocks[b] = fresh
        for k in range(b + 1, e + 1):
            self.blocks[k] = ([], [])
        if len(fresh[0]) > 4 * BLOCK:
            self._build([x for a, _ in self.blocks for x in a], [x for _, a in self.blocks for x in a])
            return
        for k in range(b, e + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.blocks[k][0]), sum(self.blocks[k][1])
        lo, hi = (b + self.width) // 2, (e + self.width) // 2
        while lo:
            for k in range(lo, hi + 1):
                self._add(k)
            lo, hi = lo // 2, hi // 2


EDITS = "array<struct<start:bigint,stop:bigint,new:string>>"
STATE = f"doc_id long, text string, edits {EDITS}, tree binary"
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_pretokens long, n_edits int, n_reencoded long, n_chars_edited long, n_tokens_edited long, text_edited string, tree_edited binary"


def _kernel(ranks: bytes) -> tuple[Callable, Counts]:
    import regex

    return regex.compile(PATTERN), kept_in_process(f"counts_{zlib.crc32(ranks)}", lambda: Counts(ranks))


def trees(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, text, edits (null where docs has none) and tree, the state of the whole text; null for a null text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    edits = F.col("edits") if "edits" in docs.columns else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = _kernel(sent.value)
        for batch in batches:
            out = [None if text is None else Tree(text, split, counts).state for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "text", "edits", "tree"])

    return docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")).mapInArrow(run, STATE)


def revised(kept: DataFrame, ranks: bytes, keep: bool = True) -> DataFrame:
    """kept: trees(), or what an earlier revision left, with edits. Counts before and after them, how many pre-tokens they
    encoded anew, and, if keep, the next text and its state. A null tree is made from the text."""
    small_batches(kept.sparkSession)
    sent = kept.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = _kernel(sent.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for doc_id, text, edits, state in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits", "tree")), strict=True):
                tree = Tree(text or "", split, counts, state)
                row = [doc_id, len(tree.text), tree.total, tree.pieces, len(edits or ())]
                tree.encoded = 0
                for e in edits or ():
                    start = max(0, min(int(e["start"] or 0), len(tree.text)))
                    tree.edit(start, int(e["stop"] if e["stop"] is not None else start), e["new"] or "")
                row += [tree.encoded, len(tree.text), tree.total, *((tree.text, tree.state) if keep else (None, None))]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return kept.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"), "tree").mapInArrow(run, SCHEMA)


def next_state(revision: DataFrame) -> DataFrame:
    """What a revision leaves, as doc_id, text and tree for the next one."""
    return revision.select("doc_id", F.col("text_edited").alias("text"), F.col("tree_edited").alias("tree"))


def edited_counts(docs: DataFrame, ranks: bytes, keep_text: bool = True) -> DataFrame:
    """docs: doc_id, text, edits (array of start, stop, new; in order). The trees of all texts, and their first revision."""
    out = revised(trees(docs, ranks), ranks, keep_text)
    return out if keep_text else out.drop("text_edited", "tree_edited")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text and, if docs has it, tree, with the edits (doc_id, number, start, stop, new) of each, in order of their
    numbers. Documents whose edits are more than a thousandth of all are joined apart from the rest."""
    each = edits.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("number", "start", "stop", "new"))).alias("__e"), F.count("*").alias("__n"))
    own = ["doc_id", "text", *(["tree"] if "tree" in docs.columns else [])]
    changes = F.transform("__e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["new"].alias("new")))
    return joined_by_key(docs.select(*own), each, ["doc_id"], "__n", "left").select(*own, changes.alias("edits"))


def revision(docs: DataFrame) -> DataFrame:
    """docs with three edits each, placed by a hash of doc_id: words come in, a span goes, a span is replaced."""
    n = F.length(F.coalesce("text", F.lit("")))

    def at(k: int):
        return F.pmod(hashed(32, F.col("doc_id"), F.lit(k)), n + 1).cast("long")

    def one(k: int, length: int, new: str):
        return F.struct(at(k).alias("start"), (at(k) + length).alias("stop"), F.lit(new).alias("new"))

    return docs.select("doc_id", "text", F.array(one(1, 0, " it's 3 new words,"), one(2, 40, ""), one(3, 12, "\n\n  Über 2026?")).alias("edits"))
