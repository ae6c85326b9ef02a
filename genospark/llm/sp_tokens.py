"""SentencePiece models in the tokenizers library.

The model file is read field by field from its wire format: pieces with scores and kinds, the
kind of model, and what the normaliser does. From that come a normaliser (prefix marker,
spaces to markers, the compiled character map where the model has one), a Unigram or BPE
model with byte fallback, user-defined pieces, and a decoder. All ids and decoded texts are
the tokenizers library's; the SentencePiece library encodes the same only to tell, in `parity`,
whether both agree: on whole texts, or word by word where no piece spans words.

Defined results: a null text has null ids; an empty text has none; ids decode to the text that
the model's normaliser leaves; special pieces written out in a text are ordinary text; repeated
rows give equal values; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genospark.llm.common import kept_in_process, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field: integers, or bytes where a length or a fixed width is given."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, data[at : at + n]
        at += n


class Model:
    """What a model file says. Field numbers of the public format."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.prefix, self.squeeze, self.escape, self.suffix, self.charsmap = True, True, True, False, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback, self.unk = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0)
                self.suffix = bool(f.get(24, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.charsmap = f.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or self.suffix:
            raise ValueError("only unigram and BPE models that mark word starts")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose union is a normal piece, the piece of highest score first."""
        known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for p, i in known.items():
            for k in range(1, len(p)):
                if p[:k] in known and p[k:] in known:
                    found.append((-self.pieces[i][1], i, k, p[:k], p[k:]))
        return [(a, b) for *_, a, b in sorted(found)]


def tokenizer(data: bytes, bare: bool = False):
    """A tokenizers.Tokenizer from the bytes of a model file; bare: for text that is normalised already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    m = Model(data)
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.prefix:
        steps.append(normalizers.Prepend(MARK))
    if not bare:
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER])
    strip = [decoders.Strip(" ", 1, 0)] if m.prefix and not bare else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


class Coder:
    """Encodes and decodes texts, batch by batch, with the tokenizers library, and tests each answer against
    the SentencePiece library's.

    Where no piece of the model has a marker after another character, none crosses from one
    word to the next: words (with the markers before them) are then encoded, decoded and tested
    apart, each distinct one once while it is kept. New words go through both libraries in lines of
    64; only where a line differs, its words are taken one by one. Otherwise, or where the
    model changes characters, whole texts are encoded and tested.
    """

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True, most: int = 600_000):
        import sentencepiece
        from tokenizers import pre_tokenizers

        m = Model(data)
        self.whole, self.bare, self.most, self.threads, self.verify = tokenizer(data), tokenizer(data, bare=True), most, threads, verify
        self.line = tokenizer(data, bare=True)
        self.line.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.byte = np.array([kind == BYTE for *_, kind in m.pieces])
        self.starts = np.array([p.startswith(MARK) for p, *_ in m.pieces])
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        self.by_word = m.prefix and m.escape and not (m.charsmap or m.squeeze or inner or any(kind == USER for *_, kind in m.pieces))
        self.mark = self.library.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        #: Words on which the libraries differ, and those that do not decode to themselves with what they decode to.
        self.odd: set[str] = set()
        self.changed: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the first of its markers."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        return parts if "" not in parts else [x[1:] for x in re.findall(r" +[^ ]+| +", " " + text)]

    def _cut(self, ids: np.ndarray) -> list[bytes]:
        """Ids, 4 bytes each, in parts that begin where a piece begins with a marker."""
        raw, at = ids.tobytes(), (np.flatnonzero(self.starts[ids]) * 4).tolist()
        if not at or at[0]:
            at.insert(0, 0)
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new words, and what they decode to. Words of one marker go in lines, which the splitter takes apart."""
        plain, rest = [], []
        for w in new:
            (plain if w and " " not in w else rest).append(w)
        lines = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        got = [e.ids for e in self.line.encode_batch_fast([MARK + MARK.join(ws) for ws in lines], add_special_tokens=False)]
        back = self.bare.decode_batch(got, skip_special_tokens=False)
        theirs = self.library.encode([" ".join(ws) for ws in lines], num_threads=self.threads) if self.verify else got
        for ws, ids, text, other in zip(lines, got, back, theirs, strict=True):
            parts = self._cut(np.array(ids, np.int32))
            self.ids.update(zip(ws, parts, strict=True))
            if ids != other or text != " " + " ".join(ws):
                self._test(ws, parts)
        if rest:
            parts = [array("i", e.ids).tobytes() for e in self.bare.encode_batch_fast([MARK + w.replace(" ", MARK) for w in rest], add_special_tokens=False)]
            self.ids.update(zip(rest, parts, strict=True))
            self._test(rest, parts)

    def _test(self, words: list[str], parts: list[bytes]) -> None:
        """Notes, word by word, where the libraries differ and what does not decode to itself."""
        mine = [array("i", x).tolist() for x in parts]
        if self.verify:
            theirs = self.library.encode(words, num_threads=self.threads)
            self.odd.update(w for w, a, b in zip(words, mine, theirs, strict=True) if a != (b if w else [self.mark]))
        self.changed.update((w, x) for w, x in zip(words, self.bare.decode_batch(mine, skip_special_tokens=False), strict=True) if x != " " + w)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[str]]:
        """Ids of each text by the tokenizers library, whether the other library gives the same, and what the ids decode to."""
        if not self.by_word:
            mine = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.library.encode(texts, num_threads=self.threads) if self.verify else mine
            return [np.array(a, np.int32) for a in mine], [a == b for a, b in zip(mine, theirs, strict=True)], self.whole.decode_batch(mine, skip_special_tokens=False)
        split = [self.words(x) for x in texts]
        get, new, found = self.ids.get, set(), []
        for ws in split:
            parts = list(map(get, ws))
            if None in parts:
                new.update([w for w, x in zip(ws, parts, strict=True) if x is None])
                parts = None
            found.append(parts)
        new = list(new)
        if new:
            self._learn(new)
        ids = [np.frombuffer(b"".join(parts or map(self.ids.__getitem__, ws)), np.int32) for ws, parts in zip(split, found, strict=True)]
        agree = [not self.odd or self.odd.isdisjoint(ws) for ws in split]
        decoded = [self._decoded(x, ws) for x, ws in zip(texts, split, strict=True)]
        if len(self.ids) > self.most:  # what came last goes: frequent words came early
            for x in new:
                del self.ids[x]
            self.odd.difference_update(new)
            for x in self.changed.keys() & new:
                del self.changed[x]
        return ids, agree, decoded

    def _decoded(self, text: str, words: list[str]) -> str:
        """The decoded words on end, without the first space."""
        if self.changed and not self.changed.keys().isdisjoint(words):
            out = "".join([self.changed.get(w, " " + w) for w in words])
            return out[1:] if out.startswith(" ") else out
        return text if MARK not in text else text.replace(MARK, " ")


SCHEMA = "doc_id long, ids array<int>, n_tokens int, n_byte_tokens int, ids_crc32 long, decoded string, round_trip boolean, parity boolean"
_TYPES = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]


def encoded(docs: DataFrame, model: bytes, keep_ids: bool = True, verify: bool = True, threads: int = 2, chars: int = 1_000_000) -> DataFrame:
    """Ids of each text, their decoded text (where it is not the text itself: round_trip says),
    and whether the SentencePiece library gives the same ids. Batches hold about `chars` characters."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        coder = kept_in_process(f"coder_{zlib.crc32(sent.value)}_{threads}_{verify}", lambda: Coder(sent.value, threads, verify), large=True)

        def rows(ids: list, texts: list[str | None]) -> pa.RecordBatch:
            at = [k for k, x in enumerate(texts) if x is not None]
            mine, same, decoded = coder.encode([texts[k] for k in at])
            out: list[list] = [[None] * len(texts) for _ in _TYPES]
            out[0] = ids
            for k, a, ok, back in zip(at, mine, same, decoded, strict=True):
                whole = back == texts[k]
                for c, v in zip(range(1, 8), (a if keep_ids else None, len(a), int(coder.byte[a].sum()), zlib.crc32(a.tobytes()), None if whole else back, whole, ok), strict=True):
                    out[c][k] = v
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, _TYPES, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            texts, ids, start, n = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), 0, 0
            for k, x in enumerate(texts):
                n += len(x or "")
                if n >= chars or k == len(texts) - 1:
                    yield rows(ids[start : k + 1], texts[start : k + 1])
                    start, n = k + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
