"""A gated recurrent language model over words, trained and applied with numpy.

Corpus counts of all training tokens give the vocabulary: the `head` most frequent tokens, in
classes of `members` by rank, and for the rest `buckets` hashes of their last two bytes, in four
classes. The probability of a token is that of its class times that of the token, or its bucket, in it.
Both come from the recurrent state; a rare token's probability within its
bucket comes from the counts, (c + 1) / (N_b + V_b + 1) with its bucket's tokens and types. Biases
start from the counts, so training starts from a unigram model.

Training: truncated backpropagation over windows of `steps` tokens, state carried from one window
to the next. Every training document is read, in one of `rounds` that its hash picks; in each round all
streams start from the same parameters, train on their own documents and are averaged,
sixteen at a time until one is left. How many streams there are follows from the number of training tokens, which
documents a stream has and their order from their hashes: how rows are partitioned changes nothing. A chunk of
documents is cut into so many lanes (at most `lanes`) that it gives `updates` windows or more.

Scoring: documents lie end to end in lanes, of larger chunks so that a long one leaves the others company, the state
starts anew with each document and runs through all of it. Counts of tokens beyond the `known` most frequent ones come by a join.

Defined results: a null text counts as empty and has one token, its end; a null doc_id counts as
empty for the split; without training tokens both scores are the base's, 0; repeated rows
are scored each and get equal scores but for rounding; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import HOT, kept_in_process, shipped, small_batches
from genospark.llm.quality import bucket
from genospark.plans.batches import keep_freed_memory
from genospark.plans.tables import tidy, written

END = b""
#: Lanes that a short stream is cut into; windows of fewer than twice as many take shorter steps.
LEAST_LANES = 16
#: Rows of a softmax at once.
ROWS = 2048


@dataclass(frozen=True)
class Settings:
    head: int = 2048
    members: int = 64
    buckets: int = 64
    hidden: int = 32
    steps: int = 32
    lanes: int = 256
    updates: int = 128
    rate: float = 0.01
    rounds: int = 3
    stream: int = 1_500_000
    known: int = 262144
    chunk: int = 1_000_000
    score_steps: int = 128
    score_chunk: int = 4_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z only), then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def tail_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-2:]) % buckets


def held_out(doc_id, remainder: int = 2, mod: int = 7):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of each of some texts on end, in Arrow's arrays, and where each text's begin, with the end of the last."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        ends = np.r_[0, np.cumsum(filled)][ends]
        words = words.filter(pa.array(filled))
    order = np.insert(np.arange(len(words)), ends[1:], len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(order)), ends + np.arange(len(ends))


def split(words: pa.Array) -> list[bytes]:
    """These tokens, at least one, none of which holds a line end: cut from one piece, as to take them one by one is slow."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"\n")[0].as_py().split(b"\n")


def token_counts(texts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(token, c) of all tokens of all texts. Each task sums what it holds before it sends, so that rows go out as they are: a
    token, however frequent, is a row or two of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found = pc.value_counts(tokenised(batch.column("text"))[0])
            held.append(pa.table({"token": found.field(0), "c": found.field(1)}))
            if sum(t.num_rows for t in held) > most:
                held[:] = [summed()]
                if held[0].num_rows > most // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return texts.select("text").mapInArrow(run, "token binary, c long").repartition("token").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Places of the most frequent tokens, their counts, and the figures of the rare classes."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int, tail: dict[int, tuple[int, int]], s: Settings, least: int = 0):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.s, self.n, self.v, self.least, self.key = s, n, v, least, uuid.uuid4().hex
        self.counts = np.array([counts[k] for k in order], np.int64)
        self.words = [words[k] for k in order]
        self.head = min(s.head, len(order))
        self.classes, self.tail_members = max(1, -(-self.head // s.members)), max(1, s.buckets // 4)
        sums = np.zeros((s.buckets, 2), np.int64)
        for b, (a, t) in tail.items():
            sums[b] = a, t
        self.code = np.arange(len(order), dtype=np.int32)
        for k in range(self.head, len(order)):
            b = tail_bucket(self.words[k], s.buckets)
            self.code[k] = s.head + b
            sums[b] += self.counts[k], 1
        self.tail_tokens, self.tail_types = sums.T
        self.whole = self.tail_tokens + self.tail_types + 1

    def __getstate__(self) -> dict:
        """Words as one piece: none holds a line end."""
        return vars(self) | {"words": b"\n".join(self.words), "had": len(self.words)}

    def __setstate__(self, state: dict) -> None:
        had = state.pop("had")
        vars(self).update(state, words=state["words"].split(b"\n") if had else [])

    def index(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words)), strict=True))

    def places(self, words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
        """Their places, or -1 less the bucket of those that are not in the vocabulary."""
        at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        out = np.flatnonzero(at < 0).tolist()
        at[out] = [-1 - tail_bucket(words[k], self.s.buckets) for k in out]
        return at


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """counts: (token, c), written. At most s.known rows come to the driver, by a bound on c found
    from a histogram of c."""
    steps = sorted(counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    least, had = 0, 0
    for b, n, _ in steps:
        if had + n > s.known:
            least = b + 1
            break
        had += n
    top = counts.filter(bucket(F.col("c")) >= least).toArrow()
    b = F.crc32(F.substring("token", -2, 2)) % s.buckets
    rest = counts.filter(bucket(F.col("c")) < least).groupBy(b.cast("int").alias("b")).agg(F.sum("c"), F.count("*")).collect()
    return Vocabulary(top.column("token").to_pylist(), top.column("c").to_pylist(), sum(x.c for x in steps), sum(x.n for x in steps), {r[0]: (r[1], r[2]) for r in rest}, s, least)


def _row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[1], a.dtype)


def _padded(x: np.ndarray) -> np.ndarray:
    """Codes of (steps, lanes), flat, and of a further step of zeros."""
    out = np.zeros(x.size + x.shape[1], np.intp)
    out[: x.size] = x.ravel()
    return out


def _firsts(fresh: np.ndarray) -> list[np.ndarray]:
    """Of each step, the lanes where a document begins."""
    at, lane = np.nonzero(fresh)
    return np.split(lane, np.searchsorted(at, np.arange(1, len(fresh))))


class Gru:
    """Parameters and passes. Inputs are codes: head tokens, then buckets."""

    NAMES = ("emb", "rec", "wc", "bc", "ww", "bw")

    def __init__(self, v: Vocabulary, parts: list[np.ndarray] | None = None):
        s = self.s = v.s
        self.members, self.tail_members, self.classes, self.head = s.members, v.tail_members, v.classes, v.head
        #: Of each class, its tokens or buckets; of each code, its class and its place there.
        self.sizes = [s.members] * self.classes + [min(self.tail_members, s.buckets - k) for k in range(0, s.buckets, self.tail_members)]
        head, tail = np.arange(s.head), np.arange(s.buckets)
        self.kind_of = np.r_[np.minimum(head // s.members, self.classes - 1), self.classes + tail // self.tail_members].astype(np.int16)
        self.place_of = np.r_[head % s.members, tail % self.tail_members]
        if parts is None:
            rng = np.random.default_rng(11)
            h, every = s.hidden, len(self.sizes)
            widest = max(self.sizes)
            sums, bw = np.zeros(every), np.full((every, widest), -30.0)
            for k, size in enumerate(self.sizes):
                first = k * s.members if k < v.classes else (k - v.classes) * v.tail_members
                counts = v.counts[first : min(first + size, v.head)] if k < v.classes else v.tail_tokens[first : first + size]
                sums[k] = counts.sum()
                bw[k, : len(counts)] = np.log((counts + (k >= v.classes) * 0.5) / max(1, sums[k]))
            parts = [rng.normal(0, 0.3, (s.head + s.buckets, 3 * h)), rng.normal(0, h**-0.5, (h, 3 * h)), np.zeros((h, every)), np.log((sums + 0.5) / max(v.n, 1)), np.zeros((every, h, widest)), bw]
        self.parts = [p.astype(np.float32) for p in parts]
        self.emb, self.rec, self.wc, self.bc, self.ww, self.bw = self.parts

    def _run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each token, (hidden, steps + 1, lanes), and after the last, (hidden, lanes): units come first, so that each
        gate is one block and embeddings are read a unit at a time. x, fresh (a document begins): (steps, lanes). The last
        step is empty: without it units would lie a power of two apart and meet in the same lines of a cache."""
        n, lanes = self.s.hidden, x.shape[1]
        before = np.zeros((n, len(x) + 1, lanes), self.emb.dtype)
        emb, rec = np.ascontiguousarray(self.emb.T), np.ascontiguousarray(self.rec.T)
        emb[: 2 * n] *= -1  # what the two gates take exp of
        rec[: 2 * n] *= -1
        gates = np.take(emb, _padded(x), axis=1, mode="clip").reshape(3 * n, len(x) + 1, lanes)
        h = h.copy()
        for t, first in enumerate(_firsts(fresh)):
            if len(first):
                h[:, first] = 0  # nothing else has this step's array yet
            before[:, t] = old = h
            u = rec @ h
            zr = u[: 2 * n] + gates[: 2 * n, t]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, uc = zr[:n], zr[n:], u[2 * n :]
            c = r * uc
            c += gates[2 * n :, t]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((z, r, c, uc, old))
            h = h - c
            h *= z
            h += c
        return before, h

    def _sorted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(order, kinds in that order, where each class begins and the last ends): by code, and so by class."""
        order = np.argsort(codes.astype(np.int16), kind="stable")
        kind = self.kind_of[codes[order]]
        return order, kind, np.searchsorted(kind, np.arange(len(self.sizes) + 1)).tolist()

    def _tops(self) -> tuple[float, float]:
        """Bounds of the logits of classes and members, as states lie within -1 and 1."""
        return tuple(float((np.abs(w).sum(axis=-2) + np.abs(b)).max(initial=0)) for w, b in ((self.wc, self.bc), (self.ww, np.maximum(self.bw, 0))))

    @staticmethod
    def _bounded(a: np.ndarray, top: float) -> np.ndarray:
        """Logits, in place, less their row's largest where some could overflow."""
        if top > 80:
            a -= a.max(axis=1, keepdims=True)
        return a

    def log_probs(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural logs of a token, or of its bucket. Rows go in blocks that stay in a core's cache."""
        order, kind, cuts = self._sorted(codes)
        st, at = np.take(states.T, order, axis=1, mode="clip").T, self.place_of[codes[order]]
        got, tops = np.empty(len(at), states.dtype), self._tops()
        for i in range(0, len(at), ROWS):
            a = st[i : i + ROWS] @ self.wc
            a += self.bc
            self._bounded(a, tops[0])
            got[i : i + ROWS] = a[np.arange(len(a)), kind[i : i + ROWS]]
            got[i : i + ROWS] -= np.log(_row_sums(np.exp(a, out=a)))
        for k, size in enumerate(self.sizes):
            i, j = cuts[k], cuts[k + 1]
            if i < j:
                b = st[i:j] @ self.ww[k, :, :size]
                b += self.bw[k, :size]
                self._bounded(b, tops[1])
                got[i:j] += b[np.arange(j - i), at[i:j]]
                got[i:j] -= np.log(_row_sums(np.exp(b, out=b)))
        out = np.empty_like(got)
        out[order] = got
        return out

    @staticmethod
    def _errors(a: np.ndarray, at: np.ndarray, scale, top: float) -> float:
        """Turns logits, in place, into gradients of minus the mean log probability of the columns at; gives
        minus the sum of those."""
        rows = np.arange(len(a))
        Gru._bounded(a, top)
        true = a[rows, at]
        np.exp(a, out=a)
        sums = _row_sums(a)
        a *= (scale / sums)[:, None]
        a[rows, at] -= scale
        return float(np.log(sums).sum() - true.sum())

    def gradients(self, x: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
        """Of minus the mean log probability over the window's real tokens; the state after it; that mean."""
        n, keep = self.s.hidden, []
        before, after = self._run(x, fresh, h, keep)
        flat, codes = before.reshape(n, -1), x.ravel()
        use = np.flatnonzero(real.ravel())
        order, kind, cuts = self._sorted(codes[use])
        use = use[order]
        st, at = np.take(flat, use, axis=1, mode="clip"), self.place_of[codes[use]]
        scale = st.dtype.type(1 / max(1, len(use)))
        grads = [np.zeros_like(w) for w in self.parts]
        loss, ds, tops = 0.0, np.zeros((n, len(at) + 1), st.dtype), self._tops()
        for i in range(0, len(at), ROWS):
            own = st[:, i : i + ROWS]
            p = own.T @ self.wc
            p += self.bc
            loss += self._errors(p, kind[i : i + ROWS], scale, tops[0])
            grads[2] += own @ p
            grads[3] += np.ones(len(p), p.dtype) @ p
            ds[:, i : i + len(p)] = self.wc @ p.T
        for k, size in enumerate(self.sizes):
            i, j = cuts[k], cuts[k + 1]
            if i < j:
                q = st[:, i:j].T @ self.ww[k, :, :size]
                q += self.bw[k, :size]
                loss += self._errors(q, at[i:j], scale, tops[1])
                grads[4][k, :, :size], grads[5][k, :size] = st[:, i:j] @ q, np.ones(j - i, q.dtype) @ q
                ds[:, i:j] += self.ww[k, :, :size] @ q.T
        place = np.full(flat.shape[1], len(at))
        place[use] = np.arange(len(at))
        dh_out = np.take(ds, place, axis=1, mode="clip").reshape(before.shape)
        dg, du = (np.empty((k * n, *before.shape[1:]), flat.dtype) for k in (3, 1))  # du: of the new states' part, the gates' is that of dg
        dg[:, -1] = du[:, -1] = 0
        dh, firsts = np.zeros_like(dh_out[:, 0]), _firsts(fresh)
        for t in range(len(x) - 1, -1, -1):
            z, r, c, uc, old = keep[t]
            g = np.empty((3 * n, x.shape[1]), flat.dtype)
            dz, dr, dc = g[:n], g[n : 2 * n], g[2 * n :]
            np.subtract(1, z, out=dz)
            np.multiply(dh, dz, out=dc)
            dz *= z
            dz *= dh
            dz *= old - c
            dc *= 1 - c * c
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= uc
            dr *= dc
            dg[:, t] = g
            dc *= r
            du[:, t] = dc
            dh *= z
            dh += self.rec @ g
            dh += dh_out[:, t]
            if len(firsts[t]):
                dh[:, firsts[t]] = 0
        dg, du = dg.reshape(3 * n, -1), du.reshape(n, -1)
        grads[1][:, : 2 * n], grads[1][:, 2 * n :] = flat @ dg[: 2 * n].T, flat @ du.T
        if len(use):
            own = codes[use]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            grads[0][own[firsts]] = np.add.reduceat(np.take(dg, use, axis=1, mode="clip"), firsts, axis=1).T
        return grads, after, loss * float(scale)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.parts)
        return out.getvalue()

    @staticmethod
    def parts_of(data: bytes) -> list[np.ndarray]:
        with np.load(io.BytesIO(data)) as z:
            return [z[k] for k in z.files]


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents end to end in lanes of like lengths, the longest lane first."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    return [out[k] for _, k in sorted(heap, reverse=True)]


def windows(codes: list[np.ndarray], lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, fresh, real, doc) of (steps, lanes still going); lanes that have ended fall away. Lanes lie on end in memory, so that a
    long one costs no more than its own tokens."""
    lengths = np.array([len(c) for c in codes])
    rows = lanes_of(lengths, lanes)
    ends = np.array([lengths[r].sum() for r in rows])
    order = np.concatenate(rows)
    x, doc = np.concatenate([codes[d] for d in order]), np.repeat(order, lengths[order]).astype(np.int32)
    begins = np.zeros(len(x), bool)
    begins[np.cumsum(lengths[order])[:-1]] = True
    begins[0] = True
    starts = np.cumsum(ends) - ends
    for at in range(0, int(ends[0]), steps):
        n = int((ends > at).sum())
        t = np.arange(at, min(at + steps, int(ends[0])))[:, None]
        real = t < ends[:n]
        where = starts[:n] + np.minimum(t, ends[:n] - 1)
        yield x[where], begins[where] & real, real, np.where(real, doc[where], -1)


def streams(codes: list[np.ndarray], lanes: int, steps: int, updates: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, fresh, real) for training: documents end to end, cut into lanes of one length. Where a cut falls within a
    document, its rest starts without a state; scoring never cuts."""
    stream = np.concatenate(codes)
    begins = np.zeros(len(stream), bool)
    begins[np.cumsum([0, *map(len, codes[:-1])])] = True
    rows = max(1, min(lanes, max(LEAST_LANES, len(stream) // (steps * updates)), len(stream) // steps))
    length = -(-len(stream) // rows)
    pad = rows * length - len(stream)
    x, fresh, real = (np.r_[v, np.zeros(pad, v.dtype)].reshape(rows, length) for v in (stream, begins, np.ones(len(stream), bool)))
    for at in range(0, length, steps):
        yield tuple(np.ascontiguousarray(v[:, at : at + steps].T) for v in (x, fresh, real))


def train(gru: Gru, codes: list[np.ndarray], state: dict | None = None) -> tuple[int, float]:
    """Adam over the windows of these documents; how many tokens there were, and their mean loss."""
    s = gru.s
    if not codes:
        return 0, 0.0
    state = {} if state is None else state
    m = state.setdefault("m", [np.zeros_like(p) for p in gru.parts])
    v = state.setdefault("v", [np.zeros_like(p) for p in gru.parts])
    h, n, lost = None, 0, 0.0
    for x, fresh, real in streams(codes, s.lanes, s.steps, s.updates):
        h = np.zeros((s.hidden, x.shape[1]), np.float32) if h is None else h
        grads, h, loss = gru.gradients(x, fresh, real, h)
        state["t"] = t = state.get("t", 0) + 1
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads)))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        rate = s.rate * min(1.0, t / 20) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * min(1.0, real.sum() / (s.steps * 2 * LEAST_LANES))
        for p, g, a, b in zip(gru.parts, grads, m, v, strict=True):  # in place: none of these arrays is small
            g *= np.float32(clip)
            a *= np.float32(0.9)
            a += g * np.float32(0.1)
            np.square(g, out=g)
            g *= np.float32(0.01)
            b *= np.float32(0.99)
            b += g
            np.sqrt(b, out=g)
            g += np.float32(1e-6)
            np.divide(a, g, out=g)
            g *= np.float32(rate)
            p -= g
        n += int(real.sum())
        lost += loss * int(real.sum())
    return n, lost / max(1, n)


def scores(gru: Gru, codes: list[np.ndarray], lanes: int = 256) -> np.ndarray:
    """The natural log of each document's tokens (of the class alone for rare ones)."""
    lengths = np.array([len(c) for c in codes])
    lanes = int(max(32, min(lanes, lengths.sum() // max(1, lengths.max()))))
    out, h = np.zeros(len(codes)), None
    for x, fresh, real, doc in windows(codes, lanes, gru.s.score_steps):
        h = np.zeros((gru.s.hidden, x.shape[1]), np.float32) if h is None else h[:, : x.shape[1]]
        before, h = gru._run(x, fresh, h)
        use = real.ravel()
        flat = before.reshape(gru.s.hidden, -1)[:, : len(use)]
        lp = gru.log_probs((flat if use.all() else flat[:, use]).T, x.ravel()[use])
        out += np.bincount(doc.ravel()[use], lp, len(codes))
    return out


def coded(docs: DataFrame, v: Vocabulary, sent: Callable) -> DataFrame:
    """(doc_id, held_out, round, codes, n_tokens, known, base, inner, rare) of each row of docs: the codes of its tokens, what the
    counts of known ones give, and the rare tokens, whose counts a join brings."""
    s = v.s
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(5)), F.lit(s.rounds)).cast("int")
    names = ["doc_id", "held_out", "round", "codes", "n_tokens", "known", "base", "inner", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = sent()
        index = kept_in_process("vocabulary_index", voc.index, voc.key)
        base = np.log10((voc.counts + 1) / (voc.n + voc.v + 1))
        inner = np.where(np.arange(len(voc.code)) < voc.head, 0, np.log10((voc.counts + 1) / voc.whole[np.maximum(voc.code - voc.s.head, 0)]))
        code = np.r_[voc.code, voc.s.head + np.arange(voc.s.buckets - 1, -1, -1)].astype(np.int16)  # a place below 0 counts from the end
        base, inner = (np.r_[x, np.zeros(voc.s.buckets)] for x in (base, inner))
        for batch in batches:
            if not batch.num_rows:
                continue
            words, ends = tokenised(batch.column("text"))
            distinct = words.dictionary_encode()
            known = split(distinct.dictionary)
            at = voc.places(known, index)[distinct.indices.to_numpy()]
            per = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            there = at >= 0
            rare = np.flatnonzero(~there)
            starts = np.r_[0, np.cumsum(np.bincount(per[rare], minlength=batch.num_rows))].astype(np.int32)
            codes = code[at]
            columns = (
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(codes)]),
                pa.array(np.diff(ends)),
                pa.array(np.bincount(per, there, batch.num_rows).astype(np.int64)),
                pa.array(np.bincount(per, base[at], batch.num_rows)),
                pa.array(np.bincount(per, inner[at], batch.num_rows)),
                pa.ListArray.from_arrays(pa.array(starts), words.take(pa.array(rare))),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return docs.select("doc_id", "held_out", part.alias("round"), "text").mapInArrow(run, "doc_id long, held_out boolean, round int, codes binary, n_tokens long, known long, base double, inner double, rare array<binary>")


def dealt(learnt: DataFrame, streams: int) -> DataFrame:
    """(round, stream, place, codes, copies): documents dealt to streams by hash, in the order of another. The
    copies of a record that has a large part of all rows are dealt out over the streams in turn."""
    key = F.coalesce("doc_id", F.lit(-1))
    rows = learnt.select("round", "codes", F.xxhash64(key, "codes", F.lit(7)).alias("place"))
    keys = written(rows.groupBy("round", "place").agg(F.count("*").alias("n")), "lm_keys")
    total, most = (x or 0 for x in keys.agg(F.sum("n"), F.max("n")).first())
    stream = lambda turn: F.pmod(F.pmod(F.xxhash64("place"), F.lit(streams)) + turn, F.lit(streams)).cast("int").alias("stream")
    one = F.lit(1).cast("long").alias("copies")
    if most < 2 or most * HOT <= total:
        return rows.select("round", stream(F.lit(0)), "place", "codes", one)
    often = F.broadcast(keys.filter((F.col("n") * HOT > total) & (F.col("n") > 1)).select("round", "place"))  # fewer than HOT
    folded = rows.join(often, ["round", "place"]).groupBy("round", "place").agg(F.first("codes").alias("codes"), F.count("*").alias("n"))
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(streams)) - 1)).alias("turn")
    folded = folded.select("round", "place", "codes", "n", turns).select("round", stream(F.col("turn")), "place", "codes", (F.floor((F.col("n") - F.col("turn") - 1) / streams) + 1).cast("long").alias("copies"))
    return rows.join(often, ["round", "place"], "left_anti").select("round", stream(F.lit(0)), "place", "codes", one).unionByName(folded)


def trained(learnt: DataFrame, v: Vocabulary, sent: Callable) -> bytes:
    """Parameters after all rounds. learnt: doc_id, round and codes of the training documents, written."""
    spark, s = learnt.sparkSession, v.s
    params = Gru(v).to_bytes()
    streams = max(1, round(v.n / s.rounds / s.stream))
    learnt = dealt(learnt, streams)
    for k in range(s.rounds):
        start = spark.sparkContext.broadcast(params)

        def fit(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            keep_freed_memory()
            gru, state, held, n = Gru(sent(), Gru.parts_of(start.value)), {}, [], 0

            def learn(most: int) -> None:
                """Trains on the first documents held, so many tokens or just more."""
                nonlocal n, size
                ends = np.cumsum([len(c) for c in held])
                k = int(np.searchsorted(ends, most)) + 1
                n += train(gru, held[:k], state)[0]
                size -= int(ends[min(k, len(ends)) - 1]) if held else 0
                del held[:k]

            size, stream = 0, 0
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("stream", "codes", "copies")]
                for stream, x, copies in zip(*columns, strict=True):
                    for _ in range(copies):
                        held.append(np.frombuffer(x, np.int16))
                        size += len(held[-1])
                        while size >= 2 * s.chunk:  # the last chunk is no remainder, which would take as many windows for few tokens
                            learn(s.chunk)
            learn(size)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([n], pa.int64()), pa.array([gru.to_bytes()], pa.binary())], names=["stream", "n", "params"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums, stream = 0, None, 0
            for batch in batches:
                for stream, n, data in zip(*(batch.column(c).to_pylist() for c in ("stream", "n", "params")), strict=True):
                    parts = [p.astype(np.float64) * n for p in Gru.parts_of(data)]
                    sums = parts if sums is None else [a + b for a, b in zip(sums, parts, strict=True)]
                    total += n
            if total:
                out = io.BytesIO()
                np.savez(out, *[(p / total).astype(np.float32) for p in sums])
                yield pa.RecordBatch.from_arrays([pa.array([stream // 16], pa.int32()), pa.array([total], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["stream", "n", "params"])

        schema, left = "stream int, n long, params binary", streams
        own = learnt.filter(F.col("round") == k).repartitionById(streams, F.col("stream")).sortWithinPartitions("place")
        fitted = written(own.select("stream", "codes", "copies").mapInArrow(fit, schema), "lm_params")
        while left > 1:
            left = -(-left // 16)
            fitted = written(fitted.repartitionById(left, F.expr("int(stream div 16)")).sortWithinPartitions("stream").mapInArrow(mean, schema), "lm_params")
        if row := fitted.first():
            params = bytes(row.params)
    return params


@tidy
def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = written(token_counts(docs.filter(~F.col("held_out"))), "lm_counts")
    v = vocabulary(counts, s)
    sent = shipped(spark, "vocabulary", v)
    first = written(coded(docs, v, sent).withColumn("row", F.monotonically_increasing_id()), "lm_rows")
    params = shipped(spark, "language_model", trained(first.filter(~F.col("held_out")), v, sent) if v.n else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        parts = params()
        gru = Gru(sent(), Gru.parts_of(parts)) if parts else None
        rows: list[list] = [[] for _ in names]
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            neural = scores(gru, held) / np.log(10) if gru else np.zeros(len(held))
            out = pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(rows, types, strict=True)], pa.array(neural)], names=[*names, "neural"])
            for x in (held, *rows):
                x.clear()
            return out

        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for k, x in enumerate(batch.column("codes").to_pylist()):
                for own, column in zip(rows, columns, strict=True):
                    own.append(column[k])
                held.append(np.frombuffer(x, np.int16))
                size += len(held[-1])
                if size >= s.score_chunk:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    out = first.select(*names, "codes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, neural double")
    rare = first.select("row", F.explode("rare").alias("token"))
    whole = F.element_at(F.array(*[F.lit(int(x)) for x in v.whole]), (F.crc32(F.substring("token", -2, 2)) % s.buckets).cast("int") + 1)
    others = counts.filter(bucket(F.col("c")) < v.least)  # a rare token is none of those in the vocabulary
    found = rare.join(others, "token", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"), whole.alias("whole"))
    sums = found.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more"), F.sum(F.log10((F.col("c") + 1) / F.lit(v.n + v.v + 1))).alias("b"), F.sum(F.log10((F.col("c") + 1) / F.col("whole"))).alias("t"))
    zero = F.lit(0)
    base = F.col("base") + F.coalesce("b", zero)
    return out.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("neural") + F.col("inner") + F.coalesce("t", zero) if v.n else base).alias("score"),
    )
