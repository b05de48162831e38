"""Language-model scoring with a gated recurrent network.

The network reads and predicts units: the OWN most frequent tokens of the training corpus are units
of their own, all other tokens share BUCKETS units by a hash of their last two bytes. A unit's
probability is factored: softmax over classes, then softmax over the units of its class, both from
the recurrent state. A token's share of its unit is (c + 0.5) / (n + 0.5 (v + 1)), with c its own
count, n and v the unit's tokens and distinct tokens, counted over the whole training corpus; what
was never seen counts as one token type of its unit. So the model is a distribution over all
tokens, and whatever it knows of words comes from every training document. The network's weights
are learned by truncated backpropagation: they start from whole documents of a bounded sample
(SAMPLE_TOKENS), which also gives the order of the units in classes, and then every training
document is learned from once. It falls to one of ROUNDS rounds by a hash of its row; in a round each
partition goes on from the same weights over its documents, and the results are averaged by tokens.
A corpus that the sample holds whole is learned from there alone.

Every text is cut and looked up once: its units are kept as a table that the rounds and the scoring
read. Documents are scored whole: the state is carried from window to window and reset where a document
begins. A task packs documents end to end into parallel lanes, longest first, so lanes stay full.

Counts of the WARM most frequent tokens are sent to the tasks (a fixed number); every other token
of every document meets its count in a join, where no key is frequent by construction.

Defined cases: a null or blank text is the end token alone; with no training documents all counts
are zero, the base score is 0 and the network is uniform; a null id belongs to the fold of the
empty text and is scored; rows that repeat are scored alike; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_rows, steps

#: Units and classes of the network, hidden size, and steps of one window.
OWN, BUCKETS, CLASSES, HIDDEN, WINDOW = 448, 64, 16, 24, 64
UNITS = OWN + BUCKETS
#: Counts that every task holds (no result depends on how many, only how many tokens take the join);
#: tokens of the learning sample; passes over it.
WARM, SAMPLE_TOKENS, EPOCHS = 200_000, 400_000, 2
#: Rounds over all training documents; lanes and first rate of a partition's steps, tokens it holds at once; tasks that add weights.
ROUNDS, WIDE, RATE, HELD, ADDERS = 4, 256, 2e-3, 1_000_000, 16
#: Tokens that a task packs into lanes at once, lanes at most, and texts and bytes of text of one step.
PACK, LANES, TEXTS, STEP_BYTES = 5_000_000, 384, 2000, 8 << 20
#: Counts below this have a class each in the histogram of counts, larger ones 64 for each doubling.
EXACT_COUNTS = 1024
#: Distinct tokens that a counting task holds before it hands them on, and that a task remembers beside the known ones.
COUNTED, REMEMBERED = 300_000, 300_000
#: The end token; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def bucket(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % BUCKETS


class Gru:
    """Weights, training and packed scoring. Units are renumbered so that classes are contiguous."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, self.size = HIDDEN, UNITS // CLASSES
        f = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        # `x` has a row for each unit read, and a last one for the start; gates are z, r, n.
        self.p = {"x": f(UNITS + 1, 3 * h, by=0.1), "u": f(h, 3 * h, by=h**-0.5), "b": np.zeros(3 * h, np.float32), "bn": np.zeros(h, np.float32), "oc": np.zeros((h, CLASSES), np.float32), "bc": np.zeros(CLASSES, np.float32), "ou": np.zeros((CLASSES, h, self.size), np.float32), "bu": np.zeros((CLASSES, self.size), np.float32)}
        self.p["b"][:h] = 1.0
        self.place = np.arange(UNITS)  # unit -> class * size + position

    def fit(self, docs: list[np.ndarray], counts: np.ndarray, epochs: int = EPOCHS, lanes: int = 64, rate: float = 4e-3) -> None:
        """docs: units of whole documents; counts: of each unit in the whole training corpus."""
        if not docs:
            return
        self.place = np.empty(UNITS, dtype=np.int64)
        self.place[self._order(docs)] = np.arange(UNITS)
        c = np.log(np.maximum(counts, 0.5))[np.argsort(self.place)].reshape(CLASSES, self.size)
        self.p["bu"][:] = c - c.max(1, keepdims=True)
        top = np.log(np.exp(c - c.max()).sum(1)) + c.max()
        self.p["bc"][:] = top - top.max()
        self.learn(docs, epochs, lanes, rate)

    def learn(self, docs: list[np.ndarray], epochs: int, lanes: int, rate: float) -> None:
        """Passes over the documents from the weights there are."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, max(1, epochs * sum(map(len, docs)) // (lanes * 32))
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(docs))
            read, said = self._stream([self.place[docs[i]] for i in order], lanes)
            h = np.zeros((lanes, HIDDEN), np.float32)
            for at in range(0, read.shape[0], 32):
                g, h = self._gradients(read[at : at + 32], said[at : at + 32], h)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale, eta = min(1.0, 1.0 / (norm + 1e-9)), rate * max(0.05, 1 - step / (total + 1))
                for k, v in g.items():
                    v = v * scale
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.003 * (v * v - s[k])
                    self.p[k] -= eta * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.997**step)) + 1e-8)

    @staticmethod
    def _stream(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(units read, units said), each (steps, lanes): one stream of documents cut into equal lanes."""
        said = np.concatenate(docs)
        read = np.r_[UNITS, said[:-1]]
        read[np.cumsum([0, *map(len, docs[:-1])])] = UNITS
        fill = -len(said) % lanes
        cut = lambda x: np.ascontiguousarray(np.r_[x, np.full(fill, -1, x.dtype)].reshape(lanes, -1).T.astype(np.int32))
        return cut(read), cut(said)

    @staticmethod
    def _order(docs: list[np.ndarray]) -> np.ndarray:
        """Units in an order in which those of like documents are close: one principal direction."""
        x = np.stack([np.bincount(d, minlength=UNITS) / len(d) for d in docs])
        x = np.sqrt(x)
        x -= x.mean(0)
        x /= np.linalg.norm(x, axis=0) + 1e-9
        cov, v = x.T @ x, np.linspace(-1, 1, UNITS)
        for _ in range(50):
            v = cov @ v
            v /= np.linalg.norm(v) + 1e-30
        return np.argsort(v, kind="stable")

    @staticmethod
    def _pack(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units read, units said, document), each (steps, lanes); -1 where a lane has ended.

        Longest documents first, each onto the lane with the least so far.
        """
        import heapq

        heap, on = [(0, i) for i in range(lanes)], []
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, lane = heap[0]
            heapq.heapreplace(heap, (n + len(docs[d]), lane))
            on.append((d, lane, n))
        steps = max(n for n, _ in heap)
        read, said, who = (np.full((lanes, steps), -1, dtype=t) for t in (np.int32, np.int32, np.int32))
        for d, lane, at in on:
            x = docs[d]
            said[lane, at : at + len(x)] = x
            read[lane, at] = UNITS
            read[lane, at + 1 : at + len(x)] = x[:-1]
            who[lane, at : at + len(x)] = d
        return np.ascontiguousarray(read.T), np.ascontiguousarray(said.T), np.ascontiguousarray(who.T)

    def _states(self, read: np.ndarray, h: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """States after each step of a window; a document's start resets its lane.

        With a tape, the states before each step and the gates are kept in it for the way back.
        """
        k, p = HIDDEN, self.p
        out = np.empty((*read.shape, k), np.float32)
        # The logistic function is taken by way of tanh, so what goes into it is halved beforehand.
        x = p["x"] + p["b"]
        gzr, gn = (x[:, : 2 * k] * h.dtype.type(0.5))[read], x[:, 2 * k :][read]
        uzr, un_ = p["u"][:, : 2 * k] * h.dtype.type(0.5), np.ascontiguousarray(p["u"][:, 2 * k :])
        starts = read == UNITS
        some = starts.any(axis=1)
        for t in range(len(read)):
            if some[t]:
                h = np.where(starts[t][:, None], np.float32(0), h)
            zr = h @ uzr
            zr += gzr[t]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :k], zr[:, k:]
            un = h @ un_
            un += p["bn"]
            n = r * un
            n += gn[t]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if tape is not None:
                for name, v in zip(("was", "z", "r", "un", "n"), (h, z, r, un, n)):
                    tape[name][t] = v
            out[t] = h = new
        return out

    @staticmethod
    def _exp(a: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a becomes exp of the scores a = h w + b; what was subtracted from them, a row or 0.

        States lie between -1 and 1, so the weights tell whether anything can overflow: two such sums
        are multiplied, and e^40 * 16 * e^40 * 32 still is a 32-bit float.
        """
        off = np.zeros(1, a.dtype)
        if float((np.abs(w).sum(0) + np.abs(b)).max()) > 40:
            off = a.max(1)
            a -= off[:, None]
        np.exp(a, out=a)
        return off

    def _log_probs(self, h: np.ndarray, said: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each said unit; with grads, also what flows back into h."""
        p, cls = self.p, said // self.size
        order = np.argsort(cls.astype(np.int8), kind="stable")
        h, cls, rows = h[order], cls[order], np.arange(len(h))
        pos, cuts = said[order] - cls * self.size, np.searchsorted(cls, np.arange(CLASSES + 1))
        a = h @ p["oc"] + p["bc"]
        own = a[rows, cls]
        own -= self._exp(a, p["oc"], p["bc"])
        total = a @ np.ones(CLASSES, a.dtype)  # a product is faster than a sum over a short axis
        back = None
        if grads is not None:
            a /= total[:, None]
            a[rows, cls] -= 1
            grads["oc"], grads["bc"] = h.T @ a, a.sum(0)
            back = a @ p["oc"].T
        ones = np.ones(self.size, a.dtype)
        for c in range(CLASSES):
            lo, hi = int(cuts[c]), int(cuts[c + 1])
            if lo == hi:
                continue
            x, at, w = h[lo:hi], rows[: hi - lo], p["ou"][c]
            a = x @ w
            a += p["bu"][c]
            picked = a[at, pos[lo:hi]]
            own[lo:hi] += picked - self._exp(a, w, p["bu"][c])
            inner = a @ ones
            total[lo:hi] *= inner
            if grads is not None:
                a /= inner[:, None]
                a[at, pos[lo:hi]] -= 1
                grads["ou"][c], grads["bu"][c] = x.T @ a, a.sum(0)
                back[lo:hi] += a @ w.T
        out = np.empty(len(h))
        out[order] = own - np.log(total)
        if back is not None:
            back[order] = back.copy()
        return out, back

    def _gradients(self, read: np.ndarray, said: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean negative log probability of one window, and the state after it."""
        k, p = HIDDEN, self.p
        live = said >= 0
        tape = {name: np.empty((*read.shape, k), h.dtype) for name in ("was", "z", "r", "un", "n")}
        states = self._states(np.where(live, read, UNITS), h, tape)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        n_live = max(1, int(live.sum()))
        if n_live == live.size:
            flow = self._log_probs(states.reshape(-1, k), said.ravel(), g)[1].reshape(states.shape)
        else:
            flow = np.zeros_like(states)
            _, flow[live] = self._log_probs(states[live], said[live], g)
        was, z, r, un, n = (tape[name] for name in ("was", "z", "r", "un", "n"))
        # What does not depend on the way back is taken for the whole window at once.
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (was - n) * z * (1 - z), un * r * (1 - r)
        goes_on = ((read != UNITS) & live)[:, :, None].astype(h.dtype)
        d, turned = np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        back, dn = np.empty((*read.shape, 3 * k), h.dtype), np.empty_like(states, dtype=h.dtype)
        for t in range(len(read) - 1, -1, -1):
            d = d + flow[t]
            np.multiply(d, to_n[t], out=dn[t])
            np.multiply(d, to_z[t], out=back[t, :, :k])
            np.multiply(dn[t], to_r[t], out=back[t, :, k : 2 * k])
            np.multiply(dn[t], r[t], out=back[t, :, 2 * k :])
            d *= z[t]
            d += back[t] @ turned
            d *= goes_on[t]
        flat = back.reshape(-1, 3 * k)
        g["u"] = was.reshape(-1, k).T @ flat
        g["bn"] = flat[:, 2 * k :].sum(0)
        at = np.where(live, read, UNITS).ravel()
        order = np.argsort(at.astype(np.int16), kind="stable")
        which, first = np.unique(at[order], return_index=True)
        g["x"][which, : 2 * k] = np.add.reduceat(flat[order, : 2 * k], first)
        g["x"][which, 2 * k :] = np.add.reduceat(dn.reshape(-1, k)[order], first)
        g["b"] = g["x"].sum(0)  # every step read one unit
        return {name: v / n_live for name, v in g.items()}, states[-1]

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_weights(self, w: np.ndarray) -> Gru:
        """A network of the same classes with these weights."""
        out, at = Gru(), 0
        out.place = self.place
        for k, v in out.p.items():
            out.p[k] = w[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's units."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        total, longest = sum(map(len, docs)), max(map(len, docs))
        lanes = int(max(1, min(LANES, len(docs), total // max(1, longest) + 1)))
        read, said, who = self._pack([self.place[d] for d in docs], lanes)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, len(read), WINDOW):
            w = said[at : at + WINDOW]
            live = w >= 0
            states = self._states(np.where(live, read[at : at + WINDOW], UNITS), h)
            h = states[-1]
            lp, _ = self._log_probs(states[live], w[live])
            out += np.bincount(who[at : at + WINDOW][live], weights=lp, minlength=len(docs))
        return out / np.log(10)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased, one after another, and how many each has; end tokens are left out."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    said = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at either end give empty words
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kept = np.r_[0, np.cumsum(said)][ends]
    return words.filter(pa.array(said)), np.diff(np.r_[0, kept]).astype(np.int64)


def spelt(words: pa.Array) -> list[bytes]:
    """A binary array's values, from its buffers; much faster than value by value."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = words.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs(t), the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                words, n = cut(part.column("t"))
                found, get = words.value_counts(), seen.get
                for word, c in zip(spelt(found.field(0)), found.field(1).to_numpy().tolist()):
                    seen[word] = get(word, 0) + c
                seen[END] += len(n)
                if len(seen) > COUNTED:
                    yield out()
        if seen:
            yield out()

    return docs.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, c) of the `most` most frequent words, most frequent first; only they come to the driver.

    A histogram of the counts, of some thousand classes at most, tells the class in which the list
    ends; of that class, words are taken by a hash.
    """
    log = F.floor((F.log2(F.col("c")) - math.log2(EXACT_COUNTS)) * 64).cast("long") + EXACT_COUNTS
    kind = F.when(F.col("c") < EXACT_COUNTS, F.col("c")).otherwise(log)
    sizes = sorted(((r["kind"], r["words"]) for r in counts.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    left, taken = most, F.lit(False)
    for k, words in sizes:
        if words > left:
            share = F.pmod(F.xxhash64("word", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * left / words)
            taken |= (kind == k) & share
            break
        taken, left = kind >= k, left - words
    got = counts.where(taken).select("word", "c").collect()  # about `most` rows
    return sorted(((bytes(r["word"]), r["c"]) for r in got), key=lambda x: (-x[1], x[0]))[:most]


class Places(dict):
    """Place of a token in the count vector: of the known ones, then of the buckets; what it was asked for it keeps.

    At most REMEMBERED tokens beside the known ones are kept between steps.
    """

    def __init__(self, known: dict):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.known) + bucket(word) - OWN
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def trim(self) -> None:
        if len(self) > len(self.known) + REMEMBERED:
            self.clear()
            self.update(self.known)


def learned(docs: DataFrame, net: Gru, rate: float) -> Gru:
    """One round: each partition learns from all its documents of docs(u), units; the mean of the weights by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, seen = sent.value.with_weights(sent.value.weights()), [], 0, 0
        for b in batches:
            for part in steps(b, "u", TEXTS, STEP_BYTES):
                got = _units(part)
                held, size = held + got, size + sum(map(len, got))
                if size > HELD:
                    own.learn(held, 1, WIDE, rate)
                    held, size, seen = [], 0, seen + size
        if held:
            own.learn(held, 1, WIDE, rate)
            seen += size
        if seen:
            yield _row(TaskContext.get().partitionId(), seen, own.weights().astype(np.float64) * seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, first = 0, 0.0, 0
        for b in batches:
            for pid, c, w in zip(*(b.column(x).to_pylist() for x in ("pid", "seen", "w"))):
                first, seen, total = pid, seen + c, total + np.frombuffer(w)
        if seen:
            yield _row(first, seen, total)

    kind = "pid int, seen long, w binary"
    sums = docs.mapInArrow(run, kind).repartition(ADDERS, "pid").sortWithinPartitions("pid").mapInArrow(add, kind).collect()  # ADDERS rows
    seen = sum(r["seen"] for r in sums)
    return net.with_weights(sum(np.frombuffer(r["w"]) for r in sorted(sums, key=lambda r: r["pid"])) / seen) if seen else net


def _row(pid: int, seen: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([seen], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["pid", "seen", "w"])


def _units(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.int16) for x in part.column("u")]


_ENCODED = "k1 long, k2 long, held_out boolean, s long, h long, n_tokens long, n_known long, base double, within double, u binary, words array<binary>, units array<int>, tf array<long>"


def encoded(rows: DataFrame, sent) -> DataFrame:
    """Each text of rows(k1, k2, held_out, s, h, t) as units, with the sums over its known tokens and its rare tokens' counts.

    `sent` broadcasts (places of the known tokens, unit, base and share of every place).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit, base, within = sent.value
        places, first_rare = Places(known), len(base) - BUCKETS
        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                words, n = cut(part.column("t"))
                # Each distinct word is looked up once a step.
                coded = words.dictionary_encode()
                kinds, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                known_at = places.of(spelt(kinds))
                x, end = known_at[which] if len(which) else np.zeros(0, np.int32), places[END]
                # Rare words by document: how often each occurs.
                far = np.flatnonzero(x >= first_rare)
                of_doc = np.repeat(np.arange(len(n)), n)[far]
                pairs, tf = np.unique(of_doc * max(1, len(kinds)) + which[far], return_counts=True)
                doc, word = np.divmod(pairs, max(1, len(kinds)))
                at = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                lists = (kinds.take(pa.array(word)), pa.array(unit[known_at[word]].astype(np.int32)), pa.array(tf.astype(np.int64)))
                # The whole sequences, each with its end token; none is empty.
                x = np.insert(x, np.cumsum(n), end)
                size = n + 1
                first = np.cumsum(size) - size
                n_known = size - np.bincount(of_doc, minlength=len(n)) - int(end >= first_rare)
                offsets = np.r_[0, np.cumsum(2 * size)].astype(np.int32)
                units = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(unit[x].tobytes())])
                cols = [*(part.column(c) for c in ("k1", "k2", "held_out", "s", "h")), pa.array(size), pa.array(n_known)]
                cols += [pa.array(np.add.reduceat(base[x], first)), pa.array(np.add.reduceat(within[x], first)), units]
                cols += [pa.ListArray.from_arrays(at, y) for y in lists]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ENCODED.split(", ")])
                places.trim()

    return rows.select("k1", "k2", "held_out", "s", "h", "t").mapInArrow(run, _ENCODED)


_SCORED = "k1 long, k2 long, held_out boolean, n_tokens long, n_known long, base double, within double, score double"


def network_scores(docs: DataFrame, net: Gru) -> DataFrame:
    """The columns of _SCORED for each of docs' rows, by their units u."""
    names = [x.split()[0] for x in _SCORED.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            s, at = sent.value.score(waiting), 0
            for cols, n in held:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s[at : at + n])], names=names)
                at += n
            held.clear()
            waiting.clear()

        for b in batches:
            for part in steps(b, "u", TEXTS, STEP_BYTES):
                got = [x.copy() for x in _units(part)]  # the batch goes before they are scored
                held.append(([part.column(c) for c in names[:-1]], len(got)))
                waiting += got
                size += sum(map(len, got))
                if size > PACK:
                    yield from scored()
                    size = 0
        if waiting:
            yield from scored()

    return docs.select(*names[:-1], "u").mapInArrow(run, _SCORED)


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), (fold_rows(doc_id, modulus) == held).alias("held_out"))
    counts = scratch.keep(token_counts(rows.where(~F.col("held_out"))), "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    warm = frequent(counts, WARM)
    index = {w: i for i, (w, _) in enumerate(warm)}
    unit = np.array([i if i < OWN else bucket(w) for i, (w, _) in enumerate(warm)] + list(range(OWN, UNITS)), dtype=np.int16)

    def unit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
        for b in batches:
            at = np.array([index[w] if index.get(w, OWN) < OWN else bucket(w) for w in b.column("word").to_pylist()], dtype=np.int64)
            total += np.bincount(at, weights=b.column("c").to_numpy(), minlength=UNITS).astype(np.int64)
            kinds += np.bincount(at, minlength=UNITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(UNITS, dtype=np.int32)), pa.array(total), pa.array(kinds)], names=["unit", "n", "v"])

    sums = counts.mapInArrow(unit_sums, "unit int, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # UNITS rows
    unit_n, unit_v = np.zeros(UNITS), np.zeros(UNITS)
    for r in sums:
        unit_n[r["unit"]], unit_v[r["unit"]] = r["n"], r["v"]
    share = np.where(np.arange(UNITS) < OWN, 1.0, unit_n + 0.5 * (unit_v + 1))
    c = np.array([x for _, x in warm] + [0] * BUCKETS, dtype=np.float64)
    rare = np.arange(len(c)) >= len(warm)
    base_of = np.where(rare, 0.0, np.log10((c + 0.5) / (n + 0.5 * (v + 1))))
    within = np.where(rare | (unit < OWN), 0.0, np.log10((c + 0.5) / share[unit]))
    sent = spark.sparkContext.broadcast((index, unit, base_of, within))  # WARM words

    # Every text is cut and looked up once; the rounds and the scoring read its units.
    draw = lambda seed: F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.lit(1 << 30))
    keyed = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("t").alias("k2"), "held_out", draw(5).alias("s"), draw(6).alias("h"), "t")
    coded = scratch.keep(encoded(keyed, sent), "encoded")
    train = coded.where(~F.col("held_out"))

    # The start: a bounded sample of whole training documents, by a hash of the row.
    got, size = [], 0
    for r in sorted(train.where(F.col("s") <= int(min(1.0, SAMPLE_TOKENS / max(1, n)) * (1 << 30))).select("h", "u").collect(), key=lambda r: (r["h"], bytes(r["u"]))):
        if size < 1.2 * SAMPLE_TOKENS:
            got.append(np.frombuffer(r["u"], dtype=np.int16))
            size += len(got[-1])
    net = Gru()
    net.fit(got, unit_n)
    if size < n:
        for k in range(ROUNDS):
            net = learned(train.where(F.col("h") % ROUNDS == k).select("u"), net, RATE * (1 - k / ROUNDS))
    main = scratch.keep(network_scores(coded, net), "scored").withColumn("score", F.col("score") + F.col("within"))
    # Tokens beyond WARM: each meets its count; no such token is more than 1/WARM of the corpus.
    far = coded.select("k1", "k2", F.explode(F.arrays_zip("words", "units", "tf")).alias("w")).select("k1", "k2", F.col("w.words").alias("word"), F.col("w.units").alias("unit"), "w.tf")
    met = far.join(counts.where(~F.col("word").isin(END)).hint("merge"), "word", "left")
    unit_share = spark.createDataFrame([(i, float(share[i])) for i in range(UNITS)], "unit int, share double")
    c0 = F.coalesce("c", F.lit(0)) + 0.5
    rare_sums = met.join(F.broadcast(unit_share), "unit").groupBy("k1", "k2").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10(c0 / (n + 0.5 * (v + 1)))).alias("more_base"),
        F.sum(F.col("tf") * F.log10(c0 / F.col("share"))).alias("more_score"),
    )
    # Rows that are equal in id and text gave the same rare tokens, each once a row.
    times = main.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.first("held_out").alias("held_out"), F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base").alias("base"), F.first("score").alias("score"))
    out = times.join(rare_sums, ["k1", "k2"], "left").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("times"))))
    more = lambda x: F.coalesce(F.col(x) / F.col("times"), F.lit(0.0))
    return out.select(
        F.when(F.col("k1") != -(1 << 63), F.col("k1")).alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_known") + F.round(more("more_known")).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"),
        (F.col("score") + more("more_score")).alias("score"),
    )
