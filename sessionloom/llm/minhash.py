"""Near-duplicate components by b-bit MinHash, links confirmed on full shingle sets.

1. Every text becomes the set of its 5-word shingles (64-bit hashes), 320 minima, the low two bits
   of each (mixed) minimum packed into ten 64-bit words, and band keys of as many minima each as
   leave a pair at the threshold a chance under 1e-5 to share none (at 0.85: 40 bands of 8, 3e-6).
2. Equal sets are one node: a node is the 128-bit digest of its set.
3. Waves over the band buckets. In a bucket that still holds several components, every node meets
   the bucket's hub - linear in the bucket. The first hub is the most central node: the one whose
   buckets hold the most members, near the origin that a group of copies was made from, and the
   same in all of the group's buckets. Pairs whose collision-corrected estimate,
   (m/320 - 1/4) / (3/4), is within five standard deviations of the threshold or above it are
   confirmed on the full sets, and links join components.
4. What hubs cannot decide is decided inside the buckets, where no pairs are written. Signatures are
   compared by bit counts, a pair in the first band that it shares; out come only the nodes that
   have a candidate of another component. These return with their full sets, an inverted index
   gives the exact intersections of all of a bucket's candidates, and what comes out is a forest:
   at most one link less than there are components. Large buckets are cut into blocks of BLOCK
   signatures or BYTES of sets, and a task meets two blocks at a time. Pairs of one component are
   never compared, so a group of copies costs its size only; what stays quadratic is the comparing
   (not the rows) of texts that share a bucket and are not linked.

Components come from minimum labels with pointer jumping over tables in the shared folder. Joins on
component labels and on buckets, where one key may stand on a large part of the rows, send the
smaller side to all tasks while it is counted to be small, and are salted beyond that.

Defined cases: a null or blank text has an empty set and is linked with nothing; a row without
doc_id is returned with a null component and kept, and links nothing; rows that repeat a doc_id
share its component where their sets link; ties go to the smaller doc_id; extra columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, remembers, shuffle_partitions, steps, tidy

WORDS, K, BITS = 5, 320, 2
#: Chance to share no band at the threshold, at most; standard deviations that an estimate may be low.
MISSED, DEVIATIONS = 1e-5, 5
#: Hub waves before buckets are compared within.
WAVES = 2
#: Signatures, and bytes of full sets, of one block; pairs that one step compares.
BLOCK, BYTES, PAIRS = 32_768, 16 << 20, 1 << 20
#: Rows of at most three short keys that are sent to all tasks, counted before; salts beyond that. Such a
#: table passes through the driver, which keeps it until its garbage is collected: 20,000 rows are about 3 MB.
SENT, SALTS = 20_000, 16
#: Planes, and bits of one, of the filter on ids: 4 MB are sent, however many ids there are.
PLANES, PLANE = 1024, 32_768
#: Texts and bytes of text of one step.
TEXTS, STEP_BYTES = 1000, 8 << 20
#: Word hashes that a task remembers.
REMEMBERED = 200_000

_rng = np.random.Generator(np.random.PCG64(6))
_MULT = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 64, K, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 64, K, dtype=np.uint64)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    if n < 1:
        return _mix((h * _MULT[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    s = h[:n] * _MULT[0]
    for k in range(1, WORDS):
        s += h[k : k + n] * _MULT[k]
    return np.unique(_mix(s + np.uint64(WORDS)))


def forget_words() -> None:
    _words.clear()


remembers("minhash", forget_words)


def minima(s: np.ndarray) -> np.ndarray:
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def banding(threshold: float) -> int:
    """The most minima a band with which a pair at the threshold is missed rarely enough."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (K // r) <= MISSED)


def least_estimate(threshold: float) -> float:
    same = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - DEVIATIONS * (same * (1 - same) / K) ** 0.5 / (1 - 2.0**-BITS)


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band, from the whole minima."""
    bands = K // rows
    by = (m[: bands * rows].astype(np.uint64) * _BAND[: bands * rows]).reshape(bands, rows)
    return _mix(by.sum(axis=1, dtype=np.uint64) + _SALT[:bands]).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The mixed minima's low bits: a plane of K bits for each of the BITS bits, as 64-bit words.

    Low bits of a * x + b with odd a agree for all functions or for none; mixing makes them independent.
    """
    m = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    m = (m ^ (m >> np.uint32(12))) * np.uint32(0x297A2D39)
    m ^= m >> np.uint32(15)
    return np.concatenate([np.packbits((m >> np.uint32(b)) & np.uint32(1)).view(np.int64) for b in range(BITS)])


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    planes = K // 64
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[i + planes].bitwiseXOR(b[i + planes]))) for i in range(planes)), F.lit(0))
    chance = 2.0**-BITS
    return ((K - apart) / F.lit(float(K)) - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all pairs of two stacks of signatures."""
    planes, chance = K // 64, 2.0**-BITS
    a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of a signed number's magnitude
    apart = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(planes):
        apart += np.bitwise_count((a[:, None, i] ^ b[None, :, i]) | (a[:, None, i + planes] ^ b[None, :, i + planes]))
    return ((K - apart) / K - chance) / (1 - chance)


_LONGS = T.ArrayType(T.LongType())
_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sig", _LONGS), T.StructField("bands", _LONGS)])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, text: str, doc_id: str, band_rows: int) -> DataFrame:
    """doc_id, n (set size), node (digest of the set, null if empty), sig and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                n, node, sig, bands = [], [], [], []
                for t in part.column("t").to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        node.append(_digest(s))
                        sig.append(packed(m))
                        bands.append(band_keys(m, band_rows))
                    else:
                        node.append(None)
                        sig.append(None)
                        bands.append(None)
                longs = pa.list_(pa.int64())
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, longs), pa.array(bands, longs)]
                yield pa.RecordBatch.from_arrays(cols, names=_FEATURES.names)
        forget_words()  # the worker lives on and serves other stages

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy("minhash", run), _FEATURES)


def _likely(rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """All of the rows whose key is wanted, and few others: one bit of a filter tells each key.

    An exact join may follow, but no semi join: Spark would push it below the filter.
    """
    spot = F.xxhash64(key)
    plane, bit = F.pmod(spot, F.lit(PLANES)), F.pmod(F.shiftrightunsigned(spot, 20), F.lit(PLANE))
    bits = wanted.select(plane.alias("_plane"), bit.alias("_bit")).groupBy("_plane").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_plane": plane, "_bit": bit}).join(F.broadcast(bits), "_plane")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0).select(*rows.columns)


def _sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, items): the full sets of the wanted (doc_id)s, items as bytes of sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                found = [s for s in map(shingles, part.column("t").to_pylist()) if len(s)]
                if found:
                    cols = [pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "items"])
        forget_words()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    # The ids go to the texts while they are counted to be few; beyond that the texts that a filter leaves are exchanged.
    few = wanted.count() <= SENT
    rows = rows.join(F.broadcast(wanted), "doc_id", "left_semi") if few else _likely(rows, wanted).join(wanted.distinct().hint("merge"), "doc_id")
    # Rows of one doc_id with different texts, and equal sets, would otherwise give a node twice.
    return rows.select("t").mapInArrow(tidy("minhash", run), "node binary, items binary").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * |both| >= num * |either|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, x = [], None, None
            for a, b in zip(batch.column("x"), batch.column("y")):
                raw = a.as_buffer()
                if last is None or not raw.equals(last):
                    last, x = raw, np.frombuffer(raw, dtype=np.uint64)
                y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    sets = _likely(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    first = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    second = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    return pairs.join(first, "b").join(second, "a").select("a", "b", "x", "y").mapInArrow(tidy("minhash", run), "a binary, b binary")


def _meet(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """big joined with small by key, where one key may stand on a large part of big.

    `spread` is a column of big that tells rows of one key apart; small has a row a key.
    """
    if small.count() <= SENT:  # small is a written table, so counting is reading a footer
        return big.join(F.broadcast(small), key, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    # Estimates leave out that salts multiply the rows: without the hint Spark may send them all.
    return dealt.join(small.withColumn("_salt", salts).hint("merge"), [key, "_salt"], how).drop("_salt")


def _joined(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp, central) after the links (u, v) between components: the smallest label wins."""
    both = links.select(F.col("u").alias("s"), F.col("v").alias("t")).unionByName(links.select(F.col("v").alias("s"), F.col("u").alias("t")))
    ends = scratch.keep(both.distinct(), "ends")
    now = scratch.keep(ends.select(F.col("s").alias("c")).distinct().select("c", F.col("c").alias("to")), "roots")
    while True:
        near = _meet(ends, now.select(F.col("c").alias("t"), "to"), "t", "s").groupBy("s").agg(F.min("to").alias("near"))
        lower = now.join(near.withColumnRenamed("s", "c"), "c").select("c", F.least("to", "near").alias("mid"), F.col("to").alias("was"))
        step = _meet(lower, now.select(F.col("c").alias("mid"), F.col("to").alias("far")), "mid", "c")
        step = scratch.keep(step.select("c", F.least("mid", "far").alias("to"), "was"), "roots")
        moved = step.where(F.col("to") != F.col("was")).limit(1).count()
        scratch.drop(now)
        now = step
        if not moved:
            break
    out = _meet(labels, now.select(F.col("c").alias("comp"), "to"), "comp", "node", "left")
    out = scratch.keep(out.select("node", F.coalesce("to", "comp").alias("comp"), "central"), "labels")
    scratch.drop(ends, now, labels)
    return out


def _cells(rows: DataFrame, n: Column, top_n: Column, size: int, tasks: int) -> DataFrame:
    """rows(bk, node, comp, top, ...) dealt to cells (bk, i, j), left block first (side 0).

    A bucket of at most `size` is one cell. A larger one is cut into blocks, of its largest
    component and of the others; every two blocks meet in a cell, but none of that component alone.
    """
    one = n <= size
    mains, others = F.ceil(top_n / size), F.ceil(F.greatest(n - top_n, F.lit(1)) / size)
    is_main = F.col("comp") == F.col("top")
    block = F.when(one, 0).when(is_main, F.pmod(F.hash("node"), mains)).otherwise(mains + F.pmod(F.hash("node"), others))
    first = F.when(~one & is_main, mains).otherwise(0)
    last = F.when(one, 0).otherwise(mains + others - 1)
    dealt = rows.withColumns({"_b": block.cast("long"), "_from": first.cast("long"), "_to": last.cast("long")})
    dealt = dealt.withColumn("_x", F.explode(F.sequence("_from", "_to")))
    dealt = dealt.withColumns({"i": F.least("_b", "_x"), "j": F.greatest("_b", "_x")})
    dealt = dealt.withColumn("side", F.when(F.col("_b") == F.col("i"), 0).otherwise(1)).drop("_b", "_from", "_to", "_x", "top")
    # Comparing costs more than the bytes of a cell tell: the number of tasks is set, not derived.
    return dealt.repartition(tasks, "bk", "i", "j").sortWithinPartitions("bk", "i", "j", "side")


class _Rows:
    """Some rows of a cell."""

    def __init__(self, batch: pa.RecordBatch, bk: int):
        n = batch.num_rows
        matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.sig, bands = matrix("sig"), matrix("bands")
        self.at = int(np.argmax(bands[0] == bk))
        self.bands = np.ascontiguousarray(bands[:, : self.at])  # those before this one
        self.n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.node, self.comp = batch.column("node").to_pylist(), batch.column("comp").to_pylist()
        self.items = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("items")] if "items" in batch.schema.names else []

    def add(self, other: _Rows) -> None:
        self.sig, self.bands, self.n = np.concatenate([self.sig, other.sig]), np.concatenate([self.bands, other.bands]), np.concatenate([self.n, other.n])
        self.node += other.node
        self.comp += other.comp
        self.items += other.items


def _candidates(left: _Rows, right: _Rows, itself: bool, least: float, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of right, mask of some rows of right by left): estimates and sizes suffice, and no earlier band is shared."""
    step = max(1, PAIRS // len(left.n))
    for at in range(0, len(right.n), step):
        own = slice(at, at + step)
        ok = estimates(right.sig[own], left.sig) >= least
        small, large = np.minimum(right.n[own, None], left.n[None]), np.maximum(right.n[own, None], left.n[None])
        ok &= den * small >= num * large
        if itself:
            ok &= np.arange(at, at + len(ok))[:, None] > np.arange(len(left.n))[None]
        for lo in range(0, len(ok), 64):
            r, c = np.nonzero(ok[lo : lo + 64])
            for k in range(0, len(r) if left.at else 0, 1 << 16):
                rk, ck = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                before = (right.bands[at + lo + rk] == left.bands[ck]).any(axis=1)
                ok[lo + rk[before], ck[before]] = False
        yield at, ok


def _over_cells(cell, schema: list[tuple[str, pa.DataType]]):
    """mapInArrow function over sorted cells; cell() gives an object with left(rows, itself), right(rows) and rows to emit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, work, out = None, None, None, []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in schema]
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[k for k, _ in schema])
            out.clear()
            return b

        def begin() -> None:
            nonlocal work
            if work is None and held is not None:
                work = cell(now[0], held, now[1] == now[2])
                out.extend(work.start())

        def close() -> None:
            nonlocal held, work
            begin()
            if work is not None:
                out.extend(work.end())
            held = work = None

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bk", "i", "j", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), n]
            for lo, hi in zip(cuts, cuts[1:]):
                bk, i, j, side = key[lo].tolist()
                if now != (bk, i, j):
                    close()
                    now = (bk, i, j)
                rows = _Rows(batch.slice(lo, hi - lo), bk)
                if side == 0:
                    if held is None:
                        held = rows
                    else:
                        held.add(rows)
                else:
                    begin()
                    if work is not None:
                        out.extend(work.meet(rows))
                if len(out) > 20_000:
                    yield emit()
        close()
        yield emit()

    return tidy("minhash", run)


def _with_candidates(least: float, num: int, den: int):
    """Cells of signatures: (bk, node) of the rows that have a candidate of another component."""

    class Cell:
        def __init__(self, bk: int, left: _Rows, itself: bool):
            self.bk, self.left, self.itself = bk, left, itself
            self.ids: dict[bytes, int] = {}
            self.comp = self.numbered(left)
            self.hit = np.zeros(len(left.n), dtype=bool)

        def numbered(self, rows: _Rows) -> np.ndarray:
            return np.array([self.ids.setdefault(c, len(self.ids)) for c in rows.comp])

        def start(self) -> list[tuple]:
            return self.meet(self.left) if self.itself else []

        def meet(self, right: _Rows) -> list[tuple]:
            comp, hit = self.numbered(right), np.zeros(len(right.n), dtype=bool)
            for at, ok in _candidates(self.left, right, self.itself, least, num, den):
                ok &= comp[at : at + len(ok), None] != self.comp[None]
                hit[at : at + len(ok)] |= ok.any(axis=1)
                self.hit |= ok.any(axis=0)
            if self.itself:
                self.hit |= hit
                return []
            return [(self.bk, right.node[i]) for i in np.flatnonzero(hit).tolist()]

        def end(self) -> list[tuple]:
            return [(self.bk, self.left.node[i]) for i in np.flatnonzero(self.hit).tolist()]

    return _over_cells(Cell, [("bk", pa.int64()), ("node", pa.binary())])


def _forest(least: float, num: int, den: int):
    """Cells with full sets: (u, v), links that join the cell's components, at most one less than these."""

    class Cell:
        def __init__(self, bk: int, left: _Rows, itself: bool):
            self.left, self.itself = left, itself
            self.ids: dict[bytes, int] = {}
            self.names: list[bytes] = []
            self.root = np.zeros(0, dtype=np.int64)  # of each component met
            self.comp = self.numbered(left)
            # An inverted index: each distinct item's rows of the left block.
            items, rows = np.concatenate(left.items), np.repeat(np.arange(len(left.n), dtype=np.int32), left.n)
            order = np.argsort(items, kind="stable")
            self.rows, items = rows[order], items[order]
            first = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
            self.items, self.first, self.many = items[first], first, np.diff(np.r_[first, len(items)])

        def numbered(self, rows: _Rows) -> np.ndarray:
            for c in rows.comp:
                if c not in self.ids:
                    self.ids[c] = len(self.names)
                    self.names.append(c)
            self.root = np.r_[self.root, np.arange(len(self.root), len(self.names))]
            return np.array([self.ids[c] for c in rows.comp])

        def shared(self, items: np.ndarray) -> np.ndarray:
            """The size of the intersection with every row of the left block."""
            at = np.searchsorted(self.items, items)
            at[at == len(self.items)] = 0
            at = at[self.items[at] == items]
            out, k = np.zeros(len(self.left.n), dtype=np.int64), 0
            ends = np.cumsum(self.many[at])
            while k < len(at):  # steps of some million entries
                z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (4 << 20), side="right")))
                many = self.many[at[k:z]]
                stops = np.cumsum(many)
                spots = np.repeat(self.first[at[k:z]] - (stops - many), many) + np.arange(stops[-1])
                out += np.bincount(self.rows[spots], minlength=len(out))
                k = z
            return out

        def start(self) -> list[tuple]:
            return self.meet(self.left) if self.itself else []

        def meet(self, right: _Rows) -> list[tuple]:
            out, left, comp = [], self.left, self.comp if right is self.left else self.numbered(right)
            for at, ok in _candidates(left, right, self.itself, least, num, den):
                for r in np.flatnonzero(ok.any(axis=1)).tolist():
                    x, own = at + r, comp[at + r]
                    open_ = ok[r] & (self.root[self.comp] != self.root[own])
                    if not open_.any():
                        continue
                    both = self.shared(right.items[x])
                    open_ &= den * both >= num * (left.n + right.n[x] - both)
                    while open_.any():
                        other = self.comp[int(open_.argmax())]
                        out.append((self.names[own], self.names[other]))
                        self.root[self.root == self.root[other]] = self.root[own]
                        open_ &= self.root[self.comp] != self.root[own]
            return out

        def end(self) -> list[tuple]:
            return []

    return _over_cells(Cell, [("u", pa.binary()), ("v", pa.binary())])


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links where den*|both| >= num*|either|."""
    scratch, least, tasks = Scratch(docs.sparkSession), least_estimate(num / den), shuffle_partitions(docs.sparkSession)
    feats = scratch.keep(features(docs, text, doc_id, banding(num / den)), "features")
    usable = feats.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = usable.groupBy("node").agg(F.min_by(F.struct("doc_id", "n", "sig", "bands"), "doc_id").alias("first"))
    nodes = scratch.keep(nodes.select("node", "first.*"), "nodes")
    of_docs = scratch.keep(feats.select("doc_id", "n", "node"), "of_docs")
    scratch.drop(feats)
    # Most bands and nodes are alone in their buckets: only what a filter leaves is exchanged for the exact joins.
    rows = nodes.select("node", F.explode("bands").alias("bk"))
    shared = scratch.keep(rows.groupBy("bk").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    buckets = scratch.keep(_likely(rows, shared, "bk").join(shared.hint("merge"), "bk"), "buckets")
    central = scratch.keep(buckets.groupBy("node").agg(F.sum("members").alias("central")), "central")
    sigs = scratch.keep(_likely(nodes, central, "node").join(central.hint("merge"), "node"), "sigs")
    named = scratch.keep(nodes.select("node", "doc_id"), "names")
    scratch.drop(nodes, shared, central)
    sets = scratch.keep(_sets(docs, scratch.keep(sigs.select("doc_id").distinct(), "wanted"), text, doc_id), "sets")
    labels = scratch.keep(sigs.select("node", F.col("node").alias("comp"), "central"), "labels")

    def estimated(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        return both.where(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")

    open_ = buckets
    for wave in range(WAVES):
        # The order is one for all bands, so that a group's buckets agree on a hub.
        order = F.struct(-F.col("central"), F.xxhash64("node")) if wave == 0 else F.struct(F.xxhash64("node", F.lit(wave)))
        at = scratch.keep(open_.join(labels, "node").select("bk", "node", "comp", order.alias("o")), "at")
        hubs = at.groupBy("bk").agg(F.min(F.struct("o", "node", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        hubs = scratch.keep(hubs.select("bk", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "hubs")
        met = _meet(at, hubs, "bk", "node").where("comp <> hub_comp").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        links = scratch.keep(_confirm(scratch.keep(estimated(met), "met"), sets, num, den), "links")
        if not links.isEmpty():
            comp = lambda end, name: labels.select(F.col("node").alias(end), F.col("comp").alias(name))
            ends = links.join(comp("a", "u"), "a").join(comp("b", "v"), "b").where("u <> v").select("u", "v").distinct()
            labels = _joined(scratch, labels, ends)
        scratch.drop(at, links)
        # A bucket of two has met whole: its one pair went through the first wave.
        open_ = _meet(buckets.where("members > 2"), hubs.select("bk"), "bk", "node", "left_semi")
    # Buckets that still hold several components: compare across components inside them.
    at = scratch.keep(open_.join(labels, "node").select("bk", "node", "comp"), "at")
    by = at.groupBy("bk", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bk")
    by = by.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    by = scratch.keep(by.select("bk", F.col("top.comp").alias("top"), F.col("top.n").alias("top_n"), "all_n"), "by")
    if not by.isEmpty():
        met = _meet(at, by, "bk", "node").join(sigs.select("node", "n", "sig", "bands"), "node")
        cells = _cells(met, F.col("all_n"), F.col("top_n"), BLOCK, tasks).drop("all_n", "top_n")
        found = scratch.keep(cells.mapInArrow(_with_candidates(least, num, den), "bk long, node binary").distinct(), "near")
        tops = by.select("bk", "top")
        near = found.join(labels.select("node", "comp"), "node").join(sigs.select("node", "n", "sig", "bands"), "node")
        near = _meet(near, tops, "bk", "node")
        mass = F.col("n") * 8
        weigh = near.groupBy("bk").agg(F.sum(mass).alias("all_bytes"), F.sum(F.when(F.col("comp") == F.col("top"), mass).otherwise(0)).alias("top_bytes"))
        near = _meet(near, scratch.keep(weigh, "weigh"), "bk", "node").join(_likely(sets, found, "node"), "node")
        cells = _cells(near, F.col("all_bytes"), F.col("top_bytes"), BYTES, tasks).drop("all_bytes", "top_bytes")
        links = scratch.keep(cells.mapInArrow(_forest(least, num, den), "u binary, v binary").distinct(), "links")
        if not links.isEmpty():
            labels = _joined(scratch, labels, links)
    # Components by their smallest doc_id; a node that is alone keeps its own.
    several = labels.join(sigs.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    several = scratch.keep(several.where("nodes > 1").drop("nodes"), "several")
    grouped = _meet(labels.select("node", "comp"), several, "comp", "node").select("node", "component_id")
    ids = scratch.keep(named.join(grouped, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "ids")
    scratch.drop(named, buckets, sigs, sets, labels)
    out = of_docs.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNull(), None).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", num: int = 85, den: int = 100) -> DataFrame:
    """The rows of docs whose document stands for its component, with docs' columns."""
    name = free_name(docs, "_gone")
    gone = components(docs, text, doc_id, num, den).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
