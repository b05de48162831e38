"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of a pre-token form a linked list. Each adjacent pair that some token's bytes spell has
a merge rank, and a bucket per rank holds the positions where the pair began. Two levels of 256-bit
words mark the ranks whose buckets have entries: find-first-set on the upper word gives the group,
on the lower word the rank. Entries whose pair has changed meanwhile are stale and skipped. A
merge adds at most two entries, so n bytes make at most 3n entries and cost O(n log n) at worst
(sorting within a bucket). The pre-tokens of several texts go through one queue together.

Defined cases: a null text is the empty text, with no ids; text that is not valid UTF-16 in its
source cannot occur in Spark strings. Encoding and decoding are row by row, so ties, repeated rows
and clashing column names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembers, small_batches, steps, tidy

_BIT = [1 << i for i in range(256)]
#: Entries of one generation of what a worker remembers.
REMEMBERED = 120_000
#: Texts and bytes of text of one step, and pre-tokens that share one queue.
TEXTS, STEP_BYTES, PIECES = 500, 4 << 20, 2_000
#: Blanks that certainly begin a pre-token, and texts in which other blanks exist.
STRETCH, DOUBLE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|\A |\s\Z")
#: Pre-tokens longer than this are not remembered.
LONGEST_REMEMBERED = 64


class ByteBpe:
    """Encoder and decoder for a file of ranks (base64 bytes, blank, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError("the rank queue's two levels hold ranks below 65,536")
        self.ranks = ranks
        self.vocab = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.byte_pairs = np.array([[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)])
        self.to_right: dict[int, dict[int, int]] = {r: {} for r in ranks.values()}  # left id -> right id -> rank
        self.to_left: dict[int, dict[int, int]] = {r: {} for r in ranks.values()}
        for b, r in ranks.items():
            for k in range(1, len(b)):
                x, y = ranks.get(b[:k]), ranks.get(b[k:])
                if x is not None and y is not None:
                    self.to_right[x][y] = self.to_left[y][x] = r
        self.pattern = regex.compile(pattern)
        # Only of this pattern is it known that a blank between two characters begins a pre-token.
        self.cuts_at_blanks = pattern == default_ranks()[1]
        # Two generations each of remembered pre-tokens, and of stretches that follow a blank.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = np.zeros(max(self.vocab) + 1, dtype=np.int64)
        for r, b in self.vocab.items():
            self.length[r] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.spelt = np.frombuffer(b"".join(self.vocab[r] for r in sorted(self.vocab)), dtype=np.uint8)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 32 bits) of each pre-token; all non-empty.

        All pre-tokens share one queue and one position space. A sentinel stands at both ends of
        each list: no pair with it has a rank, so no merge crosses from one pre-token to the next.
        """
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n, starts = len(raw), np.cumsum([0, *map(len, pieces)])
        ids = [*self.single[raw].tolist(), -2]
        first = np.full(n + 1, -1, dtype=np.int64)
        first[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        first[starts[1:] - 1] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = before[starts[:-1]] = n
        after, before, due = after.tolist(), before.tolist(), first.tolist()
        # The first pairs by rank: buckets of positions in order, and the two levels of marks.
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks = first[at]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(at) else at
        entries, ends = at.tolist(), [*cuts.tolist()[1:], len(at)]
        buckets = {r: entries[a:z] for r, a, z in zip(ranks[cuts].tolist(), cuts.tolist(), ends)}
        top, low = 0, [0] * 256
        for r in buckets:
            low[r >> 8] |= _BIT[r & 255]
            top |= _BIT[r >> 8]
        to_right, to_left = self.to_right, self.to_left
        while top:
            group = (top & -top).bit_length() - 1
            word = low[group]
            bit = word & -word
            rank = group << 8 | bit.bit_length() - 1
            low[group] = word = word ^ bit
            if not word:
                top ^= _BIT[group]
            bucket = buckets.pop(rank)
            bucket.sort()
            right, left = to_right[rank].get, to_left[rank].get
            for i in bucket:
                if due[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                h = before[i]
                ids[i], ids[j], due[j], after[i], before[k] = rank, -1, -1, k, i
                # A pair longer than the one just merged never has its rank, so this bucket does not grow.
                r = right(ids[k])
                if r is None:
                    due[i] = -1
                else:
                    due[i] = r
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        low[r >> 8] |= _BIT[r & 255]
                        top |= _BIT[r >> 8]
                r = left(ids[h])
                if r is None:
                    due[h] = -1
                else:
                    due[h] = r
                    if r in buckets:
                        buckets[r].append(h)
                    else:
                        buckets[r] = [h]
                        low[r >> 8] |= _BIT[r & 255]
                        top |= _BIT[r >> 8]
        merged = np.array(ids[:n], dtype=np.int64)
        live = merged >= 0
        ends = 4 * np.cumsum(live)[starts[1:] - 1]
        code = merged[live].astype("<u4").tobytes()
        return [code[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist())]

    def pieces(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of each given text, by way of its pre-tokens; what recurs is remembered."""
        split, young, old = self.pattern.findall, self.young, self.old
        cut = {t: split(t) for t in texts}
        new = set().union(*cut.values()).difference(young) if cut else set()
        again = {x for x in new if x in old}
        young.update((x, old[x]) for x in again)
        new = list(new.difference(again))
        own = {}
        for at in range(0, len(new), PIECES):
            part = new[at : at + PIECES]
            own.update(zip(part, self.merge([x.encode("utf-8", "surrogatepass") for x in part])))
        short = {k: v for k, v in own.items() if len(k) <= LONGEST_REMEMBERED}
        young.update(short)
        if len(short) == len(own):
            out = {t: b"".join(map(young.__getitem__, x)) for t, x in cut.items()}
        else:
            out = {t: b"".join([young[y] if y in young else own[y] for y in x]) for t, x in cut.items()}
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        A blank between two characters that are not white space always begins a pre-token, so the
        text is cut there first: the stretches between such blanks are encoded once and recur. With
        another pattern, texts are not cut first.
        """
        if not self.cuts_at_blanks:
            whole = self.pieces(list(set(texts)))
            return [whole[t] for t in texts]
        cut = []
        for t in texts:
            x = STRETCH.split(t) if DOUBLE.search(t) else t.split(" ")
            cut.append((x[0], x[1:]))
        spaced, older = self.spaced, self.older
        new = set().union(*[x for _, x in cut]).difference(spaced)
        again = {x for x in new if x in older}
        spaced.update((x, older[x]) for x in again)
        heads = {t for t, _ in cut}
        found = self.pieces([*(" " + x for x in new if x not in again), *heads])
        long_ = {}
        for x in new.difference(again):
            (spaced if len(x) <= LONGEST_REMEMBERED else long_)[x] = found[" " + x]
        if long_:
            out = [found[t] + b"".join([spaced[y] if y in spaced else long_[y] for y in x]) for t, x in cut]
        else:
            out = [found[t] + b"".join(map(spaced.__getitem__, x)) for t, x in cut]
        if len(spaced) > REMEMBERED:
            self.older, self.spaced = spaced, {}
        return out

    def rest(self) -> None:
        """Lets go of the older generations: a worker lives on between tasks, and serves other stages too."""
        self.old, self.older = {}, {}

    def decode(self, codes: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for; at most STEP_BYTES of ids are spelt at a time."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for code in codes:
            if size + len(code) > STEP_BYTES:
                out += self._spell(held)
                held, size = [], 0
            if len(code) > STEP_BYTES:
                out.append(b"".join(self._spell([code[at : at + STEP_BYTES] for at in range(0, len(code), STEP_BYTES)])))
            else:
                held.append(code)
                size += len(code)
        return out + self._spell(held)

    def _spell(self, codes: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(codes), dtype="<u4")
        size = self.length[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[ids] - (ends - size), size)
        shift += np.arange(len(shift))
        flat = self.spelt[shift].tobytes()
        cuts = np.r_[0, ends][np.cumsum([0, *(len(c) // 4 for c in codes)])].tolist()
        return [flat[a:z] for a, z in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(path, pattern)


remembers("bpe", bpe.cache_clear)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _codes(ids: pa.Array) -> list[bytes]:
    """Each row of a list column as little-endian bytes; null rows are empty."""
    ids = ids.fill_null([]) if ids.null_count else ids
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))
    return [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ids) else []


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """The kept columns, then ids (array of int) and n_tokens, a row for each row of docs.

    With `decoded`, also decoded_sha256, the digest of what the ids decode to, in the same pass.
    The file of ranks is a parameter and must be at that path on every executor.
    """
    if path is None:
        path, pattern = default_ranks()
    small_batches(docs.sparkSession)
    names = [*(f"k{i}" for i in range(len(keep))), "ids", "n_tokens", *["decoded_sha256"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                found = own.encode([x or "" for x in part.column("t").to_pylist()])
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                back = [pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(found)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(np.diff(offsets).astype(np.int64)), *back], names=names)
        own.rest()

    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    types = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded_sha256", T.StringType())] * decoded])
    return rows.mapInArrow(tidy("bpe", run), types).toDF(*keep, *names[len(keep) :])


def decode_ids(encoded: DataFrame, ids: str = "ids", keep: tuple = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The kept columns and `decoded`, the bytes that the ids stand for (null ids: none)."""
    if path is None:
        path, pattern = default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)  # ids are spelt in steps of bounded size
                out = own.decode(_codes(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*(f"k{i}" for i in range(part.num_columns - 1)), "decoded"])

    rows = encoded.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids).alias("ids"))
    return rows.mapInArrow(tidy("bpe", run), T.StructType([*rows.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])).toDF(*keep, "decoded")


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids, in one pass."""
    if path is None:
        path, pattern = default_ranks()
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        digest = hashlib.sha256
        for b in batches:
            for part in steps(b, "t", TEXTS, STEP_BYTES):
                codes = own.encode([x or "" for x in part.column("t").to_pylist()])
                n = pa.array([len(x) // 4 for x in codes], pa.int64())
                a = pa.array([digest(x).hexdigest() for x in codes], pa.string())
                z = pa.array([digest(x).hexdigest() for x in own.decode(codes)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, a, z], schema=schema)
        own.rest()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tidy("bpe", run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
