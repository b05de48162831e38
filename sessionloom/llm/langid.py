"""Language identification in two steps: the family first, then the language within it.

Families are found from the training sample: the languages' mean profiles are joined bottom-up by
cosine while more than half as many groups as languages remain. A linear SVM per family, one
against the rest, picks the family (none is needed for one family); within a family, one linear
SVM for each pair of its languages votes, margins breaking ties. Profiles are hashed byte bigrams
and trigrams of the whole text, with ASCII letters lower-cased and other ASCII bytes as blanks.

The learner sees a bounded sample: PER_LANG rows of each language, fewer where that would be more
than SAMPLE rows in all, chosen by a hash of the row; the profiles are taken from whole texts on the
executors. Every language that the training rows name is learned; more than LANGS is an error.

Defined cases: a text that is null or has no letter is `und` with score 0, also where nothing
could be learned; with one learned language every other text gets it, with score 1. A null id
belongs to fold crc32('') and is neither held out nor different from others. Where docs has a
column of the name meant for the prediction or score, underscores are added to it. Repeated rows
and ties need no care: prediction is row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, fold_rows, free_name, small_batches, steps, tidy

#: Buckets of the hashed profile; training rows a language, training rows, and languages, at most.
DIM, PER_LANG, SAMPLE, LANGS = 4096, 300, 12_000, 300
#: Bytes of one text that profiling works on at once; texts and bytes of text of one step.
STEP_BYTES, TEXTS, TEXT_BYTES = 1 << 20, 256, 8 << 20

_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[:128] = 32
_BYTE[65:91] = np.arange(97, 123)
_BYTE[97:123] = np.arange(97, 123)


def _add_profile(raw: np.ndarray, out: np.ndarray) -> None:
    """Adds the n-gram counts of one text's bytes to out."""
    for at in range(0, len(raw), STEP_BYTES):
        b = _BYTE[raw[at : at + STEP_BYTES + 2]].astype(np.uint32)
        tail = min(STEP_BYTES, len(raw) - at)
        if len(b) > 1:
            two = b[:-1] << 8 | b[1:]
            out += np.bincount(((two * np.uint32(2654435761)) >> np.uint32(20))[:tail], minlength=DIM)
        if len(b) > 2:
            three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            out += np.bincount(((three * np.uint32(2246822519)) >> np.uint32(20))[:tail], minlength=DIM)


def profiles(texts: list[str | None]) -> np.ndarray:
    """Square-rooted, length-one profiles, a row a text; zero for no text."""
    out = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        if t:
            _add_profile(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8), out[i])
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, lam: float = 1e-4, seed: int = 8) -> tuple[np.ndarray, float]:
    """Linear SVM, hinge loss, by averaged stochastic subgradient steps; y is -1 or 1."""
    rng, n = np.random.default_rng(seed), len(x)
    w, mean_w, b, mean_b, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, 0
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 16):
            rows = order[at : at + 16]
            t += 1
            eta = 1 / (lam * (t + 1 / (lam * 10)))
            margin = y[rows] * (x[rows] @ w + b)
            g = np.where(margin < 1, y[rows] * weight[rows], 0) / len(rows)
            w = (1 - eta * lam) * w + eta * (g @ x[rows])
            b += eta * 0.1 * g.sum()
            mean_w += (w - mean_w) / t
            mean_b += (b - mean_b) / t
    return mean_w.astype(np.float32), float(mean_b)


def families(centres: np.ndarray) -> list[list[int]]:
    """Languages joined by the cosine of their mean profiles, average linkage."""
    n = len(centres)
    near = centres @ centres.T
    groups = [[i] for i in range(n)]
    while len(groups) > max(1, (n + 1) // 2):
        best = max(((near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x[0])
        groups[best[1]] += groups.pop(best[2])
    return [sorted(g) for g in sorted(groups, key=min)]


class LanguageModel:
    """Families, and the two layers of SVMs stacked into one matrix."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.langs = sorted(set(labels))
        y = np.array([self.langs.index(v) for v in labels])
        if not self.langs:
            return
        centres = np.stack([x[y == k].mean(0) for k in range(len(self.langs))])
        # The part that all languages share hides the differences between families.
        spread = centres - centres.mean(0)
        self.families = families(spread / np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-9))
        rows, bias, self.pairs = [], [], []
        if len(self.families) > 1:
            for g in self.families:
                w, b = fit_svm(x, np.where(np.isin(y, g), 1.0, -1.0))
                rows.append(w)
                bias.append(b)
        for f, g in enumerate(self.families):
            for i in range(len(g)):
                for j in range(i + 1, len(g)):
                    own = (y == g[i]) | (y == g[j])
                    w, b = fit_svm(x[own], np.where(y[own] == g[i], 1.0, -1.0))
                    self.pairs.append((f, g[i], g[j]))
                    rows.append(w)
                    bias.append(b)
        self.w = np.stack(rows) if rows else np.zeros((0, DIM), np.float32)
        self.b = np.array(bias)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: the product of the two layers' logistic margins."""
        n, k = len(x), len(self.families) if len(self.families) > 1 else 0
        m = x @ self.w.T + self.b
        sure = lambda v: 1 / (1 + np.exp(-4 * np.clip(v, -30, 30)))
        family = m[:, :k].argmax(1) if k else np.zeros(n, dtype=int)
        score = sure(m[np.arange(n), family]) if k else np.ones(n)
        votes = np.zeros((n, len(self.langs)))
        close = np.full((n, len(self.langs)), np.inf)
        for p, (f, i, j) in enumerate(self.pairs):
            v = m[:, k + p]
            for lang, s in ((i, v), (j, -v)):
                votes[:, lang] += (s > 0) + 1e-3 * np.tanh(s)
                close[:, lang] = np.minimum(close[:, lang], s)
        for f, g in enumerate(self.families):
            outside = np.setdiff1d(np.arange(len(self.langs)), g)
            votes[np.ix_(family == f, outside)] = -np.inf
        best = votes.argmax(1)
        weakest = close[np.arange(n), best]
        score = score * np.where(np.isfinite(weakest), sure(np.where(np.isfinite(weakest), weakest, 0)), 1)
        return [self.langs[i] for i in best], np.clip(score, 0, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train=None) -> LanguageModel:
    """Learns from the labelled rows that `train` admits (default: crc32 of the id mod 4 is not 2)."""
    small_batches(docs.sparkSession)
    train = (fold_rows(doc_id, 4) != 2) if train is None else train
    named = docs.where(train & F.col(lang).isNotNull())
    counts = named.groupBy(F.col(lang).cast("string").alias("l")).count().orderBy("l").limit(LANGS + 1).collect()
    if not counts:
        return LanguageModel(np.zeros((0, DIM), np.float32), [])
    if len(counts) > LANGS:
        raise ValueError(f"the training rows name more than {LANGS} languages")
    rows = named.where(F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(8)), F.lit(1 << 30)).alias("h")
    )
    per = max(2, min(PER_LANG, SAMPLE // len(counts)))
    admitted = [(r["l"], int(min(1.0, 1.3 * per / r["count"]) * (1 << 30)) + 1) for r in counts]
    admitted = few_rows(docs.sparkSession, pa.schema([("l", pa.string()), ("below", pa.int64())]), admitted)  # a row a language
    picked = rows.join(F.broadcast(admitted), "l").where(F.col("h") < F.col("below")).select("t", "l", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "t", TEXTS // 2, TEXT_BYTES):
                x = profiles(part.column("t").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("l"), part.column("h"), pa.array([v.tobytes() for v in x], pa.binary())], names=["l", "h", "x"])

    got = picked.mapInArrow(tidy("langid", run), "l string, h long, x binary").collect()  # a bounded sample, about 1.3 * SAMPLE rows of 8 KB
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["h"], bytes(r["x"]))):
        by.setdefault(r["l"], []).append(bytes(r["x"]))
    labels = [k for k in sorted(by) for _ in by[k][:per]]
    x = np.stack([np.frombuffer(v, dtype=np.float16) for k in sorted(by) for v in by[k][:per]]).astype(np.float32) if labels else np.zeros((0, DIM), np.float32)
    return LanguageModel(x, labels)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, a prediction and a score between 0 and 1; only the text is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a row of DIM weights a family and a pair within one
    small_batches(docs.sparkSession)
    names = docs.columns
    prediction, score = free_name(docs, prediction), free_name(docs, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            for part in steps(b, f"k{names.index(text)}", TEXTS, TEXT_BYTES):
                lettered = part.column(part.num_columns - 1).to_pylist()
                texts = part.column(names.index(text)).to_pylist()
                if own.langs:
                    said, sure = own.predict(profiles(texts))
                else:
                    said, sure = ["und"] * len(texts), np.zeros(len(texts))
                said = [s if ok else "und" for s, ok in zip(said, lettered)]
                sure = [float(v) if ok else 0.0 for v, ok in zip(sure, lettered)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*(f"k{i}" for i in range(len(names))), "p", "s"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType())])
    return rows.mapInArrow(tidy("langid", run), schema).toDF(*names, prediction, score)


def label_documents(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows not held out."""
    model = fit(docs, text, lang, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_rows(doc_id, 4) == 2).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.0) -> DataFrame:
    """The rows whose language is not `und` and whose score is at least `least`, with docs' columns."""
    said = identify(docs, fit(docs, text, lang, doc_id), text, "_lang_pred", "_score")
    p, s = said.columns[-2:]
    return said.where((F.col(p) != "und") & (F.col(s) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
