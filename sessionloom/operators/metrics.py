"""Evaluation analytics: summaries, shares, evidence, verdicts, gates, pairings, intervals."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import span_terms


def structural_summary(rows: DataFrame, measures: list[str], groups: list[list[str]]) -> DataFrame:
    """Count, median and linear 95th percentile of each measure by several groupings at once."""
    keys = list(dict.fromkeys(c for g in groups for c in g))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.round(F.percentile(m, 0.5), 6).alias(f"{m}_p50"), F.round(F.percentile(m, 0.95), 6).alias(f"{m}_p95")]
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *keys).agg(*aggs)


def dead_state(rows: DataFrame) -> DataFrame:
    """Shares of a session's tokens in its largest, two and five largest spans, and in the newest."""
    top = F.sort_array(F.collect_list("tokens"), asc=False)
    by = rows.groupBy("session").agg(F.sum("tokens").alias("history_tokens"), F.count(F.lit(1)).alias("spans"), F.slice(top, 1, 5).alias("t"), F.max_by("tokens", "turn").alias("newest"))
    share = lambda k: F.round(F.aggregate(F.slice("t", 1, k), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("history_tokens"), 3)
    return by.select("session", "history_tokens", "spans", share(1).alias("largest_span"), share(2).alias("top2_share"), share(5).alias("top5_share"), F.round(F.col("newest") / F.col("history_tokens"), 3).alias("tail_share"))


def evidence_mass(rows: DataFrame, queries: DataFrame, share: float = 0.10, least: int = 2) -> DataFrame:
    """Tokens of earlier spans that share one, or two, rare terms with the query, and the largest span of the latter.

    A term is rare at a turn by its spans before that turn.
    """
    prior = rows.select("session", "turn").join(queries.select("session", "q_turn"), "session").where(F.col("turn") < F.col("q_turn"))
    sizes = prior.groupBy("session", "q_turn").agg(F.count(F.lit(1)).alias("n"))
    from ..functions import text as X

    asked = queries.select("session", "q_turn", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))
    hits = asked.join(span_terms(rows), ["session", "term"]).where(F.col("turn") < F.col("q_turn"))
    hits = hits.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("session", "term", "q_turn"))).join(sizes, ["session", "q_turn"])
    rare = hits.where(F.col("df") <= F.greatest(F.lit(least), F.floor(F.col("n") * share)))
    per = rare.groupBy("session", "q_turn", "span_id").agg(F.count(F.lit(1)).alias("shared")).join(rows.select("session", "span_id", "tokens"), ["session", "span_id"])
    two = F.when(F.col("shared") >= 2, F.col("tokens"))
    return per.groupBy("session", "q_turn").agg(F.sum("tokens").alias("mass1"), F.coalesce(F.sum(two), F.lit(0)).alias("mass2"), F.coalesce(F.max(two), F.lit(0)).alias("largest2"))


def near_duplicate_pairs(docs: DataFrame, threshold: float = 0.7, representatives: bool = False) -> DataFrame:
    """(a, b) with Jaccard of normalised non-blank line sets at least the threshold, by line postings.

    Lines are distinct per document and hashed; pairs meet only on lines that both hold, and only
    where the set sizes allow the threshold. A set of n lines needs only its n - ceil(t n) + 1
    rarest lines to meet every partner, so lines that many documents share form no pairs alone. With
    `representatives`, pairs are between the smallest ids of equal sets; `equal_line_sets` has the rest.
    """
    from ..functions import text as X

    lines = F.array_distinct(F.filter(F.transform(X.lines_of(F.col("text")), lambda x: F.trim(X.normalise_line(x))), lambda x: x != ""))
    each = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.sort_array(F.transform(lines, lambda x: F.xxhash64(x))).alias("s")).where(F.size("s") > 0)
    # Documents of equal sets are one node: copies meet nothing again, they are listed at the end.
    each = each.withColumn("node", F.struct(F.xxhash64("s").alias("h"), F.xxhash64("s", F.lit(7)).alias("g"), F.size("s").alias("n")))
    sets = each.groupBy("node").agg(F.first("s").alias("s"))
    post = sets.select("node", F.explode("s").alias("line"))
    freq = post.groupBy("line").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known, n = post.join(freq, "line"), F.col("node.n")
    # Lines that no other set holds are rarest, so they fill the prefix first.
    alone = n - F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "line")) + alone
    prefix = known.withColumn("r", rank).where(F.col("r") <= n - F.ceil(n * threshold - 1e-9) + 1)
    a = prefix.select(F.col("node").alias("a"), F.col("r").alias("ra"), "line")
    b = prefix.select(F.col("node").alias("b"), F.col("r").alias("rb"), "line")
    na, nb = F.col("a.n"), F.col("b.n")
    # Of the first line that two sets share, no more than the shorter rest can follow.
    room = 1 + F.least(na - F.col("ra"), nb - F.col("rb"))
    near = (F.least(na, nb) >= threshold * F.greatest(na, nb)) & (room >= threshold / (1 + threshold) * (na + nb) - 1e-9)
    pairs = a.join(b, "line").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    links = both.where(inter / union >= threshold).select("a", "b", F.round(inter / union, 6).alias("jaccard"))
    same = each.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("jaccard"))
    if representatives:
        names = each.groupBy("node").agg(F.min("id").alias("doc"))
        return links.join(names.select(F.col("node").alias("a"), F.col("doc").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("doc").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    member = lambda end, name: each.select(F.col("node").alias(end), F.col("id").alias(name))
    whole = links.unionByName(same).join(member("a", "x"), "a").join(member("b", "y"), "b")
    own = F.col("a") != F.col("b")
    return whole.where(own | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def equal_line_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, same_as): of the documents with the same set of normalised non-blank lines, the smallest id."""
    from ..functions import text as X

    lines = F.array_distinct(F.filter(F.transform(X.lines_of(F.col("text")), lambda x: F.trim(X.normalise_line(x))), lambda x: x != ""))
    each = docs.where(F.col("text").isNotNull()).select("doc_id", F.sort_array(F.transform(lines, lambda x: F.xxhash64(x))).alias("s")).where(F.size("s") > 0)
    each = each.select("doc_id", F.xxhash64("s").alias("h"), F.xxhash64("s", F.lit(7)).alias("g"), F.size("s").alias("n"))
    least = each.groupBy("h", "g", "n").agg(F.min("doc_id").alias("same_as"))
    return each.join(least, ["h", "g", "n"]).select("doc_id", "same_as")


def bucket_medians(rows: DataFrame, value: str, bucket: Column, buckets: int) -> DataFrame:
    """A row for each bucket, empty ones too: n, and the median cut to a whole number."""
    spark = rows.sparkSession
    have = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).cast("long").alias("median"))
    return spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(have, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "median")


def verdict(buckets: DataFrame, min_n: int = 8, min_buckets: int = 2, worst: float = -0.02) -> DataFrame:
    """advance, kill or inconclusive from (bucket, n, delta, fraction) rows.

    Buckets with min_n examples can be read; two of them are needed; the worst loss must stay above
    `worst` and the longest history's fraction must not exceed the shortest's.
    """
    by = buckets.where(F.col("n") >= min_n).agg(F.count(F.lit(1)).alias("readable"), F.min("delta").alias("worst"), F.min_by("fraction", "bucket").alias("first"), F.max_by("fraction", "bucket").alias("last"))
    ok = (F.col("worst") >= worst) & (F.col("last") <= F.col("first") + 1e-9)
    return by.select("readable", F.when(F.col("readable") < min_buckets, "inconclusive").when(ok, "advance").otherwise("kill").alias("verdict"))


def gate(policies: DataFrame, candidate: str = "ephemeral", baselines: tuple = ("full_kv_move", "sticky_saturated", "strict_sticky")) -> DataFrame:
    """A row per regime: the strongest baseline by goodput, the ratio to it and the cut in p99."""
    order = F.when(F.lit(False), 0)
    for i, name in enumerate(baselines):
        order = order.when(F.col("policy") == name, i)
    base = policies.where(F.col("policy").isin(*baselines)).groupBy("regime").agg(F.min_by(F.struct("policy", "goodput", "p99"), F.struct(-F.col("goodput"), order)).alias("b"))
    own = policies.where(F.col("policy") == candidate).select("regime", F.col("goodput").alias("g"), F.col("p99").alias("p"))
    ratio = F.when(F.col("b.goodput") > 0, F.col("g") / F.col("b.goodput")).when(F.col("g") > 0, float("inf"))
    cut = F.when(F.col("b.p99") > 0, 1 - F.col("p") / F.col("b.p99"))
    out = own.join(base, "regime").select("regime", F.col("b.policy").alias("baseline"), ratio.alias("ratio"), cut.alias("p99_cut"))
    return out.withColumn("verdict", F.when((F.coalesce("ratio", F.lit(0.0)) >= 1.5) | (F.coalesce("p99_cut", F.lit(0.0)) >= 0.3), "advance").otherwise("kill"))


def paired(left: DataFrame, right: DataFrame, key: str = "instance_id", value: str = "f1", position: str = "position") -> DataFrame:
    """(key, a, b, delta): inner join on the key; of repeated keys the last position counts."""
    last = lambda d, name: d.groupBy(key).agg(F.max_by(value, position).alias(name))
    return last(left, "a").join(last(right, "b"), key).withColumn("delta", F.col("b") - F.col("a"))


def bootstrap(groups: DataFrame, key: list[str], value: str = "delta", resamples: int = 20_000, seed: int = 0) -> DataFrame:
    """Mean, 95% interval, wins and losses per group, resampling by Python's Mersenne Twister.

    Bounds are the sorted means at int(.025 R) and int(.975 R) - 1. Values are taken in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["_o"])[value].dropna().tolist()
        rng, n = random.Random(seed), len(x)
        means = sorted(sum(x[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples)) if n else []
        lo, hi = (means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]) if n else (None, None)
        return pd.DataFrame([[*pdf[key].iloc[0], n, sum(x) / n if n else None, lo, hi, sum(v > 0 for v in x), sum(v < 0 for v in x)]], columns=[*key, "n", "mean", "lo", "hi", "wins", "losses"])

    fields = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in key), "n long, mean double, lo double, hi double, wins long, losses long"])
    return groups.select(*key, value, F.col("_o") if "_o" in groups.columns else F.lit(0).alias("_o")).groupBy(*key).applyInPandas(run, schema)


#: Distinct values of a group that one task draws from.
CHUNK = 50_000


def bootstrap_counts(groups: DataFrame, key: list[str], value: str = "delta", resamples: int = 20_000, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """What `bootstrap` gives, over groups of any size: the same distribution from another generator.

    A resample is a multinomial draw of how often each distinct value is taken. It is split exactly:
    first how many of the n draws fall to each chunk of distinct values, which every task of a group
    draws alike, then the draws within the chunk. Sums over chunks are added per resample.
    """
    x, near = F.col("_v"), lambda d: [F.col(k).eqNullSafe(d[f"_{i}"]) for i, k in enumerate(key)]
    counts = groups.select(*key, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).groupBy(*key, "_v").agg(F.count("_v").alias("_c"))
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(key)]
    facts = counts.groupBy(*key).agg(F.sum("_c").alias("n"), F.sum(x * F.col("_c")).alias("s"), F.sum(F.when(x > 0, F.col("_c")).otherwise(0)).alias("wins"), F.sum(F.when(x < 0, F.col("_c")).otherwise(0)).alias("losses"), F.count("_v").alias("d"))
    kinds = facts.select(*named, "d")
    cut = counts.where("_v is not null").join(kinds, near(kinds)).withColumn("_at", F.pmod(F.xxhash64("_v"), F.ceil(F.col("d") / chunk).cast("long")))
    parts = cut.groupBy(*key, "_at").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_x"), F.sum("_c").alias("_n"))
    shares = cut.groupBy(*named, "_at").agg(F.sum("_c").alias("_n")).groupBy(*[f"_{i}" for i in range(len(key))]).agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_all"))
    ready = parts.join(shares, near(shares)).select(*key, "_at", F.xxhash64(*key).alias("_k"), F.col("_x._v").alias("_v"), F.col("_x._c").alias("_c"), F.col("_all._at").alias("_ats"), F.col("_all._n").alias("_ns"))
    # Rows are dealt apart again: the drawing takes the time, not the rows' size.
    ready = ready.repartition(F.xxhash64(*key, "_at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                r = pdf.iloc[i]
                sums = chunk_sums(np.array(r["_v"]), np.array(r["_c"]), np.array(r["_ns"]), list(r["_ats"]).index(r["_at"]), resamples, [seed, int(r["_k"]) % 2**64])
                yield pd.DataFrame([[*r[key], sums]], columns=[*key, "sums"])

    fields = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    sums = ready.mapInPandas(run, ", ".join([*(f"{k} {fields[k]}" for k in key), "sums array<double>"]))
    means = sums.select(*key, F.posexplode("sums").alias("_r", "_s")).groupBy(*key, "_r").agg(F.sum("_s").alias("_s"))
    drawn = means.groupBy(*named).agg(F.sort_array(F.collect_list("_s")).alias("_m"))
    at = lambda i: F.element_at("_m", F.lit(i + 1)) / F.col("n")
    out = facts.join(drawn, near(drawn), "left")
    return out.select(*key, "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), at(int(0.025 * resamples)).alias("lo"), at(int(0.975 * resamples) - 1).alias("hi"), "wins", "losses")


def chunk_sums(values: np.ndarray, counts: np.ndarray, chunks: np.ndarray, own: int, resamples: int, seed: list[int]) -> np.ndarray:
    """Of each resample, the sum of its draws that fall to one chunk; `chunks` has the rows of all of them."""
    n, total = int(chunks.sum()), int(counts.sum())
    took = np.random.default_rng(seed).multinomial(n, chunks / n, size=resamples)[:, own]
    rng, out = np.random.default_rng([*seed, own + 1]), np.empty(resamples)
    if total > 4 * len(values):
        step = max(1, 2_000_000 // len(values))
        for at in range(0, resamples, step):
            out[at : at + step] = rng.multinomial(took[at : at + step], counts / total) @ values
        return out
    rows = np.repeat(values, counts)
    for i, m in enumerate(took):
        out[i] = rows[rng.integers(0, total, m)].sum()
    return out


def ranked_by_cost(rows: DataFrame, cost: str, ordinal: str, by: list[str]) -> DataFrame:
    """rows with `rank` from 0, ties in input order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(cost, ordinal)) - 1)


def exact_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, int]], accuracy: int = 10_000) -> DataFrame:
    """by, n, and for each name with (q, d) the value at rank floor(q n) + d (from 1, inside 1 to n); nulls are no values.

    Approximate quantiles bound each rank's value from both sides; only the values between the
    bounds, a few times n / accuracy, are counted and summed in order. Where n is small all are.
    So no group is one array, and none is sorted whole.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    held = rows.where(F.col(value).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(by, keys)], F.col(value).alias("_v"))
    eps, qs = 2.0 / accuracy, [q for q, _ in ranks.values()]
    near = F.array(*[F.lit(min(1.0, max(0.0, q + s))) for q in qs for s in (-eps, eps)])
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", near, accuracy).alias("_q"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few, bounds = F.col("n") <= 10 * accuracy, []
    for i, (name, (q, d)) in enumerate(ranks.items()):
        at = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * q) + d)).cast("long")
        lo, hi = F.when(few, F.col("_lo")).otherwise(F.get("_q", 2 * i)), F.when(few, F.col("_hi")).otherwise(F.get("_q", 2 * i + 1))
        bounds.append(F.struct(F.lit(name).alias("name"), at.alias("at"), lo.alias("lo"), hi.alias("hi")))
    wanted = sizes.select(*keys, F.explode(F.array(*bounds)).alias("w")).select(*[F.col(k).alias(f"{k}_") for k in keys], "w.*")
    met = held.join(wanted, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]) if keys else held.crossJoin(F.broadcast(wanted))
    # One pass: how many lie below the bounds, and how often each value between them occurs.
    spot = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
    counted = met.where(F.col("_v") <= F.col("hi")).groupBy(*keys, "name", "at", spot.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy(*keys, "name").orderBy(F.col("_v").asc_nulls_first()))
    found = counted.withColumn("_to", running).where(F.col("_v").isNotNull() & (F.col("_to") >= F.col("at")))
    wide = found.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    out = sizes.select(*keys, "n").join(wide.select(*[F.col(k).alias(f"{k}_") for k in keys], *ranks), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]) if keys else sizes.select("n").crossJoin(wide)
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "n", *ranks)


def latency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank 50th, 95th and 99th percentiles, the truncated-rank 95th, and the least, by group; n counts all rows."""
    ranks = {f"p{int(q * 100)}": (q, 1) for q in (0.5, 0.95, 0.99)} | {"p95_truncated": (0.95, 0)}
    got = exact_ranks(rows, by, value, ranks).drop("n").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
    every = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"))
    return every.join(got, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], "left").select(*by, "n", *ranks, "least")
