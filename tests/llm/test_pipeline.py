"""The pipeline on a small table, stage by stage against brute force."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter

import corpus_pipeline
from sessionloom.llm import bpe, minhash, mixing

KINDS = {"de": "der die das und nicht schön für ist ein auf", "en": "the of and to in that with is was for", "fr": "le la les et être qui dans une est pour"}


def documents():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(KINDS))
        text = " ".join(rng.choice(KINDS[lang].split()) + str(rng.randrange(50) if rng.random() < 0.5 else "") for _ in range(rng.randrange(30, 120)))
        rows.append((i, text, lang, f"src{rng.choice((0, 0, 0, 1, 2))}", len(text)))
    for i in range(240, 280):  # exact copies but for white space
        _, text, lang, source, n = rows[rng.randrange(200)]
        rows.append((i, text.replace(" ", "  ", 1), lang, source, n))
    for i in range(280, 320):  # near copies: one word in about a hundred
        _, text, lang, source, n = rows[rng.randrange(200)]
        w = text.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), lang, source, n))
    return rows + [(400, None, "en", "src0", 0), (401, "12 34 --", None, None, None), (402, "", "fr", "src1", 0)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_against_brute_force(spark, tmp_path):
    import tiktoken

    rows = documents()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r[0]: r for r in rows if r[0] < 400}
    assert {r["doc_id"] for r in seen[0]} == set(clean)
    first = {}
    for i in sorted(clean):
        first.setdefault(norm(clean[i][1]), i)
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(first.values())
    left = sorted(first.values())
    comp = {i: i for i in left}
    sets = {i: shingles(clean[i][1]) for i in left}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    assert sorted(r["doc_id"] for r in seen[2]) == sorted(i for i in left if root(i) == i)
    sizes, times = Counter(), Counter(r["doc_id"] for r in seen[3])
    for r in seen[2]:
        sizes[r["source"]] += len(r["text"].split())
    target = mixing.shared_targets(dict(sizes), mixing.cycled_weights(list(sizes)), sum(sizes.values()), 3.0)
    taken = Counter()
    for i, n in times.items():
        assert 1 <= n <= 3
        taken[clean[i][3]] += n * len(clean[i][1].split())
    assert all(abs(taken[s] - target[s]) <= 130 for s in sizes)
    path, pattern = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r["doc_id"] for r in seen[4]) == times
    for r in seen[4]:
        assert r["ids"] == library.encode_ordinary(clean[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"])


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    """Null ids and sources, repeated rows, a very long text, clashing extra columns; and no rows at all."""
    rng = random.Random(2)
    long_ = " ".join(f"{rng.choice(KINDS['en'].split())}{rng.randrange(900)}" for _ in range(30_000))
    said = [" ".join(rng.choices(KINDS[k].split(), k=40)) for k in ("de", "en", "fr") for _ in range(20)]
    rows = [(i, t, ("de", "en", "fr")[i // 20], f"s{i % 3}", 1) for i, t in enumerate(said)]
    rows += [(None, "own words of no id one two three", "en", None, None), (None, "other words of no id four five six", None, None, None)]
    rows += [(70, long_, "en", "s0", 1), (71, long_ + " tail", None, "s1", 1), (72, said[0], "de", "s0", 2), (72, said[0], "de", "s0", 2), (73, None, None, None, None), (74, "", "en", "s0", 0)]
    extra = {c: "x" for c in ("k0", "t", "id", "ids", "n_tokens", "node", "norm", "row", "copies", "times", "lang_pred", "_score", "_gone", "_i", "_p")}
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("odd", rows), ("none", [])):
        d = tmp_path / name
        docs = spark.createDataFrame(part, columns)
        docs.withColumns({k: spark_lit(v) for k, v in extra.items()}).write.parquet(str(d / "documents.parquet"))
        docs, seen = spark.read.parquet(str(d / "documents.parquet")), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(d)).write.parquet(str(d / f"out{k}"))
            docs = spark.read.parquet(str(d / f"out{k}"))
            seen.append(docs.collect())
            assert k == 4 or docs.columns == [*columns.replace(" long", "").replace(" string", "").split(", "), *extra]
        if name == "none":
            assert seen == [[]] * 5
            continue
        assert Counter(r["doc_id"] for r in seen[0]) == Counter(r[0] for r in rows if r[0] not in (73, 74))
        assert Counter(r["doc_id"] for r in seen[1]) == Counter([*range(60), None, None, 70, 71])
        ids = [r["doc_id"] for r in seen[2]]
        assert ids.count(None) == 2 and 70 in ids and 71 not in ids
        copies = Counter((r["doc_id"], r["text"]) for r in seen[3])
        assert set(copies) <= {(r["doc_id"], r["text"]) for r in seen[2]} and max(copies.values()) <= 3
        assert Counter(r["doc_id"] for r in seen[4]) == Counter(r["doc_id"] for r in seen[3])


def test_near_dedup_does_not_exchange_texts_for_sets(spark, tmp_path, monkeypatch):
    """Beyond the rows that are sent, the texts of a few wanted sets do not take all texts through an exchange."""
    monkeypatch.setattr(minhash, "SENT", 0)
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.randrange(10**9):x}" for _ in range(1500)), None, None, None) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " tail", None, None, None) for i in range(5)]
    d = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d)
    written = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in stages()}

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    before = set(written())
    kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(d), str(tmp_path)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(400))
    assert sum(n for k, n in written().items() if k not in before) < 0.5 * sum(len(r[1]) for r in rows)


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
