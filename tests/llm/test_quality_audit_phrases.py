"""Positive-unlabelled quality, source divergence and collocations: brute force, known laws, held-out accuracy, odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import collocations, divergence, mph, pu

WORDS = re.compile(r"[^\x20\x09]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- minimal perfect hash


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_mph_is_minimal_and_refuses_strangers(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
    table = mph.build(keys)
    slots = table.find(keys, mph.hashes(keys))
    assert sorted(slots) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    others = np.setdiff1d(rnd.integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert (table.find(others, mph.hashes(others)) == -1).all()
    wide = np.stack([keys, keys[::-1], keys, keys], 1)
    assert sorted(mph.build(wide).find(wide, mph.hashes(wide))) == list(range(len(keys)))


def test_word_keys_tell_words_apart():
    words = [b"a", b"b", b"aa", b"abcdefg", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop", b"abcdefghijklmnopq", b"abcdefgh" * 4, b"abcdefgh" * 3 + b"abcdefgx", "é".encode()]
    keys = collocations.listed(words * 2, ["en"] * len(words) + [None] * len(words))
    assert len({k.tobytes() for k in keys}) == 2 * len(words)
    assert (collocations.listed([b"und"], ["und"]) == collocations.listed([b"und"], [None])).all()


# --- collocations


def brute(rows, least, longest, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = WORDS.findall(piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in counts.items():
        some = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, i] = (p.decode(), -a, l, r, n[lang], -s)
    return out


def phrase_rows():
    rnd = random.Random(2)
    stock = ["a", "b", "c", "éé", "Long" * 6, "x-1", "ab\x00c", "the", "of"]
    phrases = ["new york city", "of the", "as soon as possible", "a b a b a"]
    rows = [(None, None), ("en", None), ("en", ""), (None, " \t\n"), ("", "a b a b a b"), ("und", "a b, a b"), ("xx", "a b!a b?a\tb\x0ba b")]
    for _ in range(150):
        words = []
        for _ in range(rnd.randrange(1, 40)):
            words.append(rnd.choice(phrases) if rnd.random() < 0.2 else rnd.choice(stock))
            if rnd.random() < 0.1:
                words[-1] += rnd.choice([".", ",", "\n", "; ", "\r\n"])
        text = " ".join(words)
        rows.append((rnd.choice(["en", "en", "fr", None]), text.upper() if rnd.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 5, 2000), (2, 3, 7), (40, 5, 3)])
def test_collocations_against_brute_force(spark, least, longest, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, slot int, word string").repartition(5)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(df, least, longest, top).collect()}
    assert got == brute(rows, least, longest, top) and got


def test_collocations_in_small_pieces(spark, monkeypatch):
    """The ways that large inputs take: many bundles, flushes, stretches of one text, sparse counts."""
    for name, value in (("SOME", 64), ("ENTRIES", 5), ("BUNDLE", 1), ("HELD", 1)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.stretches, "__defaults__", (64,))
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(df, 10, 4, 50).collect()}
    assert got == brute(rows, 10, 4, 50)


def test_collocations_of_long_texts_and_nothing(spark):
    long = "one two three four five six seven " * 60_000
    rows = [("en", long), ("en", "x" * 3_000_000 + " one two"), ("en", "," * 100_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(df, 100, 5, 20).collect()}
    assert got == brute(rows, 100, 5, 20)
    for some in (df.filter("false"), df.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"))):
        assert collocations.mine(some).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations.mine(some).count() == 0


# --- divergence


def audit_rows():
    rnd = random.Random(6)
    stock = ["alpha", "Beta", "gamma", "été", "Ünder", "x1y", "don't", "日本"]
    rows = [(None, None, None), ("en", "empty", None), ("en", "empty", "12 34"), (None, "s", "solo"), ("yy", "a", ""), ("yy", "b", None)]
    for i in range(220):
        weights = [1 + (i % 4 == k % 4) * 3 for k in range(len(stock))]
        rows.append((rnd.choice(["en", "fr"]), f"s{i % 4}" if i % 9 else None, " ".join(rnd.choices(stock, weights, k=rnd.randrange(30)))))
    return rows + rows[30:40]


def test_audit_against_sql_and_arithmetic(spark):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, count int, term string").repartition(4)
    got = sorted(map(tuple, divergence.audit(df).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in con.sql(divergence.AUDIT_SQL).to_arrow_table().to_pylist())
    assert got == want
    # by hand
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    pairs = {}
    for lang, a in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= 10)
        share = lambda s: [1 + 10**9 * (counts[lang, s][t] + 2) // (sum(counts[lang, s][u] for u in kept) + 2 * len(kept)) for t in kept]  # noqa: B023, E731
        for other, b in groups:
            if other == lang and a != b:
                pairs[lang, a, b] = sum((p - q) ** 2 // (p + q) for p, q in zip(share(a), share(b), strict=True))
    assert {(r[0], r[1], r[3]): r[4] for r in got if r[2] == "pair"} == pairs
    assert ("yy", "a", "b") in pairs and pairs["yy", "a", "b"] == 0
    assert divergence.audit(df.filter("false")).count() == 0


# --- positive-unlabelled learning


def test_prior_of_a_known_mixture():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        positive = rnd.normal(2, 1, 4000)
        unlabelled = np.where(rnd.random(6000) < share, rnd.normal(2, 1, 6000), rnd.normal(-3, 1, 6000))
        assert abs(pu.estimate_prior(positive, unlabelled) - share) < 0.08


def test_risk_stays_non_negative_and_separates():
    rnd = np.random.default_rng(2)
    n, good = 900, rnd.random(900) < 0.7
    positive = np.arange(n) < 300
    good[:300] = True
    dense = np.where(good, 1.0, -1.0)[:, None] * 1.5 + rnd.normal(0, 0.5, (n, 2))
    sample = pu.Sample([np.zeros(0, np.uint16)] * n, [np.zeros(0, np.float32)] * n, dense, positive)
    w = pu.fit(sample, 0.7)
    assert ((sample.scores(*w) > 0) == good).mean() > 0.97


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in pu.score_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = (np.array([s for q, s in held if q == v]) for v in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97 and (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.8


def test_labels_of_the_held_out_fold_and_zeros_are_never_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).when(F.col("quality") == 0, None).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in pu.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_of_odd_rows(spark):
    long = "word " * 400_000
    rows = [(None, "some text"), (5, "some text"), (5, None), (7, ""), (8, long), (8, long), (9, "#" * 2000), (10, "é\x00 \n")]
    rows += [(100 + i, f"plain words number {i} and so on") for i in range(40)]
    docs = spark.createDataFrame([(*r, 0.1, True) for r in rows], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    got = pu.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert by[None] <= by[5] and by[7] <= by[5]  # equal texts score alike whatever their ids; null as empty
    none = pu.score_quality(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert pu.score_quality(docs.filter("false"), labels).count() == 0


# --- toxicity: equal texts


def test_equal_texts_score_alike_whatever_their_ids(spark):
    from parcelspark.llm import toxicity

    rnd = random.Random(3)
    word = lambda: rnd.choice("one two three four five six seven eight".split())
    rows = [(i, " ".join(word() for _ in range(30)) + (" nasty nasty" if i % 3 == 0 else "")) for i in range(90)]
    rows += [(1000 + i, rows[i][1]) for i in range(90)] + [(None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = defaultdict(set)
    for r in toxicity.score_toxicity(docs, labels).collect():
        got[dict(rows)[r.doc_id]].add(r.score)
        assert all(e.cosine < 1 - 1e-12 or dict(rows)[e.doc_id] != dict(rows)[r.doc_id] for e in r.evidence)
    assert all(len(scores) == 1 for scores in got.values())


# --- nearest neighbours with production leaves


def test_recall_over_many_leaves_of_production_size(spark):
    from parcelspark.llm import ann
    from parcelspark.llm.common import materialise

    rnd = np.random.default_rng(11)
    n, dims = 45_000, 24
    x = (rnd.normal(size=(300, dims))[rnd.integers(0, 300, n)] * 2 + rnd.normal(size=(n, dims))).astype(np.float32)
    assert ann.Tree(x[: ann.SAMPLE].astype(float), n // ann.LEAF_ROWS).leaves > 30
    table = materialise(spark.range(n).withColumn("part", F.col("id") % 8).repartition(8, "part").mapInPandas(lambda frames: (f[["id"]].assign(embedding=[v.tolist() for v in x[f["id"]]]) for f in frames), "id long, embedding array<float>").withColumnRenamed("id", "vec_id"), "vectors")
    got = defaultdict(list)
    for r in ann.nearest(table, "vec_id % 20 = 0", 20).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").toArrow().to_pylist():
        got[r["query_id"]].append(r["vec_id"])
    queries = np.arange(0, n, 20)
    assert set(got) == set(queries.tolist()) and all(len(v) == 20 for v in got.values())
    hits = 0
    for part in np.array_split(queries, 30):
        s = x[part].astype(float) @ x.T.astype(float)
        s[np.arange(len(part)), part] = -np.inf
        best = np.argpartition(-s, 20, axis=1)[:, :20]
        hits += sum(len(set(b.tolist()) & set(got[q])) for q, b in zip(part.tolist(), best, strict=True))
    recall = hits / (20 * len(queries))
    print(f"recall {recall:.4f}")
    assert recall >= 0.9
