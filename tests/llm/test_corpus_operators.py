"""Operators against brute force on small tables, with nulls, empty and long texts, ties and copies."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import ann, bpe, common, jaccard, langid, lm, packing, pii, quality, shards, tokens, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6)))
    texts = [None, "", " \n\t ", "one two", "ONE two", "é", "x" * 3000, "a b c d e", "a b c d e"]
    for _ in range(40):
        base = [word() for _ in range(rnd.choice([4, 6, 30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append("\n".join([" ".join(copy), " ".join(copy[:3])]))
    texts.append(" ".join(word() for _ in range(30_000)))
    return [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = common.scratch_path(spark, "docs")
    df.write.parquet(path)
    return spark.read.parquet(path).withColumn("size", F.lit(1)).withColumn("comp", F.lit(2))


def test_quality_counts(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert got[i].base_failed == (len(w) < 50 or 2 * len(covered) > len(w))


def test_jaccard_components(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall(lower(t or ""))
        sets[i] = set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(None, a), (3, a), (3, b), (5, b), (None, "z"), (None, None), (9, None), (9, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted([(None, 4, 3), (3, 4, 3), (3, 4, 3), (5, 4, 3), (None, 1, None), (None, 0, None), (9, 0, 9), (9, 0, 9)], key=key)


def test_jaccard_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rnd = random.Random(5)
    base = [str(rnd.random()) for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(120)] = str(rnd.random())
        rows.append((i, " ".join(copy)))
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)))) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


@pytest.mark.parametrize(("order", "min_count"), [(2, 1), (3, 1), (2, 2), (3, 2)])
def test_lm_scores(docs, rows, order, min_count, spark):
    rows = [*rows, (None, "one two three", None, None, None), (7, "one two", None, None, None), (7, "again é", None, None, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows[-3:]], "doc_id long, text string"))
    path = common.scratch_path(spark, "lm")
    table.write.parquet(path)
    counts = Counter()
    for _, t, *_ in rows:
        w = WORDS.findall(lower(t or ""))
        for n in range(1, order + 1):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= min_count else math.log(0.4) + log_s(gram[1:])

    want = []
    for i, t, *_ in rows:
        w = WORDS.findall(lower(t or ""))
        want.append((i, len(w), round(sum(log_s(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))), 6) if w else None))
    got = [(r.doc_id, r.n_tokens, None if r.log_score is None else round(r.log_score, 6)) for r in lm.score_documents(spark.read.parquet(path), order, min_count=min_count, buckets=3).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert [r[:2] for r in sorted(got, key=key)] == [r[:2] for r in sorted(want, key=key)]
    assert all(math.isclose(a[2] or 0, b[2] or 0, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(sorted(got, key=key), sorted(want, key=key)))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_documents(docs, TOKENIZER, 256, 1).collect()
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in rows}
    for r in got:
        part = np.array(ids[r.doc_id][r.piece * 256 : r.piece * 256 + 256], "<u4")
        assert (r.start, r.length, r.ids_crc32) == (r.piece * 256, len(part), zlib.crc32(part.tobytes()))
    assert len(got) == sum(-(-len(x) // 256) for x in ids.values())
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 256
    assert len(bins) <= packing.lower_bound(np.bincount([r.length for r in got], minlength=257), 256) + 1


def test_lower_bound_never_exceeds_a_packing():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x = rnd.integers(1, 60, rnd.integers(1, 40))
        assert packing.lower_bound(np.bincount(x, minlength=61), 60) <= packing.best_fit_decreasing(x, 60).max() + 1


def test_chunk_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    tk, enc, rnd = Tokenizer.from_file(TOKENIZER), tokens.ChunkEncoder(TOKENIZER), random.Random(1)
    parts = ["a", "B1", "É", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x01", "\x1c", "\x85", "'s", "二", "!", "Σ", "́", "\x00"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    flat, counts = enc.encode([t.encode() for t in odd])
    at = 0
    for t, n in zip(odd, counts, strict=True):
        assert flat[at : at + n].tolist() == tk.encode(t, add_special_tokens=False).ids
        at += n


def test_byte_bpe_round_trip(docs, rows):
    enc = bpe.encoding(RANKS, P.PATTERN)
    got = {r.doc_id: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), bpe.sha256_hex(ids.tobytes()), bpe.sha256_hex((t or "").encode()))
    long = "word 12 's  é\n" * 4000
    assert bpe.encode(long, enc, 100).tolist() == enc.encode_ordinary(long)


def test_pii(spark):
    texts = ["card 4539 1488 0343 6467, not 4539 1488 0343 6468", "a.b+c@mail.example.com!", "1999-12-31 or 31/12/1999, never 1999-02-30", "+1 (017) 555-7713 and 10.20.30.40 and 999.1.1.1", "GB82 WEST 1234 5698 7654 32", "", None, "no data"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit("clash"))
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    kinds = {i: [x.kind for x in got[i].pii or []] for i in got}
    assert kinds == {0: ["card"], 1: ["email"], 2: ["date", "date"], 3: ["phone", "ipv4"], 4: ["iban"], 5: [], 6: [], 7: []}
    card = re.sub(r"\D", "", got[0].pii[0].value)
    assert sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(card))) % 10 == 0
    assert "4539 1488 0343 6468" in got[0].text and "1999-02-30" in got[2].text and "999.1.1.1" in got[3].text
    iban = got[4].pii[0].value.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    d, e = (x.value for x in got[2].pii)
    assert d == "-".join(reversed(e.split("/"))) and got[6].text is None and got[7].text == "no data"


def test_feistel_is_a_permutation(spark):
    df = spark.range(600).select(pii.feistel(F.col("id"), F.lit(20).cast("long"), F.lit(30).cast("long"), "k", F.lit("t")).alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(600))
    for n in (1, 2, 7, 100, 1025):
        assert sorted(shards.slots(np.arange(n), n, "k").tolist()) == list(range(n))


def test_shards_read_back(docs, rows, spark):
    out = common.scratch_path(spark, "shards")
    got = shards.materialise_training_order(docs, out, RANKS, P.PATTERN, "k", length=64, per_shard=50).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    read = shards.read_slots(spark, out, 0, len(got) + 5, 64, 50)
    assert len(read) == len(got)
    assert all(zlib.crc32(read[r.slot].tobytes()) == r.crc32 and r.shard == r.slot // 50 for r in got)
    enc = bpe.encoding(RANKS, P.PATTERN)
    want = Counter(x for _, t, *_ in rows for x in [*enc.encode_ordinary(t or ""), 50256])
    have = Counter(np.concatenate(read).tolist())
    want[50256] = have[50256] = 0
    assert want == have


def test_neighbours(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits, y = 0, x.astype(float)
    for q in range(0, 400, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(400), -np.round(s, 9)))[:5].tolist()) & set(got[q]))
    assert set(got) == set(range(0, 400, 20)) and hits >= 90


def test_neighbours_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK", 10)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(60, 12)) * 3
    x = centres[rnd.integers(0, 60, 3000)] + rnd.normal(size=(3000, 12))
    x[100:1100] = x[100]  # one vector, a thousand times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.Tree(x, 3000 // 16).leaves > 100
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        s = np.zeros(3000)
        for d in range(12):
            s += x[:, d] * x[q, d]
        s[q] = -np.inf
        assert len(got[q]) == 20 and all(y == s[i] for i, y in got[q]) and [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-s[i], i))
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20].tolist()) & {i for i, _ in got[q]})
    assert len(got) == 150 and hits >= 0.9 * 150 * 20


def test_tree_goes_on_until_k_rows(spark):
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = ann.Tree(x, 250)
    sizes = dict(Counter(tree.file(x).tolist()))
    for q in x[:20]:
        assert sum(sizes.get(c, 0) for c in tree.visit(q, 1, sizes, 21)) >= 21
        assert sorted(tree.visit(q, 10**9)) == list(range(tree.leaves))


@pytest.mark.parametrize("run", [
    lambda d, l: jaccard.jaccard_components(d), lambda d, l: lm.score_documents(d), lambda d, l: packing.pack_documents(d, TOKENIZER), lambda d, l: bpe.digests(d, RANKS, P.PATTERN),
    lambda d, l: quality.quality(d, l), lambda d, l: toxicity.score_toxicity(d, l), lambda d, l: langid.detect_language(d), lambda d, l: pii.pseudonymise(d, "k"),
    lambda d, l: ann.nearest(d.selectExpr("doc_id AS vec_id", "array(CAST(n_chars AS double)) AS embedding"), "vec_id % 20 = 0"),
    lambda d, l: shards.materialise_training_order(d, common.scratch_path(d.sparkSession, "none"), RANKS, P.PATTERN, "k"),
])
def test_empty_tables(spark, run):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert run(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.detect_language(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.filter("lang = lang_pred").count() >= 0.95 * lang.count()
    tox = toxicity.score_toxicity(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic IS NOT NULL")
    assert tox.filter("toxic = predicted").count() >= 0.85 * tox.count()


def test_chunk_encoder_that_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    monkeypatch.setattr(tokens, "KEPT", 3)
    tk, enc, rnd = Tokenizer.from_file(TOKENIZER), tokens.ChunkEncoder(TOKENIZER), random.Random(4)
    for _ in range(50):
        t = " ".join("".join(rnd.choice("abcxyz") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(12)))
        assert enc.encode([t.encode()])[0].tolist() == tk.encode(t, add_special_tokens=False).ids
        assert len(enc.known) <= 20
    enc.shrink()
    assert len(enc.known) == 3


def test_toxicity_drops_verified_copies_only(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["north", "south", "east", "west"]) for _ in range(60)) for _ in range(12)]  # one word set, so equal bands
    texts += [texts[0], texts[0] + " north", "", "", "one two", "one two"]
    kept = []
    monkeypatch.setattr(toxicity, "without_copies", lambda seen, run=toxicity.without_copies: kept.extend(run(seen)) or kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toxicity.train(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert sorted(kept) == [*range(12), 14, 15, 16]


def test_toxicity_neighbours_are_exact_over_all_words(spark):
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.choice([3, 20, 60]))) for _ in range(400)]
    texts += [None, "", "rare"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index, a, c = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert "rare" in index.terms and set(index.terms) == {w for t in texts for w in toxicity.words(t)} and min(index.weight) > 0
    vectors = {int(i): dict(zip(*(x.tolist() for x in index.vector(Counter(toxicity.words(texts[i])))))) for i in index.ids}
    for t in ["a b abcd", "dcba dcba " + texts[5], *texts[20:60]]:
        v = dict(zip(*(x.tolist() for x in index.vector(Counter(toxicity.words(t))))))
        want = sorted(((-sum(w * u.get(k, 0) for k, w in v.items()), i) for i, u in vectors.items() if set(u) & set(v)))[:15]
        got = index.nearest(*index.vector(Counter(toxicity.words(t))), 15)
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-9)


def test_pii_of_neighbouring_values(spark):
    texts = {
        "+1 (826) 555-4081 190.137.223.204 end": ["phone", "ipv4"],
        "4539 1488 0343 6467 12/27": ["card"],
        "4539 1488 0343 6467 123": ["card"],
        "555-123-4567 555-987-6543": ["phone", "phone"],
        "030 1234567 2023-01-02": ["phone", "date"],
        "030 1234567 030 7654321": ["phone", "phone"],
        "030 1234567 4539 1488 0343 6467": ["phone", "card"],
        "4539 1488 0343 6468 and 1 2 3 4 5 6 7": [],
        "0.123 0.456 0.789 0.321 0.654 and 1 2 3 4 5 6 7 8 9 10 11 12 13 14": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r, (text, kinds) in zip(pii.pseudonymise(df, "k").orderBy("doc_id").collect(), texts.items(), strict=True):
        assert [x.kind for x in r.pii] == kinds, text
        assert re.sub("[0-9]+", "", r.text) == re.sub("[0-9]+", "", text) and (r.text == text) == (not kinds)


def test_pipeline_language_stage_rejects_junk(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(80)) for letters in ["qxzkjwvbcdfghpty", "абвгдежзиклмнопрст", "{}[]();=<>!#$%^&*_x"] for _ in range(10)]
    more = spark.createDataFrame([(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(more.select(*docs.columns))
    kept = corpus_pipeline.keep_known_languages(spark, every, "")
    assert kept.filter("source = 'junk'").count() <= 3
    whole = docs.filter("length(text) >= 200")
    assert kept.filter("doc_id < 1000000000").count() >= 0.95 * whole.count()


def test_packing_of_null_and_repeated_ids(spark):
    texts = [(None, "a b c"), (None, "a b c"), (None, None), (7, "one two " * 150), (7, "x"), (7, "x"), (8, "y z")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.pack_documents(df, TOKENIZER, 64, 1).collect()
    want = tokens.pieces(df, TOKENIZER, 64, 1).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64


@pytest.fixture(scope="module")
def odd(spark):
    """A table with nulls in any column, empty and long texts, repeated rows and columns that clash with the operators' own names."""
    rnd = random.Random(11)
    english = lambda n: " ".join(rnd.choice("the house of a small town was near that river and people went there with their horses every day".split()) for _ in range(n))
    base = [english(80) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(None, base[0], None, None, None), (3, base[3], "en", "s", 1), (3, "other text 555-123-4567", None, "s", 1), (20, None, "en", None, None), (21, "", "en", "s", 0), (22, " ", "fr", "s", 1), (23, english(60_000), "en", "s", 1), (24, "² ½ ① Ⅷ", "de", "s", 7), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "score", "row", "_found", "_new", "_text", "pii", "key", "part", "count", "label", "a.b"):
        df = df.withColumn(c, F.lit("clash"))
    path = common.scratch_path(spark, "odd")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_operators_keep_every_odd_row(spark, odd):
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 1), (23, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    ids = Counter(r.doc_id for r in odd.collect())
    for out in (jaccard.jaccard_components(odd), lm.score_documents(odd), bpe.digests(odd, RANKS, P.PATTERN), quality.quality(odd, labels), toxicity.score_toxicity(odd, labels), langid.detect_language(odd), pii.pseudonymise(odd, "k")):
        assert Counter(r.doc_id for r in out.collect()) == ids
    packed = packing.pack_documents(odd, TOKENIZER).filter("piece = 0").collect()
    assert Counter(r.doc_id for r in packed) == ids
    assert shards.materialise_training_order(odd, common.scratch_path(spark, "s"), RANKS, P.PATTERN, "k").count() > 0
    lang = {r.doc_id: r.lang_pred for r in langid.detect_language(odd).filter("doc_id >= 20").collect()}
    assert [lang[i] for i in (20, 21, 22, 24)] == ["und"] * 4 and lang[23] == "en"
    safe = pii.pseudonymise(odd, "k")
    assert safe.columns == [c for c in odd.columns if c != "pii"] + ["pii"] and safe.filter("_found = 'clash' AND `a.b` = 'clash' AND _text = 'clash'").count() == odd.count()
    assert safe.filter("text LIKE '%555-123-4567%'").isEmpty()


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.keep_known_languages(spark, odd, "")
    assert kept.columns == odd.columns and not kept.filter("text IS NULL OR trim(text) = '' OR doc_id = 24").count()
    clean = corpus_pipeline.drop_toxic(spark, odd, str(tmp_path))
    want = toxicity.score_toxicity(odd, labels).filter("predicted = 0")
    assert clean.columns == odd.columns and clean.count() == want.count()
    alone = corpus_pipeline.drop_near_duplicates(spark, odd, "")
    assert alone.columns == odd.columns and alone.count() == odd.count() - 2  # copies of rows 0 and 3
    safe = corpus_pipeline.pseudonymise(spark, odd, "")
    assert safe.columns == odd.columns and safe.count() == odd.count() and safe.filter("n_chars <> length(text)").isEmpty()
    assert corpus_pipeline.pack(spark, odd, "").filter("piece = 0").count() == odd.count()


def test_pipeline_stages_on_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    none = odd.filter("false")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_long_texts_are_scored_in_windows():
    docs = [b"one two three " * 100_000, b"", b"x" * 700_000, b"a b"]
    weights = np.random.default_rng(0).normal(size=(quality.GRAMS.size, 2))
    got = quality.GRAMS.project(docs, weights)
    for i, (index, value) in enumerate(quality.GRAMS.sparse(docs)):
        assert np.allclose(got[i], value @ weights[index], rtol=1e-4, atol=1e-4)
    counts = quality.base_counts([b"w%d\n" % (i % 1000) for i in range(3)] + [b"\n".join(b"line %d" % (i % 5000) for i in range(300_000))])
    assert counts["n_dup_lines"].tolist() == [0, 0, 0, 295_000] and counts["n_words"].tolist() == [1, 1, 1, 600_000]


def test_identifiers_stay_valid(spark):
    texts = ["123-45-6789", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "001-01-0001 and 899-99-9999"]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [[x.kind for x in r.pii] for r in got] == [["identifier"], [], [], [], [], [], ["identifier"] * 2]
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x.value) for r in got for x in r.pii)
