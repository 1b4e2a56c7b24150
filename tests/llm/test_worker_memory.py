"""What workers hold between tasks and at once."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from parcelspark.llm import collocations, common, mph, tokens, toxicity


def test_one_table_of_powers_for_all_sizes():
    common._all_powers.cache_clear()
    words = [b"w%d" % (i % 977) for i in range(400_000)]
    texts = [b" ".join(words[: 4**k]) for k in range(10)] + [b"x" * (common.WINDOW * 3) + b" w1"]
    hashes = [common.word_hashes([t])[0] for t in texts]
    assert common._all_powers.cache_info().currsize == 1
    assert sum(x.nbytes for x in common._all_powers(2 * common.WINDOW)) <= 8 << 20
    one = {w: common.word_hashes([w])[0][0] for w in set(words)}
    for k in range(10):
        assert hashes[k].tolist() == [one[w] for w in words[: 4**k]]
    assert hashes[-1][1] == one[b"w1"] and len(hashes[-1]) == 2


def test_pieces_give_the_tokenizer_up(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    want = sorted(map(tuple, tokens.pieces(docs, path, 4096, 1).collect()))
    assert sorted(map(tuple, tokens.pieces(docs.repartition(8), path, 4096, 1, keep=0).collect())) == want

    def seen(batches):
        from parcelspark.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.encoder.cache_info().currsize])], ["n"])

    tokens.pieces(docs.repartition(8), path, 4096, 1, keep=0).collect()
    assert max(r.n for r in spark.range(8).repartition(4).mapInArrow(seen, "n long").collect()) == 0


def test_parts_are_made_by_one_worker_a_core(spark):
    keys = spark.createDataFrame([(k % 2, np.arange(k, 9, dtype="<u8").tobytes()) for k in range(6)], "part int, data binary")
    built = collocations.build_parts(keys, collocations.distinct_keys, words=False)
    stage = built._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "InArrow" not in stage and "InPandas" not in stage  # nothing runs in Python after the last grouping
    import pickle

    got = {r.part: sorted(pickle.loads(r.table).keys.tolist()) for r in built.collect()}
    assert got == {0: list(range(9)), 1: list(range(1, 9))}
    assert isinstance(mph.build(np.arange(3, dtype="<u8")), mph.Mph)


def test_distinct_keys_fold(monkeypatch):
    monkeypatch.setattr(collocations, "SOME", 10)
    parts = [np.arange(i, i + 7, dtype="<u8").tobytes() for i in range(50)]
    assert np.frombuffer(collocations.distinct_keys(parts), "<u8").tolist() == list(range(56))
    assert collocations.distinct_keys([]) == b""


def test_batches_for_python_are_bounded(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    common.prepare(spark)
    try:
        rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        most = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert max(most) <= 2 * common.BATCH_BYTES and sum(most) >= 64 << 20
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_written_tables_leave_no_garbage_on_the_driver(spark):
    jvm = spark.sparkContext._jvm
    rows = spark.range(3)
    held = jvm.java.util.ArrayList()
    for _ in range(3):
        jvm.System.gc()  # among the old ones, which small collections pass over
    seen = jvm.java.lang.ref.WeakReference(held)
    del held
    common.trim()  # py4j lets go of it
    out = common.materialise(rows, "few")
    assert seen.get() is None
    assert out.count() == 3
    common.discard(out)


def test_chosen_ids_start_no_python_workers(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    some = toxicity.documents_of(rows, [3, 7, 99])
    assert "ExistingRDD" not in some._jdf.queryExecution().sparkPlan().toString()  # a list of rows is pickled by workers of its own
    assert sorted(r.doc_id for r in some.collect()) == [3, 7]
    assert toxicity.documents_of(rows, []).collect() == []


def test_index_holds_each_weight_once():
    rnd = np.random.default_rng(5)
    rows = [(np.flatnonzero(rnd.random(300) < np.where(np.arange(300) < 20, 0.5, 0.02)), None) for _ in range(200)]
    rows = [(t.astype(np.int32), rnd.integers(1, 4, len(t))) for t, _ in rows]
    weight = rnd.random(300) + 0.1
    index = toxicity.BlockMaxIndex(list(range(200)), list(range(200)), rows, [0, 1] * 100, {str(i): i for i in range(300)}, weight)
    postings = sum(len(t) for t, _ in rows)
    assert len(index.dense) >= 20 and np.count_nonzero(index.dense) + len(index.value) == postings
    full = np.zeros((200, 300))
    for i, (t, n) in enumerate(rows):
        full[i, t] = index.weigh(t, n)[1]
    for own, r in enumerate(rows[:40]):
        near = index.nearest(*index.weigh(*r), 5, own)
        want = full @ full[own]
        want[own] = 0
        assert np.allclose([s for s, _ in near], np.sort(want)[::-1][:5]) and all(np.isclose(want[index.ids[at]], s) for s, at in near)


def test_pipeline_sends_few_rows_to_python_at_once(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            common.prepare(spark)
            docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
            stage(spark, docs, "")
            assert int(spark.conf.get(size)) <= 250
    finally:
        spark.conf.set(size, before)
