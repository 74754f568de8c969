"""The stage that drops near-duplicates works by row."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pagemill.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, number long"
A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue violet brown black white grey pink gold"


def left(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_the_only_copy_of_a_text_under_a_shared_id_stays(spark):
    assert left(spark, [(1, A), (2, A), (2, B)]) == [(1, A), (2, B)]


def test_repeated_and_odd_rows(spark):
    rows = [(3, A), (3, A), (4, None), (5, ""), (None, A), (None, None), (7, B), (8, B + " end")]
    want = [(3, A), (4, None), (5, ""), (7, B), (None, A), (None, None)]
    assert left(spark, rows) == sorted(want, key=str)


def test_an_empty_table(spark):
    assert left(spark, []) == []


def test_secrets_and_decoding_go_out_in_parts(monkeypatch, spark):
    # A task held the masked texts, or the decoded ones, of a whole batch before any row went out.
    from pagemill.llm import pieces, secret_scan

    made = {}
    for module in (secret_scan, pieces):
        monkeypatch.setattr(module, "map_batches", lambda df, schema, make, m=module: made.setdefault(m, (df, make)))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    secret_scan.scan_secrets(docs, ["doc_id"], redact=True)
    long = "some words " * 40_000
    texts = [long, None, "token=" + "Ab3" * 5, long, long, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "__text": texts})
    parts = list(made[secret_scan][1]()(batch))
    assert len(parts) > 1
    assert [t for p in parts for t in p["text_masked"].to_pylist()] == [*texts[:2], "[assign]", *texts[3:]]

    vocabulary = pieces.Vocabulary.load(corpus_pipeline.PIECES)
    pieces.decode(docs, vocabulary, block_ids=4)
    ids = [[vocabulary.pieces.index("a")] * n for n in (3, 0, 5, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], names=["token_ids"])
    parts = list(made[pieces][1]()(batch))
    assert len(parts) > 1
    assert [t for p in parts for t in p["decoded"].to_pylist()] == ["aaa", "", "aaaaa", "aa", None]


def test_an_encoder_ends_with_its_task(monkeypatch, spark):
    # Workers kept the segments that an encoder remembers while they ran tasks of other stages.
    from pagemill.llm import pieces

    made = []
    monkeypatch.setattr(pieces, "map_batches", lambda df, schema, make: made.append(make))
    pieces.encode(spark.createDataFrame([("x",)], "text string"), pieces.Vocabulary.load(corpus_pipeline.PIECES))
    before = len([x for x in gc.get_objects() if isinstance(x, pieces.Encoder)])
    one = made[0]()
    assert len(list(one(pa.RecordBatch.from_pydict({"text": ["some words", None]})))) == 1
    del one
    gc.collect()
    assert len([x for x in gc.get_objects() if isinstance(x, pieces.Encoder)]) == before


def test_the_mix_reaches_the_tokens(spark):
    # The order of the mix ended at the files of its stage; tokens had neither place nor surplus mark.
    rows = [(i, f"word {i}", "en", "big" if i % 3 else f"s{i % 4}", 6) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    places = {r.doc_id: (r.mix_slot, r.mixed) for r in mixed}
    assert [r.mix_slot for r in mixed] == sorted(r.mix_slot for r in mixed) and len({r.mix_slot for r in mixed}) == 120
    assert {r.mixed for r in mixed} == {True, False}
    shuffled = spark.createDataFrame(mixed).repartition(5, "doc_id")
    tokens = corpus_pipeline.encode_pieces(spark, shuffled, "").collect()
    assert {r.doc_id: (r.mix_slot, r.mixed) for r in tokens} == places
    # Documents that were not mixed have no place.
    plain = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    assert len(plain) == 120 and {(r.mix_slot, r.mixed) for r in plain} == {(None, None)}


def test_texts_go_to_the_workers_once(monkeypatch, spark):
    # Texts went twice to the workers of the first and third stage, as a key and as what is read.
    from pagemill.llm import language, secret_scan

    sent = []
    for module in (language, secret_scan):
        monkeypatch.setattr(module, "map_batches", lambda df, schema, make, real=module.map_batches: sent.append(df) or real(df, schema, make))
    docs = spark.createDataFrame([(1, "secret=" + "Ab3" * 5, "en", "s", 22), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    masked = corpus_pipeline.mask_secrets(spark, docs, "")
    assert sorted(map(tuple, masked.collect())) == [(1, "[assign]", "en", "s", 8), (2, None, None, None, None)]
    told = language.predict(docs, None, ["doc_id", "text"])
    assert sorted(tuple(r)[:3] for r in told.collect()) == [(1, "secret=" + "Ab3" * 5, "und"), (2, None, "und")]
    assert [sum("text" in c for c in df.columns) for df in sent] == [1, 1]


def test_an_encoder_holds_one_step_of_new_segments(monkeypatch):
    # The lattice of all new segments of a block was held at once, in every worker of the last stage.
    from pagemill.llm import pieces

    vocabulary = pieces.Vocabulary.load(corpus_pipeline.PIECES)
    segments = [f"{pieces.SPACE}word{i}s" for i in range(40_000)] + ["", "x" * 5000, "\0\u00e9" * 7]

    def encoded(step, some):
        monkeypatch.setattr(pieces.Encoder, "STEP_CHARS", step, raising=False)
        encoder = pieces.Encoder(vocabulary)
        tracemalloc.start()
        found = encoder._encode_segments(some)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    whole, _ = encoded(1 << 30, segments)
    parts, large = encoded(1 << 14, segments)
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(whole, parts))
    assert large < 2 * encoded(1 << 14, segments[:5000])[1]


def test_the_mix_starts_no_python_on_executors(spark, capsys):
    # Weights went out as lists of rows, for which executors started a second daemon and workers of their own.
    docs = spark.createDataFrame([(i, f"word {i}", "en", f"s{i % 3}", 6) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, written(docs, "mix-input"), "")
    capsys.readouterr()
    mixed.explain()
    plan = capsys.readouterr().out
    assert "Parquet" in plan and "ExistingRDD" not in plan and "Python" not in plan
    assert mixed.count() == 60
