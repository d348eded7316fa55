"""The pipeline against its stages in plain Python, and each stage on awkward rows."""

import corpus_pipeline as cp
from stallwright.llm import decontaminate, mixing, quality

from ..conftest import SMALL
from .brute import closure, documents, empty, odd
from .test_decontaminate import slow_leaks
from .test_near_copies import shingles, similar
from .test_simhash import slow_fingerprint
from .test_token_files import slow as slow_tokens


def test_run_against_brute_force(spark):
    import pandas as pd
    import public_tokenizers

    d = documents()
    fertility = quality.Fertility(public_tokenizers.path("piece_bpe_32k.model"))
    d = d[[quality.judge(fertility, quality.BANDS, t, x)[-1] for t, x in zip(d.text, d.lang)]]
    fps, sets = (dict(zip(d.doc_id, map(f, d.text))) for f in (slow_fingerprint, shingles))
    groups = closure(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or similar(sets[a], sets[b]))
    d = d[[groups[i] == i for i in d.doc_id]]
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    leaks = slow_leaks(zip(d.doc_id, d.text), zip(items.item_id, items.text))
    d = d[[i not in {doc for doc, _ in leaks} for i in d.doc_id]]
    import duckdb

    c = duckdb.connect()
    c.register("documents", d)
    mixed = c.sql(mixing.OP1_SQL).df().sort_values("doc_id")
    got = sorted(tuple(r) for r in cp.run(spark, SMALL).collect())
    assert got == sorted(slow_tokens(zip(mixed.doc_id.tolist(), mixed.text)))


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_output"]
    for name, stage in cp.STAGES:
        out = stage(spark, odd(spark), SMALL)
        out.collect()
        if name != "token_output":
            assert out.columns == odd(spark).columns
        assert stage(spark, empty(spark), SMALL).count() == 0
    assert decontaminate.benchmark_table(spark, SMALL).count() > 0


def test_worker_holds_one_model():
    """A stage's model goes before the next one's: together they outgrew an executor."""
    import gc
    import weakref

    import public_tokenizers

    from stallwright.llm import common, token_files

    fertility = quality.fertility_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert quality.fertility_of(public_tokenizers.path("piece_bpe_32k.model")) is fertility
    gone = weakref.ref(fertility)
    del fertility
    encoder = weakref.ref(token_files.piece_encoder(token_files.tokenizer_path("byte_bpe_50k.json")))
    gc.collect()
    assert gone() is None and encoder() is token_files.piece_encoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    common.release_models()
    assert encoder() is None


def test_near_duplicate_tasks_hold_no_model(spark):
    """Worker processes that serve a stage without a model give back the one before."""
    import sys

    from pyspark.sql import functions as F

    from stallwright.llm import near_copies, simhash

    docs = spark.createDataFrame([(i, f"some words of text {i} and a few more") for i in range(8)], "doc_id long, text string").coalesce(1)

    def held(batches):
        import pyarrow as pa

        common = sys.modules.get("stallwright.llm.common")
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._models) if common else 0] * b.num_rows)], ["n"])

    for stage in (simhash.fingerprints, near_copies.signatures):
        quality.quality_rules(docs).collect()
        stage(docs).collect()
        assert docs.select("doc_id").mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0
