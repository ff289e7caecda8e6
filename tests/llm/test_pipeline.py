"""The pipeline's stages against the operators' brute-force results, and the registered queries with SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bandweave.llm import pii
from bandweave.llm.queries import ORACLES, QUERIES

from ..conftest import rows_of
from .test_dedup import brute_components, brute_contained, shingles
from .test_quality import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, data, duck, name):
    assert rows_of(QUERIES[name](spark, data).toPandas()) == rows_of(duck.sql(ORACLES[name]).df())


def test_all_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = None
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if before is None:  # rules
            assert all(not brute(t)[5] for t in now.values())
            assert set(now) <= set(kept)
        elif len(before) == 1:  # near duplicates
            want = brute_components({i: shingles(t) for i, t in kept.items()})
            assert set(now) == {i for i in kept if want[i] == i}
        elif len(before) == 2:  # decontamination
            assert set(now) == set(kept) - {w[0] for w in brute_contained(kept.items(), items)}
        else:
            assert set(now) == set(kept) and all(not pii.base_spans(t) for t in now.values())
        before, kept = [*(before or []), 1], now
    packed = corpus_pipeline.STAGES[4][1](spark, docs, data).toPandas()
    assert set(packed.doc_id) == set(kept)
    whole = corpus_pipeline.run(spark, data).toPandas()
    assert sorted(whole[["doc_id", "piece", "ids_crc32"]].itertuples(index=False)) == sorted(packed[["doc_id", "piece", "ids_crc32"]].itertuples(index=False))
