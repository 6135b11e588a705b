import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from glosswork.llm import decontam, mixing, quality, sharding, simhash  # noqa: E402

from . import test_decontam, test_quality, test_simhash  # noqa: E402
from .frames import DOCS, LABELS, frame, odd, rows  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs, truth = test_quality.corpus(150, 61)
    copies = [(2000 + k, t + " indeed", lang, s, n) for k, (i, t, lang, s, n) in enumerate(docs[:40])]
    leaks, items = test_decontam.data()
    known = [(i, y, 0) for i, y in truth.items()]
    for name, data, schema in (("documents", docs + copies + [(3000 + i, *r) for i, *r in leaks] + odd(), DOCS), ("labels", known, LABELS), ("benchmark", items, test_decontam.ITEMS)):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage_equals_brute_force_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    order = lambda x: sorted(map(repr, x))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        data, out = rows_of(docs), stage(spark, docs, folder)
        got = rows_of(out)
        assert out.columns[: len(names)] == names
        if k == 0:
            w, mean = quality.fit(docs, labels, "doc_id", "text", "quality", quality.MAX_LABELLED)
            post = test_quality.brute(data, w, np.log(mean / (1 - mean)))
            want = [r for r in data if min(post[repr(r[0])]) >= quality.THRESHOLD]
            assert order(got) == order(want) and len(want) < len(data)
        elif k == 1:
            groups, _ = test_simhash.brute(data)
            ids = sorted(x[0] for x in got if x[0] is not None and x[1] is not None)
            assert ids == sorted(set(groups.values())) and len(ids) < len(groups)
            assert order(x for x in got if x[0] is None or x[1] is None) == order(x for x in data if x[0] is None or x[1] is None)
        elif k == 2:
            hit = {r[0] for r in test_decontam.brute([r for r in data if len(r[1] or "") < 9000], items)}
            assert hit and order(got) == order(r for r in data if repr(r[0]) not in hit)
        elif k == 3:
            low, high = {}, {}
            for r in mixing.rates(docs, labels).collect():
                i = repr(r["doc_id"])
                low[i], high[i] = low.get(i, 0) + np.floor(r["rate"]), high.get(i, 0) + np.ceil(r["rate"])
            n = {}
            for r in got:
                n[repr(r[0])] = n.get(repr(r[0]), 0) + 1
            assert set(n) <= set(low)
            assert all(low[i] <= n.get(i, 0) <= high[i] for i in low)
        else:
            assert out.columns == [*names, "shard_id"]
            assert order(r[:-1] for r in got) == order(data)
        path = f"{folder}/out{k}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_run_applies_the_stages_one_after_the_other(spark, folder):
    last = f"{folder}/out{len(corpus_pipeline.STAGES) - 1}.parquet"
    show = lambda df: sorted(repr(tuple(r)[:5]) for r in df.collect())
    assert show(corpus_pipeline.run(spark, folder)) == show(spark.read.parquet(last))


def test_stages_take_empty_documents(spark, folder):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_takes_empty_labels_and_benchmark(spark, tmp_path):
    data = rows(40, 62) + odd()
    for name, found, schema in (("documents", data, DOCS), ("labels", [], LABELS), ("benchmark", [], test_decontam.ITEMS)):
        spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    # without labels all is kept but copies, without a benchmark nothing is dropped, without domains nothing is repeated
    groups, _ = test_simhash.brute(data)
    lone = [r for r in data if r[0] is None or r[1] is None]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(set(groups.values())) + len(lone)
