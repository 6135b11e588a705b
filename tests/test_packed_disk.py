"""What a packed corpus puts on disk, and that its two-byte document numbers don't overflow."""

import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from glosswork.operators import graph, packed
from glosswork.runtime import setting, stored


def files(p, what):
    return [np.load(f"{p.folder.removeprefix('file:')}/{s}.{what}.npy") for s in p.shards]


def corpus():
    return [[f"w{(i * k) % 17}" for k in range(1 + i % 9)] for i in range(60)] + [[], None]


@pytest.mark.parametrize("docs", [1 << 16, 8])
def test_an_occurrence_takes_six_bytes(spark, monkeypatch, docs):
    monkeypatch.setattr(packed, "DOCS", docs)
    p, _ = packed.pack(spark.createDataFrame([(t,) for t in corpus()], "tokens array<string>").coalesce(1))
    held = sum(len(set(t or [])) for t in corpus())
    assert sum(a.nbytes for what in ("ids", "doc") for a in files(p, what)) == 6 * held
    assert all(len(off) - 1 <= docs for off in files(p, "off")) and len(p.shards) == (1 if docs > 60 else 8)
    n = Counter(x for t in corpus() for x in combinations(sorted(set(t or [])), 2))
    out = packed.rows(spark, p, packed.supported(1), packed.SUPPORTED, half=True).collect()
    assert {(r["t1"], r["t2"]): r["n"] for r in out} == n


def test_places_of_ids():
    flat, off = np.array([0, 3, 5, 9, 2, 1, 2, 4], np.int32), np.array([0, 4, 5, 8])
    doc, ids = np.array([0, 0, 0, 1, 2, 2, 2]), np.array([0, 5, 9, 2, 1, 2, 4])
    assert packed._places(flat, ids, off[doc], off[doc + 1]).tolist() == [0, 2, 3, 4, 5, 6, 7]
    assert packed._places(flat, ids[:0], off[:0], off[:0]).tolist() == []


def test_tokens_are_stored_without_what_they_share(spark, monkeypatch):
    """pack() stores its token sets in order and without shared first letters: less than they take as they stand."""
    sizes = []
    monkeypatch.setattr(packed, "dropped", lambda df: sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())))
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (200_000, 8))]
    c = stored(spark.createDataFrame([([words[i] for i in rng.integers(0, 200_000, 5_000)],) for _ in range(40)], "tokens array<string>").coalesce(1))
    packed.pack(c)
    plain = sum(os.path.getsize(f.removeprefix("file://")) for f in c.inputFiles())
    assert len(sizes) == 1 and sizes[0] < 0.8 * plain
    assert spark.conf.get("parquet.writer.version", None) is None


def test_a_setting_holds_only_inside(spark):
    with pytest.raises(ValueError), setting(spark, "spark.x", "1"):
        assert spark.conf.get("spark.x") == "1"
        raise ValueError
    assert spark.conf.get("spark.x", None) is None


def test_a_forest_grows_with_the_nodes_not_with_the_partitions(spark):
    """A chain that every partition holds is left once a task, and tasks are bounded by the cores."""
    cores = spark.sparkContext.defaultParallelism
    n = 20 * cores
    e = spark.range(0, 9 * n, 1, n).selectExpr("id % 9 as a", "id % 9 + 1 as b")
    out = packed.forest(e, parts=4 * cores)
    assert out.count() <= 4 * cores * 9
    assert {tuple(r) for r in graph.components(out).collect()} == {(i, 0) for i in range(10)}
