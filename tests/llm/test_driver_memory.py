"""What the pipeline's driver keeps: tables of short texts stay small, stars take no round."""

import numpy as np
from cohortflow.llm import _text, near_dedup


def test_hash_tables_are_as_large_as_texts_need(monkeypatch):
    """The driver hashes the benchmark's short windows and keeps its tables; small and large tables give equal hashes."""
    short = lambda: _text.words(np.frombuffer(b"seven herons", np.uint8), np.array([0, 12]), _text.SPACE)[0].tolist()
    monkeypatch.setattr(_text, "_tables", {})
    first = short()
    size = lambda: sum(a.nbytes for x in _text._tables.values() for a in (x if isinstance(x, tuple) else (x,)))
    assert size() < 8 << 20
    _text.words(np.frombuffer(b"a b " * 500_000, np.uint8), np.array([0, 2_000_000]), _text.SPACE)
    assert size() > 64 << 20 and short() == first


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Edges that already form stars are told at a glance; longer chains still get the smallest node of all."""
    tables = []
    monkeypatch.setattr(near_dedup, "kept", lambda _, frame: tables.append(1) or frame.localCheckpoint())
    roots = lambda *edges: sorted(tuple(r) for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).select("node", "root").collect())
    assert roots((5, 1), (1, 7), (5, 1), (9, 8), (3, 3)) == [(5, 1), (7, 1), (9, 8)] and len(tables) == 1
    assert roots(*((i, i + 1) for i in range(1, 12)), (30, 20), (40, 30), (20, 40)) == [(i, 1) for i in range(2, 13)] + [(30, 20), (40, 20)]
    assert spark.createDataFrame([], "u long, v long").transform(near_dedup.components).count() == 0
