"""Vectors dealt to many parts: in bounded batches, whole, and the same links by four blocks or one."""

import numpy as np
import pyarrow as pa
import pytest

from meetflow.llm import embed

from .test_pairs import test_vectors as check_vectors


@pytest.mark.parametrize("blocks", [4, 1])
def test_batches(monkeypatch, blocks):
    """A batch holds some rows even where its cells have hundreds of parts; every pair of near cells meets once a block."""
    monkeypatch.setattr(embed, "PART_ROWS", 2)
    monkeypatch.setattr(embed, "DEALT_ROWS", 64)
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    u = embed.unit(x)
    moments = np.concatenate([u.sum(axis=0), (u.T @ u).ravel(), [len(u)]])
    plan = embed.Plan(moments, 8, 0.2, blocks)
    cells = plan.cells(u @ plan.rotation)
    plan.divide({(j, int(c)): int((cells[:, j] == c).sum()) for j in range(cells.shape[1]) for c in np.unique(cells[:, j])})
    ids = np.arange(400, dtype=np.int64) * 7919
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), pa.array(ids), pa.array(np.ones(400, np.int64))], ["vec", "c", "mult"])
    dealt = list(embed.deal([batch], plan, 8))
    assert len(dealt) > 10 and max(b.num_rows for b in dealt) <= 64
    t = pa.Table.from_batches(dealt).to_pydict()
    groups, met = {}, {}
    for j, cell, p, q, side, c in zip(*(t[k] for k in ("j", "cell", "p", "q", "side", "c"))):
        groups.setdefault((j, cell, p, q), ([], []))[side].append(c // 7919)
    for (j, _, p, q), (a, b) in groups.items():
        for i, k in ((i, k) for i in a for k in (a if p == q else b) if p != q or i < k):
            met[j, min(i, k), max(i, k)] = met.get((j, min(i, k), max(i, k)), 0) + 1
    near = {(j, i, k) for j in range(cells.shape[1]) for i in range(400) for k in range(i + 1, 400) if abs(cells[i, j] - cells[k, j]) <= 1}
    assert set(met) == near and set(met.values()) == {1}


@pytest.mark.parametrize("blocks", [4, 1])
def test_vectors_by_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(embed, "BLOCKS", (blocks,))
    check_vectors(spark, monkeypatch, 20)
