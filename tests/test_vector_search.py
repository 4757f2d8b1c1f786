"""Vector search in tiles of a bounded size."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from evigraph.operators import cells as ce
from evigraph.operators import retrieval as rt


def batch(n=3000, queries=400, ties=False):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    if ties:
        x[:] = x[rng.integers(0, 5, n)]
    ids = rng.permutation(n)
    rows = [{"query_id": int(i), "q": x[at].tolist()} for at, i in enumerate(ids[:queries])]
    return rows, pd.DataFrame({"vec_id": ids, "embedding": list(x)})


def peak(run, frame):
    tracemalloc.start()
    out = pd.concat(run(iter([frame])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


@pytest.mark.parametrize("ties", [False, True])
def test_tiles_give_the_same(monkeypatch, ties):
    rows, frame = batch(400, 60, ties)
    whole = pd.concat(rt._search_block(rows, 5, None)(iter([frame]))).to_numpy().tolist()
    monkeypatch.setattr(rt, "TILE_SCORES", 60 * 7)
    assert pd.concat(rt._search_block(rows, 5, None)(iter([frame[:150], frame[150:]]))).to_numpy().tolist() == whole
    x = np.stack(frame["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = frame["vec_id"].to_numpy()
    want = []
    for r in rows:
        score = np.round(x @ (np.array(r["q"]) / np.linalg.norm(r["q"])), 6)
        want += [[r["query_id"], ids[v], score[v]] for v in [v for v in np.lexsort((ids, -score)) if ids[v] != r["query_id"]][:5]]
    assert whole == want


@pytest.mark.parametrize("search", ["topk", "range", "cells", "buckets"])
def test_memory_does_not_grow_with_a_batch(search):
    rows, frame = batch(20000, 1000)
    if search == "cells":
        ids, matrix = np.array([r["query_id"] for r in rows]), ce._unit(np.array([r["q"] for r in rows]))
        run, frame = ce._best_of_cells(ids, matrix, {0: np.arange(len(ids))}, 5), frame.assign(cell=0)
    elif search == "buckets":
        run, frame = rt._search_buckets([{**r, "h": [0, 1]} for r in rows], 5), frame.assign(h=[np.array([0, 2])] * len(frame))
    else:
        run = rt._search_block(rows, 5, None) if search == "topk" else rt._search_block(rows, None, 0.97)
    _, most = peak(run, frame)
    assert most < 60 << 20  # the whole matrix has 160 MB
