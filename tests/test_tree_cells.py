"""Tree attributions: rows in one cell of the model are explained once."""

import math

import numpy as np

from quarry.operators import attribution
from quarry.operators.attribution import Condition, Path


def test_cells_are_explained_once(monkeypatch):
    paths = [Path(2.0, [0, 2], [Condition(high=1.5, share=0.4), Condition(allowed=frozenset({0.0, 2.0}), share=0.3)]),
             Path(-1.0, [0, 1], [Condition(low=1.5, high=4.0, share=0.5), Condition(low=0.0, share=0.7)]),
             Path(3.0, [1], [Condition(high=0.0, share=0.3)])]
    x = np.array([[a, b, c] for a in (0.0, 1.5, 1.6, 4.0, 5.0, math.nan, math.inf, -math.inf) for b in (-1.0, 0.0, 0.1, math.nan)
                  for c in (0.0, 1.0, 2.0, math.nan)] * 50)
    want = attribution.path_attributions(paths, x)
    plain, seen = attribution.path_attributions, []
    monkeypatch.setattr(attribution, "path_attributions", lambda p, rows: seen.append(len(rows)) or plain(p, rows))
    got = attribution.cell_attributions(paths, attribution.model_edges(paths, 3), x)
    assert np.array_equal(got, want)
    assert sum(seen) <= 3 * 2 * 4 < len(x)
