import math

import numpy as np
import pytest

from varietas.operators import diversity

ORDERS = (0.01, 0.5, 1.0, 2.0, 4.0, 4.5, 60.0, 400.0)


def plain(counts, n, q, what):
    p = np.array([c for c in counts if c > 0]) / sum(counts)
    if what == "D":
        return math.exp(-(p * np.log(p)).sum()) if q == 1 else (p**q).sum() ** (1 / (1 - q))
    if n == 1:
        return None
    return -(p * np.log(p)).sum() / math.log(n) if q == 1 else (1 - (p**q).sum()) / (1 - n ** (1 - q))


@pytest.mark.parametrize("what", ["S", "D"])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e40])
def test_orders_low_and_high_over_counts_of_all_sizes(spark, what, scale):
    """Sums of counts for low orders, of shares for high ones: tiny and huge counts give what their shares give."""
    rng = np.random.default_rng(1)
    cells = {(g, s): [float(x) * scale if rng.random() > 0.2 else 0.0 for x in rng.gamma(0.5, 1e4, 1 + 3 * g)] for g in range(4) for s in range(5)}
    cells[1, 2] = [0.0] * 4
    rows = [(g, f"t{i}", s, c) for (g, s), counts in cells.items() for i, c in enumerate(counts)] + [(2, "t0", 9, None), (2, "t1", 9, 5.0)]
    df = spark.createDataFrame(rows, "gene long, tx string, sample long, count double").repartition(5)
    found = {(r["gene"], r["sample"], r["q"]): r["value"] for r in diversity.diversity(df, ORDERS, what=what, complete=False).collect()}
    assert len(found) == (len(cells) + 1) * len(ORDERS) and all(found[2, 9, q] is None for q in ORDERS)
    for (g, s), counts in cells.items():
        for q in ORDERS:
            want = plain(counts, len(counts), q, what) if sum(counts) else None
            assert found[g, s, q] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-12)), (g, s, q)
