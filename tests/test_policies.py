from __future__ import annotations

import pytest

from seqlake.operators.policies import POLICIES, simulate


@pytest.mark.parametrize("policy", POLICIES)
def test_written_and_dropped_are_what_was_offered(spark, policy):
    rows = spark.createDataFrame([(i, i, "reseed" if i % 50 == 7 else "message", "P") for i in range(400)], "arrival long, recv_us long, kind string, product string")
    got = simulate(rows, policy, depth=1, service_us=3).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == 400 and len(kept) + sum(not r.kept for r in got) == 400
    assert {i for i in range(400) if i % 50 == 7} <= {r.arrival for r in kept}
    assert (len(kept) < 200) if policy == "drop" else len(kept) == 400
    starts = [r.start_us for r in sorted(kept, key=lambda r: r.arrival)]
    assert all(b - a >= 3 for a, b in zip(starts, starts[1:], strict=False))
    with pytest.raises(ValueError):
        simulate(rows, "none", depth=1, service_us=1)
