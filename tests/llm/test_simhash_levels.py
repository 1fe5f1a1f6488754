"""Large anchors of either half are divided by the other half, at both levels."""

from __future__ import annotations

import random

import pytest

from vellumframe.llm import simhash


@pytest.mark.parametrize("half", [0, 1])
def test_both_levels_divide(spark, half):
    """The other halves share a byte, so one part of level 1 holds all rows, and level 2 has to divide it."""
    rng = random.Random(4)
    values = [((rng.randrange(1 << 24) << 8 | 0x33) << 32 * (1 - half)) | (0x5A5A5A5A << 32 * half) for _ in range(500)]
    rows = [((half << 32) | 0x5A5A5A5A, v - (1 << 64) if v >> 63 else v) for v in values]
    over, largest = spark.createDataFrame(rows, "key long, fp long"), []
    for level in (1, 2):
        over = simhash._divided(over, level)
        largest.append(max(r["count"] for r in over.groupBy("key").count().collect()))
        assert {r["bit"] for r in over.selectExpr("shiftright(key, 32) & 1 AS bit").distinct().collect()} == {half}
    assert largest[0] == 500 and largest[1] < 50
