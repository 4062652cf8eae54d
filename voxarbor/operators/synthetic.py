"""Synthetic images as column expressions, and random walks by seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def lattice(spacing: int) -> Column:
    """1 on the lines along the axes through every spacing-th voxel, 0 elsewhere."""
    on = sum((F.col(a) % spacing == 0).cast("int") for a in XYZ)
    return F.when(on >= 2, 1).otherwise(0)


def barriers(side: int, spacing: int) -> Column:
    """0 on nested cubic walls around the centre, every spacing-th shell, but for the voxels in
    line with the centre along x; 1 elsewhere."""
    c = side // 2
    shell = F.greatest(*(F.abs(F.col(a) - c) for a in XYZ))
    gap = (F.col("y") == c) & (F.col("z") == c)
    return F.when((shell % spacing == spacing - 1) & ~gap, 0).otherwise(1)


def random_walks(seeds: DataFrame, side: int, share: float) -> DataFrame:
    """(seed_id, x, y, z): the voxels of a walk from the centre of a cube over its faces until
    it has been at that share of the voxels (1 at least); one task a walk, and the same walk
    for the same seed."""
    target = max(1, min(side**3, round(share * side**3)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf.seed_id.iloc[0])
        rng, at = np.random.default_rng(seed % (1 << 63)), [side // 2] * 3
        seen = {tuple(at)}
        while len(seen) < target:
            for step in rng.integers(0, 6, 1024).tolist():
                axis, to = step // 2, at[step // 2] + (1 if step % 2 else -1)
                if 0 <= to < side:
                    at[axis] = to
                    seen.add(tuple(at))
                    if len(seen) == target:
                        break
        cells = np.array(sorted(seen), dtype=np.int32)
        return pd.DataFrame({"seed_id": seed, **{a: cells[:, k] for k, a in enumerate(XYZ)}})

    return seeds.select("seed_id").distinct().groupBy("seed_id").applyInPandas(walk, "seed_id long, x int, y int, z int")
