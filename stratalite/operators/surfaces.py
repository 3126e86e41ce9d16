"""Surfaces of equal value through voxels, as triangles with shared vertices.

Voxels are dealt over cubes of blocks, those on a block's lower faces also to the blocks
below: one shuffle of little more than the voxels. In a block all cubes of eight
neighbours are done at once. What a cube holds follows from a rule: on each of its faces,
lines separate the corners above from those below (each above one by itself where both
pairs of opposite corners differ), and the lines join into rings, which are filled. As
neighbouring cubes see the same lines on the face they share, surfaces have no cracks.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship

#: Voxels along a block, bits of a place in the name of a vertex.
SIZE, BITS = 32, 20
CORNERS = list(itertools.product((0, 1), repeat=3))
#: The edges of a cube: corners that differ in one place.
EDGES = [(a, b) for a, b in itertools.combinations(range(8), 2) if sum(x != y for x, y in zip(CORNERS[a], CORNERS[b], strict=True)) == 1]


def _faces() -> list[list[int]]:
    """The corners of each face in a ring, turning to the left seen from outside."""
    out = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            ring = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)) if side else ((0, 0), (0, 1), (1, 1), (1, 0)):
                c = [0, 0, 0]
                c[axis], c[u], c[v] = side, a, b
                ring.append(CORNERS.index(tuple(c)))
            out.append(ring)
    return out


@functools.cache
def triangles_of_cases() -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """Of each set of corners above (a bit for each corner): triangles of edges, made by the rule."""
    out = []
    for case in range(256):
        ahead = {}
        for ring in _faces():
            up = [case >> c & 1 for c in ring]
            edge = [EDGES.index(tuple(sorted((ring[k], ring[(k + 1) % 4])))) for k in range(4)]
            for k in range(4):
                if up[k] and not up[(k + 1) % 4]:  # the line that leaves here goes back to where this corner's run above began
                    j = k
                    while up[j]:
                        j = (j - 1) % 4
                    ahead[edge[k]] = edge[j]
        triangles = []
        while ahead:
            start, ring = next(iter(ahead)), []
            while start in ahead:
                ring.append(start)
                start = ahead.pop(start)
            triangles += [(ring[0], ring[k + 1], ring[k]) for k in range(1, len(ring) - 1)]
        out.append(tuple(triangles))
    return tuple(out)


def isosurface(voxels: DataFrame, level: float, value: str = "value", size: int = SIZE) -> DataFrame:
    """Triangles of the surface where the values of voxels (i, j, k, value) pass ``level``: v1, v2, v3 (names of vertices) and their x, y, z.

    A value equal to the level is below it. Places are counted in voxels. Triangles turn
    to the left seen from below the level. Cubes with a missing or null voxel have none,
    so the surface is open there; triangles without area don't come out. No voxels give
    no rows.
    """
    ship(voxels.sparkSession)
    low = voxels.agg(F.min("i"), F.min("j"), F.min("k")).first()
    if low[0] is None:
        low = (0, 0, 0)
    known = voxels.where(F.col(value).isNotNull()).select(*[(F.col(c) - l).cast("long").alias(c) for c, l in zip("ijk", low, strict=True)], F.col(value).cast("double").alias("value"))
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    of = lambda c: F.when((F.col(c) % size == 0) & (F.col(c) > 0), F.array(block(c), block(c) - 1)).otherwise(F.array(block(c)))
    dealt = known
    for c in "ijk":
        dealt = dealt.withColumn(f"b{c}", F.explode(of(c)))

    def cubes(key, pdf):
        import numpy as np
        import pandas as pd

        at = [int(b) * size for b in key]
        v = np.full((size + 1,) * 3, np.nan)
        v[tuple(pdf[c].to_numpy() - a for c, a in zip("ijk", at, strict=True))] = pdf["value"].to_numpy()
        corner = [v[tuple(slice(o, o + size) for o in c)] for c in CORNERS]
        known_ = ~np.isnan(sum(corner))
        case = sum((c > level).astype(int) << n for n, c in enumerate(corner))
        case[~known_] = 0
        table, rows = triangles_of_cases(), []
        for number in np.unique(case):
            if not table[number]:
                continue
            place = np.argwhere(case == number)
            ends = {}
            for e in {e for t in table[number] for e in t}:
                a, b = (np.array(CORNERS[c]) for c in EDGES[e])
                p, q = (v[tuple((place + c).T)] for c in (a, b))
                f = ((level - p) / (q - p))[:, None]
                name = place + np.minimum(a, b) + at
                axis = int(np.flatnonzero(a != b)[0])
                ends[e] = (((name[:, 0] << BITS | name[:, 1]) << BITS | name[:, 2]) << 2 | axis, place + a + f * (b - a) + at + np.array(low))
            for t in table[number]:
                rows.append(([ends[e][0] for e in t], np.concatenate([ends[e][1] for e in t], axis=1)))
        if not rows:
            return pd.DataFrame({n: [] for n in names})
        out = pd.DataFrame({f"v{n + 1}": np.concatenate([r[0][n] for r in rows]) for n in range(3)})
        xyz = np.concatenate([r[1] for r in rows])
        for n, c in enumerate(names[3:]):
            out[c] = xyz[:, n]
        p = xyz.reshape(-1, 3, 3)
        return out[np.linalg.norm(np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), axis=1) > 0]

    names = ["v1", "v2", "v3", *[f"{c}{n}" for n in (1, 2, 3) for c in "xyz"]]
    return dealt.groupBy("bi", "bj", "bk").applyInPandas(cubes, ", ".join(f"{n} {'long' if n[0] == 'v' else 'double'}" for n in names))


def vertices(triangles: DataFrame) -> DataFrame:
    """Each vertex once: id, x, y, z, and nx, ny, nz, the direction of the sum of its triangles' unit normals."""
    d = lambda a, b: [F.col(f"{c}{a}") - F.col(f"{c}{b}") for c in "xyz"]
    p, q = d(2, 1), d(3, 1)
    n = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    t = triangles.withColumns({f"_n{c}": v for c, v in zip("xyz", n, strict=True)})
    t = t.withColumn("_l", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz")))
    ends = F.array(*[F.struct(F.col(f"v{k}").alias("id"), *[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in (1, 2, 3)])
    each = t.select(F.explode(ends).alias("e"), *[F.try_divide(F.col(f"_n{c}"), F.col("_l")).alias(f"n{c}") for c in "xyz"])
    total = each.groupBy("e.id").agg(*[F.min(f"e.{c}").alias(c) for c in "xyz"], *[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return total.withColumn("_l", length).select("id", "x", "y", "z", *[F.try_divide(F.col(f"n{c}"), F.col("_l")).alias(f"n{c}") for c in "xyz"])
