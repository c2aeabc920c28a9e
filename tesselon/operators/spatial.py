"""Radius and nearest-neighbour joins over points x, y, z.

Points are dealt to grid cells of the radius; a point meets only the 27 cells
around its own, so the join is an equi-join on cells whatever the number of points.
Where only counts of pairs or nearest points are asked for, pairs aren't formed: points
are dealt to blocks of neighbours, a task takes one block of either side, and boxes of
a few points each decide which distances it computes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")

#: Points of a block and of a box, on the left and on the right, and columns of distances
#: that a task computes at once.
LEFT_BLOCK, RIGHT_BLOCK, LEFT_BOX, RIGHT_BOX, COLUMNS = 16_384, 131_072, 64, 32, 8_192


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def distance2(a: str = "a_", b: str = "b_") -> Column:
    return reduce(lambda s, c: s + c, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in XYZ])


def radius_join(left: DataFrame, right: DataFrame, id_left: str, id_right: str, r2: float, strict: bool = True, by: list[str] = ()) -> DataFrame:
    """by, a_id, b_id, d2 of all pairs closer than sqrt(r2) (at most, if not strict)
    (J14, J15)."""
    size = float(r2) ** 0.5
    a = left.select(*by, F.col(id_left).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in XYZ], *[_cell(c, size).alias(f"g_{c}") for c in XYZ])
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = right.select(*by, F.col(id_right).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in XYZ], *[_cell(c, size).alias(f"h_{c}") for c in XYZ])
    for c in XYZ:
        b = b.withColumn("__o", F.explode(near)).withColumn(f"g_{c}", F.col(f"h_{c}") + F.col("__o")).drop("__o")
    pairs = a.join(b, [*by, *[f"g_{c}" for c in XYZ]]).withColumn("d2", distance2())
    return pairs.where(F.col("d2") < r2 if strict else F.col("d2") <= r2).select(*by, "a_id", "b_id", "d2")


def _placed(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ]))


def dealt(points: DataFrame, size: int, name: str) -> DataFrame:
    """points with the block of each, of at most some three times size points: cells of a
    grid over all of them follow a curve that keeps neighbours together, and are filled into
    blocks; a cell that is too large for one is split by a hash of its rows."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]).first()
    code = F.lit(0).cast("long")
    for k, c in enumerate(XYZ):
        width = (ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0)
        if 0 < width < float("inf"):
            at = F.least(F.floor((F.col(c) - ends[f"lo_{c}"]) / width * 32), F.lit(31)).cast("long")
            code = reduce(lambda s, i: s + F.shiftleft(F.shiftright(at, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + k), range(5), code)  # noqa: B023
    p = points.withColumn("__cell", code)
    n, upto = F.col("n"), F.sum("n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = p.groupBy("__cell").agg(F.count("*").alias("n")).select("__cell", F.floor((upto - n) / size).alias("__first"), F.ceil(n / size).alias("__parts"))  # at most 32,768 cells
    part = F.pmod(F.xxhash64(*points.columns), F.col("__parts"))
    return p.join(F.broadcast(cells), "__cell").withColumn(name, F.col("__first") + part).drop("__cell", "__first", "__parts")


def _boxes(points: DataFrame, block: str, by: list[str]) -> DataFrame:
    return points.groupBy(*by, block).agg(*[f(c).alias(f"{block}{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])


def by_blocks(left: DataFrame, right: DataFrame, boxes: DataFrame, r2: float, run: Callable, schema: str, by: list[str] = ()) -> DataFrame:
    """run(left rows, right rows) for each pair of a left block (__l) and a right one (__r)
    whose boxes come within the radius; boxes: those of the left blocks."""
    gap = lambda c: F.greatest(F.col(f"__llo_{c}") - F.col(f"__rhi_{c}"), F.col(f"__rlo_{c}") - F.col(f"__lhi_{c}"), F.lit(0.0))
    other = _boxes(right, "__r", by)
    both = boxes.join(other, [*by]) if by else boxes.crossJoin(F.broadcast(other))  # one row a block
    pairs = both.where(reduce(lambda a, b: a + b, [gap(c) * gap(c) for c in XYZ]) <= r2 * (1 + 1e-9)).select(*by, "__l", "__r")
    keys = [*by, "__l", "__r"]
    a, b = left.join(pairs, [*by, "__l"]), right.join(pairs, [*by, "__r"])
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  # both sides may come from one table
    return fresh(a).groupBy(*keys).cogroup(fresh(b).groupBy(*keys)).applyInPandas(run, schema)


def _leaves(p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of points, and the starts of boxes of at most so many of them, by halving the
    longest side."""
    order, starts, todo = np.arange(len(p)), [], [(0, len(p))]
    while todo:
        a, z = todo.pop()
        if z - a <= most:
            starts.append(a)
            continue
        q, mid = p[order[a:z]], -(-(z - a) // (2 * most)) * most  # full boxes but the last
        order[a:z] = order[a:z][np.argpartition(q[:, np.argmax(q.max(axis=0) - q.min(axis=0))], mid)]
        todo += [(a + mid, z), (a, a + mid)]
    return order, np.array(starts)


class Block:
    """Points in boxes: places, starts and sizes of the boxes, and their corners."""

    def __init__(self, p: np.ndarray, starts: np.ndarray):
        self.p, self.starts = p, starts
        self.sizes = np.diff(np.append(starts, len(p)))
        self.lo, self.hi = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)

    def reach(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest square distance between a box and each of these."""
        gap = np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0)
        far = np.maximum(self.hi - lo, hi - self.lo)
        return (gap * gap).sum(axis=1), (far * far).sum(axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square distances, summed up as distance2 does."""
    d = a - b
    d *= d
    return d[..., 0] + d[..., 1] + d[..., 2]


def _count_block(a: Block, of_a: np.ndarray, b: Block, of_b: np.ndarray, r2: float, counts: np.ndarray) -> None:
    """Adds the pairs closer than the radius to counts (classes of a, classes of b). Boxes
    that lie wholly inside or outside need no distances; the others' come from a product of
    matrices in single precision around the box, and those too near to the radius for its
    rounding once more, exactly. a is sorted by class in each box."""
    by_class = np.argsort(of_b, kind="stable")
    box, of_b = np.repeat(np.arange(len(b.starts)), b.sizes)[by_class], of_b[by_class]
    places = np.ascontiguousarray(b.p[by_class].T)
    for k, start in enumerate(a.starts):
        end = start + a.sizes[k]
        least, most = b.reach(a.lo[k], a.hi[k])
        inside = most < r2 * (1 - 1e-9)
        edge = ~inside & (least <= r2 * (1 + 1e-9))
        kinds, first, sizes = np.unique(of_a[start:end], return_index=True, return_counts=True)
        kind = (inside * np.uint8(2) + edge)[box]
        if inside.any():
            counts[kinds] += sizes[:, None] * np.bincount(of_b[kind == 2], minlength=counts.shape[1])
        if not edge.any():
            continue
        own, centre = a.p[start:end], (a.lo[k] + a.hi[k]) / 2
        p = own - centre
        square = (p * p).sum(axis=1)
        left = np.column_stack([-2 * p, square, np.ones(len(p))]).astype(np.float32)
        at, cut = np.flatnonzero(kind == 1), [*first, len(p)]
        for i in range(0, len(at), COLUMNS):
            part = at[i : i + COLUMNS]
            right = np.ones((5, len(part)), np.float32)
            for c in range(3):
                right[c] = places[c, part] - centre[c]
            right[4] = right[0] * right[0] + right[1] * right[1] + right[2] * right[2]
            slack = 4e-6 * (square.max() + float(right[4].max()) + r2)
            d = left @ right
            near, maybe = d < np.float32(r2 - slack), d < np.float32(r2 + slack)
            if np.count_nonzero(near) != np.count_nonzero(maybe):
                x, y = np.nonzero(near ^ maybe)
                near[x, y] = _exact(own[x], places[:, part[y]].T) < r2
            of = of_b[part]
            where = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            byte = near.view(np.uint8)
            rows = np.stack([byte[u:v].sum(axis=0, dtype=np.uint8) for u, v in zip(cut[:-1], cut[1:], strict=True)])  # those of a box fit a byte
            counts[np.ix_(kinds, of[where])] += np.add.reduceat(rows.astype(np.int32), where, axis=1)


def near_counts(left: DataFrame, right: DataFrame, of_left: str, of_right: str, r2: float, maps: dict[int, list[list[float]]]) -> DataFrame:
    """map, a, b, n: the pairs closer than sqrt(r2) of each class of left points, moved by
    each map (an affine 3 x 4 matrix), and class of right points (J14). Points without a class
    or a place take part in none. Counts are exact; pairs aren't formed."""
    from tesselon.operators.relational import checkpointed

    spark = left.sparkSession
    clean = lambda df, of, name: checkpointed(_placed(df.select(F.col(of).alias(name), *[F.col(c).cast("double").alias(c) for c in XYZ])).where(F.col(name).isNotNull()))
    a, b = clean(left, of_left, "a"), clean(right, of_right, "b")
    schema = f"map int, a {a.schema['a'].dataType.simpleString()}, b {b.schema['b'].dataType.simpleString()}, n long"
    a, b = dealt(a, min(LEFT_BLOCK, max(256, -(-a.count() // 64))), "__l"), dealt(b, RIGHT_BLOCK, "__r")  # blocks for many tasks also of few points
    table = spark.createDataFrame([([float(v) for row in m for v in row],) for m in maps.values()], "m array<double>")
    moved = lambda i: reduce(lambda s, v: s + v, [F.col(c) * F.col("m")[4 * i + k] for k, c in enumerate(XYZ)]) + F.col("m")[4 * i + 3]
    boxes = _boxes(_placed(a.crossJoin(F.broadcast(table)).select("__l", *[moved(i).alias(c) for i, c in enumerate(XYZ)])), "__l", [])  # few maps

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names_a, of_a = np.unique(p["a"].to_numpy(), return_inverse=True)
        names_b, of_b = np.unique(q["b"].to_numpy(), return_inverse=True)
        at, to = p[list(XYZ)].to_numpy(float), q[list(XYZ)].to_numpy(float)
        order, starts = _leaves(at, LEFT_BOX)
        order = order[np.lexsort((of_a[order], np.searchsorted(starts, np.arange(len(order)), "right")))]
        at, of_a = at[order], of_a[order]
        order, cells = _leaves(to, RIGHT_BOX)
        fixed, of_b = Block(to[order], cells), of_b[order]
        out = []
        for k, m in maps.items():
            m = np.array(m, float)
            gone = np.column_stack([at[:, 0] * r[0] + at[:, 1] * r[1] + at[:, 2] * r[2] + r[3] for r in m])
            counts = np.zeros((len(names_a), len(names_b)), np.int64)
            _count_block(Block(gone, starts), of_a, fixed, of_b, r2, counts)
            i, j = np.nonzero(counts)
            out.append(pd.DataFrame({"map": k, "a": names_a[i], "b": names_b[j], "n": counts[i, j]}))
        return pd.concat(out)

    return checkpointed(by_blocks(a, b, boxes, r2, run, schema).groupBy("map", "a", "b").agg(F.sum("n").alias("n")))


def _nearest_block(a: Block, b: Block, rank: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray]:
    """The least square distance under r2 of each point of a to those of b, and that point's
    place in b: of equal ones, the one of the smallest rank; infinite and -1 if there is none.
    The boxes nearest to a box come first; then those that may hold a nearer point."""
    best, of = np.full(len(a.p), np.inf), np.full(len(a.p), -1)
    for k, start in enumerate(a.starts):
        end = start + a.sizes[k]
        least, _ = b.reach(a.lo[k], a.hi[k])
        order = np.argsort(least)
        order = order[least[order] <= r2 * (1 + 1e-9)]
        done, take = 0, 4
        while done < len(order):
            now = order[done : done + take]
            bound = min(best[start:end].max(), r2) * (1 + 1e-9)
            now = now[least[now] <= bound]  # ascending: what is left out stays out
            if not len(now):
                break
            part = np.concatenate([np.arange(b.starts[x], b.starts[x] + b.sizes[x]) for x in now])
            part = part[np.argsort(rank[part])]
            d = _exact(a.p[start:end, None], b.p[part][None])
            at = d.argmin(axis=1)  # the first of equal ones
            d, at = d[np.arange(end - start), at], part[at]
            old = of[start:end]
            nearer = (d < r2) & ((d < best[start:end]) | (d == best[start:end]) & (rank[at] < rank[old]))
            best[start:end][nearer], of[start:end][nearer] = d[nearer], at[nearer]
            done, take = done + len(now), min(2 * take, 64)
    return best, of


def nearest_join(left: DataFrame, right: DataFrame, id_left: str, id_right: str, r2: float, by: list[str] = ()) -> DataFrame:
    """The nearest right point of each left one within the radius, ties to the smaller
    id (J16). Pairs aren't formed: a task takes a block of either side. Points without an id
    or a place have no row."""
    from tesselon.operators.relational import checkpointed

    clean = lambda df, of, name: checkpointed(_placed(df.select(*by, F.col(of).alias(name), *[F.col(c).cast("double").alias(c) for c in XYZ])).where(F.col(name).isNotNull()))
    a, b = clean(left, id_left, "a_id"), clean(right, id_right, "b_id")
    schema = ", ".join([*[f"`{c}` {a.schema[c].dataType.simpleString()}" for c in by], *[f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((a, "a_id"), (b, "b_id"))], "d2 double"])
    a, b = dealt(a, LEFT_BLOCK, "__l"), dealt(b, RIGHT_BLOCK, "__r")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        at, to = p[list(XYZ)].to_numpy(float), q[list(XYZ)].to_numpy(float)
        (order, starts), (other, cells) = _leaves(at, LEFT_BOX), _leaves(to, RIGHT_BOX)
        ids = q["b_id"].to_numpy()[other]
        best, of = _nearest_block(Block(at[order], starts), Block(to[other], cells), np.unique(ids, return_inverse=True)[1], r2)
        found = of >= 0
        return pd.DataFrame({**{c: [p[c].iloc[0]] * int(found.sum()) for c in by}, "a_id": p["a_id"].to_numpy()[order][found], "b_id": ids[of[found]], "d2": best[found]})

    near = by_blocks(a, b, _boxes(a, "__l", by), r2, run, schema, by)
    return near.groupBy(*by, "a_id").agg(F.min(F.struct("d2", "b_id")).alias("m")).select(*by, "a_id", "m.b_id", "m.d2")


def nearest_vertex(points: DataFrame, vertices: DataFrame, by: list[str], z_scale: float = 2.0) -> DataFrame:
    """The nearest vertex of the same block for each point, z scaled; ties to the
    smaller vertex (J17). Radii grow from the vertices' spacing: a point whose nearest vertex
    lies within a radius is done, and only the others look further, so the pairs examined
    grow with the points. Points without a place, or a vertex in their block, have no row."""
    from tesselon.operators.relational import checkpointed

    def placed(df: DataFrame, name: str) -> DataFrame:
        xyz = df.select(*by, name, *[(F.col(c) * (z_scale if c == "z" else 1.0)).cast("double").alias(c) for c in XYZ])
        return xyz.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ]))

    v = checkpointed(placed(vertices, "vertex"))
    left = checkpointed(placed(points, "point").join(v.select(*by).distinct(), by, "left_semi"))
    ends = v.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
    if not ends["n"]:
        return left.select(*by, "point", F.lit(None).cast(v.schema["vertex"].dataType).alias("vertex"), F.lit(None).cast("double").alias("d2")).where("false")
    sides = [ends[c] for c in XYZ if ends[c] > 0]
    radius = (reduce(lambda a, b: a * b, sides) / ends["n"]) ** (1 / len(sides)) if sides else 1.0
    done = []
    while not left.isEmpty():
        near = radius_join(left, v, "point", "vertex", radius * radius, False, by)
        found = checkpointed(near.groupBy(*by, F.col("a_id").alias("point")).agg(F.min(F.struct("d2", F.col("b_id").alias("vertex"))).alias("m")))
        done.append(found.select(*by, "point", "m.vertex", "m.d2"))
        left, radius = checkpointed(left.join(found, [*by, "point"], "left_anti")), 2 * radius
    return reduce(DataFrame.unionAll, done) if done else left.select(*by, "point", F.lit(None).cast(v.schema["vertex"].dataType).alias("vertex"), F.lit(None).cast("double").alias("d2"))
