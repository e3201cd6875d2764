"""Positions and rotations by least squares.

The normal equations of a collage are solved by elimination over a tree. Parts
are cut into blocks of ``BLOCK`` in the order of their ids. A block eliminates
the parts that are tied to no part outside it and hands what is left, the few
parts at its rim, to the next level, where two blocks meet, and so on; then
solutions go back down. So a level is one grouped pass, a collage of n parts
takes log2(n / ``BLOCK``) of them, and a task holds a block and the rims of
two. In a mosaic whose ids follow the scans rims are short; the largest rim,
not the collage, has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .placement import numbered

PAIR = ["collage_id", "image_a", "image_b"]
#: Parts of a block of the lowest level.
BLOCK = 256
_FRONT = "collage_id long, node long, kind string, ids array<int>, labels array<int>, inner int, matrix binary, right binary"


def _of_displacements(q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of pairs, in x and y of the first and of the second part."""
    h, g = np.zeros((len(q), 4, 4)), np.zeros((len(q), 4))
    for k, d in enumerate(("dx", "dy")):
        h[:, k, k] = h[:, 2 + k, 2 + k] = q["n"]
        h[:, k, 2 + k] = h[:, 2 + k, k] = -q["n"]
        g[:, k], g[:, 2 + k] = -q[d], q[d]
    return h, g


def _of_points(q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of pairs, in x, y, c and s of the first and of the second part."""
    h = np.zeros((len(q), 8, 8))
    for at, s in ((0, "a"), (4, "b")):
        own = h[:, at : at + 4, at : at + 4]
        own[:, 0, 0] = own[:, 1, 1] = q["n"]
        own[:, 2, 2] = own[:, 3, 3] = q[f"r{s}"]
        for i, j, v in ((0, 2, q[f"x{s}"]), (0, 3, -q[f"y{s}"]), (1, 2, q[f"y{s}"]), (1, 3, q[f"x{s}"])):
            own[:, i, j] = own[:, j, i] = v
    both = np.zeros((len(q), 4, 4))
    both[:, 0, 0] = both[:, 1, 1] = q["n"]
    both[:, 0, 2], both[:, 0, 3], both[:, 1, 2], both[:, 1, 3] = q["xb"], -q["yb"], q["yb"], q["xb"]
    both[:, 2, 0], both[:, 2, 1], both[:, 3, 0], both[:, 3, 1] = q["xa"], q["ya"], -q["ya"], q["xa"]
    both[:, 2, 2] = both[:, 3, 3] = q["dot"]
    both[:, 2, 3], both[:, 3, 2] = -q["cross"], q["cross"]
    h[:, :4, 4:], h[:, 4:, :4] = -both, -both.transpose(0, 2, 1)
    return h, np.zeros((len(q), 8))


def _join_labels(ids: list[int], have: dict[int, int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest image that each image hangs together with, by what was known of it (``have``) and by pairs."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in [*have.items(), *pairs]:
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in ids}


def _eliminate(a: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first n unknowns in terms of the others (weights, constants), and the equations of the others.

    Unknowns are measured by their columns. What the equations leave open gets
    the least value that fits.
    """
    size = np.sqrt(np.maximum(np.diag(a), 0.0))
    scale = np.where(size > 0, 1 / np.where(size > 0, size, 1.0), 0.0)
    inner = a[:n, :n] * np.outer(scale[:n], scale[:n])
    right = np.column_stack([a[:n, n:], g[:n]]) * scale[:n, None]
    at = np.flatnonzero(scale[:n])
    found = np.zeros_like(right)
    if len(at):
        inner, right = inner[np.ix_(at, at)], right[at]
        try:
            sure = np.diag(np.linalg.cholesky(inner)).min() > 1e-5
        except np.linalg.LinAlgError:
            sure = False
        if sure:
            found[at] = np.linalg.solve(inner, right)
        else:
            values, vectors = np.linalg.eigh(inner)
            good = values > 1e-11 * values.max()
            found[at] = vectors[:, good] @ ((vectors[:, good].T @ right) / values[good][:, None])
    found *= scale[:n, None]
    weights, constants = found[:, :-1], found[:, -1]
    return weights, constants, a[n:, n:] - a[n:, :n] @ weights, g[n:] - a[n:, :n] @ constants


def _solve(parts: DataFrame, pairs: DataFrame, normal: Callable, m: int, block: int) -> DataFrame:
    """(collage_id, image_id, known, values, component) of m unknowns each that fit best; ``known`` of ``parts`` are their values, nan where open. ``pairs``: sums that ``normal`` makes equations of."""
    order = parts if "position" in parts.columns else numbered(parts, "collage_id", "image_id")
    placed = materialize(order.withColumn("block", F.floor(F.col("position") / block)), "parts")
    side = lambda s: placed.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("known").alias(f"known_{s}"), F.col("block").alias(f"block_{s}"))
    tied = pairs.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"])
    # Two blocks meet where their numbers, halved again and again, are the same.
    level = F.ceil(F.log2(F.col("block_a").bitwiseXOR(F.col("block_b")) + 1.0)).cast("int")
    tied = materialize(tied.withColumn("level", level), "pairs")
    # A part is eliminated at the level of its furthest pair.
    ends = tied.select("collage_id", "level", F.explode(F.array("image_a", "image_b")).alias("image_id")).groupBy("collage_id", "image_id").agg(F.max("level").alias("last"))
    top = ends.agg(F.max("last")).first()[0] or 0
    keep = materialize if top else lambda df, _: df
    lasts = lambda s: ends.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("last").alias(f"last_{s}"))
    tied = keep(tied.join(lasts("a"), ["collage_id", "image_a"]).join(lasts("b"), ["collage_id", "image_b"]), "pairs")

    def climb(at: int) -> Callable:
        def run(key, fronts: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            ids = {int(i) for of in fronts["ids"] for i in of} | set(new["image_a"]) | set(new["image_b"])
            last = {int(i): n for s in ("a", "b") for i, n in zip(new[f"image_{s}"], new[f"last_{s}"], strict=True)}
            # What a front brings that no pair of this level names goes by the front's own note.
            for of, notes in zip(fronts["ids"], fronts["right"], strict=True):
                n = len(of)
                last |= dict(zip((int(i) for i in of), np.frombuffer(notes, float)[n * m :].astype(int).tolist(), strict=True))
            listed = sorted(ids, key=lambda i: (last[i] > at, i))
            n = sum(last[i] <= at for i in listed)
            where = {i: k * m for k, i in enumerate(listed)}
            a, g = np.zeros((len(listed) * m, len(listed) * m)), np.zeros(len(listed) * m)
            spread = lambda of: (np.array([where[int(i)] for i in of], int)[:, None] + np.arange(m)).ravel()
            for of, matrix, right in zip(fronts["ids"], fronts["matrix"], fronts["right"], strict=True):
                to = spread(of)
                a[np.ix_(to, to)] += np.frombuffer(matrix, float).reshape(len(to), len(to))
                g[to] += np.frombuffer(right, float)[: len(to)]
            if len(new):
                h, r = normal(new)
                known = np.concatenate([np.stack(new["known_a"].to_list()), np.stack(new["known_b"].to_list())], axis=1)
                free = np.isnan(known)
                r = np.where(free, r - np.einsum("pij,pj->pi", h, np.where(free, 0.0, known)), 0.0)
                h = h * free[:, :, None] * free[:, None, :]
                to = np.concatenate([spread(new["image_a"]).reshape(-1, m), spread(new["image_b"]).reshape(-1, m)], axis=1)
                np.add.at(a, (to[:, :, None], to[:, None, :]), h)
                np.add.at(g, to, r)
            weights, constants, a, g = _eliminate(a, g, n * m)
            have = {int(i): int(k) for of, labels in zip(fronts["ids"], fronts["labels"], strict=True) for i, k in zip(of, labels, strict=True)}
            labels = _join_labels(listed, have, list(zip(new["image_a"].tolist(), new["image_b"].tolist(), strict=True)))
            rim = listed[n:]
            out = [(key[0], key[1], "solved", listed, [labels[i] for i in listed], n, weights.tobytes(), constants.tobytes())]
            if rim:
                out.append((key[0], key[1] // 2, "front", rim, [labels[i] for i in rim], 0, a.tobytes(), np.concatenate([g, [last[i] for i in rim]]).tobytes()))
            return pd.DataFrame(out, columns=[c.split()[0] for c in _FRONT.split(", ")])

        return run

    fronts = placed.sparkSession.createDataFrame([], _FRONT)
    levels = []
    for at in range(top + 1):
        new = tied.where(F.col("level") == at).withColumn("node", F.floor(F.col("block_a") / 2**at)).drop("block_a", "block_b", "level")
        done = fronts.where("kind = 'front'").groupBy("collage_id", "node").cogroup(new.groupBy("collage_id", "node")).applyInPandas(climb(at), _FRONT)
        fronts = materialize(done, f"level{at}")
        levels.append(fronts.where("kind = 'solved'"))

    columns = ["collage_id", "node", "ids", "labels", "inner", "values"]

    def descend(key, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.assign(values=None)[columns]
        final = dict(zip(above["ids"].iloc[0], above["labels"].iloc[0], strict=True)) if len(above) else {}
        values = dict(zip((int(i) for i in above["ids"].iloc[0]), np.frombuffer(above["values"].iloc[0]).reshape(-1, m), strict=True)) if len(above) else {}
        out = []
        for r in own.itertuples():
            rim = [values[int(i)] for i in r.ids[r.inner :]]
            rest = np.concatenate(rim) if rim else np.zeros(0)
            found = np.frombuffer(r.right) - np.frombuffer(r.matrix).reshape(r.inner * m, len(rest)) @ rest
            # A part hangs together with what the rim that it hangs together with does.
            named = {k: final[i] for i, k in zip(r.ids[r.inner :], r.labels[r.inner :], strict=True)}
            out.append((r.collage_id, r.node, r.ids, [named.get(k, k) for k in r.labels], r.inner, np.concatenate([found, rest]).tobytes()))
        return pd.DataFrame(out, columns=columns)

    solved, found = None, []
    schema = "collage_id long, node long, ids array<int>, labels array<int>, inner int, values binary"
    none = placed.sparkSession.createDataFrame([], schema)
    for own in reversed(levels):
        above = none if solved is None else solved
        # A node's rim is part of what the node above has solved.
        below = own.withColumn("up", F.floor(F.col("node") / 2)).groupBy("collage_id", "up").cogroup(above.withColumn("up", F.col("node")).groupBy("collage_id", "up")).applyInPandas(descend, schema)
        solved = materialize(below, "solved")
        found.append(solved)

    def unpack(batches):
        for batch in batches:
            rows = [(c, int(i), int(k), v) for c, ids, labels, n, values in zip(batch["collage_id"], batch["ids"], batch["labels"], batch["inner"], batch["values"], strict=True) for i, k, v in zip(ids[:n], labels, np.frombuffer(values).reshape(-1, m).tolist())]
            yield pd.DataFrame(rows, columns=["collage_id", "image_id", "component", "found"])

    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    values = all_.mapInPandas(unpack, "collage_id long, image_id int, component int, found array<double>")
    one = lambda k: F.when(F.isnan(F.col("known")[k]), F.coalesce(F.col("found")[k], F.lit(0.0))).otherwise(F.col("known")[k])
    return placed.join(values, ["collage_id", "image_id"], "left").select("collage_id", "image_id", "known", F.array(*(one(k) for k in range(m))).alias("values"), F.coalesce("component", "image_id").alias("component"))


def _known(*cells: F.Column) -> F.Column:
    return F.array(*(F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in cells)).alias("known")


def _keys(parts: DataFrame) -> list[str]:
    """The key of a part, and its index within the collage if it is known (``pin_first`` gives it)."""
    return ["collage_id", "image_id", *(c for c in ["position"] if c in parts.columns)]


def _between(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose two images are parts, and different ones."""
    ids = parts.select("collage_id", "image_id")
    side = lambda s: ids.withColumnRenamed("image_id", f"image_{s}")
    return rows.where("image_a <> image_b").join(side("a"), ["collage_id", "image_a"], "left_semi").join(side("b"), ["collage_id", "image_b"], "left_semi")


def solve_positions(parts: DataFrame, displacements: DataFrame, block: int = BLOCK) -> DataFrame:
    """(collage_id, image_id, x, y, component) that fit -p_a + p_b = d best; cells of ``parts`` that are set stay.

    Parts that nothing fixes get the least solution: what hangs together has the
    mean 0. ``component`` is the smallest image that a part hangs together with.
    """
    d = _between(parts, displacements.select(*PAIR, "dx", "dy"))
    sums = d.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    named = _solve(parts.select(*_keys(parts), _known(F.col("x"), F.col("y"))), sums, _of_displacements, 2, block)
    axis = lambda k: F.when(F.max(~F.isnan(F.col("known")[k])), F.lit(0.0)).otherwise(F.avg(F.col("values")[k]))
    shift = named.groupBy("collage_id", "component").agg(axis(0).alias("mean_x"), axis(1).alias("mean_y"))
    return named.join(shift, ["collage_id", "component"]).select("collage_id", "image_id", (F.col("values")[0] - F.col("mean_x")).alias("x"), (F.col("values")[1] - F.col("mean_y")).alias("y"), "component")


def residuals(positions: DataFrame, displacements: DataFrame) -> DataFrame:
    """Achieved displacements and how far they are from the measured ones."""
    side = lambda s: positions.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    both = displacements.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"])
    return both.select("collage_id", "image_a", "image_b", (F.col("xb") - F.col("xa") - F.col("dx")).alias("rx"), (F.col("yb") - F.col("ya") - F.col("dy")).alias("ry"))


def layout_error(rest: DataFrame) -> DataFrame:
    """The largest residual of all; 0 if there are none."""
    return rest.agg(F.coalesce(F.max(F.greatest(F.abs("rx"), F.abs("ry"))), F.lit(0.0)).alias("error"))


def solve_layout(parts: DataFrame, correspondences: DataFrame, block: int = BLOCK) -> DataFrame:
    """(collage_id, image_id, x, y, c, s) that put corresponding points (xa, ya) and (xb, yb) on each other best.

    ``parts`` has x, y and dangle_deg, null where open. The fitted (c, s) may stretch. Parts that nothing fixes are 0.
    """
    q = _between(parts, correspondences.select(*PAIR, *(F.col(c).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb"))))
    x = {c: F.col(c) for c in ("xa", "ya", "xb", "yb")}
    sums = {"ra": x["xa"] * x["xa"] + x["ya"] * x["ya"], "rb": x["xb"] * x["xb"] + x["yb"] * x["yb"], "dot": x["xa"] * x["xb"] + x["ya"] * x["yb"], "cross": x["xa"] * x["yb"] - x["ya"] * x["xb"]}
    moments = q.groupBy(*PAIR).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in (x | sums).items()))
    turn = F.radians(F.col("dangle_deg"))
    solved = _solve(parts.select(*_keys(parts), _known(F.col("x"), F.col("y"), F.cos(turn), F.sin(turn))), moments, _of_points, 4, block)
    return solved.select("collage_id", "image_id", *(F.col("values")[k].alias(c) for k, c in enumerate(("x", "y", "c", "s"))))
