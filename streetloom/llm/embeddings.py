"""Embedding near-dedup by collision counts over one-dimensional projections, inside cells of bands of projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_components, materialize
from .components import components
from .shingles import _lists

#: Projections whose windows are counted, and how many of them a pair must meet at least.
PROJECTIONS, COUNT = 16, 10
#: Share of true pairs (at the threshold exactly) that the windows, and as many that the bands may lose.
LOSS = 1e-4
#: About so many vectors of a label share a cell of a band, if they are spread evenly.
CELL_ROWS = 256
#: A task takes so many vectors of a cell at most; a fuller cell is compared block by block.
BLOCK_ROWS = 4_000
#: Queries compared at once in a task.
QUERIES = 256
#: Counts of so many full cells are broadcast at most (under 10 MB); more of them meet the rows in a shuffle.
MOST_SENT = 100_000


def _hit(half: float, distance: float, dims: int) -> float:
    """P(a projection of two unit vectors at that distance differs by at most half)."""
    return math.erf(half / (distance / math.sqrt(dims)) / math.sqrt(2))


def half_window(cosine: float, dims: int) -> float:
    """The least half window at which pairs at the threshold pass the count but for LOSS (normal approximation, bisected)."""
    distance = math.sqrt(max(1e-12, 2 - 2 * cosine))
    lo, hi = 0.0, 20 * distance
    for _ in range(60):
        mid = (lo + hi) / 2
        p = _hit(mid, distance, dims)
        passed = sum(math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k) for k in range(COUNT, PROJECTIONS + 1))
        lo, hi = (lo, mid) if passed >= 1 - LOSS else (mid, hi)
    return hi


def bands(rows: int, cosine: float) -> tuple[int, int]:
    """(bands, bits): a band's cell is the signs of `bits` projections; so many bands that all but LOSS of the pairs at the threshold share a cell."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / CELL_ROWS)))
    share = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return (1 if share == 1 else math.ceil(math.log(LOSS) / math.log(1 - share))), bits


def directions(dims: int, n: int, seed: int) -> np.ndarray:
    """(dims, n) random unit vectors; orthogonal by groups of `dims`."""
    rng, out = np.random.default_rng(seed), []
    for lo in range(0, n, dims):
        out.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, : n - lo])
    return np.concatenate(out, 1) if out else np.zeros((dims, 0))


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _meet(unit: np.ndarray, p: np.ndarray, cells: np.ndarray, n: np.ndarray, block: np.ndarray, band: int, half: float, cosine: float):
    """(links of each vector, ends a, ends b) of one cell's vectors, or of two blocks of it: then only across the blocks.

    Each projection is sorted; a query's window is a run of ranks. The runs that hold a pair are counted, pairs with
    COUNT of them are verified. A pair that shares a cell in an earlier band is left to that band.
    """
    order = np.argsort(p, axis=0, kind="stable")
    rank = np.empty(p.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(len(p), dtype=np.int32)[:, None], 0)
    lo, hi = np.empty(p.shape, np.int32), np.empty(p.shape, np.int32)
    for k in range(p.shape[1]):
        line = p[order[:, k], k]
        lo[:, k], hi[:, k] = np.searchsorted(line, p[:, k] - half, "left"), np.searchsorted(line, p[:, k] + half, "right")
    across = block[0] != block[-1]
    query, other = (np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])) if across else (np.arange(len(p)),) * 2
    sums, ends = np.zeros(len(p), np.int64), []
    ranks = np.ascontiguousarray(rank[other].T)
    for at in range(0, len(query), QUERIES):
        some = query[at: at + QUERIES]
        count = np.zeros((len(some), len(other)), np.int8)
        for k in range(p.shape[1]):
            count += (ranks[k] >= lo[some, k][:, None]) & (ranks[k] < hi[some, k][:, None])
        i, j = np.nonzero(count >= COUNT)
        i, j = some[i], other[j]
        if not across:
            i, j = i[i < j], j[i < j]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[near], j[near]
        fresh = ~(cells[i, :band] == cells[j, :band]).any(1)
        i, j = i[fresh], j[fresh]
        np.add.at(sums, i, n[j])
        np.add.at(sums, j, n[i])
        node, root = local_components(i, j)
        ends.append((root[node != root], node[node != root]))
    return sums, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


def link_vectors(vectors: DataFrame, cosine: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine, in double precision,
    is at least `cosine`. Null, empty or zero vectors, and those with a null or non-finite component, link with nothing:
    n_links 0, a component of their own. Equal vectors of a label are one class with a count, so copies aren't paired.
    Rows that repeat a vec_id are vectors of their own and count as links; vec_id is a whole number. Empty table: no
    rows. Other columns are ignored, whatever their names.

    A label's classes are dealt to cells: in each of several bands a cell is the signs of some projections, so many that
    a cell holds about CELL_ROWS however large the label is. Bands grow with a small power of its size (0.1 at 0.98), so
    do the copies of a vector. In a cell the windows of PROJECTIONS sorted projections are counted for each pair.
    """
    v = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e"), vectors["label"].alias("label"))
    # products of two components must neither overflow nor vanish: the operator scales by the largest one
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = materialize(v.select("vec_id", "label", fit.alias("fit"), F.when(fit, F.transform("e", lambda x: x + F.lit(0.0))).alias("e")).withColumn("hash", F.when(F.col("fit"), F.xxhash64("label", "e"))), "vectors")
    classes = rows.where("fit").groupBy("hash", "label", "e").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = materialize(classes.select("*", F.size("e").alias("dims"), F.monotonically_increasing_id().alias("cls")), "classes")
    sizes = classes.groupBy(F.col("label").alias("l"), F.col("dims").alias("d")).count()
    sized = classes.join(sizes, F.col("label").eqNullSafe(F.col("l")) & (F.col("dims") == F.col("d"))).select("label", "e", "cls", "n", "dims", "count")
    kind = vectors.schema["label"].dataType.simpleString()

    def deal(batches):
        for b in batches:
            dims, count = b.column(4).to_numpy(), b.column(5).to_numpy()
            for d, c in sorted(set(zip(dims.tolist(), count.tolist()))):
                t = b.filter(pa.array((dims == d) & (count == c)))
                many, bits = bands(c, cosine)
                unit = _unit(_vectors(t.column(1), d))
                sign = (unit @ directions(d, many * bits, 11) > 0).reshape(len(t), many, bits)
                cell = sign @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(t), many), np.int64)
                yield pa.record_batch({"label": t.column(0), "e": t.column(1), "cls": t.column(2), "n": t.column(3), "dims": t.column(4), "cells": _lists(list(cell))})

    dealt = materialize(sized.mapInArrow(deal, f"label {kind}, e array<double>, cls long, n long, dims int, cells array<long>"), "cells")
    key = ["label", "dims", "band", "cell"]
    spread = dealt.select("*", F.posexplode("cells").alias("band", "cell"))
    full = spread.groupBy(*key).count().where(F.col("count") > block_rows)
    full = materialize(full.select(*(F.col(c).alias(f"full_{c}") for c in key), F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "full")
    met = spread.join(F.broadcast(full) if full.count() <= MOST_SENT else full, [F.col(c) == F.col(f"full_{c}") for c in key], "left")
    # a class of a full cell goes to all pairs of blocks that its own block is in
    met = met.select("label", "e", "cls", "n", "dims", "cells", "band", "cell", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "e", "cls", "n", "dims", "cells", "band", "cell", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))

    def meet(key, table):
        dims, band = key[1].as_py(), key[2].as_py()
        unit, cls = _unit(_vectors(table.column("e"), dims)), table.column("cls").to_numpy()
        cells = np.asarray(table.column("cells").combine_chunks().flatten()).reshape(len(cls), -1)
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        unit, cls, cells, block, n = unit[order], cls[order], cells[order], table.column("block").to_numpy()[order], table.column("n").to_numpy()[order]
        if key[4] != key[5] and block[0] == block[-1]:
            sums, a, b = np.zeros(len(cls), np.int64), *np.zeros((2, 0), np.int64)
        else:
            sums, a, b = _meet(unit, unit @ directions(dims, PROJECTIONS, 7), cells, n, block, band, half_window(cosine, dims), cosine)
        some = np.flatnonzero(sums)
        return pa.table({"a": np.concatenate([cls[some], cls[a]]), "b": np.concatenate([cls[some], cls[b]]), "links": np.concatenate([sums[some], np.full(len(a), -1)])})

    found = materialize(met.groupBy(*key, "one", "two").applyInArrow(meet, "a long, b long, links long"), "links")
    links = found.where("links >= 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    groups = components(found.where("links < 0").select("a", "b"))
    named = classes.select("hash", "label", "e", "cls", "n", "low").join(links, F.col("cls") == F.col("c"), "left").join(groups, F.col("cls") == F.col("node"), "left")
    named = named.select("hash", "label", "e", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("g"))
    alone = classes.select("hash").distinct().count() == classes.count()  # no two classes share a hash
    named = materialize(named.drop(*(["label", "e"] if alone else [])), "named")
    least = named.groupBy("g").agg(F.min("low").alias("component_id"))
    named = named.join(least, "g").drop("g", "low")
    by = [c for c in ("hash", "label", "e") if c in named.columns]
    named = named.select(*(F.col(c).alias(f"class_{c}") for c in by), "n_links", "component_id")
    out = rows.select("vec_id", *by).join(named, [F.col(c) == F.col(f"class_{c}") for c in by], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
