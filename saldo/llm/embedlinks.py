"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so "cosine at least c" is a range join of radius
eps = sqrt(2 - 2c). Pivots, drawn from the vectors by a hash and growing in number with them, cut space into
cells: a vector's home is its nearest pivot's cell. A vector y of another cell can be within eps of some x at
home in cell p only if
 - by the triangle inequality, d(y, p) <= R_p + eps, with R_p the largest distance of a home row to p, and
 - y is within eps of the half-space that is closer to p than to y's own pivot:
   (d(y, p)^2 - d(y, own)^2) / (2 d(p, own)) <= eps;
then, and only then, y is replicated into cell p as a partner. Of two cells the one of smaller number gets the
other's partners, so each pair meets once. Cells are joined independently, in tiles: a cell's home rows are cut
into chunks by a hash and its partners into slices, and a task streams one slice past one chunk. It holds
about `chunk_rows` home rows and BLOCK partners, whatever the size of the table or of a cell. Pairs are
decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import checkpointed, connected_components

THRESHOLD = 0.9
#: Home rows of a tile, and of a cell while there are fewer than MAX_PIVOTS pivots.
CHUNK_ROWS = 16_384
#: Bound on the pivots, and so on what is broadcast (MAX_PIVOTS x dimension doubles for each of DIMS dimensions).
MAX_PIVOTS = 1024
#: Vector lengths with pivots, the most frequent ones; each other length is one cell, of chunks like any.
DIMS = 4
#: Partners of a slice are a part of all vectors of their length, of so many at least.
SLICE_ROWS = 32_768
BLOCK = 2048
SLACK = 1e-9
#: Single precision finds the pairs to decide; its error on unit vectors stays far below this.
COARSE = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares then neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(vectors, dtype: str) -> np.ndarray:
    return np.array(list(vectors), dtype).reshape(len(vectors), -1)


def valid(col) -> F.Column:
    """Whether a vector can link: not null, no null or non-finite component, not all zero."""
    bad = F.exists(col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(col.isNotNull() & ~bad & F.exists(col, lambda v: v != 0), F.lit(False))


class Cells:
    """Pivots by vector length. Cells of a length with pivots are numbered from `first`; any other length n is cell -n."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))
        self.between = {n: np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 0)) for n, p in pivots.items()}

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors of one length: home cell, squared distances to the length's pivots, and to their own."""
        n = x.shape[1]
        if n not in self.pivots:
            return np.full(len(x), -n), np.zeros((len(x), 1)), np.zeros(len(x))
        d2 = np.maximum(2 - 2 * x @ self.pivots[n].T, 0)
        own = d2.argmin(1)
        return self.first[n] + own, d2, d2[np.arange(len(x)), own]


def _by_length(pdf: pd.DataFrame, dtype: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    lengths = pdf["v"].map(len)
    for n in sorted(set(lengths)):
        some = pdf[lengths == n]
        yield some, _matrix(some["v"], dtype)


def _homes(points: DataFrame, cells: Cells, dtype: str) -> pd.DataFrame:
    """Per cell: its reach (largest distance of a home row) and number of home rows. One row a cell comes to the driver."""
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, raw in _by_length(pdf, dtype):
                cell, _, own = shared.value.home(_unit(raw))
                yield pd.DataFrame({"cell": cell, "d": np.sqrt(own)})

    return points.select("v").mapInPandas(run, "cell int, d double").groupBy("cell").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("n")).toPandas()


TILES = "cell int, chunk int, slice int, kind int, key long, n long, raw binary"


def _tiles(points: DataFrame, cells: Cells, homes: pd.DataFrame, eps: float, dtype: str, chunk_rows: int, slice_rows: int) -> DataFrame:
    """The rows (TILES) of all tiles; kind is 0 for a chunk's home rows and 1 for partners."""
    reach = dict(zip(homes["cell"], homes["reach"]))
    chunks = {c: -(-n // chunk_rows) for c, n in zip(homes["cell"].tolist(), homes["n"].tolist())}
    length = {first + k: n for n, first in cells.first.items() for k in range(len(cells.pivots[n]))}
    rows: dict[int, int] = {}
    for c, n in zip(homes["cell"].tolist(), homes["n"].tolist()):
        rows[length.get(c, -c)] = rows.get(length.get(c, -c), 0) + n
    shared = points.sparkSession.sparkContext.broadcast((cells, reach, chunks, {n: -(-r // slice_rows) for n, r in rows.items()}))

    def deal(pdf: pd.DataFrame, raw: np.ndarray) -> Iterator[pd.DataFrame]:
        cells, reach, chunks, slices = shared.value
        n = raw.shape[1]
        cell, d2, own = cells.home(_unit(raw))
        key = pdf["key"].to_numpy()
        some = (key * 0x9E3779B1) & 0x7FFFFFFF  # spread; keys of a partition are consecutive
        parts = slices[n]
        mine = some % np.array([chunks[c] for c in cell.tolist()])
        cut = (some >> 8) % parts
        at = np.arange(len(raw))
        # home rows go to all slices of their chunk
        found = [(np.repeat(at, parts), np.repeat(cell, parts), np.repeat(mine, parts), np.tile(np.arange(parts), len(at)), 0)]
        # and as partners to the earlier chunks of their cell
        rep = np.repeat(at, mine)
        found.append((rep, cell[rep], np.arange(len(rep)) - np.repeat(np.cumsum(mine) - mine, mine), cut[rep], 1))
        if n in cells.pivots:
            first = cells.first[n]
            far = np.array([reach.get(first + k, -4.0) for k in range(len(cells.pivots[n]))])
            gap = d2 - own[:, None]
            near = (np.sqrt(d2) <= far[None, :] + eps + SLACK) & (gap <= 2 * (eps + SLACK) * cells.between[n][:, cell - first].T)
            near &= np.arange(len(far))[None, :] < (cell - first)[:, None]
            row, to = np.nonzero(near)
            many = np.array([chunks.get(first + k, 0) for k in range(len(far))])[to]
            rep = np.repeat(np.arange(len(row)), many)
            found.append((row[rep], first + to[rep], np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many), cut[row[rep]], 1))
        packed = raw.tobytes()
        width = raw.itemsize * n
        packed = np.array([packed[k : k + width] for k in range(0, len(packed), width)], object)
        weight = pdf["n"].to_numpy()
        for row, c, chunk, piece, kind in found:
            for k in range(0, len(row), 8192):
                r = row[k : k + 8192]
                yield pd.DataFrame({"cell": c[k : k + 8192], "chunk": chunk[k : k + 8192], "slice": piece[k : k + 8192], "kind": kind, "key": key[r], "n": weight[r], "raw": packed[r]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, raw in _by_length(pdf, dtype):
                yield from deal(some, raw)

    return points.select("key", "n", "v").mapInPandas(run, TILES)


class _Rows:
    """Rows of one kind of one tile."""

    def __init__(self, keys: list, weights: list, raws: list, dtype: str):
        self.key, self.weight = np.concatenate(keys), np.concatenate(weights)
        raws = [r for part in raws for r in part]
        self.raw = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1)
        self.unit = _unit(self.raw)
        self.fast = self.unit.astype(np.float32)


def _pairs(a: _Rows, b: _Rows, threshold: float, within: bool, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions of a and b, block by block; within one set (a is b) each pair once."""
    for p in range(0, len(a.key), block):
        for q in range(p if within else 0, len(b.key), block):
            cos = a.fast[p : p + block] @ b.fast[q : q + block].T
            i, j = np.nonzero(cos >= threshold - COARSE)
            i, j = i + p, j + q
            if within:
                i, j = i[i < j], j[i < j]
            exact = np.concatenate([np.einsum("ij,ij->i", a.unit[i[k : k + 65536]], b.unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            ok = exact >= threshold
            for k in np.flatnonzero(np.abs(exact - threshold) <= SLACK):  # on the edge: the plain formula on the vectors as given
                x, y = a.raw[i[k]].astype(float), b.raw[j[k]].astype(float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                ok[k] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
            if ok.any():
                yield i[ok], j[ok]


class _Tile:
    """One chunk of home rows, against which a slice of partners is streamed."""

    def __init__(self, home: _Rows, threshold: float, first: bool, block: int):
        self.home, self.threshold, self.block = home, threshold, block
        self.root = np.arange(len(home.key))
        self.links = np.zeros(len(home.key), np.int64)
        if first:  # the pairs within the chunk are looked at with its first slice
            for i, j in _pairs(home, home, threshold, True, block):
                self.links += np.bincount(i, home.weight[j], len(self.root)).astype(np.int64) + np.bincount(j, home.weight[i], len(self.root)).astype(np.int64)
                self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            p, q = root[i], root[j]
            low = np.minimum(p, q)
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            while ((up := root[root]) != root).any():
                root = up
            keep = root[i] != root[j]
            i, j = i[keep], j[keep]
        self.root = root

    def partners(self, other: _Rows) -> pd.DataFrame:
        """Weight of each linked partner's links here, and a link to one of them."""
        links = np.zeros(len(other.key), np.int64)
        to = np.full(len(other.key), -1)
        for i, j in _pairs(self.home, other, self.threshold, False, self.block):
            self.links += np.bincount(i, other.weight[j], len(self.root)).astype(np.int64)
            links += np.bincount(j, self.home.weight[i], len(links)).astype(np.int64)
            to[j] = np.where(to[j] < 0, i, to[j])  # of several, the one written last; all are joined with it
            self.join(i, to[j])
        hit = np.flatnonzero(to >= 0)
        return pd.DataFrame({"key": other.key[hit], "links": links[hit], "to": self.home.key[to[hit]]})

    def done(self) -> pd.DataFrame:
        hit = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return pd.DataFrame({"key": self.home.key[hit], "links": self.links[hit], "to": self.home.key[self.root[hit]]})


def _join_tiles(threshold: float, dtype: str, block: int):
    """Kernel over rows sorted by tile, home rows first: yields weight of links and one link per linked row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tile = None, None
        home: tuple[list, list, list] = ([], [], [])
        some: tuple[list, list, list] = ([], [], [])

        def rows(held) -> _Rows:
            out = _Rows(*held, dtype)
            for part in held:
                part.clear()
            return out

        def opened():
            return tile if tile is not None else _Tile(rows(home), threshold, now[2] == 0, block) if home[0] else None

        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf[["cell", "chunk", "slice", "kind"]].to_numpy()
            cuts = np.r_[0, np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1, len(code)]
            for a, b in zip(cuts, cuts[1:]):
                if now is None or tuple(code[a, :3]) != now:
                    if now is not None and (tile := opened()) is not None:
                        if some[0]:
                            yield tile.partners(rows(some))
                        yield tile.done()
                    now, tile = tuple(code[a, :3]), None
                    for part in (*home, *some):
                        part.clear()
                into = some if code[a, 3] else home
                for part, column in zip(into, ("key", "n", "raw")):
                    part.append(pdf[column].to_numpy()[a:b])
                if code[a, 3] and sum(map(len, some[0])) >= block:
                    tile = opened()
                    got = rows(some)
                    if tile is not None:
                        yield tile.partners(got)
        if now is not None and (tile := opened()) is not None:
            if some[0]:
                yield tile.partners(rows(some))
            yield tile.done()

    return run


def near_duplicates(vectors: DataFrame, *, vector: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, max_pivots: int = MAX_PIVOTS, chunk_rows: int = CHUNK_ROWS, slice_rows: int = SLICE_ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) per row of vectors.

    Vectors that are null, zero, or hold a null or non-finite component link with nothing; vectors of
    different lengths don't link. Equal vectors collapse to one weighted row first, so copies cost one row.
    Rows that repeat an id, and rows without one, are rows of their own: each is counted as a link and each is
    returned. component_id is the smallest id of a component that is not null, null where it has none. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    dtype = "float32" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "float64"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>" if dtype == "float32" else "array<double>").alias("v"))
    good = rows.where(valid(F.col("v"))).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    # equal vectors by a hash of 128 bits; an internal key of its own for each, as ids may be null or repeat
    points = good.groupBy("h", "g").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = checkpointed(points.withColumn("key", F.monotonically_increasing_id()))
    pivots: dict[int, np.ndarray] = {}
    for dim, total in points.groupBy(F.size("v")).count().orderBy(F.desc("count"), F.size("v")).limit(DIMS).collect():
        many = min(max_pivots, -(-total // chunk_rows))
        share = min(1.0, 4 * many / total)
        drawn = points.where((F.size("v") == dim) & (F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))).orderBy("h", "g").limit(many).toPandas()
        if len(drawn):
            pivots[dim] = _unit(_matrix(drawn["v"], dtype))
    cells = Cells(pivots)
    dealt = _tiles(points, cells, _homes(points, cells, dtype), eps, dtype, chunk_rows, slice_rows)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "cell", "chunk", "slice").sortWithinPartitions("cell", "chunk", "slice", "kind")
    found = checkpointed(dealt.mapInPandas(_join_tiles(threshold, dtype, block), "key long, links long, to long"))
    comps = connected_components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    per = (
        points.select("key", "h", "g", "id", "n")
        .join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
        .join(comps.withColumnRenamed("node", "key"), "key", "left")
        .select("h", "g", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("root"))
    )
    per = per.join(per.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("h", "g", "n_links", "component_id")
    linked = good.select("id", "h", "g").join(per, ["h", "g"]).select("id", "n_links", "component_id")
    return linked.unionByName(rows.where(~valid(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
