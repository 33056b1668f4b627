"""SimHash near-duplicate groups by pivot distance tables.

Fingerprints that differ in at most `radius` bits are linked. Pairs to look at come from cells. In a cell,
each fingerprint's Hamming distances to many reference fingerprints (the pivot table) are computed once; a
pair is dropped when any coordinate differs by more than the radius (triangle inequality), and survivors are
verified bit by bit. Cells of more than `cell_rows` rows are cut into chunks whose pairs are separate groups,
so no task holds an unbounded cell and nothing is skipped. A cell yields a spanning forest of its links, not
its pairs: as many rows as it has members at most.

There are two kinds of fingerprints and cells:
 - `near_duplicates`: 64 bits, few of them different. The bits are cut into `blocks` blocks, and by the
   pigeonhole principle two linked fingerprints agree on at least blocks - radius of them, so every choice of
   that many blocks gives one cell key. Exact.
 - `near_copies`: WIDE bits over five-word shingles, for texts of shingle likeness 0.8 or more. Two such texts
   differ in so many bits that no block need agree, so cells are the BANDS joint minima of BAND_ROWS seeded
   hashes of their shingles: a pair of likeness j shares one with probability 1 - (1 - j^BAND_ROWS)^BANDS,
   0.9997 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import checkpointed, connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 5
PIVOTS = 32
CELL_ROWS = 1024

#: Near copies: words of a shingle and 64-bit words of a fingerprint.
WIDE_SHINGLE, WIDE = 5, 4
#: Bits of 256 that texts of likeness 0.8 differ in: 256 acos(2 * 0.8 / 1.8) / pi = 38.8 on average, 5.7 around it.
WIDE_RADIUS = 45
BANDS, BAND_ROWS = 16, 4
WIDE_PIVOTS = 8
#: Words whose hashes a worker keeps; past that it forgets them all and starts over.
CACHE = 100_000
#: Rows that a worker compares at once, whole cells and one cell at least.
STEP_ROWS = 32_768


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 for null or no words. Fewer words than a shingle: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), ">u8", len(grams))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_seeds = _mix(np.arange(1, 1 + WIDE + BANDS * BAND_ROWS + WIDE_SHINGLE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: str | None, cache: dict[bytes, int], shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Hash of each word shingle of a whole text, repeats included; of the whole sequence where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(cache) > CACHE:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = _mix(out * _seeds[-1] + h[k : len(h) - n + 1 + k])
    return out


def wide_print(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's fingerprint of WIDE words, and its BANDS cell keys, from its shingles' hashes. No shingles: all zero."""
    if not len(hashes):
        return np.zeros(WIDE, np.uint64), np.zeros(BANDS, np.uint64)
    counts = np.zeros(64 * WIDE, np.int64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        bits = np.stack([_mix(some ^ s) for s in _seeds[:WIDE]], 1).view(np.uint8).reshape(len(some), -1)
        counts += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
        least = np.minimum(least, ((some[None, :] ^ _seeds[WIDE : WIDE + len(least), None]) * np.uint64(0x9E3779B97F4A7C15)).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64), key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) per row of docs; the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "fp": np.array(fps, np.int64)})

    # ids travel as text, as pandas would turn long ids beside a null into floating point
    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("t")).mapInPandas(run, "id string, fp long")
    return made.select(F.col("id").cast(kind).alias("id"), "fp")


def pivots(n: int = PIVOTS, seed: int = SEED, words: int = 1) -> np.ndarray:
    """Reference fingerprints, drawn once from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, (n, words), np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64)[:, None] % np.uint64(2)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return sum(np.bitwise_count(fps[:, None, k] ^ refs[None, :, k]).astype(np.int16) for k in range(fps.shape[1]))


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of blocks - radius blocks."""
    edge = np.linspace(0, 64, blocks + 1).astype(int)
    part = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edge, edge[1:])]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component under the links i-j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while ((up := root[root]) != root).any():
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def _links(key: np.ndarray, fps: np.ndarray, side: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions among rows sorted by key; rows of one side (1 or 2) are compared with the other side only."""
    table = pivot_table(fps, refs)
    found_i, found_j = [], []
    step, n = 1, len(key)
    at = np.arange(n)
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        i, j = at, at + step
        ok = (side[i] == 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        near = np.abs(table[i] - table[j]).max(1, initial=0) <= radius
        i, j = i[near], j[near]
        true = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= radius
        found_i.append(i[true])
        found_j.append(j[true])
        step += 1
    return np.concatenate(found_i or [at]), np.concatenate(found_j or [at])


def _cell_edges(radius: int, n_pivots: int, words: int):
    """Kernel over rows sorted by cell: yields the spanning links of each cell. A cell cut by a batch is carried on."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots(n_pivots, words=words)
        held: list[pd.DataFrame] = []
        size = 0

        def edges(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf["cell"].to_numpy()
            ids = pdf["id"].to_numpy()
            i, j = _links(key, pdf[names].to_numpy().astype(np.uint64), pdf["side"].to_numpy(), refs, radius)
            root = _roots(len(key), i, j)
            far = root != np.arange(len(key))
            return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size < STEP_ROWS or pdf["cell"].iloc[0] == pdf["cell"].iloc[-1]:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["cell"] == whole["cell"].iloc[-1]
            yield edges(whole[~last])
            held, size = [whole[last]], int(last.sum())
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return run


def _edges(cells: DataFrame, radius: int, n_pivots: int, cell_rows: int, words: int) -> DataFrame:
    """Spanning links (a, b) of the rows (cell long, id long, f0 long, f1 ...) that share a cell."""
    names = [f"f{k}" for k in range(words)]
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    cells = cells.join(sizes, "cell")
    chunks = F.ceil(F.col("n") / cell_rows).cast("int")
    mine = F.pmod(F.xxhash64(*names, F.lit(SEED)), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    whole = cells.where(F.col("n") <= cell_rows).select("cell", "id", *names, F.lit(0).alias("side"))
    parts = cells.where(F.col("n") > cell_rows).select("cell", "id", *names, mine.alias("mine"), other).select(
        F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "id", *names,
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(parts).repartition(n, "cell").sortWithinPartitions("cell", "id")
    return dealt.mapInPandas(_cell_edges(radius, n_pivots, words), "a long, b long")


def link_edges(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints. points: (id long, fp long), one row per fingerprint."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, radius)])
    cells = points.select("id", "fp", F.posexplode(masks).alias("t", "mask")).select(
        F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("cell"), "id", F.col("fp").alias("f0")
    )
    return _edges(cells, radius, n_pivots, cell_rows, 1)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, **options) -> DataFrame:
    """(id, fingerprint, component_id) per row of docs.

    Equal fingerprints collapse before any pairing, so a group of exact copies costs one row. Null and
    empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are kept. A row
    without an id links others like any row; component_id is the smallest id of a group that is not null, and
    null where a group has none. An empty table gives no rows; other columns of docs are ignored.
    """
    shingle = options.pop("shingle", SHINGLE)
    fps = checkpointed(fingerprints(docs, text, id_col, shingle))
    points = fps.groupBy("fp").agg(F.min("id").alias("id"))
    comps = connected_components(link_edges(points.select(F.col("fp").alias("id"), "fp"), radius, **options))
    classes = points.join(comps, points["fp"] == comps["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    first = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = classes.join(first, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_prints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with f0.. (the fingerprint's words) and cells (array of its cell keys)."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHashes()
        for pdf in batches:
            made = [wide_print(shingle_hashes(t, cache)) for t in pdf["_text"]]
            out = pdf[keep].copy()
            fps = np.array([m[0] for m in made], np.uint64).reshape(-1, WIDE).view(np.int64)
            for k in range(WIDE):
                out[f"f{k}"] = fps[:, k]
            out["cells"] = [m[1].view(np.int64) for m in made]
            yield out

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = ", ".join([kinds, *[f"f{k} long" for k in range(WIDE)], "cells array<long>"])
    return docs.select(*[f"`{c}`" for c in keep], F.col(text).alias("_text")).mapInPandas(run, schema)


def near_copies(docs: DataFrame, text: str = "text", radius: int = WIDE_RADIUS, n_pivots: int = WIDE_PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs (any columns that are never null, and the text) with `group` in the text's place: equal for rows linked by near copies.

    Links are fingerprints of five-word shingles within `radius` of 256 bits that share a cell. Equal
    fingerprints collapse before any pairing. Null and empty texts have fingerprint zero and one group.
    """
    names = [f"f{k}" for k in range(WIDE)]
    keep = [c for c in docs.columns if c != text]
    prints = checkpointed(wide_prints(docs, text).withColumn("_print", F.xxhash64(*names)))
    points = prints.groupBy("_print", *names).agg(F.min("cells").alias("cells"))
    cells = points.select(F.explode("cells").alias("cell"), F.col("_print").alias("id"), *names)
    comps = connected_components(_edges(cells, radius, n_pivots, cell_rows, WIDE))
    return prints.join(comps.withColumnRenamed("node", "_print"), "_print", "left").select(*[f"`{c}`" for c in keep], F.coalesce("component", "_print").alias("group"))


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near copies: of smallest id (null last), then of smallest hash over all columns.

    Rows that share an id are told apart by their content: those that are no near copies all stay. Of rows
    that agree in every column one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    content = [F.coalesce(c.cast("string"), F.lit("")) for c in columns] + [c.isNull() for c in columns]
    h, g = F.xxhash64(*content), F.xxhash64(F.lit(1), *content)
    own = F.col(f"`{id_col}`")
    groups = near_copies(docs.select(own.isNull().alias("none"), F.coalesce(own.cast("long"), F.lit(0)).alias("id"), h.alias("h"), g.alias("g"), F.col(f"`{text}`").alias("_body")), "_body", **options)
    first = groups.groupBy("group").agg(F.min(F.struct("none", "id", "h", "g")).alias("least")).select(F.col("least.h").alias("_h"), F.col("least.g").alias("_g"))
    # rows that repeat go before the join, map-side first
    rows = docs.withColumn("_h", h).withColumn("_g", g).dropDuplicates(["_h", "_g"])
    return rows.join(first, ["_h", "_g"]).select(*columns)
