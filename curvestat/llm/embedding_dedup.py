"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are padded to a multiple of 64 coordinates and turned by random rotations;
the signs of the turned coordinates are a vector's binary code. Of the first rotation
each vector also stores its correction factor, the inner product of the vector with its own
code, read as a unit vector. For another vector's turned coordinates q, <code, q> / factor is an unbiased
estimate of the inner product, off by more than ``DEVIATIONS`` times
sqrt((1 - factor^2) / factor^2 / (d - 1)) with a probability below 1e-6. Pairs whose estimates,
either way round, can't reach ``LIKE`` within that bound are given up; all others are recomputed
from the vectors in double precision, and only that decides on a link.

Pairs meet in bands of code bits. Two vectors at a cosine of ``LIKE`` differ in a sign
with probability acos(LIKE) / pi, so bands of b bits meet with p^b each; b follows the logarithm of
the number of vectors, so that few meet by chance, and there are as many bands
as leave a pair at ``LIKE`` apart with probability ``MISSED`` or less (one closer far less).
Vectors travel only with bands in which they meet another. A band's vectors are compared in tiles of
``TILE`` by ``TILE``; a tile counts a pair only in the first band that both share, and yields sums
for each vector and a spanning set of its links, never pairs.

Equal vectors are one node with a weight. Components are found by contraction.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different lengths don't link; repeated rows are vectors of their own and
link like equal ones; a null vec_id counts, but is a component's smallest only where it has no other, and isn't kept; an empty
table gives an empty result; other columns (labels too) are ignored. A dense
band of m different vectors is m^2 / TILE^2 tiles, each bounded: all its pairs are compared, as n_links asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.llm.common import cut, few
from curvestat.llm.graph import components

LIKE = 0.95
MISSED = 1e-5
DEVIATIONS = 5.0
#: Vectors on a side of a tile, rows of tiles that go to a task together, and rows of a band whose pairs are listed at once with those of others.
TILE, TOGETHER, SMALL = 512, 4096, 32
#: Pairs that one step compares.
PAIRS = 1 << 14
#: Bits of a band beyond the logarithm of the number of vectors, the least and the most.
SPARE_BITS, LEAST_BITS, MOST_BITS = 5, 8, 40
SEED = 13
WORD = 64
#: Bands' keys of several vectors that are made at once.
BLOCK = 1 << 10
MOST_BROADCAST = 500_000


def bands(n: int) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) + SPARE_BITS))
    meets = (1 - math.acos(LIKE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-meets))


def padded(d: int) -> int:
    return max(WORD, -(-d // WORD) * WORD)


@cache
def rotation(d: int, number: int) -> np.ndarray:
    """A random rotation of d coordinates, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)))


def units(flat: np.ndarray, d: int) -> np.ndarray:
    """Rows of unit vectors, padded with zeros."""
    x = flat.reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    out = np.zeros((len(x), padded(d)))
    out[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def band_keys(unit: np.ndarray, bits: int, many: int) -> np.ndarray:
    """Keys of each vector's bands, one column a band."""
    d = unit.shape[1]
    signs = np.concatenate([unit @ rotation(d, i) > 0 for i in range(-(-bits * many // d))], axis=1)[:, : bits * many]
    value = signs.reshape(len(unit), many, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return value | (np.arange(many, dtype=np.int64) << MOST_BITS)


def code(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed code of the first rotation and correction factor of each vector."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def slack(factor: np.ndarray, d: int) -> np.ndarray:
    """How far estimates from each code may be off."""
    return DEVIATIONS * np.sqrt((1 - factor**2).clip(0) / factor**2 / (d - 1))


def signs(packed: np.ndarray, d: int) -> np.ndarray:
    """A code's coordinates times the root of d."""
    return np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1


def possible(turned: np.ndarray, coded: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the inner product of each vector (turned coordinates) with each coded vector can reach LIKE, by estimate and bound."""
    d = turned.shape[1]
    return turned @ coded["signs"].T / math.sqrt(d) / coded["factor"] + coded["slack"] >= LIKE


def _exact(v: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of rows that met in these bands that are linked and share no band before it."""
    out = [(i[:0], j[:0])]
    for at in range(0, len(i), PAIRS):
        x, y, t = (a[at : at + PAIRS] for a in (i, j, band))
        # the first band that both share: argmax finds the first True
        new = (v["keys"][x] == v["keys"][y]).argmax(axis=1) == t
        x, y = x[new], y[new]
        like = np.einsum("nd,nd->n", v["unit"][x], v["unit"][y]) >= LIKE
        out.append((x[like], y[like]))
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))


def linked_small(v: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of many runs of few rows each, which begin at first and have size rows."""
    d, found = v["unit"].shape[1], []
    for m in np.unique(size):
        one, two = np.triu_indices(m, 1)
        begin = first[size == m][:, None]
        i, j = (begin + one).ravel(), (begin + two).ravel()
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            may = np.ones(len(x), dtype=bool)
            for query, coded in ((x, y), (y, x)):
                may &= np.einsum("nd,nd->n", v["turned"][query], v["signs"][coded]) / math.sqrt(d) / v["factor"][coded] + v["slack"][coded] >= LIKE
            found.append(_exact(v, x[may], y[may], v["band"][x[may]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else first[:0] for k in (0, 1))


def linked_tile(v: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of a with rows of b; a and b are the same rows or have none in common."""
    side = lambda rows: {k: v[k][rows] for k in ("signs", "factor", "slack")}
    may = possible(v["turned"][a], side(b)) & possible(v["turned"][b], side(a)).T
    i, j = np.nonzero(np.triu(may, 1) if a is b else may)
    return _exact(v, a[i], b[j], v["band"][a[i]])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is linked to, through others or not."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def described(vectors: DataFrame) -> DataFrame:
    """vec_id, the components as doubles, whether they can link, and two hashes of them."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", x.alias("x"), sound.alias("sound"))
    return rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(SEED), "x")})


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _keyed(nodes: DataFrame, bits: int, many: int) -> DataFrame:
    """Rows (node, d, keys, code, factor) of each node (node, d, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                own = batch.filter(pa.array(length == d))
                for at in range(0, own.num_rows, BLOCK):
                    part = own.slice(at, BLOCK)
                    unit = units(_flat(part.column("x")), int(d))
                    keys, (packed, factor) = band_keys(unit, bits, many), code(unit)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * many), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("d"), lists, pa.array([c.tobytes() for c in packed]), pa.array(factor)], names=["node", "d", "keys", "code", "factor"])

    return nodes.select("node", "d", "x").mapInArrow(run, "node bigint, d int, keys array<bigint>, code binary, factor double")


TILED = "node bigint, links bigint, low bigint"


def _tiles(rows: pa.Table) -> pa.Table:
    """node, links (weights of linked vectors) and low (a node that it is linked to, through others or not) of the linked vectors of several tiles."""
    rows = rows.sort_by([(c, "ascending") for c in ("key", "tile_a", "tile_b", "chunk")])
    n, column = rows.num_rows, lambda c: rows[c].to_numpy()
    x = _flat(rows["x"].combine_chunks())
    d = padded(len(x) // n)
    v = {
        "unit": units(x, len(x) // n), "keys": _flat(rows["keys"].combine_chunks()).reshape(n, -1), "factor": column("factor"), "band": column("key") >> MOST_BITS,
        "signs": signs(np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(n, -1), d),
    }
    v |= {"slack": slack(v["factor"], d), "turned": (v["unit"] @ rotation(d, 0)).astype(np.float32)}
    node, weight, tile = column("node"), column("weight"), np.stack([column(c) for c in ("key", "tile_a", "tile_b")], axis=1)
    first = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)])
    size = np.diff(np.r_[first, n])
    same = tile[first, 1] == tile[first, 2]
    small = same & (size <= SMALL)
    found = [linked_small(v, first[small], size[small])]
    chunk = column("chunk")
    for at, m, is_same in zip(first[~small], size[~small], same[~small], strict=True):
        own = np.arange(at, at + m)
        found.append(linked_tile(v, own, own) if is_same else linked_tile(v, own[chunk[own] == tile[at, 1]], own[chunk[own] != tile[at, 1]]))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    low = spanning(n, i, j)
    has = links > 0
    return pa.table({"node": node[has], "links": links[has], "low": node[low][has]})


def link_sums(nodes: DataFrame) -> DataFrame:
    """Rows (node, links, low) of the tiles of all bands; nodes: node, d, x, weight."""
    bits, many = bands(nodes.count())
    keyed = cut(_keyed(nodes, bits, many))
    met = keyed.select("node", "d", F.explode("keys").alias("key"))
    full = cut(met.groupBy("d", "key").agg(F.count("*").alias("m")).filter("m > 1"))
    chunks = F.ceil(F.col("m") / TILE)
    # tiles go to tasks in groups of about TOGETHER rows, so that many small bands share one
    groups = max(1, (full.agg(F.sum(F.col("m") * chunks)).first()[0] or 0) // TOGETHER)
    members = met.join(few(full, MOST_BROADCAST), ["d", "key"]).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
    tiles = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda other: F.struct(F.least("chunk", other).alias("tile_a"), F.greatest("chunk", other).alias("tile_b")))
    dealt = members.withColumn("tile", F.explode(tiles)).select("node", "d", "key", "chunk", "tile.tile_a", "tile.tile_b")
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("key", "tile_a", "tile_b"), F.lit(groups)))
    vectors = keyed.join(nodes.select("node", "x", "weight"), "node").drop("d")
    return dealt.join(vectors, "node").groupBy("d", "bin").applyInArrow(_tiles, TILED)


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors."""
    rows = described(vectors)
    grouped = rows.filter("sound").groupBy("h1", "h2").agg(F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = cut(grouped.select("h1", "h2", "x", "weight", "least", F.size("x").alias("d"), F.monotonically_increasing_id().alias("node")))
    found = cut(link_sums(nodes).groupBy("node", "low").agg(F.sum("links").alias("links")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "at")
    named = nodes.select("h1", "h2", "weight", "least", "node").join(links, "node", "left").join(roots, F.col("node") == F.col("at"), "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    solved = cut(named.join(least, "root").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    narrow = rows.select("vec_id", "sound", F.when(F.col("sound"), F.col("h1")).alias("h1"), F.when(F.col("sound"), F.col("h2")).alias("h2"))
    out = narrow.join(solved, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
