"""Near-duplicate embeddings by product quantisation: coarse lists, residual codes, table look-ups, exact cosine.

Vectors are compared inside their label and length only. Equal vectors of a label are one unit, with the number of its rows.

Index: coarse centroids and the codebooks of SUBSPACES parts of the residual are fitted on a sample of at most MOST_FITTED
units; every unit is indexed. A unit lies in the list of its nearest centroid, with the code of its residual and the error
of that code.

Probes: two unit vectors of cosine c are sqrt(2 - 2c) apart. If they lie in different lists, the plane that halves the way
between the two centroids parts them, so one of them is within half that distance of the plane. Every unit visits the lists
that are so near: no link is lost, whatever the sample was. Pairs that would meet in both lists count in the smaller one.

Scan: a visitor looks the distances of its residual to the codes up in one table per subspace. What is farther from the code
than the link's distance plus the code's error cannot be a link; the others are compared exactly, in double precision.

A list's units are divided into tiles and its visitors into parts, so a task's work is bounded and a crowd of near copies is
no hot task. A tile returns for each unit how many rows it is linked with, and links that join what its links join (a star
a chunk), never all pairs.

Rows: null, empty and zero vectors, those with a null, NaN or infinite component, and rows without a label link with
nothing. A null id never is a component's smallest one; if all of a component's ids are null, so is the component_id, and
kept is true. Repeated ids are rows of their own. Other columns are not read, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .graph import components

#: Vectors that the index is fitted on, at most.
MOST_FITTED = 1 << 15
#: Parts of a residual, and codes of a part.
SUBSPACES, CODES = 16, 16
#: Least and most coarse lists; between them, the power of two next to the square root of the units.
LEAST_LISTS, MOST_LISTS = 16, 2048
#: Units of a tile, visitors of a part.
TILE, PART = 512, 8192
#: Rounding that the bounds on distances, never the links, allow for.
SLACK = 1e-6


class Index(NamedTuple):
    centroids: np.ndarray
    books: np.ndarray  # subspace, code, place


def padded(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The vectors, padded with zeros to a width."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of to."""
    return np.maximum((x * x).sum(1)[:, None] + (to * to).sum(1) - 2 * x @ to.T, 0)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(squares(x[i : i + 2048], to).argmin(1) for i in range(0, len(x), 2048))])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """sample: unit vectors, their width a multiple of SUBSPACES."""
    centroids = np.unique(k_means(sample, lists, 8, 1), axis=0)
    rest = sample - centroids[nearest(sample, centroids)]
    part = rest.shape[1] // SUBSPACES
    return Index(centroids, np.stack([k_means(rest[:, i * part : (i + 1) * part], CODES, 8, i) for i in range(SUBSPACES)]))


def encode(x: np.ndarray, index: Index, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """List, code, error of the code, and the other lists to visit, of unit vectors."""
    home, far = np.zeros(len(x), np.int64), []
    between = np.sqrt(squares(index.centroids, index.centroids))
    for i in range(0, len(x), 2048):
        d = squares(x[i : i + 2048], index.centroids)
        own = home[i : i + 2048] = d.argmin(1)
        gap = np.maximum(between[own], 1e-12)
        plane = (d - d[np.arange(len(d)), own][:, None]) / (2 * gap)
        near = plane <= reach + SLACK
        near[np.arange(len(d)), own] = False
        far += [np.flatnonzero(row).astype(np.int32) for row in near]
    rest = x - index.centroids[home]
    parts = rest.reshape(len(x), SUBSPACES, -1)
    code = np.stack([squares(parts[:, s], index.books[s]).argmin(1) for s in range(SUBSPACES)], axis=1).astype(np.uint8)
    decoded = np.stack([index.books[s][code[:, s]] for s in range(SUBSPACES)], axis=1)
    return home, code, np.sqrt(((parts - decoded) ** 2).sum(axis=(1, 2))), far


ROW = "u long, n long, label string, size int, home int, code binary, error double, visits array<int>, vec binary"


def index_rows(index: Index, least: float, width: int, kind: str):
    reach = math.sqrt(2 - 2 * least) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = padded(batch.column("vec"), width, kind)
                home, code, error, far = encode(unit(x), index, reach)
                some = [batch.column("u"), batch.column("n"), batch.column("label"), batch.column("size"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*some, pa.array(far, pa.list_(pa.int32())), pa.array([v.tobytes() for v in x], pa.binary())], names=[c.split()[0] for c in ROW.split(", ")])

    return run


class Tile:
    """Units of one tile of a list, and what their links with visitors add up to."""

    def __init__(self, index: Index, least: float, kind: str, key: tuple, rows: pa.RecordBatch):
        self.index, self.least, self.kind, self.list = index, least, kind, key[2]
        self.u, self.n, self.x = rows.column("u").to_numpy(), rows.column("n").to_numpy(), vectors(rows, kind)
        self.code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES).astype(np.int64)
        self.within = (math.sqrt(2 - 2 * least) + rows.column("error").to_numpy() + SLACK) ** 2
        self.visits = [set(v) for v in rows.column("visits").to_pylist()]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of visitor and unit of all pairs that the codes leave and the exact cosine confirms."""
        parts = (x - self.index.centroids[self.list]).reshape(len(x), SUBSPACES, -1)
        books = self.index.books
        tables = (parts * parts).sum(2)[:, :, None] + (books * books).sum(2)[None] - 2 * np.einsum("vsp,scp->vsc", parts, books)
        total = np.zeros((len(x), len(self.u)))
        for s in range(SUBSPACES):
            total += tables[:, s][:, self.code[:, s]]
        i, j = np.nonzero(total <= self.within)
        links = np.concatenate([np.zeros(0, bool), *((x[i[k : k + 65536]] * self.x[j[k : k + 65536]]).sum(1) >= self.least for k in range(0, len(i), 65536))])
        return i[links], j[links]

    def met(self, rows: pa.RecordBatch | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Unit, rows linked with it, and the edges of a chunk of visitors; None: the tile's own pairs."""
        if rows is None:
            i, j = self.near(self.x)
            i, j = i[i < j], j[i < j]
            yield self.totals(self.u, self.n, i, j)
            return
        for at in range(0, rows.num_rows, 512):
            some = rows.slice(at, 512)
            home = some.column("home").to_numpy()
            i, j = self.near(vectors(some, self.kind))
            # Who visits the other's list too is met there as well: the smaller list counts.
            once = np.array([h >= self.list or h not in self.visits[k] for h, k in zip(home[i].tolist(), j.tolist(), strict=True)], bool)
            yield self.totals(some.column("u").to_numpy(), some.column("n").to_numpy(), i[once], j[once])

    def totals(self, u: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        seen, at = np.unique(np.concatenate([u[i], self.u[j]]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        count = np.zeros(len(seen), np.int64)
        np.add.at(count, a, self.n[j])
        np.add.at(count, b, n[i])
        root = np.arange(len(seen))
        while True:  # each step takes the smaller root of either end, then the root's root
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for ends in (a, b):
                np.minimum.at(new, root[ends], low)
                np.minimum.at(new, ends, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return seen, count, seen[root], seen


def vectors(rows: pa.RecordBatch, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(rows.num_rows, -1))


def compare(index: Index, least: float, kind: str):
    """For rows by tile and part, units before visitors: u, linked (rows linked with it), root (a unit joined with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile = None, [], None

        def done(found: Iterator) -> Iterator[pa.RecordBatch]:
            for u, linked, root, _ in found:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(linked), pa.array(root)], names=["u", "linked", "root"])

        def opened() -> Iterator[pa.RecordBatch]:
            nonlocal tile, held
            if tile is None and held:
                tile = Tile(index, least, kind, key, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
                if key[4] == 0:  # one part alone compares the tile's own units
                    yield from done(tile.met(None))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "size", "list", "tile", "part", "visitor")), strict=True))
            at = 0
            for now, some in itertools.groupby(keys):
                n = len(list(some))
                rows = batch.slice(at, n)
                at += n
                if now[:5] != key:
                    yield from opened()
                    key, held, tile = now[:5], [], None
                if now[5]:
                    yield from opened()
                    if tile is not None:
                        yield from done(tile.met(rows))
                else:
                    held.append(rows)
        yield from opened()

    return run


def units_of(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """Distinct vectors that can link, by label: u, vec, label, size, n rows, head (their smallest id)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.filter(F.col(label).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0))
    grouped = good.groupBy(F.col(label).alias("label"), F.col(vec).alias("vec")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"))
    return grouped.select(F.monotonically_increasing_id().alias("u"), "vec", "label", F.size("vec").alias("size"), "n", "head")


def fitted(units: DataFrame, lists: int | None) -> tuple[Index, int] | None:
    """The index over a sample of units, and the width of its vectors."""
    n, longest = units.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return None
    width = -(-longest // SUBSPACES) * SUBSPACES
    most = max(64, min(MOST_FITTED, (1 << 28) // (8 * width)))  # 256 MB of sample
    some = units if n <= most else units.filter(F.pmod(F.xxhash64("u"), F.lit(1 << 40)) < int(most * 0.95 / n * (1 << 40)))
    sample = np.concatenate([unit(padded(x.combine_chunks(), width, "f8")) for x in [some.select("vec").toArrow().column("vec")] if len(x)] or [np.eye(1, width)])
    k = lists or min(MOST_LISTS, max(LEAST_LISTS, 1 << round(math.log2(n) / 2)))
    return fit(sample, min(k, max(1, len(sample) // 8))), width


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, lists: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. lists: coarse lists, if not by the number of vectors."""
    if not 0 < least <= 1:
        raise ValueError("the cosine of a link is above 0 and at most 1")
    prepare(table.sparkSession)
    kind, type_ = ("<f4", "array<float>") if table.schema[vec_col].dataType.simpleString() == "array<float>" else ("<f8", "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(type_).alias("vec"), F.col(label_col).cast("string").alias("label"))
    units = written(units_of(rows, "vec", "label"), "units")
    if (made := fitted(units, lists)) is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    index, width = made
    indexed = written(units.select("u", "n", "label", "size", "vec").mapInArrow(index_rows(index, least, width, kind), ROW), "indexed")
    visits = indexed.select("*", F.explode("visits").alias("list"))
    place = ["label", "size", "list"]
    # Tiles and parts of each list; a visitor without units in the list goes nowhere.
    lists_ = indexed.groupBy("label", "size", F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("r"))
    guests = visits.groupBy(place).agg(F.count(F.lit(1)).alias("v"))
    tiles, parts = F.ceil(F.col("r") / TILE).cast("int"), F.ceil((F.col("r") + F.coalesce("v", F.lit(0))) / PART).cast("int")
    # Written, so that its size is known: where it is small, no vector is shuffled to meet it.
    sized = written(lists_.join(guests, place, "left").select(*place, tiles.alias("tiles"), parts.alias("parts")), "lists")
    dealt = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    own = indexed.withColumn("list", F.col("home")).join(sized, place).withColumn("tile", dealt("tiles"))
    to_range = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*place, "tile", "part", "visitor", "u", "n", "home", "code", "error", "visits", "vec"]
    bare = {"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("double"), "visits": F.lit(None).cast("array<int>")}
    part = F.pmod(F.xxhash64("u", F.lit(1)), F.col("parts")).cast("int")
    residents = own.withColumn("part", to_range("parts")).withColumn("visitor", F.lit(False))
    # A unit visits the earlier tiles of its own list.
    inner = own.filter("tile > 0").withColumns(bare | {"part": part, "visitor": F.lit(True)}).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)))
    outer = visits.join(sized, place).withColumns(bare | {"part": part, "visitor": F.lit(True)}).withColumn("tile", to_range("tiles"))
    all_ = residents.select(columns).union(inner.select(columns)).union(outer.select(columns))
    keys = [*place, "tile", "part"]
    met = written(all_.repartition(*keys).sortWithinPartitions(*keys, "visitor").mapInArrow(compare(index, least, kind), "u long, linked long, root long"), "met")
    joined = components(met.filter("u <> root").select(F.col("u").alias("src"), F.col("root").alias("dst")))
    heads = joined.join(units.select(F.col("u").alias("node"), "head"), "node")
    least_ids = heads.groupBy("root").agg(F.min("head").alias("least"))
    component = heads.join(least_ids, "root").select(F.col("node").alias("u"), "least", F.lit(True).alias("linked_at_all"))
    linked = met.groupBy("u").agg(F.sum("linked").alias("linked"))
    found = units.join(linked, "u", "left").join(component, "u", "left").filter(F.col("linked_at_all") | (F.col("n") > 1))
    of_unit = found.select(F.col("vec").alias("v"), F.col("label").alias("l"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.when(F.col("linked_at_all"), F.col("least")).otherwise(F.col("head")).alias("c"), F.lit(True).alias("shared"))
    out = rows.join(of_unit, (rows.vec == of_unit.v) & (rows.label == of_unit.l), "left")
    component_id = F.when(F.col("shared"), F.col("c")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))
