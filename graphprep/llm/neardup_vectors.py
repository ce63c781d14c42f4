"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that the directions of most variance come first. A k-d tree over the
leading directions deals them into cells, and cells into tiles of about TILE_ROWS vectors. Two unit vectors with cosine c
are sqrt(2 - 2c) apart, so cells whose boxes are further apart than that are never compared; vectors without any structure
leave nothing to that bound, and then every two tiles meet. Two tiles are compared block by block in steps: the product over the first directions, plus the product of the lengths of what remains of both vectors, bounds the
cosine from above; pairs that cannot reach the threshold stop there, and a tile pair stops when none is left. What passes
the last step is decided by the cosine of the vectors as given, in double precision.

Any turn and any tree give the same result; only the amount of work depends on them. So both are fitted on a sample of at
most SAMPLE_ROWS vectors, and all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import components, forest, map_batches, materialize

THRESHOLD = 0.95
SAMPLE_ROWS = 8192
#: Vectors of a tile at most, and how many tiles there are at least, so that few vectors still keep many tasks busy. A vector
#: is sent once for each tile that it is compared with, so larger tiles cost less to send.
TILE_ROWS, LEAST_TILES = 8192, 8
#: Rows of two tiles that are compared at once: what a task holds of their products.
BLOCK_ROWS = 1024
#: Vectors of the sample that a cell of the tree holds at least.
CELL_SAMPLE = 8
#: Directions that the tree and the boxes look at; the length of what remains is one more side of a box.
BOX_DIMS = 12
#: Directions added in each step of a comparison; the rest follow at once.
STEPS = (12, 16)
#: Room for rounding in the bounds: far over the error of a sum of double products of unit vectors.
SLACK = 1e-9


class Tree:
    """Splits of the leading directions: rows (direction, value, left, right); a negative child -k-1 is cell k."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.splits: list[list[float]] = []
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if cells <= 1 or len(rows) < 2 or spread.max() <= 0:
            self.cells += 1
            return -self.cells
        d = int(np.argmax(rows.var(axis=0)))
        value = float(np.median(rows[:, d]))
        low = rows[:, d] < value
        if not low.any() or low.all():
            self.cells += 1
            return -self.cells
        at = len(self.splits)
        self.splits.append([d, value, 0, 0])
        self.splits[at][2] = self._grow(rows[low], cells // 2)
        self.splits[at][3] = self._grow(rows[~low], cells - cells // 2)
        return at

    def cell(self, rows: np.ndarray) -> np.ndarray:
        node = np.full(len(rows), self.root)
        while (inside := np.flatnonzero(node >= 0)).size:
            for at in np.unique(node[inside]):
                own = inside[node[inside] == at]
                d, value, left, right = self.splits[at]
                node[own] = np.where(rows[own, int(d)] < value, left, right)
        return -node - 1


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors end in zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    if sizes.size and (sizes == sizes[0]).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for i, n in enumerate(sizes):
        out[i, :n] = values[offsets[i] : offsets[i] + n]
    return out


def _unit(rows: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    out[:, : rows.shape[1]] = rows
    out /= np.abs(out).max(axis=1, keepdims=True)  # keeps the squares of huge and tiny components in range
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def near_pairs(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in a, in b) of all pairs with cosine >= threshold. ua, ub: the unit vectors, turned."""
    dims, done = ua.shape[1], 0
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    part: np.ndarray | None = None
    for step in (*STEPS, dims):
        upto = min(dims, done + step)
        if pairs is None:
            grown = ua[:, done:upto] @ ub[:, done:upto].T
            part = grown if part is None else part + grown
        else:
            part = part + np.einsum("ij,ij->i", ua[pairs[0], done:upto], ub[pairs[1], done:upto])
        done = upto
        ra, rb = (np.sqrt(np.maximum((u[:, done:] ** 2).sum(axis=1), 0)) for u in (ua, ub))
        if pairs is None:
            alive = part + ra[:, None] * rb[None, :] >= threshold - SLACK
            n = int(alive.sum())
            if n * 8 < alive.size or done == dims:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            alive = part + ra[pairs[0]] * rb[pairs[1]] >= threshold - SLACK
            pairs, part = (pairs[0][alive], pairs[1][alive]), part[alive]
        if pairs is not None and not pairs[0].size:
            return pairs
        if done == dims:
            break
    out_a, out_b = [], []
    for lo in range(0, len(pairs[0]), 1 << 16):
        i, j = pairs[0][lo : lo + (1 << 16)], pairs[1][lo : lo + (1 << 16)]
        x, y = a[i], b[j]
        ok = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= threshold
        out_a.append(i[ok])
        out_b.append(j[ok])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector: (vec_id, n_links, component_id).

    n_links: other rows with cosine >= threshold; component_id: smallest id reachable by links, itself included.
    Null vectors, zero vectors and those with null or non-finite components link with nothing and are their own
    component. Vectors of unequal length are compared as if the shorter ended in zeros. Equal vectors are one node with a
    multiplicity; repeated ids are rows of their own that link if their vectors do. Rows with a null id count as links of
    others and never name a component unless alone. Other columns are not read. An empty table gives an empty result.
    """
    every = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    sound = F.coalesce(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = every.withColumn("v", F.when(sound, F.col("v")))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
    # The numbers are written once and then only read, so they are the same for all that follows.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n, dims = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sample = nodes.orderBy(F.xxhash64("v"), "node").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    seen = _unit(_matrix(pa.array(list(sample), pa.list_(pa.float64()))), dims)
    _, axes = np.linalg.eigh(seen.T @ seen)
    turn = np.ascontiguousarray(axes[:, ::-1])
    lead = min(BOX_DIMS, dims)
    tile_rows, cells = max(1, min(TILE_ROWS, n // LEAST_TILES)), 1
    while cells * 2 * CELL_SAMPLE <= len(seen) and cells * tile_rows < n:
        cells *= 2
    tree = Tree(seen @ turn[:, :lead], cells)
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((turn, tree))
    kind = nodes.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, tree = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column(1)), dims) @ turn
            x = np.column_stack([u[:, :lead], np.sqrt((u[:, lead:] ** 2).sum(axis=1))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cell(x).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))], names=["node", "v", "many", "cell", "lead"])

    dealt = materialize(map_batches(nodes.select("node", "v", "many"), deal, f"node long, v {kind}, many long, cell int, lead array<double>"), "vector-cells")
    # A row for each cell of the tree comes to the driver, SAMPLE_ROWS / CELL_SAMPLE at most: its count and box.
    box = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("lead")[d]).alias(f"{p}{d}") for d in range(lead + 1) for p, f in (("a", F.min), ("z", F.max))]).toPandas()
    low, high = (box[[f"{p}{d}" for d in range(lead + 1)]].to_numpy() for p in "az")
    reach = 2 - 2 * threshold + 1e-6
    tiles = {int(c): -(-int(k) // tile_rows) for c, k in zip(box["cell"], box["n"], strict=True)}
    near_cells = []
    for i, c in enumerate(box["cell"]):
        gap = np.maximum(np.maximum(low - high[i], low[i] - high), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
        near_cells.append((int(c), tiles[int(c)], [(int(box["cell"][j]), tiles[int(box["cell"][j])]) for j in near]))
    around = spark.createDataFrame(near_cells, "cell int, tiles int, near array<struct<cell:int,tiles:int>>")
    tiled = dealt.drop("lead").join(F.broadcast(around.select("cell", "tiles")), "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("tiles")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of a tile to one row."""

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            block = pa.RecordBatch.from_arrays([t.column(k).chunk(0) for k in ("node", "many", "v")], names=["node", "many", "v"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as w:
                w.write_batch(block)
            return pa.RecordBatch.from_arrays([t.column("cell").chunk(0)[:1], t.column("tile").chunk(0)[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["cell", "tile", "block"])

        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = list(zip(b.column("cell").to_pylist(), b.column("tile").to_pylist(), strict=True))
            lo = 0
            for i, k in enumerate(keys):
                if k != now:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    if held:
                        yield out(held)
                    held, now, lo = [], k, i
            if len(keys) > lo:
                held.append(b.slice(lo))
        if held:
            yield out(held)

    packed = materialize(map_batches(tiled.repartition("cell", "tile").sortWithinPartitions("cell", "tile"), bundle, "cell int, tile int, block binary"), "vector-tiles")
    # Each tile goes to every pair of tiles that it is part of; the two meet in one partition, one after the other.
    other = F.flatten(F.transform("near", lambda c: F.transform(F.sequence(F.lit(0), c["tiles"] - 1), lambda t: F.struct(c["cell"].alias("cell"), t.alias("tile")))))
    met = packed.join(F.broadcast(around.select("cell", "near")), "cell").withColumn("self", F.struct("cell", "tile")).withColumn("other", F.explode(other))
    met = met.select(F.least("self", "other").alias("x"), F.greatest("self", "other").alias("y"), "block")
    met = met.withColumn("pair", F.concat_ws("/", "x.cell", "x.tile", "y.cell", "y.tile")).select("pair", "block").repartition(F.col("pair")).sortWithinPartitions("pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = sent.value

        def read(block: bytes) -> tuple[np.ndarray, ...]:
            b = next(iter(pa.ipc.open_stream(block)))
            v = _matrix(b.column("v"))
            return b.column("node").to_numpy(), b.column("many").to_numpy(), v, _unit(v, dims) @ turn

        def found(one: bytes, two: bytes | None) -> pa.RecordBatch:
            na, ma, a, ua = read(one)
            if two is None:
                nb, mb, b, ub, shift = na, ma, a, ua, 0
            else:
                nb, mb, b, ub = read(two)
                shift = len(na)
                wide = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
            nodes = na if two is None else np.concatenate([na, nb])
            links = np.zeros(len(nodes))
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for la in range(0, len(na), BLOCK_ROWS):
                for lb in range(la if two is None else 0, len(nb), BLOCK_ROWS):
                    ra, rb = slice(la, la + BLOCK_ROWS), slice(lb, lb + BLOCK_ROWS)
                    i, j = near_pairs(a[ra], b[rb], ua[ra], ub[rb], threshold)
                    i, j = i + la, j + lb
                    if two is None and la == lb:
                        i, j = i[i != j], j[i != j]
                    links[:] += np.bincount(i, weights=mb[j], minlength=len(nodes))
                    if two is not None or la != lb:
                        links[:] += np.bincount(j + shift, weights=ma[i], minlength=len(nodes))
                    # What a block links is kept as a star, a row a vector, however many pairs there are.
                    own, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
                    head = own[forest(len(own), at[: len(i)], at[len(i) :])] if len(own) else own
                    low.append(own)
                    high.append(head)
            head = forest(len(nodes), np.concatenate(low), np.concatenate(high))
            hit = np.flatnonzero(links > 0)
            return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(nodes[head[hit]]), pa.array(links[hit].astype(np.int64))], names=["node", "head", "links"])

        held: tuple[str, bytes] | None = None
        for b in batches:
            for pair, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and held[0] == pair:
                    yield found(held[1], block)
                    held = None
                    continue
                if held:
                    yield found(held[1], None)
                held = (pair, block)
        if held:
            yield found(held[1], None)

    # Rows: at most one for each vector and tile pair, however many pairs link.
    joined = materialize(map_batches(met, compare, "node long, head long, links long"), "vector-links")
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(joined.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("id", "node")
    owner = nodes.join(parts, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owner.groupBy("component").agg(F.min("first").alias("component_id"))
    by_vector = owner.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), "component_id")
    return rows.join(by_vector, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
