"""Embedding near-duplicates by an exact metric range join.

Cosine at or above ``COSINE`` means that the unit vectors are within r = sqrt(2 - 2 * COSINE) of each other. Equal vectors
of one label are one class first, so copies cost nothing in the join. Then, per label and number of components:

1. Pivots are a sample of the classes by hash: one in ``PER_PIVOT``, fewer where that would be more than ``MOST_PIVOTS``
   in all. Each class has its home in the cell of its nearest pivot.
2. By the triangle inequality a class y can have a partner at home with pivot p only if d(y, p) <= d(y, home) + 2r;
   between unit vectors the same argument for the border plane sharpens this to
   d(y, p)^2 - d(y, home)^2 <= 2r d(p, home). Such y visit p as guests, if p ranks before their home, so that every pair
   meets in exactly one cell.
3. Cells are joined independently: rows are sorted by their distance to the pivot, and only blocks whose distances come
   within r of each other are multiplied. A cell of more than ``BLOCK`` rows is dealt to several tasks by pairs of parts.
   Each cell gives link counts and only those edges that join its parts, never its pairs.
4. Counts are added up and components found from the edges in Spark.

Pairs near the limit are decided by the double-precision cosine of the given components.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or has no label, links with
nothing: no links, its own component, kept. Vectors of different length never link. Repeated rows are vectors of their
own. Null ids do not count as the smallest of a component. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import landed
from sitefold.llm.components import components
from sitefold.operators.joins import lookup_join

COSINE = 0.98
PER_PIVOT = 1_000
#: Bound of the broadcast: a pivot is 8 bytes a component.
MOST_PIVOTS = 2_000
#: Rows of a cell that one task takes at home, and as guests; larger cells are dealt to several tasks.
BLOCK = 8_192
#: Slack of distances in floating point.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    parts = [np.frombuffer(x, "<f8") for x in column.to_pylist()]
    return np.array(parts) if parts else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def read_vectors(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """Key, label, number of components and the components as bytes of doubles; null bytes if unusable."""

    def run(batches):
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                row = np.array([np.nan if x is None else x for x in own or []], dtype="<f8")
                usable = len(row) and np.isfinite(row).all() and row.any()
                out.append((row + 0.0).tobytes() if usable else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[key, "label", "vector"])

    kinds = vectors.schema
    schema = f"`{key}` {kinds[key].dataType.simpleString()}, label {kinds[label].dataType.simpleString()}, vector binary"
    read = vectors.select(key, F.col(label).alias("label"), embedding).mapInArrow(run, schema)
    group = F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), F.concat_ws("/", F.col("label").cast("string"), F.length("vector").cast("string")))
    # 128 bits name a class of equal vectors within its group.
    return read.select(key, group.alias("space"), F.when(group.isNotNull(), F.col("vector")).alias("vector")).withColumn(
        "class", F.when(F.col("space").isNotNull(), F.md5(F.concat(F.col("space").cast("binary"), F.lit("\n").cast("binary"), F.col("vector"))))
    )


def placed_in_cells(classes: DataFrame, pivots: list[tuple[str, bytes]], cosine: float) -> DataFrame:
    """A row for the home of every class and for each cell that it visits."""
    spaces: dict[str, list[bytes]] = {}
    for space, vector in sorted(pivots):
        spaces.setdefault(space, []).append(vector)
    held = {s: _unit(np.array([np.frombuffer(v, "<f8") for v in own])) for s, own in spaces.items()}
    shared = classes.sparkSession.sparkContext.broadcast(held)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches):
        gaps: dict[str, np.ndarray] = {}
        for batch in batches:
            space = np.array(batch.column(1).to_pylist(), dtype=object)
            for own in dict.fromkeys(space.tolist()):
                rows = np.flatnonzero(space == own)
                vectors = _unit(_matrix(batch.column(2).take(pa.array(rows))))
                p = shared.value.get(own)
                if p is None:  # a space without a pivot is one cell around its origin
                    home, cell, at, distance = np.zeros(len(rows), int), np.zeros(len(rows), int), np.arange(len(rows)), np.ones(len(rows))
                else:
                    if own not in gaps:
                        gaps[own] = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                    squared = np.maximum(0, 2 - 2 * vectors @ p.T)
                    home = squared.argmin(axis=1)
                    nearest = squared[np.arange(len(rows)), home]
                    d = np.sqrt(squared)
                    visits = (d <= np.sqrt(nearest)[:, None] + 2 * radius + SLACK) & (squared - nearest[:, None] <= 2 * radius * gaps[own][home] + SLACK)
                    visits &= np.arange(len(p)) < home[:, None]
                    visits[np.arange(len(rows)), home] = True
                    at, cell = np.nonzero(visits)
                    distance = d[at, cell]
                taken = batch.take(pa.array(rows[at]))
                columns = [
                    pa.array([f"{own}/{c}" for c in cell], pa.string()),
                    pa.array(home[at] == cell),
                    pa.array(distance),
                    taken.column(0),
                    taken.column(2),
                    taken.column(3),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "home", "distance", "class", "vector", "copies"])

    return classes.select("class", "space", "vector", "copies").mapInArrow(
        run, "cell string, home boolean, distance double, class string, vector binary, copies bigint"
    )


def _linked(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of two blocks are at ``cosine`` or more; a, b: unit vectors, left, right: as given.

    Only pairs within rounding of the limit are computed again from the given components, a few at a time.
    """
    products = a @ b.T
    near = products >= cosine
    i, j = np.nonzero(np.abs(products - cosine) <= 1e-9)
    for k in range(0, len(i), 4096):
        x, y = left[i[k : k + 4096]], right[j[k : k + 4096]]
        exact = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        usable = np.isfinite(exact)
        near[i[k : k + 4096][usable], j[k : k + 4096][usable]] = exact[usable] >= cosine
    return near


def cell_links(cell: pa.Table, cosine: float = COSINE, block: int = 512) -> pa.Table:
    """Link counts of the classes of a cell and the edges that join what the cell links."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    cell = cell.sort_by([("distance", "ascending"), ("class", "ascending")])
    names, copies = cell.column("class").to_pylist(), cell.column("copies").to_numpy()
    given, distance = _matrix(cell.column("vector")), cell.column("distance").to_numpy()
    home, part = cell.column("home").to_numpy(zero_copy_only=False), cell.column("part").to_numpy()
    low_part, high_part = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
    unit, n = _unit(given), len(names)
    links, component, edges = np.zeros(n, np.int64), np.arange(n), []
    for first in range(0, n, block):
        rows = np.arange(first, min(n, first + block))
        for other in range(first, n, block):
            if distance[other] - distance[rows[-1]] > radius + SLACK:
                break
            columns = np.arange(other, min(n, other + block))
            near = _linked(unit[rows], unit[columns], given[rows], given[columns], cosine)
            # A pair counts once: in order, with one at home, and in the task of both its parts.
            near &= (rows[:, None] < columns) & (home[rows][:, None] | home[columns])
            near &= np.minimum(part[rows][:, None], part[columns]) == low_part
            near &= np.maximum(part[rows][:, None], part[columns]) == high_part
            links[rows] += near @ copies[columns]
            links[columns] += copies[rows] @ near
            for i in np.flatnonzero(near.any(axis=1)):
                own, partners = rows[i], columns[near[i]]
                others, at = np.unique(component[partners], return_index=True)
                at, others = at[others != component[own]], others[others != component[own]]
                if len(others):
                    edges += [(names[own], names[j]) for j in partners[at]]
                    component[np.isin(component, others)] = component[own]
    some = np.flatnonzero(links)
    out = {"a": [names[k] for k in some] + [a for a, _ in edges], "b": [None] * len(some) + [b for _, b in edges], "links": links[some].tolist() + [0] * len(edges)}
    return pa.table(out, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("links", pa.int64())]))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """Key, n_links, component_id and kept of every vector."""
    rows = landed(read_vectors(vectors, key, embedding, label))
    usable = rows.where("class IS NOT NULL").groupBy("class", "space", "vector")
    classes = landed(usable.agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")))
    total = classes.count()
    every = max(PER_PIVOT, -(-total // MOST_PIVOTS))
    # About total / every rows; those beyond the bound are left to the other pivots.
    chosen = classes.where(F.pmod(F.xxhash64("class"), F.lit(every)) == 0).select("space", "vector").orderBy("vector").limit(2 * MOST_PIVOTS)
    pivots = [(r[0], bytes(r[1])) for r in chosen.collect()]
    placed = landed(placed_in_cells(classes, pivots, cosine))
    sizes = placed.groupBy("cell").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) AS int)").alias("parts"))
    sized = lookup_join(placed, landed(sizes), ["cell"], "inner", ["class"])
    parted = sized.withColumn("part", F.expr("cast(pmod(xxhash64(class), parts) AS int)"))
    # Each row goes to the tasks of all pairs that its part is in.
    dealt = parted.withColumn("other", F.expr("explode(sequence(0, parts - 1))")).select(
        "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "home", "distance", "class", "vector", "copies"
    )
    found = landed(dealt.groupBy("cell", "low", "high").applyInArrow(lambda cell: cell_links(cell, cosine), "a string, b string, links bigint"))
    links = found.where("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    found_components = components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("vertex", "class")
    labelled = classes.select("class", "copies", "first_id").join(links, "class", "left").join(found_components, "class", "left")
    labelled = landed(labelled.withColumn("top", F.coalesce("component", "class")))
    smallest = landed(labelled.groupBy("top").agg(F.min("first_id").alias("component_id")))
    # A component may hold a third of all classes, so it is not gathered to learn its smallest id.
    members = lookup_join(labelled, smallest, ["top"], "inner", ["class"]).select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    judged = lookup_join(rows.select(key, "class"), landed(members), ["class"], "left", [key])
    own = F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return judged.select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id"))
    )


def near_duplicates_by_brute_force(rows: list[tuple], cosine: float = COSINE) -> list[tuple]:
    """(id, n_links, component_id, kept) by comparing all pairs; for tests."""
    n, top = len(rows), list(range(len(rows)))
    links = [0] * n
    usable = [label is not None and own and all(x is not None and np.isfinite(x) for x in own) and any(own) for _, own, label in rows]

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if (a == b).all() or a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    top[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i in range(n):
        smallest[root(i)] = min(rows[i][0], smallest.get(root(i), rows[i][0]))
    return [(rows[i][0], links[i], smallest[root(i)], rows[i][0] == smallest[root(i)]) for i in range(n)]
