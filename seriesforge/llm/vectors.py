"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, and a vector lies in the cell
of its two nearest codewords. A query visits cells in the order of the sum of its halves' distances to the cells'
codewords (the multi-sequence order), as many as a target recall needs. That number is measured: sampled queries are
compared by brute force with all vectors, and with disturbed copies of themselves at the threshold, and the rank of
each true neighbour's cell is noted. Every pair met in a cell is verified by its cosine in double precision.

A cell that holds very many vectors is split into blocks of queries by blocks of residents, so no task gets a whole
one. Pairs are never listed: a block gives each vector's number of links and the components among its own vectors,
which connected components then join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _anchors as A
from seriesforge.llm._frames import arrow_map, staged
from seriesforge.llm._graph import connected_components

#: Vectors that codebooks are fitted on at most, queries that the number of visits is measured on, codewords at most.
SAMPLE, QUERIES, CODEWORDS = 20_000, 1_000, 256
#: Residents that a codebook aims at for a cell, share of true pairs to be met, vectors of a block, rounds of k-means.
CELL, RECALL, BLOCK, ROUNDS = 16, 0.995, 1024, 15


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def codebook(rows: np.ndarray, size: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means centres."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size, replace=len(rows) < size)].copy()
    for _ in range(rounds):
        near = _nearest(rows, centres)
        n = np.bincount(near, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = rows[rng.choice(len(rows), int((n == 0).sum()))]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows ** 2).sum(1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(1), 0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(rows[i:i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


class MultiIndex:
    """Two codebooks; cell = first codeword * size + second codeword."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.half, self.size = (first, second), first.shape[1], len(first)

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, :self.half], rows[:, self.half:]

    def cell(self, rows: np.ndarray) -> np.ndarray:
        a, b = (_nearest(h, book) for h, book in zip(self.halves(rows), self.books))
        return a * self.size + b

    def visits(self, rows: np.ndarray, number: int) -> np.ndarray:
        """The first ``number`` cells of the multi-sequence of each row, nearest first. With both lists sorted, cell
        (i, j) has (i+1)(j+1)-1 cells before it at least, so only those under that hyperbola can be among the first."""
        number = min(number, self.size ** 2)
        i, j = np.divmod(np.arange(self.size ** 2), self.size)
        under = (i + 1) * (j + 1) <= number
        i, j = i[under], j[under]
        out = np.empty((len(rows), number), np.int64)
        for at in range(0, len(rows), 512):
            d = [_distances(h, book) for h, book in zip(self.halves(rows[at:at + 512]), self.books)]
            order = [x.argsort(1, kind="stable") for x in d]
            near = [np.take_along_axis(x, o, 1) for x, o in zip(d, order)]
            best = (near[0][:, i] + near[1][:, j]).argsort(1, kind="stable")[:, :number]
            out[at:at + 512] = np.take_along_axis(order[0], i[best], 1) * self.size + np.take_along_axis(order[1], j[best], 1)
        return out

    def ranks(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each row visits until it comes to the given one."""
        d = [_distances(h, book) for h, book in zip(self.halves(rows), self.books)]
        at = np.arange(len(rows))
        own = d[0][at, cells // self.size] + d[1][at, cells % self.size]
        second = np.sort(d[1], 1)
        out = np.zeros(len(rows), np.int64)
        for i in range(self.size):
            left = own - d[0][:, i]
            out += (second <= left[:, None] + 1e-12).sum(1)
        return np.maximum(out, 1)


def vectors_of(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, dim, v) of the vectors that can link with anything, scaled to length one: v is the doubles as bytes."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, dims, out = [], [], []
        for key, vector in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not vector or any(x is None for x in vector):
                continue
            x = np.array(vector, np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()  # no overflow on the way
            ids.append(key)
            dims.append(len(x))
            out.append((x / np.linalg.norm(x)).astype("<f8").tobytes())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])
    return arrow_map(rows.select(rows[id_column].cast("long").alias("id"), rows[vector_column].cast("array<double>").alias("v")), batch, "id long, dim int, v binary")


def build_index(distinct: DataFrame, dim: int, rows: int, sample: int = SAMPLE) -> MultiIndex:
    """Codebooks from at most ``sample`` vectors of least hash; about CELL vectors of all ``rows`` a cell."""
    some = _matrix(pa.array([bytes(r["v"]) for r in distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").limit(sample).select("v").collect()], pa.binary()))
    size = int(max(2, min(CODEWORDS, round((rows / CELL) ** 0.5), len(some))))
    half = max(1, dim // 2)
    if dim == 1:
        some = np.hstack([some, np.zeros((len(some), 1))])
    return MultiIndex(codebook(some[:, :half], size), codebook(some[:, half:], size))


def visits_needed(distinct: DataFrame, index: MultiIndex, dim: int, threshold: float, recall: float = RECALL, queries: int = QUERIES) -> int:
    """Cells to visit for the target recall, measured on at most ``queries`` vectors against all vectors by brute force,
    and on disturbed copies of them whose cosine is just the threshold."""
    own = _matrix(pa.array([bytes(r["v"]) for r in distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("v", F.lit(1)), "v").limit(queries).select("v").collect()], pa.binary()))
    rng = np.random.default_rng(11)
    noise = rng.standard_normal(own.shape)
    noise -= (noise * own).sum(1, keepdims=True) * own
    disturbed = threshold * own + np.sqrt(max(0.0, 1 - threshold ** 2)) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    worst = np.quantile(index.ranks(_padded(own), index.cell(_padded(disturbed))), recall)
    shared = distinct.sparkSession.sparkContext.broadcast((own, index))

    def true_ranks(b: pa.RecordBatch) -> pa.RecordBatch | None:
        own, index = shared.value
        rows = _matrix(b.column(0))
        near = own @ rows.T >= threshold
        q, r = np.nonzero(near & (own @ rows.T < 1 - 1e-12))
        if not len(q):
            return None
        cells = index.cell(_padded(rows))
        rank, n = np.unique(np.concatenate([index.ranks(_padded(own[q[i:i + 512]]), cells[r[i:i + 512]]) for i in range(0, len(q), 512)]), return_counts=True)
        return pa.record_batch([pa.array(rank.astype(np.int64)), pa.array(n.astype(np.int64))], names=["rank", "n"])
    seen = sorted((r["rank"], r["n"]) for r in arrow_map(distinct.where(F.col("dim") == dim).select("v"), true_ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect())
    need, total, have = 1, sum(n for _, n in seen), 0
    for rank, n in seen:
        if have >= recall * total:
            break
        need, have = rank, have + n
    return int(min(index.size ** 2, max(need, worst)))


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.hstack([rows, np.zeros((len(rows), 1))]) if rows.shape[1] == 1 else rows


def _components(hit: np.ndarray) -> np.ndarray:
    """Labels of the rows, then the columns, of a bipartite graph: equal within a component."""
    rows, cols = hit.shape
    row, col = np.arange(rows), np.full(cols, rows + cols)
    q, r = np.nonzero(hit)
    col_own = rows + np.arange(cols)
    np.minimum.at(col_own, r, row[q])
    col = col_own
    while True:
        new_row = row.copy()
        np.minimum.at(new_row, q, col[r])
        new_col = col.copy()
        np.minimum.at(new_col, r, new_row[q])
        if (new_row == row).all() and (new_col == col).all():
            return np.concatenate([row, col])
        row, col = new_row, new_col


def _links_in_tiles(threshold: float):
    """Rows of tiles -> (id, links found here, another vector of the same component or null)."""
    def tile(t: pa.RecordBatch) -> tuple | None:
        query = t.column("query").to_numpy(zero_copy_only=False)
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        q, r = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(r):
            return None
        rows = _matrix(t.column("v"))
        hit = rows[q] @ rows[r].T >= threshold
        hit &= ids[q][:, None] != ids[r][None, :]
        if not hit.any():
            return None
        home = t.column("home").to_numpy()
        # a resident counts a query that it doesn't visit itself
        seen = t.column("visits").take(pa.array(r)).to_pylist()
        homes, at = np.unique(home[q], return_inverse=True)
        meets = np.array([np.isin(homes, v) for v in seen])[:, at].T
        links_q = hit @ copies[r]
        links_r = (hit & ~meets).T @ copies[q]
        label = _components(hit)
        every = np.concatenate([ids[q], ids[r]])
        root = np.full(len(label) + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, label, every)
        part = np.concatenate([hit.any(1), hit.any(0)])
        return every[part], np.concatenate([links_q, links_r])[part], root[label][part]

    def work(t: pa.RecordBatch) -> pa.RecordBatch | None:
        key = t.column("ah").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        parts = [x for a, b in zip(cuts, cuts[1:]) if (x := tile(t.slice(a, b - a))) is not None]
        if not parts:
            return None
        ids, links, roots = (np.concatenate(c) for c in zip(*parts))
        return pa.record_batch([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(roots)], names=["id", "links", "near"])
    return A.by_anchor(work, lambda b: np.ones(b.num_rows, np.int64), BLOCK)


def similar_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95,
                    recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: the id column, n_links (other vectors linked directly), component_id (least id reachable) and
    kept (the id is its component's).

    Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different
    lengths don't link. Equal vectors are one node with a number of copies, and link with each other. Rows that repeat
    an id are rows each, with the links of their own vectors, and one node if the vectors are equal. Null ids stay, link
    like others, and are no component's id unless it has no other. An empty table gives no rows.
    """
    plain = rows.select(rows[id_column].cast("long").alias("id"))
    valid = staged(vectors_of(rows, id_column, vector_column))
    distinct = staged(valid.groupBy("dim", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least")).withColumn("id", F.xxhash64("v", F.col("dim"))))
    found, edges = None, None
    for r in distinct.groupBy("dim").count().collect():  # a row for each length of vector that occurs
        links = _links(distinct, r["dim"], r["count"], threshold, recall, sample, block)
        found = links if found is None else found.union(links)
    if found is None:
        return plain.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found)
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = distinct.join(counts, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "dim", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    nodes = staged(nodes)
    first = staged(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    known = staged(nodes.join(first, "root").select("dim", "v", "n_links", "component_id"))
    linked = valid.join(known, ["dim", "v"]).select("id", "n_links", "component_id")
    counted = staged(valid.groupBy("id").agg(F.count("*").alias("have")))
    others = plain.groupBy("id").agg(F.count("*").alias("all")).join(counted.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left")
    lone = others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.explode(F.expr("if(`all` > coalesce(have, 0), sequence(1, `all` - coalesce(have, 0)), array())"))).drop("col")
    return linked.union(lone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(distinct: DataFrame, dim: int, rows: int, threshold: float, recall: float, sample: int, block: int) -> DataFrame:
    """(id, links, near) of the vectors of one length."""
    own = distinct.where(F.col("dim") == dim)
    index = build_index(distinct, dim, rows, sample)
    number = visits_needed(distinct, index, dim, threshold, recall)
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _padded(_matrix(b.column(1)))
        visits = shared.value.visits(v, number)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * visits.shape[1]), pa.array(visits.ravel().astype(np.int32)))
        return pa.record_batch([*b.columns, pa.array(shared.value.cell(v).astype(np.int32)), lists], names=["id", "v", "copies", "home", "visits"])
    at = staged(arrow_map(own.select("id", "v", "copies"), placed, "id long, v binary, copies long, home int, visits array<int>"))
    # at most CODEWORDS ** 2 cells: how many blocks of residents and of queries each is split into
    cells = index.size ** 2
    tiles = np.ones((2, cells), np.int64)
    for k, counts in enumerate((at.groupBy("home").count(), at.select(F.explode("visits").alias("home")).groupBy("home").count())):
        for r in counts.collect():
            tiles[k, r["home"]] = -(-r["count"] // block)
    split = distinct.sparkSession.sparkContext.broadcast(tiles)

    def dealt(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, home, visits = b.column("id").to_numpy(), b.column("home").to_numpy().astype(np.int64), b.column("visits")
        residents, queries = split.value
        at = np.arange(len(ids))
        draw = (ids.view(np.uint64) >> np.uint64(17)).astype(np.int64)
        # a resident goes to its own block, for every block of queries; a query to its block, for every block of residents
        many = queries[home]
        r = np.repeat(at, many)
        q_block = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        r_key = (home[r] << 32) | ((draw[r] % residents[home[r]]) << 16) | q_block
        width = np.diff(visits.offsets.to_numpy())
        cell = visits.flatten().to_numpy().astype(np.int64)
        of = np.repeat(at, width)
        many = residents[cell]
        pick = np.repeat(np.arange(len(cell)), many)
        r_block = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
        q = of[pick]
        q_key = (cell[pick] << 32) | (r_block << 16) | (draw[q] % queries[cell[pick]])
        rows = pa.array(np.concatenate([r, q]))
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(q) + 1, np.int32)), pa.array([], pa.int32()))
        return pa.record_batch([pa.array(np.concatenate([r_key, q_key])), b.column("id").take(rows), b.column("v").take(rows), b.column("copies").take(rows), b.column("home").take(rows),
                                pa.concat_arrays([visits.take(pa.array(r)), empty]), pa.array(np.concatenate([np.zeros(len(r), bool), np.ones(len(q), bool)]))],
                               names=["ah", "id", "v", "copies", "home", "visits", "query"])
    rows_ = arrow_map(at, dealt, "ah long, id long, v binary, copies long, home int, visits array<int>, query boolean")
    return rows_.repartition("ah").sortWithinPartitions("ah", "query", "id").mapInArrow(_links_in_tiles(threshold), "id long, links long, near long")
