"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, greedy search answers queries.

* **Nodes** are the distinct vectors, so that a vector that a third of the rows share is one node; a node keeps its ``k + 1``
  smallest ids, more of which no answer can hold. Vectors get one more coordinate that makes all norms equal: near by inner
  product is then near by angle (queries get 0 there).
* **Blocks**: a few sets of random hyperplanes deal nodes into cells of like direction, of at most ``CELL`` nodes (larger
  ones are dealt on by the id's hash). The first neighbours of a node are the nearest in its cells.
* **NN-descent**: neighbours of a node, forward and backward, are likely neighbours of each other. Each round joins the
  edges with the vectors at their other ends, block by block, so that a vector travels once a block and not once an edge;
  a task compares the neighbours of each node of its block and emits the pairs that beat a node's worst neighbour.
* **Search**: queries of like direction go together. Each round expands the best nodes of a query's pool that aren't yet
  expanded; their neighbours' vectors are joined to the group and scored for all its queries.

The graph keeps ``DEGREE`` neighbours a node, and a node takes part in at most ``4 * DEGREE`` of its followers' comparisons a round: that,
``ROUNDS`` and the pool's size are what is approximate. Recall is measured against brute force by a test.

Edge cases: null vectors, zero vectors, vectors with null or non-finite components, rows without an id, and vectors of
another length than most take no part; rows of one id count once, with the bytewise smallest vector; equal scores go by id;
fewer candidates than k are all given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, discard, join_sized, materialize, tidy

DEGREE, ROUNDS, CELL, PLANES = 32, 4, 512, 3
EACH = 8
POOL, WIDTH, SEARCH_ROUNDS, TOGETHER = 100, 20, 5, 128
SETTLED = 0.01
CHUNK_BITS = 20


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of packed vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def shape(rows: DataFrame, vector: str) -> tuple[str, int]:
    """Type and (most frequent) length of the vectors."""
    common = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return "<f4" if dict(rows.dtypes)[vector] == "array<float>" else "<f8", common["dim"] if common else 0


def packed(rows: DataFrame, key: str, vector: str, kind: str, dim: int) -> DataFrame:
    """(id, vec) of the vectors that take part, little-endian floats end to end."""
    there = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)  # null components are NaN
            fine = np.isfinite(values).all(1) & (values != 0).any(1)
            values = np.ascontiguousarray(values[fine])
            vec = pa.array([row.tobytes() for row in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), vec], names=["id", "vec"])

    whole = there.where((F.size("x") == dim) & (F.size("x") > 0))
    return whole.mapInArrow(tidy(run), "id long, vec binary")


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(id, vec, ids): the distinct vectors of rows (id, vec), each by its smallest id, with its smallest ids."""
    once = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    first = once.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("r") <= keep)
    return first.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).select("id", "vec", "ids")


class Space:
    """What all tasks share: the type and length of vectors, the largest norm, the mean and the hyperplanes."""

    def __init__(self, nodes: DataFrame, kind: str, dim: int, cell: int):
        self.kind, self.dim = kind, dim

        def sums(batches):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0), kind).astype(np.float64)
                    total = np.concatenate([[len(x)], x.sum(0)])
                    yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max())]), pa.array([total.tolist()])], names=["most", "total"])

        parts = nodes.select("vec").mapInArrow(sums, "most double, total array<double>")
        found = parts.select("most", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.max("most").alias("most"), F.sum("x").alias("x")).orderBy("i").collect()
        self.n = int(found[0]["x"]) if found else 0
        self.most = found[0]["most"] if found else 0.0
        self.mean = np.array([r["x"] for r in found[1:]]) / max(self.n, 1)
        self.bits = max(0, round(math.log2(max(self.n, 1) / cell)))
        self.planes = PLANES if self.bits else 1
        self.normals = np.random.default_rng(12).standard_normal((dim, self.planes * self.bits))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes all norms equal."""
        rest = np.sqrt(np.maximum(self.most - (x.astype(np.float64) ** 2).sum(1), 0))
        return np.concatenate([x.astype(np.float32), rest[:, None].astype(np.float32)], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers, one column a set of hyperplanes."""
        side = ((x.astype(np.float64) - self.mean) @ self.normals > 0).reshape(len(x), self.planes, self.bits)
        return side @ (1 << np.arange(self.bits, dtype=np.int64)) if self.bits else np.zeros((len(x), self.planes), np.int64)


def celled(rows: DataFrame, space: Space, cell: int, *, planes: int | None = None, mask: int = -1) -> tuple[DataFrame, list[DataFrame]]:
    """rows (id, vec, ...) with c0, c1, ...: cells of at most about ``cell`` rows; and the written tables that this is read from."""
    planes = planes or space.planes
    columns = rows.columns

    def run(batches):
        for batch in batches:
            codes = space.codes(matrix(batch.column(columns.index("vec")), space.kind).reshape(batch.num_rows, space.dim)) & mask
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(codes[:, p])) for p in range(planes)]], names=[*columns, *[f"c{p}" for p in range(planes)]])

    schema = StructType([*rows.schema.fields, *[StructField(f"c{p}", LongType()) for p in range(planes)]])
    out, used = materialize(rows.mapInArrow(tidy(run), schema), "coded"), []
    used.append(out)
    for p in range(planes):
        sizes = materialize(out.groupBy(f"c{p}").agg(F.ceil(F.count("*") / cell).alias(f"m{p}")), "sizes", light=True)
        used.append(sizes)
        out = join_sized(out, sizes, f"c{p}", f"m{p}").withColumn(f"c{p}", F.col(f"c{p}") * (1 << CHUNK_BITS) + F.pmod(F.xxhash64("id", F.lit(p)), F.col(f"m{p}"))).drop(f"m{p}")
    return out, used


EDGE = "u long, ub long, w long, wb long, score float"
EDGES = ["u", "ub", "w", "wb", "score"]


def edge_table(ids: np.ndarray, blocks: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"u": ids[i], "ub": blocks[i], "w": ids[j], "wb": blocks[j], "score": score.astype(np.float32)})


def best_of_rows(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest finite values of each row: row, column, value."""
    k = min(k, s.shape[1])
    j = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), np.int64)
    i = np.repeat(np.arange(len(s)), k)
    j = j.ravel()
    fine = s[i, j] > -np.inf
    return i[fine], j[fine], s[i[fine], j[fine]]


def cell_edges(space: Space, k: int):
    """Each node's k nearest in its cell."""

    def run(table: pa.Table) -> pa.Table:
        x = space.lifted(matrix(table.column("vec"), space.kind))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        return edge_table(table.column("id").to_numpy(), table.column("c0").to_numpy(), *best_of_rows(s, k))

    return run


def local_joins(space: Space, degree: int):
    """Pairs of neighbours of one node, of which one at least is fresh, that beat the worst neighbour of the first."""

    def run(members: pa.Table, ends: pa.Table) -> pa.Table:
        ids = ends.column("id").to_numpy()
        order = np.argsort(ids)
        ids, blocks, worst = ids[order], ends.column("c0").to_numpy()[order], ends.column("worst").to_numpy()[order]
        x = space.lifted(matrix(ends.column("vec"), space.kind)[order])
        v, m, fresh = members.column("v").to_numpy(), np.searchsorted(ids, members.column("m").to_numpy()), members.column("fresh").to_numpy(zero_copy_only=False)
        order = np.lexsort((~fresh, m, v))  # of a pair in both directions, a fresh one first
        v, m, fresh = v[order], m[order], fresh[order]
        once = np.ones(len(v), bool)
        once[1:] = (v[1:] != v[:-1]) | (m[1:] != m[:-1])
        v, m, fresh = v[once], m[once], fresh[once]
        cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])) if len(v) else [0]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, new = m[a:b], fresh[a:b]
            if not new.any():
                continue
            s = x[at] @ x[at].T
            np.fill_diagonal(s, -np.inf)
            s[~new[:, None] & ~new] = -np.inf
            s[s <= worst[at][:, None]] = -np.inf
            i, j, score = best_of_rows(s, EACH)
            found.append((at[i], at[j], score))
        i, j, score = map(np.concatenate, zip(*found, strict=True))
        _, once = np.unique(i * max(len(ids), 1) + j, return_index=True)
        i, j, score = i[once], j[once], score[once]
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return edge_table(ids, blocks, i[rank < degree], j[rank < degree], score[rank < degree])

    return run


def merged(old: DataFrame | None, new: DataFrame, degree: int) -> DataFrame:
    """Each node's best edges of both; fresh: those that old does not have. One shuffle, by the node."""
    both = new.select(*EDGES, F.lit(True).alias("fresh"))
    if old is not None:
        both = both.unionByName(old.select(*EDGES, F.lit(False).alias("fresh")))
    one = both.repartition("u").groupBy("u", "ub", "w", "wb").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    best = F.row_number().over(W.partitionBy("u").orderBy(F.desc("score"), "w"))
    return one.withColumn("r", best).where(F.col("r") <= degree).drop("r")


def descend(nodes: DataFrame, space: Space, *, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """Edges (u, ub, w, wb, score, fresh), written, of nodes (id, vec, c0, c1, ...): each node's near ones."""
    cells = F.posexplode(F.array(*[F.col(f"c{p}") for p in range(space.planes)])).alias("p", "cell")
    first = nodes.select("id", "vec", "c0", cells).groupBy("p", "cell").applyInArrow(cell_edges(space, degree if space.planes == 1 else degree // 2), EDGE)
    edges = materialize(merged(None, first, degree), "edges")
    for turn in range(rounds if space.planes > 1 else 0):
        follower = F.row_number().over(W.partitionBy("w").orderBy(F.xxhash64("u", "w", F.lit(turn))))
        some = edges.withColumn("r", follower).where(F.col("r") <= 4 * degree)
        ways = F.array(F.struct(F.col("ub").alias("block"), F.col("u").alias("v"), F.col("w").alias("m")), F.when(F.col("r") <= degree, F.struct(F.col("wb").alias("block"), F.col("w").alias("v"), F.col("u").alias("m"))))
        members = materialize(some.select("fresh", F.explode(ways).alias("e")).where("e IS NOT NULL").select("e.block", "e.v", "e.m", "fresh"), "members")
        worst = edges.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= degree, F.min("score")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        ends = nodes.select("id", "vec", "c0").join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
        met = members.select(F.col("block").alias("at"), F.col("m").alias("id")).distinct().join(ends, "id")
        pairs = members.groupBy("block").cogroup(met.groupBy("at")).applyInArrow(local_joins(space, degree), EDGE)
        better = materialize(merged(edges, pairs, degree), "edges")
        discard(edges, members)
        edges = better
        fresh, every = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if fresh <= SETTLED * every:
            break
    return edges


STATE = "grp long, qid long, qvec binary, pool array<long>, scores array<double>, expanded array<boolean>, front array<long>"


def searched(space: Space, pool: int, width: int):
    """A group's queries with the fetched nodes scored: the best of each query's pool, and which of them are to be expanded next."""

    def run(state: pa.Table, near: pa.Table) -> pa.Table:
        q = matrix(state.column("qvec"), space.kind).astype(np.float64)
        ids, x = near.column("id").to_numpy(), matrix(near.column("vec"), space.kind).astype(np.float64).reshape(-1, q.shape[1])
        out = {"pool": [], "scores": [], "expanded": [], "front": []}
        held = [state.column(c).to_pylist() for c in ("pool", "scores", "expanded")]
        s = q @ x.T
        for row in range(len(q)):
            some = np.argpartition(-s[row], pool)[:pool] if len(ids) > pool else np.arange(len(ids))
            exact = (x[some] * q[row]).sum(1)  # the same for a pair in whatever company it is scored
            known = np.array(held[0][row], np.int64)
            other = ~np.isin(ids[some], known)
            node = np.concatenate([known, ids[some][other]])
            score = np.concatenate([np.array(held[1][row]), exact[other]])
            done = np.concatenate([np.array(held[2][row], bool), np.zeros(other.sum(), bool)])
            best = np.lexsort((node, -score))[:pool]
            node, score, done = node[best], score[best], done[best]
            front = np.flatnonzero(~done)[:width]
            done[front] = True
            for name, value in zip(out, (node, score, done, node[front]), strict=True):
                out[name].append(value.tolist())
        kinds = {"pool": pa.int64(), "scores": pa.float64(), "expanded": pa.bool_(), "front": pa.int64()}
        return pa.table({"grp": state.column("grp"), "qid": state.column("qid"), "qvec": state.column("qvec"), **{c: pa.array(v, pa.list_(kinds[c])) for c, v in out.items()}})

    return run


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, space: Space, *, pool: int = POOL, width: int = WIDTH, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(qid, pool, scores), written: the best nodes found for queries (id, vec), best first, ties by id.

    A query begins in its cell, and at its own node's neighbours if it is one.
    """
    together = max(8, min(TOGETHER, TOGETHER * 64 // max(space.dim, 1)))
    total = queries.count()
    bits = min(space.bits, max(0, round(math.log2(max(total, 1) / together))))
    grouped, used = celled(queries, space, 2 * together, planes=1, mask=(1 << bits) - 1)
    coded, more = celled(queries, space, 1 << 40, planes=1)  # whole cells: chunk 0 stands for them
    start = materialize(grouped.withColumnRenamed("c0", "grp").join(coded.select("id", F.col("c0").alias("cell")), "id"), "queries")
    discard(*used, *more)
    cells = nodes.groupBy(F.shiftright("c0", CHUNK_BITS).alias("code")).agg(F.min("c0").alias("c0"))
    own = start.select("grp", F.shiftright("cell", CHUNK_BITS).alias("code")).distinct().join(cells, "code").join(nodes.select("id", "c0"), "c0").select("grp", "id")
    same = start.select("grp", "vec").join(nodes.select("vec", F.col("id").alias("u")), "vec").join(edges.select("u", "w"), "u").select("grp", F.explode(F.array("u", "w")).alias("id"))
    fetch = materialize(own.unionByName(same).distinct(), "fetch")
    nothing = [F.expr("array()").cast(f"array<{t}>") for t in ("long", "double", "boolean", "long")]
    state = start.select("grp", F.col("id").alias("qid"), F.col("vec").alias("qvec"), *[c.alias(n) for c, n in zip(nothing, ("pool", "scores", "expanded", "front"), strict=True)])
    fetched, held = [fetch], start
    for turn in range(rounds + 1):
        near = fetch.join(nodes.select("id", "vec"), "id")
        now = state.groupBy("grp").cogroup(near.groupBy("grp")).applyInArrow(searched(space, pool, width), STATE)
        state = materialize(now, "state")
        discard(held)
        held = state
        if turn == rounds:
            break
        front = state.select("grp", F.explode("front").alias("u")).distinct()
        seen = fetched[0]
        for t in fetched[1:]:
            seen = seen.unionByName(t)
        fetch = materialize(front.join(edges.select("u", "w"), "u").select("grp", F.col("w").alias("id")).distinct().join(seen, ["grp", "id"], "left_anti"), "fetch")
        if fetch.isEmpty():
            discard(fetch)
            break
        fetched.append(fetch)
    discard(*fetched)
    return state


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int, degree: int = DEGREE, rounds: int = ROUNDS, cell: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (key, vector), rows of the table, its k nearest other rows."""
    bound_batches(rows.sparkSession)
    kind, dim = shape(rows, vector)
    nodes = materialize(nodes_of(packed(rows, key, vector, kind, dim), k + 1), "nodes")
    cell = cell or max(64, min(CELL, CELL * 64 // max(dim, 1)))
    space = Space(nodes, kind, dim, cell)
    placed, used = celled(nodes.select("id", "vec"), space, cell)
    placed = materialize(placed, "placed")
    discard(*used)
    edges = descend(placed, space, degree=degree, rounds=rounds)
    asked = materialize(packed(queries, key, vector, kind, dim).groupBy("id").agg(F.min("vec").alias("vec")), "asked")
    found = search(asked, placed, edges, space)
    discard(placed, edges, asked)
    # the k + 1 best nodes are enough: one may be the query's own row alone
    best = found.select("qid", F.explode(F.slice(F.arrays_zip("pool", "scores"), 1, k + 1)).alias("e")).select("qid", F.col("e.pool").alias("id"), F.col("e.scores").alias("score"))
    each = best.join(nodes.select("id", "ids"), "id").select(F.col("qid").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=20)
