"""Approximate nearest neighbours by a navigable small-world graph per shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash. Each shard's
graph is built in a task and stored as flat arrays in one row: vectors, a
level per node, and padded neighbour arrays for the ground and upper levels.
The number of shards follows the table, so a task's work and memory do not.
Query vectors travel in large pieces to every shard, so a graph is sent once a
piece; the shards' bests are merged.

Nearness is the inner product. In a graph a vector has one more coordinate,
sqrt(the shard's largest norm^2 - norm^2), after which the largest inner product
is the shortest distance. That coordinate enters distances as a difference of its
own, in double precision, so that vectors of very unlike norms do not cancel.

A graph is built as by inserting its nodes in order: a node's candidates are the
nearest among the nodes before it, of which it links to those nearer to itself than
to each other, and a node with too many links keeps the best by the same rule. All
nodes of a level are done together, by blocks of matrix products.

Equal vectors are one node: it carries its smallest ids, as many as any query
can ask for, so thousands of copies neither clutter the graph nor gather in a
task. That loses nothing, as ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite
values take no part, on either side; nor does a null id, nor vectors of other than
the commonest length; an id in several rows is one candidate, by the best of its
scores, asks with each of its vectors, and is never its own neighbour; fewer
candidates give fewer neighbours; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

#: Vectors of a shard, links of a node, candidates when linking, candidates when searching, queries of a piece, queries searched together, nodes a query expands at once.
SHARD_ROWS, LINKS, BUILD, SEARCH, PIECE, TOGETHER, EXPAND = 6_000, 16, 80, 128, 16_384, 128, 8


def spread(x: np.ndarray, own: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, nearest first, up to ``most``: those nearer to the node than to one taken before, then the nearest of the rest.

    ``held`` has positions in ``x`` (-1: none), ``own`` the distances to the row's node. Places not used are -1.
    """
    n, width = held.shape
    taken = np.zeros((n, width), bool)
    step = max(1, min(256, 4_000_000 // max(1, width) ** 2))
    for s in range(0, n, step):
        t = slice(s, s + step)
        y = x[held[t]]
        norm = np.einsum("ijk,ijk->ij", y, y)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
        closest, room = np.full(held[t].shape, np.inf), np.full(len(y), most)
        for k in range(width):
            take = (held[t][:, k] >= 0) & (own[t][:, k] < closest[:, k]) & (room > 0)
            taken[t][:, k] = take
            room -= take
            np.minimum(closest, np.where(take[:, None], between[:, k], np.inf), out=closest)
    order = np.argsort(np.where(held < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(held, np.sort(order, axis=1), axis=1)


class Graph:
    """Nodes with padded neighbour arrays; -1 is no neighbour."""

    def __init__(self, x: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 5):
        self.x, n = np.ascontiguousarray(x, "f8"), len(x)
        draw = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(draw.random(n)) / math.log(links)).astype("i4"), 12) if n else np.zeros(0, "i4")
        self.first = np.cumsum(self.level) - self.level  # rows of the upper levels
        self.upper = np.full((int(self.level.sum()), links), -1, "i4")
        norm = np.einsum("ij,ij->i", self.x, self.x)
        lifted = np.hstack([self.x, np.sqrt(np.maximum(0.0, norm.max(initial=0.0) - norm))[:, None]])
        self.ground = self._linked(lifted, np.arange(n), links, 2 * links, build)
        for k in range(1, int(self.level.max(initial=0)) + 1):
            nodes = np.nonzero(self.level >= k)[0]
            self.upper[self.first[nodes] + k - 1] = self._linked(lifted, nodes, links, links, build)
        self.entry = int(self.level.argmax()) if n else -1

    @staticmethod
    def _linked(lifted: np.ndarray, nodes: np.ndarray, links: int, most: int, build: int) -> np.ndarray:
        """Neighbours (nodes, most) of one level, as positions in the whole graph."""
        n = len(nodes)
        if n < 2:
            return np.full((n, most), -1, "i4")
        x, last = lifted[nodes, :-1], lifted[nodes, -1]
        x = x - x.mean(axis=0)  # distances stay, products shrink
        full = np.hstack([x, (last - last.mean())[:, None]])
        norm = np.einsum("ij,ij->i", full, full)
        width = min(build, n - 1)
        held, own = np.full((n, width), -1, "i4"), np.full((n, width), np.inf)
        for s in range(0, n, 512):
            t = slice(s, min(s + 512, n))
            ahead = min(t.stop, n)
            far = norm[t, None] + norm[:ahead] - 2 * (full[t] @ full[:ahead].T)
            far[np.arange(ahead) >= np.arange(t.start, t.stop)[:, None]] = np.inf  # only nodes before
            best = np.argpartition(far, min(width, ahead - 1), axis=1)[:, :width] if ahead > width else np.broadcast_to(np.arange(ahead), far.shape)
            d = np.take_along_axis(far, best, axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            best, d = np.take_along_axis(best, order, axis=1), np.take_along_axis(d, order, axis=1)
            held[t, : best.shape[1]] = np.where(np.isinf(d), -1, best)
            own[t, : best.shape[1]] = d
        chosen = spread(full, own, held, links)
        src, place = np.nonzero(chosen >= 0)
        dst = chosen[src, place]
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        d = norm[a] + norm[b] - 2 * np.einsum("ij,ij->i", full[a], full[b])
        order = np.lexsort((d, a))
        a, b, d = a[order], b[order], d[order]
        count = np.bincount(a, minlength=n)
        rank = np.arange(len(a)) - (np.cumsum(count) - count)[a]
        out = np.full((n, most), -1, "i4")
        fits = count[a] <= most
        out[a[fits], rank[fits]] = b[fits]
        crowded = np.nonzero(count > most)[0]
        for some in np.array_split(crowded, max(1, len(crowded) // 256)):  # a hub of any degree keeps its nearest few hundred as candidates
            if not len(some):
                continue
            wide = min(int(count[some].max()), 8 * most)
            row = np.full(n, -1)
            row[some] = np.arange(len(some))
            mine = (row[a] >= 0) & (rank < wide)
            near, far = np.full((len(some), wide), -1, "i4"), np.full((len(some), wide), np.inf)
            near[row[a[mine]], rank[mine]], far[row[a[mine]], rank[mine]] = b[mine], d[mine]
            out[some] = spread(full, far, near, most)
        return np.where(out >= 0, nodes[out], -1).astype("i4")

    def nearest(self, q: np.ndarray, k: int, width: int = SEARCH) -> list[np.ndarray]:
        """For each row of ``q`` the nodes found, nearest (of largest inner product) first."""
        if self.entry < 0 or not len(q):
            return [np.zeros(0, "i4") for _ in q]
        return [row[row >= 0] for s in range(0, len(q), TOGETHER) for row in self._search(q[s : s + TOGETHER], self._climb(q[s : s + TOGETHER]), max(k, width))]

    def _climb(self, q: np.ndarray) -> np.ndarray:
        """A node near to each query, by greedy steps down the upper levels."""
        node = np.full(len(q), self.entry)
        best = q @ self.x[self.entry]
        for level in range(int(self.level[self.entry]), 0, -1):
            moving = np.arange(len(q))
            while len(moving):
                around = self.upper[self.first[node[moving]] + level - 1]
                product = np.where(around >= 0, np.einsum("ijk,ik->ij", self.x[around], q[moving]), -np.inf)
                k = product.argmax(axis=1)
                top = product[np.arange(len(moving)), k]
                better = top > best[moving]
                moving, k = moving[better], around[better, k[better]]
                best[moving], node[moving] = top[better], k
        return node

    def _search(self, q: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
        """Best-first search on the ground level: (queries, width) nodes, nearest first, -1 where there are none."""
        n, rows = len(q), np.arange(len(q))
        ids, gain, done = np.full((n, width), -1), np.full((n, width), -np.inf), np.ones((n, width), bool)
        ids[:, 0], gain[:, 0], done[:, 0] = node, np.einsum("ij,ij->i", self.x[node], q), False
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, node] = True
        while len(rows):
            next_ = ~done[rows] & (np.cumsum(~done[rows], axis=1) <= EXPAND)
            r, c = np.nonzero(next_)
            done[rows[r], c] = True
            around = self.ground[ids[rows[r], c]]
            r, new = np.repeat(rows[r], around.shape[1]), around.ravel()
            fresh = new >= 0
            r, new = r[fresh], new[fresh]
            fresh = ~seen[r, new]
            key = np.unique(r[fresh] * len(self.x) + new[fresh])
            r, new = key // len(self.x), key % len(self.x)
            seen[r, new] = True
            product = np.einsum("ij,ij->i", self.x[new], q[r])
            close = product > gain[r, -1]
            r, new, product = r[close], new[close], product[close]
            count = np.bincount(r, minlength=n)
            rows = rows[count[rows] > 0] if len(r) else rows[:0]
            if len(rows):
                more = int(count.max())
                place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                at = np.full(n, -1)
                at[rows] = np.arange(len(rows))
                wide = [np.concatenate([old[rows], np.full((len(rows), more), empty)], axis=1) for old, empty in ((ids, -1), (gain, -np.inf), (done, True))]
                for held, value in zip(wide, (new, product, False), strict=True):
                    held[at[r], width + place] = value
                order = np.argsort(-wide[1], axis=1, kind="stable")[:, :width]
                ids[rows], gain[rows], done[rows] = (np.take_along_axis(held, order, axis=1) for held in wide)
            rows = np.nonzero((~done).any(axis=1))[0]
        return ids

    def arrays(self) -> dict[str, bytes]:
        return {"level": self.level.tobytes(), "ground": self.ground.tobytes(), "upper": self.upper.tobytes(), "entry": int(self.entry).to_bytes(4, "little", signed=True)}

    @classmethod
    def stored(cls, x: np.ndarray, arrays: dict[str, bytes], links: int = LINKS) -> Graph:
        out = cls(np.zeros((0, x.shape[1])), links)
        out.x = np.ascontiguousarray(x, "f8")
        out.level = np.frombuffer(arrays["level"], "i4")
        out.first = np.cumsum(out.level) - out.level
        out.ground = np.frombuffer(arrays["ground"], "i4").reshape(-1, 2 * links)
        out.upper = np.frombuffer(arrays["upper"], "i4").reshape(-1, links)
        out.entry = int.from_bytes(arrays["entry"], "little", signed=True)
        return out

    def best_ids(self, q: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
        """For each row of ``q``, ``(-score, id)`` of the best ``k`` different ids of the nodes found; the search widens until there are so many."""
        out: list = [None] * len(q)
        todo, width = np.arange(len(q)), max(k, SEARCH)
        while len(todo):
            short = []
            for at, found in zip(todo.tolist(), self.nearest(q[todo], k, width), strict=True):
                product = self.x[found] @ q[at]
                best: dict[int, float] = {}
                for s, i in zip(product.tolist(), found.tolist(), strict=True):
                    for own in ids[i]:
                        best[own] = max(s, best.get(own, s))
                if len(best) < k and width < len(self.x):
                    short.append(at)
                else:
                    out[at] = sorted((-s, own) for own, s in best.items())[:k]
            todo, width = np.array(short, "i8"), min(len(self.x), 4 * width)
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` with finite, non-zero vectors of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, piece: int = PIECE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for rows where ``queries`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    # -0.0 is made 0.0, so that equal vectors are equal keys
    rows = usable(vectors, id_col, vector_col).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = materialise(rows.withColumn("cls", F.sha2(F.to_json("v"), 256)), "vectors")
    named = rows.select("cls", "id").distinct()
    smallest = named.withColumn("_i", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(f"_i <= {k + 1}")
    ids = smallest.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = rows.groupBy("cls").agg(F.first("v").alias("v")).join(ids, "cls")
    shards = max(1, math.ceil(rows.select("cls").distinct().count() / shard_rows))
    classes = materialise(classes.withColumn("shard", F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int")), "classes")
    wanted = materialise(named.where(queries), "wanted")
    asked = classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("cls", "v")

    def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.array(column.combine_chunks().flatten().to_numpy()).reshape(rows, -1)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("cls")
        x = matrix(group.column("v"), len(group))
        made = {"shard": [group.column("shard")[0].as_py()], "n": [len(group)], "x": [x.tobytes()]} | {name: [data] for name, data in Graph(x).arrays().items()} | {"ids": [group.column("ids").to_pylist()]}
        return pa.table(made, schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("level", pa.binary()), ("ground", pa.binary()), ("upper", pa.binary()), ("entry", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    # one row per shard, of a size that shard_rows bounds; ranges, for hashes of few numbers collide
    dealt = classes.select("shard", "cls", "v", "ids").repartitionByRange(shards, "shard")
    index = materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, n int, x binary, level binary, ground binary, upper binary, entry binary, ids array<array<long>>"), "index")
    n_asked = asked.count()
    pieces = max(1, math.ceil(n_asked / piece))
    packed = asked.withColumn("piece", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(pieces))).groupBy("piece").agg(F.collect_list(F.struct("cls", "v")).alias("asked"))
    sent = materialise(packed, "asked").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = sent.join(index, "shard").withColumn("turn", F.col("piece") * shards + F.col("shard")).repartitionByRange(max(1, min(pieces * shards, 20 * parts)), "turn")

    def find(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = {name: batch.column(name)[r] for name in batch.schema.names}
                x = np.frombuffer(get["x"].as_py(), "f8").reshape(get["n"].as_py(), -1)
                graph, ids = Graph.stored(x, {c: get[c].as_py() for c in ("level", "ground", "upper", "entry")}), get["ids"].as_py()
                cls, v = get["asked"].values.flatten()
                q = np.array(v.flatten().to_numpy()).reshape(len(cls), -1)
                for s in range(0, len(q), 1024):
                    found = graph.best_ids(q[s : s + 1024], ids, k + 1)
                    flat = [(at + s, -far, own) for at, best in enumerate(found) for far, own in best]
                    at, score, own = zip(*flat, strict=True) if flat else ((), (), ())
                    yield pa.RecordBatch.from_arrays([cls.take(pa.array(at, pa.int64())), pa.array(score, pa.float64()), pa.array(own, pa.int64())], ["cls", "score", "vec_id"])

    hits = work.select("n", "x", "level", "ground", "upper", "entry", "ids", "asked").mapInArrow(find, "cls string, score double, vec_id long")
    each = hits.groupBy("cls", "vec_id").agg(F.max("score").alias("score"))
    best = each.withColumn("_i", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).where(f"_i <= {k + 1}")
    lists = materialise(best.groupBy("cls").agg(F.collect_list(F.struct("score", "vec_id")).alias("near")), "lists")
    asking = wanted.select(F.col("id").alias("query_id"), "cls")
    pairs = asking.join(small(lists, n_asked, 20_000), "cls").select("query_id", F.inline("near")).where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
