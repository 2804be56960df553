"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors), in the task that gathers the sample, and is shared with all
tasks: at most ``SAMPLE / LEAF`` leaves. The driver sees the tree and the probes, never the sample.
Every row is indexed under its leaf. A query walks the tree with a priority queue: the node whose centre is nearest is
opened next, so leaves come out in order of promise. How many leaves a query visits is calibrated: on ``PROBES`` sample
vectors, compared with a brute-force pass over all rows, the number is the least that reaches the target recall (and then
a margin). The visits are cut in tasks by leaf, and a leaf of many rows (copies of one vector, say) is cut further.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktally.llm import blocks as B

SAMPLE = 40_000
LEAF = 100  # sample vectors under a leaf
BRANCH = 8
PROBES = 200
CELL = 20_000  # rows of a leaf in one task


def usable(rows, id_col, vector_col):
    """(id, vector) of the vectors that take part: not null, not zero, all components finite. Of several lengths the most
    frequent counts (the longer of equally frequent ones): only vectors of one length have a cosine."""
    x = F.col("vector")
    ok = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    dim = ok.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return (ok.where(F.size(x) == dim[0].d), dim[0].d) if dim else (ok, 0)


def _unit(x):
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit_tree(x, seed=0):
    """(centres, children of each node, leaf numbers): spherical k-means, split until a node has at most ``LEAF`` vectors."""
    rng = np.random.default_rng(seed)
    centres, kids, leaves = [], [], []

    def node(rows):
        me = len(centres)
        c = x[rows].mean(0)
        centres.append(c / max(np.sqrt(c @ c), 1e-12))
        kids.append([])
        leaves.append(-1)
        return me

    todo = [(node(np.arange(len(x))), np.arange(len(x)))]
    n_leaves = 0
    while todo:
        me, rows = todo.pop()
        parts = []
        if len(rows) > LEAF:
            c = x[rng.choice(rows, BRANCH, replace=False)]
            for _ in range(8):
                near = (x[rows] @ c.T).argmax(1)
                for k in range(BRANCH):
                    mine = x[rows[near == k]]
                    if len(mine):
                        s = mine.sum(0)
                        c[k] = s / max(np.sqrt(s @ s), 1e-12)
            parts = [rows[near == k] for k in range(BRANCH) if (near == k).any()]
        if len(parts) < 2:
            leaves[me] = n_leaves
            n_leaves += 1
        else:
            for p in parts:
                kids[me].append(node(p))
                todo.append((kids[me][-1], p))
    return np.array(centres), kids, leaves


def fitted(sample, seed):
    """(tree, ids and vectors of the probes) of an ordered sample, fitted by the one task in which its rows are gathered."""
    n_probes = PROBES

    def fit(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        x = _vectors(t)
        centres, kids, leaves = fit_tree(_unit(x), seed)
        ids = np.asarray(t.column("id"))[:n_probes]
        vectors = [*centres, *x[:n_probes]]
        yield pa.RecordBatch.from_pydict({
            "at": pa.array([*range(len(centres)), *range(len(ids))], pa.int32()), "probe": pa.array([None] * len(centres) + ids.tolist(), pa.int64()),
            "vector": pa.array(vectors, pa.list_(pa.float64())), "kids": pa.array(kids + [None] * len(ids), pa.list_(pa.int32())),
            "leaf": pa.array(leaves + [None] * len(ids), pa.int32())})

    got = sorted(sample.mapInArrow(fit, "at int, probe long, vector array<double>, kids array<int>, leaf int").collect(), key=lambda r: r.at)
    nodes, probes = [r for r in got if r.probe is None], [r for r in got if r.probe is not None]
    tree = np.array([r.vector for r in nodes]), [r.kids for r in nodes], [r.leaf for r in nodes]
    return tree, np.array([r.probe for r in probes]), np.array([r.vector for r in probes])


def leaf_of(tree, x):
    """Leaf of each vector: the nearest child at every node."""
    centres, kids, leaves = tree
    out = np.empty(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        me, rows = todo.pop()
        if leaves[me] >= 0:
            out[rows] = leaves[me]
        elif len(rows):
            near = (x[rows] @ centres[kids[me]].T).argmax(1)
            todo.extend((k, rows[near == i]) for i, k in enumerate(kids[me]))
    return out


def best_bins(tree, q, visits):
    """The first ``visits`` leaves of one query, best bin first."""
    centres, kids, leaves = tree
    heap, out = [(0.0, 0)], []
    while heap and len(out) < visits:
        _, me = heapq.heappop(heap)
        if leaves[me] >= 0:
            out.append(leaves[me])
        else:
            for k, s in zip(kids[me], (centres[kids[me]] @ q).tolist(), strict=True):
                heapq.heappush(heap, (-s, k))
    return out


def _top(q_ids, q, ids, x, k):
    """Exact (query number, id, cosine) of the k nearest rows of each query, ties to the smaller id."""
    out = []
    qu, xu = _unit(q), _unit(x)
    for a in range(0, len(q), 256):
        s = qu[a:a + 256] @ xu.T
        s[q_ids[a:a + 256, None] == ids[None, :]] = -2
        for i, row in enumerate(s, a):
            m = int((row > -2).sum())
            if not m:
                continue
            edge = np.partition(row, len(row) - min(k, m))[len(row) - min(k, m)] - 1e-9
            near = np.flatnonzero((row >= edge) & (row > -2))
            exact = cosine(q[i], x[near])
            best = near[np.lexsort((ids[near], -exact))[:k]]
            out += [(i, int(ids[j]), float(c)) for j, c in zip(best, cosine(q[i], x[best]), strict=True)]
    return out


def _different(ids, x, k):
    """Rows without repeated (id, vector) rows, and of equal vectors only the k + 1 least ids: no more can be among k."""
    key = np.array([r.tobytes() for r in x], object)
    order = sorted(range(len(ids)), key=lambda i: (key[i], ids[i]))
    keep, n, last = [], 0, None
    for i in order:
        if last is None or key[i] != key[last]:
            n = 0
        elif ids[i] == ids[last]:
            continue
        n += 1
        last = i
        if n <= k + 1:
            keep.append(i)
    return ids[keep], x[keep]


def cosine(q, x):
    """Cosine in double precision, one row at a time in the same order of operations wherever the row lies."""
    dot = np.array([np.dot(q, r) for r in x]) if len(x) else np.zeros(0)
    return dot / (np.sqrt(np.dot(q, q)) * np.sqrt(np.array([np.dot(r, r) for r in x]))) if len(x) else dot


def _vectors(table, name="vector"):
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten(), np.float64).reshape(table.num_rows, -1)


def search(rows, is_query, id_col="vec_id", vector_col="embedding", k=5, recall=0.97, seed=0):
    """The k nearest rows of each row for which ``is_query`` (a function of the id column) holds: query_id, rank, id, score.

    All rows but those of the query's own id are candidates; nearest first, ties to the smaller id; score is the cosine in
    double precision. Null, zero and non-finite vectors take no part, nor do vectors of another length than most, nor null
    ids. A repeated row (equal id and vector) counts once; an id with several vectors asks for the nearest of any of them.
    """
    spark = rows.sparkSession
    base, dim = usable(rows.where(F.col(id_col).isNotNull()), id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    total = base.count()
    order = F.xxhash64("id", F.lit(seed))
    part = base.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * SAMPLE / total) * (1 << 30)))).orderBy(order, "id").limit(SAMPLE)
    tree, probe_ids, probes = fitted(part, seed)
    shared = spark.sparkContext.broadcast(tree)
    n_leaves = max(tree[2]) + 1

    def brute(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                x = _vectors(t)
                found = _top(probe_ids, probes, np.asarray(t.column("id")), x, k)
                row_of = {}
                for r, d in enumerate(np.asarray(t.column("id")).tolist()):
                    row_of.setdefault(d, r)
                leaf = leaf_of(shared.value, _unit(x[[row_of[d] for _, d, _ in found]])) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"q": pa.array([f[0] for f in found], pa.int32()), "id": pa.array([f[1] for f in found], pa.int64()),
                                                  "score": pa.array([f[2] for f in found], pa.float64()), "leaf": pa.array(leaf, pa.int64())})

    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "leaf"))), 1, k)
    truth = base.mapInArrow(brute, "q int, id long, score double, leaf long").groupBy("q").agg(best.alias("best")).collect()
    unit = _unit(probes)
    depth = []
    for r in truth:
        place = {leaf: n for n, leaf in enumerate(best_bins(tree, unit[r.q], n_leaves))}
        depth += [place[b.leaf] + 1 for b in r.best]
    # widen until the probes reach the target, then by a quarter for queries unlike them
    visits = min(n_leaves, int(np.ceil(1.25 * np.quantile(depth, recall))) + 1) if depth else n_leaves

    def index(batches):
        for batch in batches:
            leaf = leaf_of(shared.value, _unit(_vectors(pa.Table.from_batches([batch])))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vector": batch.column("vector"), "leaf": pa.array(leaf, pa.int32())})

    # a number per leaf comes to the driver and goes out with the tasks: joined, it would let Spark broadcast the other side,
    # whose size it takes for that of the queries before each is repeated for every leaf it visits
    indexed = base.mapInArrow(index, "id long, vector array<double>, leaf int")
    cells = np.zeros(n_leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        cells[r["leaf"]] = -(-r["count"] // CELL)

    def walk(batches):
        for batch in batches:
            x = _vectors(pa.Table.from_batches([batch])) if batch.num_rows else np.zeros((0, dim))
            leaf, cell = [], []
            for q in (_unit(x) if len(x) else x):
                found = np.array(best_bins(shared.value, q, visits), np.int64)
                n = cells[found]
                leaf.append(np.repeat(found, n).astype(np.int32))
                cell.append((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vector": batch.column("vector"),
                                              "leaf": pa.array(leaf, pa.list_(pa.int32())), "cell": pa.array(cell, pa.list_(pa.int32()))})

    def visit(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids = np.asarray(left.column("id"))
        found = _top(q_ids, _vectors(left), *_different(np.asarray(right.column("id")), _vectors(right), k), k)
        return pa.table({"query_id": pa.array([int(q_ids[f[0]]) for f in found], pa.int64()), "id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64())})

    of_leaf = F.get(F.array(*map(F.lit, cells.tolist())), F.col("leaf"))
    held = indexed.withColumn("cell", F.pmod(F.xxhash64("id", "vector"), of_leaf).cast("int"))
    asked = (base.where(is_query(F.col("id"))).distinct().mapInArrow(walk, "id long, vector array<double>, leaf array<int>, cell array<int>")
             .select("id", "vector", F.inline(F.arrays_zip("leaf", "cell"))))
    near = asked.groupBy("leaf", "cell").cogroup(held.groupBy("leaf", "cell")).applyInArrow(visit, "query_id long, id long, score double")
    top = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "id"))), 1, k).alias("best"))
    return top.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.far")).alias("score"))


B.by_value(__name__)
