"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared only under equal labels and lengths.  Equal vectors are one node.  A
label's nodes are dealt to clusters, each node to its ``NEAR`` nearest; centroids that are near
copies of each other make one cluster, so that no group round one centre is divided.  A
cluster is a shard, which builds a graph: of a node's nearest and some random nodes, robust
pruning keeps those that no kept one is much nearer to.  The shards' adjacency lists of a node
are united.  Every node is then searched for in each of its shards: greedily from the shard's
medoids, and where near nodes are found the search expands through all neighbours within the
range and a margin.  Cosines in double precision verify what is found.  A cluster above
``SHARD_ROWS`` is cut into blocks by hash, and every pair of its blocks meets in a tile of at
most about ``SHARD_ROWS`` nodes, where all pairs are compared, so the cut parts no pair.

Links leave no task as pairs: a shard or tile gives for each node the weight of its links and
one edge to the least node it is connected with, so what moves grows with the nodes and not
with the square of a group.  A pair that two shards share counts in the first of them only.

``audit`` compares the links of ``AUDIT`` nodes (by hash) with brute force over all nodes.
Where it finds less than ``RECALL`` of them, nodes are dealt more widely, and at last every label is
one cluster, which is exact.

Centroids are fitted by label on at most ``SAMPLE_ROWS`` nodes of it (by hash), for the
``MODEL_LABELS`` largest labels above ``SHARD_ROWS`` and at most ``MODEL_CENTROIDS`` in all; any
other label is one cluster.  Every node is indexed and searched for.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or
have no label, link with nothing and are their own component; vectors of different length don't
link; repeated rows are a node's copies and link with each other; rows that share a vec_id are
told apart; a null vec_id never names a component that has another id; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

SHARD_ROWS = 2000
#: Of ``SHARD_ROWS``, a hash block's mean size: two blocks fit in a tile though hashing is uneven.
BLOCK_SHARE = 0.4
PER_CENTROID = 700
MAX_CENTROIDS, MODEL_CENTROIDS, MODEL_LABELS = 1024, 32_768, 4096
SAMPLE_ROWS = 8192
NEAR, WIDER = 2, 6
AUDIT, RECALL = 512, 0.95
NEAREST, RANDOM, DEGREE, ALPHA = 48, 16, 24, 1.2
BEAM, MARGIN, MEDOIDS = 24, 0.04, 12


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The node nearest to the mean, then nodes farthest from all chosen before."""
    chosen = [int((x @ x.mean(0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(sorted(set(chosen)))


def robust_graph(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Adjacency of a shard's nodes: pruned out-edges and their reverses."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(NEAREST + 1, n)
    out: list[set[int]] = [set() for _ in range(n)]
    for lo in range(0, n, 128):
        block = np.arange(lo, min(n, lo + 128))
        sims = x[block] @ x.T
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([top, rng.integers(0, n, (len(block), RANDOM))], 1)
        far = 2 - 2 * np.take_along_axis(sims, cand, 1)
        far[cand == block[:, None]] = np.inf  # itself
        order = np.argsort(far, 1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        among = 2 - 2 * np.einsum("bcd,bed->bce", x[cand], x[cand], optimize=True)
        alive = np.isfinite(far)
        for _ in range(DEGREE):
            has = alive.any(1)
            if not has.any():
                break
            pick = alive.argmax(1)
            rows = np.flatnonzero(has)
            for r in rows.tolist():
                out[lo + r].add(int(cand[r, pick[r]]))
            alive[rows] &= ALPHA**2 * among[rows, pick[rows]] > far[rows]
            alive[rows, pick[rows]] = False
    for a in range(n):
        for b in list(out[a]):
            out[b].add(a)
    for a in range(n):
        out[a].discard(a)
    return [np.array(sorted(s), np.int64) for s in out]


def range_search(x: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, query: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes within the range of node ``query``, with cosines: best-first from ``starts``, then
    through every neighbour within the range and the margin."""
    q, seen = x[query], np.zeros(len(x), bool)
    seen[starts] = True
    ids, sims, done = starts, x[starts] @ q, np.zeros(len(starts), bool)
    while True:
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        bar = np.partition(sims, -BEAM)[-BEAM] if len(sims) > BEAM else -np.inf
        go = open_[sims[open_] >= least - MARGIN]
        if not len(go):
            best = open_[sims[open_].argmax()]
            if sims[best] < bar or done.sum() >= BEAM:
                break
            go = np.array([best])
        done[go] = True
        new = np.unique(np.concatenate([graph[ids[g]] for g in go]))
        new = new[~seen[new]]
        seen[new] = True
        ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q]), np.concatenate([done, np.zeros(len(new), bool)])
    hit = (sims >= least) & (ids != query)
    return ids[hit], sims[hit]


def _merged(c: np.ndarray, least: float) -> np.ndarray:
    """The cluster of each centroid: centroids that are near copies themselves divide one group of
    near copies, so they, and chains of them, are one cluster."""
    own = np.arange(len(c))
    near = c @ c.T >= least
    np.fill_diagonal(near, True)
    while True:
        lower = np.where(near, own[None], len(c)).min(1)
        if (lower == own).all():
            return own
        own = lower


def _centroids(nodes: DataFrame, least: float) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Centroids of each large label and length with their clusters, fitted by tasks on bounded samples."""
    counts = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
    large = counts.orderBy(F.desc("n"), "label", "dim").limit(MODEL_LABELS).collect()
    asked = {(r["label"], r["dim"]): min(MAX_CENTROIDS, -(-r["n"] // PER_CENTROID)) for r in large}
    if not asked:
        return {}
    share = min(1.0, MODEL_CENTROIDS / sum(asked.values()))
    asked = {key: max(2, int(k * share)) for key, k in asked.items()}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("node").embedding)
        k = min(asked[int(key[0]), int(key[1])], max(1, len(x) // 8))
        c = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
        for _ in range(8):
            own = (x @ c.T).argmax(1)
            for j in range(k):
                if (own == j).any():
                    m = x[own == j].mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        return pd.DataFrame({"label": key[0], "dim": key[1], "cluster": _merged(c, least), "centroid": list(c)})

    # a hash below the bound takes about SAMPLE_ROWS nodes of a label, however many it has
    bounds = [(r["label"], r["dim"], min(2**31, SAMPLE_ROWS * 2**31 // r["n"])) for r in large]
    listed = nodes.sparkSession.createDataFrame(bounds, "label int, dim int, below long")
    dealt = nodes.join(F.broadcast(listed), ["label", "dim"]).where(F.pmod(F.xxhash64("embedding", F.lit(9)), F.lit(2**31)) < F.col("below"))
    fitted = dealt.groupBy("label", "dim").applyInPandas(fit, "label int, dim int, cluster int, centroid array<double>").toPandas()
    return {(int(a), int(b)): (np.stack(rows.centroid.to_numpy()), rows.cluster.to_numpy().astype(np.int64)) for (a, b), rows in fitted.groupby(["label", "dim"])}


def _deal(nodes: DataFrame, model: dict, near: int) -> DataFrame:
    """Every node once in each of its clusters, with all its clusters (``homes``) and in how many blocks this one is cut."""
    shared = nodes.sparkSession.sparkContext.broadcast(model)
    names = ["node", "label", "dim", "copies", "embedding", "cluster", "homes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for key, rows in pdf.groupby(["label", "dim"]):
                c, cluster = shared.value.get((int(key[0]), int(key[1])), (None, None))
                if c is None:
                    homes = np.zeros((len(rows), 1), np.int64)
                else:
                    order = np.argsort(cluster, kind="stable")
                    named, begin = np.unique(cluster[order], return_index=True)
                    best = np.maximum.reduceat(unit(rows.embedding) @ c[order].T, begin, axis=1)
                    homes = np.sort(named[np.argsort(-best, 1, kind="stable")[:, :near]], 1)
                for j in range(homes.shape[1]):
                    part = rows.assign(cluster=homes[:, j], homes=list(homes))
                    yield pa.RecordBatch.from_pandas(part[names], preserve_index=False)

    dealt = written(nodes.select(names[:5]).mapInArrow(run, "node long, label int, dim int, copies long, embedding array<double>, cluster long, homes array<long>"), "graph-dealt")
    n = F.count(F.lit(1))
    parts = F.when(n <= SHARD_ROWS, 1).otherwise(F.ceil(n / (SHARD_ROWS * BLOCK_SHARE)))
    sizes = written(dealt.groupBy("label", "dim", "cluster").agg(parts.cast("int").alias("parts")), "graph-sizes")
    return written(dealt.join(sizes, ["label", "dim", "cluster"]), "graph-shards")


LINKED = "node long, root long, n long"


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _linked(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """What a shard or tile tells of its links between places ``a`` and ``b`` of ``pdf`` (sorted by node):
    each node's weight of links that this cluster counts, and the least node it is connected with."""
    ids, copies, homes, here = pdf.node.to_numpy(), pdf.copies.to_numpy(), np.stack(pdf.homes.to_numpy()), pdf.cluster.iloc[0]
    common = (homes[a][:, :, None] == homes[b][:, None, :]).any(2)
    mine = np.where(common, homes[a], np.iinfo(np.int64).max).min(1) == here
    n = np.bincount(a[mine], copies[b[mine]], len(ids)) + np.bincount(b[mine], copies[a[mine]], len(ids))
    root = _roots(len(ids), a, b)
    use = (n > 0) | (root != np.arange(len(ids)))
    return pd.DataFrame({"node": ids[use], "root": ids[root[use]], "n": n[use].astype(np.int64)})


def _tiles(dealt: DataFrame, least: float) -> DataFrame:
    """Links of clusters above ``SHARD_ROWS``: every pair of nodes is compared in one tile of two hash blocks, or of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        block, x = pdf.block.to_numpy(), unit(pdf.embedding)
        left, right = np.flatnonzero(block == pdf.lo.iloc[0]), np.flatnonzero(block == pdf.hi.iloc[0])
        same, a, b = pdf.lo.iloc[0] == pdf.hi.iloc[0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(x[rows] @ x[right].T >= least)
            use = rows[i] < right[j] if same else np.ones(len(i), bool)
            a.append(rows[i[use]])
            b.append(right[j[use]])
        return _linked(pdf, np.concatenate(a), np.concatenate(b))

    block = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    cut = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    tiles = cut.select("label", "dim", "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "copies", "homes", "embedding")
    return tiles.groupBy("label", "dim", "cluster", "lo", "hi").applyInPandas(run, LINKED)


def _adjacency(dealt: DataFrame) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf.node.to_numpy()
        graph = robust_graph(unit(pdf.embedding))
        return pd.DataFrame({"node": ids, "near": [ids[g] for g in graph]})

    lists = dealt.groupBy("label", "dim", "cluster").applyInPandas(build, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search(dealt: DataFrame, adjacency: DataFrame, least: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, x = pdf.node.to_numpy(), unit(pdf.embedding)
        graph = []
        for near in pdf.near:
            near = np.asarray(near if near is not None else [], np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            graph.append(at[ids[at] == near])
        starts, pairs = medoids(x, MEDOIDS), [np.empty(0, np.int64)]
        for q in range(len(ids)):
            found, _ = range_search(x, graph, starts, q, least)
            pairs.append(np.minimum(found, q) * len(ids) + np.maximum(found, q))
        pairs = np.unique(np.concatenate(pairs))
        return _linked(pdf, pairs // len(ids), pairs % len(ids))

    joined = dealt.join(adjacency, "node", "left").select("label", "dim", "cluster", "node", "copies", "homes", "embedding", "near")
    return joined.groupBy("label", "dim", "cluster").applyInPandas(run, LINKED)


def _links(nodes: DataFrame, model: dict, near: int, least: float) -> DataFrame:
    dealt = _deal(nodes, model, near)
    whole = dealt.where("parts = 1")
    found = _search(whole, written(_adjacency(whole), "graph-adjacency"), least)
    return written(found.union(_tiles(dealt.where("parts > 1"), least)), "graph-links")


def audit(embeddings: DataFrame, rows: DataFrame, least: float = 0.98, queries: int = AUDIT) -> float:
    """Share found of the links of ``queries`` vectors (those of least hash): their ``n_links`` in ``rows``
    against brute force over all of ``embeddings`` (vec_id, label, embedding and, if there, copies)."""
    weight = F.col("copies") if "copies" in embeddings.columns else F.lit(1)
    vectors = embeddings.where(valid()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"), weight.cast("long").alias("copies"))
    chosen = vectors.orderBy(F.xxhash64("embedding", F.lit(21)), "vec_id").limit(queries).toPandas()
    asked = {(int(a), int(b)): (part.vec_id.to_numpy(), unit(part.embedding)) for (a, b), part in chosen.groupby(["label", "dim"])}
    shared = embeddings.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for key, part in batch.to_pandas().groupby(["label", "dim"]):
                ids, q = shared.value.get((int(key[0]), int(key[1])), (None, None))
                if ids is not None:
                    hit = (q @ unit(part.embedding).T >= least) & (ids[:, None] != part.vec_id.to_numpy()[None])
                    for i, n in zip(ids.tolist(), (hit @ part.copies.to_numpy()).tolist(), strict=True):
                        total[i] = total.get(i, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["q", "truth"])

    truth = vectors.mapInArrow(run, "q long, truth long").groupBy("q").agg(F.sum("truth").alias("truth"))
    both = truth.join(rows.select("vec_id", "n_links"), F.col("q") == F.col("vec_id"), "left").agg(F.sum("truth").alias("all"), F.sum(F.least("truth", F.coalesce("n_links", F.lit(0)))).alias("found")).first()
    return both["found"] / both["all"] if both["all"] else 1.0


def valid(label: str = "label", vector: str = "embedding"):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(rows, links): vec_id, n_links, component_id and kept for every row; and an edge (a, b) between
    nodes for each connection that a shard found."""
    typed = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = typed.where(valid())
    keyed = good.withColumn("key", F.xxhash64("label", "embedding")).withColumn("key2", F.xxhash64("embedding", F.lit(77)))
    grouped = keyed.groupBy("label", "key", "key2", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(grouped.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    model = _centroids(nodes, least)
    for near, clusters in ((NEAR, model), (WIDER, model), (1, {})):
        links = _links(nodes, clusters, near, least)
        counts = links.groupBy("node").agg(F.sum("n").alias("n_links"))
        if not clusters or audit(nodes.withColumnRenamed("node", "vec_id"), counts.withColumnRenamed("node", "vec_id"), least) >= RECALL:
            break
    edges = links.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    found = components(edges)
    named = nodes.join(counts.withColumnRenamed("n_links", "around"), "node", "left").join(found, "node", "left")
    named = written(named.select("label", "key", "key2", "least_id", (F.coalesce("around", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component")), "graph-named")
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least_ids, "component").select("label", "key", "key2", "n_links", "component_id")
    rows = keyed.select("vec_id", "label", "key", "key2").join(named, ["label", "key", "key2"]).select("vec_id", "n_links", "component_id")
    rest = typed.where(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), edges
