"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors that are equal are one node, numbered by its first row. Centres fitted on a
bounded sample cut space into clusters: up to ``CENTRES`` of them, then as many of what
is left of the vectors without their centres, and so on, so that the number of clusters
grows with the number of nodes. A node's home is its nearest cluster, and it visits the
next ones. A cluster's members are dealt to parts of about ``SHARD_LIMIT``. Each part's
members make a graph: nodes come in batches, each as large as the graph so far, are
searched for in it, and linked with some of what is found, so that no neighbour is much
nearer to another neighbour than to the node; then all are searched for once more. The
adjacency lists of a node from all its shards are united. Then every node is searched
for in all parts of its clusters, block by block: a greedy search from the part's medoid
that goes on as long as it finds nodes in range. Similarities are computed in double
precision, so a link is never below the threshold; a node is found in its home cluster
only, so none counts twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, components, numbered, small_side, table

THRESHOLD = 0.95
#: Nodes a cluster has on average, the clusters a node is in (of each level), and the members a part has on average at most.
CLUSTER, VISITS, SHARD_LIMIT = 1500, 3, 6000
#: The bound of the sample that the centres are fitted on, and of a level's number of centres.
SAMPLE, CENTRES = 20_000, 2_500
DEGREE, RANDOM, ALPHA, FIRST = 20, 8, 1.2, 256
BEAM, WIDE, QUERIES, EXPANDED = 32, 4, 256, 8192
SLACK = 0.05
#: Of the audit: every so many ids are compared with all rows, in blocks of so many queries and rows.
EVERY, AUDIT_QUERIES, AUDIT_ROWS = 50, 2_000, 20_000


def _scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Larger is nearer."""
    return x @ centres.T - 0.5 * (centres * centres).sum(1)


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from spread-out rows; the same for the same rows."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        home = _scores(x, centres).argmax(1)
        sums, n = np.zeros_like(centres), np.bincount(home, minlength=k)
        np.add.at(sums, home, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_levels(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Centres by level, for ``n`` vectors of which ``x`` is a sample: as many levels as it takes to have a cluster for each CLUSTER."""
    levels, wanted = [], -(-n // CLUSTER)
    while True:
        levels.append(_fit(x, max(1, min(len(x), CENTRES, wanted))))
        wanted = -(-wanted // len(levels[-1]))
        if wanted <= 1 or len(levels[-1]) == 1:
            return levels
        x = x - levels[-1][_scores(x, levels[-1]).argmax(1)]


def clusters(x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each vector its home cluster and those that it visits: the next ones of the first level, and around the home those of the last."""
    near = np.argsort(-_scores(x, levels[0]), axis=1, kind="stable")[:, :VISITS]
    found = []
    for v in range(near.shape[1]):
        at, rest = near[:, v].astype(np.int64), x - levels[0][near[:, v]]
        for k, centres in enumerate(levels[1:], 2):
            order = np.argsort(-_scores(rest, centres), axis=1, kind="stable")
            more = range(1, min(VISITS, len(centres))) if v == 0 and k == len(levels) else ()
            others = [at * len(centres) + order[:, m] for m in more]
            at, rest = at * len(centres) + order[:, 0], rest - centres[order[:, 0]]
            found += others
        found.insert(v if v == 0 else len(found), at)
    return np.stack(found, 1)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(levels: dict[int, list[np.ndarray]]):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                vectors = part.column("vec").to_pylist()
                dims = np.fromiter(map(len, vectors), int, len(vectors))
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = _unit([vectors[k] for k in at])
                    near = clusters(x, levels[dim])
                    v = near.shape[1]
                    node, weight = (np.repeat(part.column(c).to_numpy()[at], v) for c in ("node", "weight"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), dim, np.int32)), pa.array(near.ravel()), pa.array(np.tile(np.arange(v) == 0, len(at))), pa.array(node), pa.array(weight), pa.array([r.tobytes() for r in np.repeat(x, v, axis=0)], pa.binary())], ["dim", "cluster", "home", "node", "weight", "unit"])

    return run


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each node of ``of`` up to DEGREE of its candidates (rows, nearest first; -1: none), else -1."""
    some = candidates >= 0
    c = x[candidates]
    near = np.where(some, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", c, x[of]))), np.inf)
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(c, c.transpose(0, 2, 1))))
    out, rows = np.full((len(of), DEGREE), -1), np.arange(len(of))
    for k in range(DEGREE):
        best = near.argmin(1)
        live = np.isfinite(near[rows, best])
        if not live.any():
            break
        out[live, k] = candidates[rows, best][live]
        near[ALPHA * between[rows, best] <= near] = np.inf
        near[rows, best] = np.inf
    return out


def _distinct(candidates: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each row's candidates once, without the node itself; -1 for what goes."""
    c = np.sort(np.where(candidates == of[:, None], -1, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    return c


def _reverse(forward: np.ndarray, rng) -> np.ndarray:
    """For each node at most DEGREE of the nodes that have it in their lists."""
    n = len(forward)
    a, b = np.repeat(np.arange(n), forward.shape[1]), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((rng.random(len(b)), b))
    a, b = a[order], b[order]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    back = np.full((n, DEGREE), -1)
    back[b[place < DEGREE], place[place < DEGREE]] = a[place < DEGREE]
    return back


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (rows of node numbers, -1: none) of one shard, with reverse edges, by searches in the graph as it grows."""
    n, rng = len(x), np.random.default_rng(seed)
    order = rng.permutation(n)
    start = medoid(x)
    order[[0, int(np.flatnonzero(order == start)[0])]] = order[[int(np.flatnonzero(order == start)[0]), 0]]
    forward = np.full((n, DEGREE), -1)
    done = min(n, FIRST)

    def link(of: np.ndarray, near: np.ndarray, among: np.ndarray) -> None:
        cand = np.concatenate([near, forward[of], among[rng.integers(0, len(among), (len(of), RANDOM))]], axis=1)
        forward[of] = robust_prune(x, of, _distinct(cand, of))

    first = order[:done]
    link(first, np.broadcast_to(first[np.argsort(-(x[first] @ x[first].T), axis=1, kind="stable")[:, : BEAM + 1]], (done, min(done, BEAM + 1))), first)
    for again in (False, True):
        at = 0 if again else done
        while at < n:
            batch = order[at : n if again else at + done]
            adjacency = np.concatenate([forward, _reverse(forward, rng)], axis=1)
            for k in range(0, len(batch), QUERIES):
                of = batch[k : k + QUERIES]
                link(of, search(x, adjacency, x[of], start)[0], order[: n if again else done])
            at, done = at + len(batch), max(done, min(n, at + len(batch)))
    return np.concatenate([forward, _reverse(forward, rng)], axis=1)


def search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, start: int, threshold: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, q, node): the BEAM best nodes of each query (-1: none), and the queries' places and nodes of all found at or above the threshold.

    Greedy from ``start``: the WIDE best of a query's BEAM best nodes that haven't been
    expanded are, until there are none; so are all that are within SLACK of the range.
    """
    n, q = len(x), len(queries)
    seen, mark = np.zeros((q, n), bool), np.zeros((q, n), np.int32)
    seen[:, start] = True
    pool, score, open_ = np.full((q, BEAM), -1), np.full((q, BEAM), -3.0), np.zeros((q, BEAM), bool)
    pool[:, 0], score[:, 0] = start, queries @ x[start]
    hit_q, hit_n = [np.flatnonzero(score[:, 0] >= threshold)], []
    hit_n.append(np.full(len(hit_q[0]), start))
    rows, nodes = np.arange(q), np.full(q, start)
    wait_q, wait_n = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(rows):
        near = adjacency[nodes]
        r, c = np.repeat(rows, near.shape[1]), near.ravel()
        some = c >= 0
        r, c = r[some], c[some]
        some = ~seen[r, c]
        r, c = r[some], c[some]
        number = np.arange(len(r), dtype=np.int32)
        mark[r, c] = number
        some = mark[r, c] == number
        r, c = r[some], c[some]
        seen[r, c] = True
        s = np.einsum("id,id->i", queries[r], x[c])
        hit = s >= threshold
        hit_q.append(r[hit])
        hit_n.append(c[hit])
        close = s >= threshold - SLACK
        wait_q, wait_n = np.concatenate([wait_q, r[close]]), np.concatenate([wait_n, c[close]])
        if len(r):  # the pools and what was found, side by side; r is in order
            n_new = np.bincount(r, minlength=q)
            who = np.flatnonzero(n_new)
            place = np.arange(len(r)) - np.repeat(np.cumsum(n_new) - n_new, n_new)
            row = np.searchsorted(who, r)
            wide = BEAM + n_new.max()
            s_all, n_all, o_all = np.full((len(who), wide), -3.0), np.full((len(who), wide), -1), np.zeros((len(who), wide), bool)
            s_all[:, :BEAM], n_all[:, :BEAM], o_all[:, :BEAM] = score[who], pool[who], open_[who]
            s_all[row, BEAM + place], n_all[row, BEAM + place], o_all[row, BEAM + place] = s, c, ~close
            best = np.argpartition(-s_all, BEAM - 1, axis=1)[:, :BEAM]
            score[who], pool[who], open_[who] = (np.take_along_axis(a, best, 1) for a in (s_all, n_all, o_all))
        who = np.flatnonzero(open_.any(1))
        pick = np.argsort(-np.where(open_[who], score[who], -4.0), axis=1)[:, :WIDE]
        go = np.take_along_axis(open_[who], pick, 1)
        r, k = np.nonzero(go)
        at = pick[r, k]
        rows, nodes = who[r], pool[who[r], at]
        open_[rows, at] = False
        rows, nodes = np.concatenate([rows, wait_q[:EXPANDED]]), np.concatenate([nodes, wait_n[:EXPANDED]])
        wait_q, wait_n = wait_q[EXPANDED:], wait_n[EXPANDED:]
        order = np.argsort(rows, kind="stable")
        rows, nodes = rows[order], nodes[order]
    return pool, np.concatenate(hit_q), np.concatenate(hit_n)


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the components of each pair; parent points to smaller numbers and is flat before and after."""
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(pa_, pb)[apart], np.minimum(pa_, pb)[apart])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _shard(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
    return pdf, np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, x = _shard(pdf)
    node = pdf["node"].to_numpy()
    graph = build_graph(x, int(pdf["cluster"].iloc[0]))
    return pd.DataFrame({"node": node, "near": [node[np.unique(r[r >= 0])] for r in graph]})


def _search(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, whole = _shard(pdf)
        every, is_node = pdf["node"].to_numpy(), pdf["is_node"].to_numpy()
        x, node, home, weight = whole[is_node], every[is_node], pdf["home"].to_numpy()[is_node], pdf["weight"].to_numpy()[is_node]
        n, asked = len(node), np.flatnonzero(pdf["is_query"].to_numpy())
        links, parent = np.zeros(len(every), np.int64), np.arange(len(every))
        if n and len(asked):
            place = np.flatnonzero(is_node)
            local = []
            for near in pdf["near"][is_node]:  # only neighbours that live in this part
                near = np.unique(np.concatenate(near)) if near is not None and len(near) else np.empty(0, np.int64)
                at = np.searchsorted(node, near)
                at[at == n] = 0
                local.append(at[node[at] == near])
            adjacency = np.full((n, max(1, max(map(len, local)))), -1)
            for k, near in enumerate(local):
                adjacency[k, : len(near)] = near
            start = medoid(x)
            for k in range(0, len(asked), QUERIES):
                queries = asked[k : k + QUERIES]
                _, q, found = search(x, adjacency, whole[queries], start, threshold)
                q = queries[q]
                other = (place[found] != q) & home[found]
                q, found = q[other], found[other]
                np.add.at(links, q, weight[found])
                _hook(parent, q, place[found])
        return pd.DataFrame({"node": every, "links": links, "root": every[parent]})

    return run


def _sound(vec: str):
    """Whether a vector isn't null or zero and holds finite components only."""
    return F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row a row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null id, link with nothing: n_links 0, the component is their own
    id, kept. Vectors of different lengths never link. Equal vectors (by 128 bits of
    hashes) count each other. Rows with the same id are vectors of their own; the smallest
    id of a component names it, and all its rows with that id are kept. n_links is what
    the row's own search found; see audit() for what it misses. Other columns don't matter.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & _sound("vec"), F.transform("vec", lambda v: v + F.lit(0.0))).alias("vec"))
    digests = [F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(k), "vec")).alias(f"d{k}") for k in (1, 2)]
    rows = numbered(scratch.write(rows.select("vec_id", "vec", *digests), "rows"), scratch)
    nodes = rows.where("vec IS NOT NULL").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"), F.count("*").alias("weight"))
    nodes = scratch.write(nodes, "nodes")
    sizes = nodes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row a number of components
    levels = {}
    for dim, n in sorted((r["dim"], r["n"]) for r in sizes):
        share = F.shiftrightunsigned(F.xxhash64("node"), 11).cast("double") / float(1 << 53)
        some = nodes.where(F.size("vec") == dim)
        sample = some.where(share < SAMPLE / n).orderBy("node").select("vec").collect() or some.orderBy("node").limit(1).select("vec").collect()
        levels[dim] = fit_levels(_unit([r["vec"] for r in sample]), n)
    assigned = scratch.write(nodes.select("node", "weight", "vec").mapInArrow(_assign(levels), "dim int, cluster long, home boolean, node long, weight long, unit binary"), "assigned")
    parts = scratch.write(assigned.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / SHARD_LIMIT).cast("int").alias("parts")), "parts")
    member = assigned.join(small_side(parts), ["dim", "cluster"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    graph = scratch.write(member.groupBy("dim", "cluster", "own").applyInPandas(_build, "node long, near array<long>"), "graph")
    united = graph.groupBy("node").agg(F.collect_list("near").alias("near"))
    # a part's nodes meet every block of the cluster's queries, and the part's members all of its parts
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    as_node = member.withColumn("part", F.col("own")).withColumn("block", every).withColumn("is_node", F.lit(True)).withColumn("is_query", F.col("block") == F.col("own"))
    as_query = member.withColumn("block", F.col("own")).withColumn("part", every).where("part != own").withColumn("is_node", F.lit(False)).withColumn("is_query", F.lit(True))
    shown = ["dim", "cluster", "part", "block", "is_node", "is_query", "home", "node", "weight", "unit"]
    both = as_node.join(united, "node", "left").select(*shown, "near").unionByName(as_query.select(*shown, F.lit(None).cast("array<array<bigint>>").alias("near")))
    found = scratch.write(both.groupBy("dim", "cluster", "part", "block").applyInPandas(_search(threshold), "node long, links long, root long"), "found")
    comps = scratch.write(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "components")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.select("d1", "d2", "node", "least", "weight").join(counted, "node").join(comps.withColumnRenamed("id", "node"), "node", "left")
    whole = scratch.write(whole.withColumn("root", F.coalesce("component", "node")), "linked")
    names = scratch.write(whole.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    whole = scratch.write(whole.join(names, "root").select("d1", "d2", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    out = rows.select("vec_id", "d1", "d2").join(whole, ["d1", "d2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, every: int = EVERY) -> DataFrame:
    """(vec_id, exact_links) of the vectors whose id is divisible by ``every``: by brute force against all rows, in bounded blocks; no pair leaves a task.

    Rows of the same id and vector are one row here. Rows that link with nothing have no row.
    """
    scratch = Scratch(vectors.sparkSession, "audit")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & _sound("vec")).withColumn("dim", F.size("vec"))
    rows = numbered(scratch.write(rows, "rows"), scratch)
    queries = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_queries = rows.count(), queries.count()
    deal = lambda n, most: F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // most)))).cast("int")
    spread = lambda n, most: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // most)) - 1)))
    left = queries.withColumn("q", deal(n_queries, AUDIT_QUERIES)).withColumn("r", spread(n_rows, AUDIT_ROWS))
    right = rows.withColumn("r", deal(n_rows, AUDIT_ROWS)).withColumn("q", spread(n_queries, AUDIT_QUERIES))

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": pd.Series([], dtype="int64"), "row": pd.Series([], dtype="int64"), "exact_links": pd.Series([], dtype="int64")})
        a, b = _unit(list(left["vec"])), _unit(list(right["vec"]))
        n = ((a @ b.T >= threshold) & (left["row"].to_numpy()[:, None] != right["row"].to_numpy())).sum(1)
        return pd.DataFrame({"vec_id": left["vec_id"], "row": left["row"], "exact_links": n})

    keys = ["dim", "q", "r"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "vec_id long, row long, exact_links long")
    return counts.groupBy("vec_id", "row").agg(F.sum("exact_links").alias("exact_links")).groupBy("vec_id").agg(F.max("exact_links").alias("exact_links"))


def recall(found: DataFrame, audited: DataFrame) -> float:
    """The share of the audited vectors' links that ``found`` (of near_vectors, with unique ids) has; 1.0 without links."""
    both = found.join(audited, "vec_id").agg(F.sum("exact_links").alias("links"), F.sum(F.least("exact_links", "n_links")).alias("found")).first()
    return both["found"] / both["links"] if both["links"] else 1.0


def op9_vector_dedup(spark, sf_dir):
    """near_vectors, and exact_links: what brute force finds for the ids divisible by EVERY (else null), so that the recall can be read from the rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_vectors(vectors).join(small_side(audit(vectors)), "vec_id", "left")
