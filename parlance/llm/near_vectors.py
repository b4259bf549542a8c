"""Embedding near-duplicates by NN-descent over a neighbour graph.

1. Equal vectors of a label collapse into one node with a multiplicity.
2. Start lists: each random-projection tree orders the nodes by the sign
   bits of their projections; in sorted order every node takes its best
   ``k`` neighbours from a sliding block of ``BLOCK`` nodes.
3. NN-descent rounds: for every node a, the nodes that list a and a's own
   neighbours are compared with each other in one matrix product, and better
   ones enter the lists, until few entries change.
4. Lists full of neighbours above the threshold are saturated: they double
   once. What a doubled list can't hold is settled exactly, by 5 and 6.
5. Links between components of threshold edges: nodes are dealt into balls
   around a neighbour; ball centres are compared in pairs of bounded blocks,
   and balls of two components within the angular bound member by member.
   One link joins two components. Every node is in a ball, so no link between
   components is missed, whatever the graph has found; with few duplicates
   this is a pass over all pairs of a label.
6. The members of every component are compared with each other in pairs of
   bounded blocks, and only link counts leave the task.
7. Audit: the links of ``AUDIT`` nodes (smallest hashes) and of as many nodes
   that the search has linked are counted against all nodes of their labels;
   the first sample grows until ``LINKED`` of its nodes have links, up to
   ``AUDIT_MOST``. Recall is the smaller of its means by link and by node;
   below ``RECALL`` the operator fails. It is null where only part of the
   nodes was audited and none of them has a link.
8. Threshold edges (cosine in double precision) give the components.

Vectors that are null, empty, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing; vectors of different lengths are
never compared. Null and repeated ids keep their rows: a component's id is
its smallest id that is not null. An empty table gives no rows; extra columns
are ignored. Lists of reverse neighbours are split at ``FAN``, never capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hub

K = 10
TREES = 5
BLOCK = 128
FAN = 256
ROUNDS = 8
SETTLED = 0.01  # changed entries a round at which the descent ends
AUDIT = 256
AUDIT_MOST = 4096
LINKED = 64
RECALL = 0.99
MEMBERS = 512
CENTRES = 16_384  # most ball centres in a block
SPREAD = 32  # blocks of a label before blocks grow beyond MEMBERS
SLACK = 1e-5  # single precision in the search; links are verified in double

LISTS = "node long, ids array<long>, sims array<float>"
LIST_TYPE = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]


def _matrix(column, dtype="<f4") -> np.ndarray:
    """Rows of equal length from a binary column."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1)


def _lists(node, ids, sims):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((node, ids, sims), LIST_TYPE)], names=["node", "ids", "sims"])


def _normalise(batches):
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = np.asarray(v, float)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "x"])


def _codes(trees: int):
    """Rows (tree, code, node, lab, len, x32): projection signs as an integer."""
    def run(batches):
        planes = {}
        for b in batches:
            node, lab, dim, xs = (b.column(i).to_pylist() for i in range(4))
            for d in set(dim):
                at = [i for i, z in enumerate(dim) if z == d]
                x = np.frombuffer(b"".join(xs[i] for i in at), "<f8").reshape(len(at), d)
                small = [r.tobytes() for r in x.astype("<f4")]
                for t in range(trees):
                    if (d, t) not in planes:
                        planes[d, t] = np.random.default_rng(1000 * d + t).standard_normal((d, 48))
                    bits = (x @ planes[d, t] > 0)
                    code = (bits * (1 << np.arange(47, -1, -1, dtype=np.int64))).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array(code), pa.array([node[i] for i in at], pa.int64()), pa.array([lab[i] for i in at], pa.string()), pa.array([d] * len(at), pa.int32()), pa.array(small, pa.binary())], names=["tree", "code", "node", "lab", "len", "x"])
    return run


def _best(s: np.ndarray, ids: np.ndarray, k: int):
    """Ids and similarities of each row's k largest entries (-2: none)."""
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(s, top, 1)
    return [(ids[t[v > -2]], v[v > -2]) for t, v in zip(top, val)]


def _tree_lists(k: int):
    """Start lists from sorted rows; a sliding block sees BLOCK nodes and
    settles its middle half."""
    def solve(node, x):
        n, h = len(node), BLOCK // 2
        for a in range(0, n, h):
            lo, hi = max(0, a - h // 2), min(n, a + h + h // 2)
            s = x[a:a + h] @ x[lo:hi].T
            rows = np.arange(a, min(a + h, n))
            s[np.arange(len(rows)), rows - lo] = -2
            got = _best(s, node[lo:hi], k)
            yield _lists(node[a:a + h], [g[0] for g in got], [g[1] for g in got])

    def run(batches):
        key, nodes, xs = None, [], []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 3, 4, 2, 5)]
            for t, lab, dim, node, x in zip(*cols):
                if (t, lab, dim) != key or len(nodes) >= 64 * BLOCK:
                    if nodes:
                        yield from solve(np.array(nodes), np.frombuffer(b"".join(xs), "<f4").reshape(len(nodes), -1))
                    key, nodes, xs = (t, lab, dim), [], []
                nodes.append(node)
                xs.append(x)
        if nodes:
            yield from solve(np.array(nodes), np.frombuffer(b"".join(xs), "<f4").reshape(len(nodes), -1))
    return run


def _merge(threshold: float, base: int):
    """Distinct best entries of a node's lists; a saturated list of ``base``
    entries doubles. Adds the number of entries that changed; a list that is
    saturated again is left to the blocks and counts as settled."""
    def run(batches):
        for b in batches:
            node, old, k, ids, sims = (b.column(i).to_pylist() for i in range(5))
            out = []
            for o, kk, i, s in zip(old, k, ids, sims):
                i = np.concatenate([np.asarray(x, np.int64) for x in i])
                s = np.concatenate([np.asarray(x, np.float32) for x in s])
                i, first = np.unique(i, return_index=True)
                s = s[first]
                top = np.lexsort((i, -s))[:kk]
                i, s = i[top], s[top]
                full = len(s) == kk and s[-1] >= threshold - SLACK
                new = 0 if full and kk > base else len(np.setdiff1d(i, np.asarray(o or [], np.int64)))
                out.append((i, s, 2 * base if full else kk, new))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r[0] for r in out], LIST_TYPE[1]), pa.array([r[1] for r in out], LIST_TYPE[2]),
                pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int32())], names=["node", "ids", "sims", "k", "changed"])
    return run


def _local_join(batches):
    """Compare the nodes that list a, and a's neighbours, with each other."""
    for b in batches:
        us, ux, kth, vs, vx, kmax = (b.column(i).to_pylist() for i in range(6))
        for u, x, low, v, y, k in zip(us, ux, kth, vs, vx, kmax):
            u, low = np.array(u), np.array(low, np.float32)
            x = np.frombuffer(b"".join(x), "<f4").reshape(len(u), -1)
            ids, allx = np.concatenate([u, np.array(v, np.int64)]), np.concatenate([x, np.frombuffer(b"".join(y), "<f4").reshape(len(v), -1)])
            s = x @ allx.T
            s[(u[:, None] == ids[None, :]) | (s <= low[:, None])] = -2
            got = _best(s, ids, k)
            some = [j for j, g in enumerate(got) if len(g[0])]
            if some:
                yield _lists(u[some], [got[j][0] for j in some], [got[j][1] for j in some])


def _descend(graph: DataFrame, vec: DataFrame, threshold: float, base: int) -> DataFrame:
    """One NN-descent round over graph (node, ids, sims, k, changed)."""
    kth = F.when(F.size("ids") < F.col("k"), F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float")
    own = graph.join(vec, "node").select("node", "x", kth.alias("kth"), "ids", "k")
    out = own.select(F.col("node").alias("u"), "x", "kth", "k", F.explode("ids").alias("a"))
    fan = out.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("f"))
    ins = (out.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("f")))
           .groupBy("a", "salt").agg(F.collect_list(F.struct("u", "x", "kth")).alias("i"), F.max("k").alias("k")))
    heads = own.select(F.col("node").alias("a"), F.explode("ids").alias("v"))
    outs = (heads.join(vec.withColumnRenamed("node", "v"), "v").groupBy("a").agg(F.collect_list(F.struct("v", "x")).alias("o")))
    found = (ins.join(outs, "a").select("i.u", F.col("i.x").alias("ux"), "i.kth", "o.v", F.col("o.x").alias("vx"), "k")
             .mapInArrow(_local_join, LISTS))
    return _merged(graph, found, threshold, base)


def _merged(graph: DataFrame, found: DataFrame, threshold: float, base: int) -> DataFrame:
    rows = (graph.select("node", F.col("ids").alias("old"), "k", "ids", "sims")
            .unionByName(found.select("node", F.lit(None).cast("array<long>").alias("old"), F.lit(None).cast("int").alias("k"), "ids", "sims")))
    lists = rows.groupBy("node").agg(F.first("old", ignorenulls=True).alias("old"), F.max("k").alias("k"), F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims"))
    return hub(lists.select("node", "old", "k", "ids", "sims").mapInArrow(_merge(threshold, base), "node long, ids array<long>, sims array<float>, k int, changed int"))


def neighbour_graph(nodes: DataFrame, threshold: float, k: int = K, trees: int = TREES) -> DataFrame:
    """(node, ids, sims): neighbour lists of nodes (node, lab, len, x)."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = nodes.select("node", "lab", "len", "x").mapInArrow(_codes(trees), "tree int, code long, node long, lab string, len int, x binary")
    keys = ["tree", "lab", "len", "code", "node"]
    lists = coded.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_tree_lists(k), LISTS)
    empty = nodes.select("node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"), F.lit(k).alias("k"))
    graph = _merged(empty, lists, threshold, k)
    vec = hub(nodes.mapInArrow(_single, "node long, x binary"))
    for _ in range(ROUNDS):
        graph = _descend(graph, vec, threshold, k)
        moved = graph.agg((F.sum("changed") / F.sum(F.size("ids"))).alias("m")).first()["m"]
        if not moved or moved < SETTLED:
            break
    return graph


def _single(batches):
    for b in batches:
        x = [np.frombuffer(v, "<f8").astype("<f4").tobytes() for v in b.column(b.schema.get_field_index("x")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), pa.array(x, pa.binary())], names=["node", "x"])


def _verify_pairs(threshold: float):
    def run(batches):
        for b in batches:
            if len(b):
                u, v = b.column(2).to_pylist(), b.column(3).to_pylist()
                cos = np.array([float(np.dot(np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8"))) for x, y in zip(u, v)])
                keep = cos >= threshold
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])
    return run


def _count_links(threshold: float):
    """Links per node within a pair of blocks; rows come sorted by group."""
    def solve(rows):
        x = np.frombuffer(b"".join(r[6] for r in rows), "<f8").reshape(len(rows), -1)
        block = np.array([r[3] for r in rows])
        node, mult = np.array([r[4] for r in rows]), np.array([r[5] for r in rows], np.int64)
        near = x @ x.T >= threshold
        if rows[0][1] != rows[0][2]:
            near &= block[:, None] != block[None, :]
        else:
            np.fill_diagonal(near, False)
        links = near.astype(np.int64) @ mult
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    def run(batches):
        held = []
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if held and r[:3] != held[0][:3]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)
    return run


def _cells(column, i: int, dtype=None) -> np.ndarray:
    """One row of a list column: numbers, or vectors of a binary column."""
    v = column[i].values
    if dtype is None:
        return v.to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(v.to_pylist()), dtype).reshape(len(v), -1)


def _near_centres(threshold: float):
    """Pairs of balls in different components that may hold a link: the
    centres' angle is at most the threshold's, once more for each ball that
    has members beside its centre. A sure link of two components stands for
    their other pairs in the block pair."""
    angle = np.arccos(np.clip(threshold, -1, 1))
    limits = np.array([np.cos(min(np.pi, angle * k)) for k in (1, 2, 3)], np.float32) - np.float32(SLACK)
    sure_at = threshold + SLACK

    def run(batches):
        for batch in batches:
            same = batch.column(0).to_pylist()
            for i in range(len(batch)):
                (u, cu, fu), (v, cv, fv) = ([_cells(batch.column(k + j), i) for j in range(3)] for k in (1, 5))
                x, y = (_cells(batch.column(k), i, "<f4") for k in (4, 8))
                sure = set()
                for a in range(0, len(u), 1024):
                    s = x[a:a + 1024] @ y.T
                    near = (s >= limits[fu[a:a + 1024, None] + fv[None, :]]) & (cu[a:a + 1024, None] != cv[None, :])
                    if same[i]:
                        near &= u[a:a + 1024, None] < v[None, :]
                    r, c = np.nonzero(near)
                    if not len(r):
                        continue
                    good = s[r, c] >= sure_at
                    r += a
                    pair = np.stack([np.minimum(cu[r], cv[c]), np.maximum(cu[r], cv[c])], 1)
                    keep = []
                    for j in np.argsort(~good, kind="stable"):
                        key = (pair[j, 0], pair[j, 1])
                        if key not in sure:
                            keep.append(j)
                            if good[j]:
                                sure.add(key)
                    if keep:
                        yield pa.RecordBatch.from_arrays([pa.array(u[r[keep]]), pa.array(v[c[keep]])], names=["bu", "bv"])
    return run


def _link_members(threshold: float):
    """A link between the members of two balls' blocks, if there is one."""
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for i in range(len(batch)):
                s = _cells(batch.column(1), i, "<f8") @ _cells(batch.column(3), i, "<f8").T
                r, c = np.unravel_index(int(np.argmax(s)), s.shape)
                if s[r, c] >= threshold:
                    us.append(batch.column(0)[i][int(r)].as_py())
                    vs.append(batch.column(2)[i][int(c)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    return run


def cross_links(nodes: DataFrame, pairs: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between nodes (node, lab, len, x) of different components
    of ``pairs``, at least one for every two components that have any."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sym = pairs.select("u", "v").union(pairs.select("v", "u"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    centres = sym.groupBy("u").agg(F.min(rank("v")).alias("m")).filter(rank("u") < F.col("m")).select(F.col("u").alias("v"))
    # A node without a neighbour that is a centre is a ball of its own.
    near = sym.join(centres, "v").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("ball"))
    balls = hub(nodes.select("node", "lab", "len", "x").join(comp, "node", "left").join(near, "node", "left")
                .select("node", "lab", "len", "x", F.coalesce("comp", "node").alias("comp"), F.coalesce("ball", "node").alias("ball")))
    sizes = balls.groupBy("ball").agg(F.count("*").alias("size"))
    heads = balls.filter("node = ball").join(sizes, "ball").select("node", "lab", "len", "x", "comp", (F.col("size") > 1).cast("int").alias("fat"))
    small = heads.select("node", "x").mapInArrow(_single, "node long, x binary")
    heads = hub(heads.drop("x").join(small, "node"))
    blocks = (heads.groupBy("lab", "len").agg(F.count("*").alias("c"))
              .select("lab", "len", F.greatest(F.least(F.ceil(F.col("c") / MEMBERS), F.lit(SPREAD)), F.ceil(F.col("c") / CENTRES)).cast("int").alias("g")))
    cells = hub(heads.join(blocks, ["lab", "len"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
                .groupBy("lab", "len", "b").agg(F.collect_list(F.struct("node", "comp", "fat", "x")).alias("c"))
                .select("lab", "len", "b", "c.node", "c.comp", "c.fat", "c.x"))
    tasks = blocks.select("lab", "len", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("p"), "g").select("lab", "len", "p", F.explode(F.sequence("p", F.col("g") - 1)).alias("q"))

    def side(i):
        return cells.select("lab", "len", F.col("b").alias(i), *(F.col(c).alias(c + "_" + i) for c in ("node", "comp", "fat", "x")))
    maybe = hub(tasks.repartition(n, "lab", "len", "p", "q").join(side("p"), ["lab", "len", "p"]).join(side("q"), ["lab", "len", "q"])
                .select(F.expr("p = q").alias("same"), *(c + "_" + i for i in "pq" for c in ("node", "comp", "fat", "x")))
                .mapInArrow(_near_centres(threshold), "bu long, bv long").distinct())
    wanted = maybe.select(F.col("bu").alias("ball")).union(maybe.select("bv")).distinct()
    members = hub(balls.join(wanted, "ball").join(sizes.withColumn("g", F.ceil(F.col("size") / MEMBERS)), "ball")
                  .withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")))
                  .groupBy("ball", "b").agg(F.collect_list(F.struct("node", "x")).alias("c")).select("ball", "c.node", "c.x"))
    return (maybe.join(members.toDF("bu", "nu", "xu"), "bu").join(members.toDF("bv", "nv", "xv"), "bv")
            .select("nu", "xu", "nv", "xv").mapInArrow(_link_members(threshold), "u long, v long"))


def _audit(queries, threshold: float):
    """Links of the audited nodes among a partition's nodes."""
    def run(batches):
        q = queries.value
        total = np.zeros(len(q), np.int64)
        for b in batches:
            node, lab, dim, mult, xs = (b.column(i).to_pylist() for i in range(5))
            for key in set(zip(lab, dim)):
                at = [i for i, z in enumerate(zip(lab, dim)) if z == key]
                qs = [j for j, r in enumerate(q) if (r[1], r[2]) == key]
                if qs:
                    x = np.frombuffer(b"".join(xs[i] for i in at), "<f8").reshape(len(at), -1)
                    y = np.frombuffer(b"".join(q[j][3] for j in qs), "<f8").reshape(len(qs), -1)
                    near = (y @ x.T >= threshold) & (np.array([q[j][0] for j in qs])[:, None] != np.array([node[i] for i in at])[None, :])
                    total[qs] += near.astype(np.int64) @ np.array([mult[i] for i in at], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in q], pa.int64()), pa.array(total)], names=["node", "true_links"])
    return run


def audited_recall(nodes: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """The smaller of recall by link and by node of ``links`` (node, links)
    over audited nodes; None where a part of the nodes shows no link."""
    spark = nodes.sparkSession
    columns = ["node", "lab", "len", "x"]

    def first(some, n):
        return some.select(*columns).orderBy(F.xxhash64("node"), "node").limit(n).collect()

    def check(picked):
        queries = spark.sparkContext.broadcast([(r["node"], r["lab"], r["len"], bytes(r["x"])) for r in picked])
        true = (nodes.select("node", "lab", "len", "mult", "x").mapInArrow(_audit(queries, threshold), "node long, true_links long")
                .groupBy("node").agg(F.sum("true_links").alias("t")).filter("t > 0"))
        return [(r["t"], min(r["t"], r["f"])) for r in true.join(links, "node", "left").select("t", F.coalesce("links", F.lit(0)).alias("f")).collect()]
    size = AUDIT
    while True:
        picked = first(nodes, size)
        found = check(picked)
        whole = len(picked) < size
        if whole or len(found) >= LINKED or size >= AUDIT_MOST:
            break
        size *= 4
    samples = [found]
    if not whole:
        samples.append(check(first(nodes.join(links.filter("links > 0").select("node"), "node", "left_semi"), AUDIT)))
    recalls = [r for s in samples if s for r in (sum(f for _, f in s) / sum(t for t, _ in s), sum(f / t for t, f in s) / len(s))]
    return min(recalls) if recalls else 1.0 if whole else None


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row."""
    spark = vectors.sparkSession
    rows = hub(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"), F.col(label_col).cast("string").alias("lab")))
    finite = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("lab").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    good = rows.filter(valid)
    reps = hub(good.groupBy("lab", "e").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("mult")).withColumn("node", F.monotonically_increasing_id()))
    unit = reps.select("node", "e").mapInArrow(_normalise, "node long, x binary")
    nodes = hub(reps.select("node", "lab", F.size("e").alias("len"), "mult").join(unit, "node"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = nodes.select("node", "x")
    graph = neighbour_graph(nodes, threshold)
    edges = (graph.select(F.col("node").alias("u"), F.explode(F.arrays_zip("ids", "sims")).alias("z")).filter(F.col("z.sims") >= threshold - SLACK)
             .select(F.least("u", "z.ids").alias("u"), F.greatest("u", "z.ids").alias("v")).distinct())
    pairs = (edges.join(x.select(F.col("node").alias("u"), F.col("x").alias("ux")), "u").join(x.select(F.col("node").alias("v"), F.col("x").alias("vx")), "v")
             .select("u", "v", "ux", "vx").mapInArrow(_verify_pairs(threshold), "u long, v long"))
    pairs = hub(pairs)
    comp = hub(components(pairs))
    cross = cross_links(nodes, pairs, comp, threshold)
    comp = hub(components(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(cross)))
    sizes = comp.groupBy("comp").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("g"))
    blocks = (comp.join(sizes, "comp").withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
              .select("comp", "node", "b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
              .select("comp", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "node"))
    members = blocks.join(nodes.select("node", "mult", "x"), "node").select("comp", "p", "q", "b", "node", "mult", "x")
    links = hub(members.repartition(n, "comp", "p", "q").sortWithinPartitions("comp", "p", "q", "node").mapInArrow(_count_links(threshold), "node long, links long")
                .groupBy("node").agg(F.sum("links").alias("links")))
    recall = audited_recall(nodes, links, threshold)
    if recall is not None and recall < RECALL:
        raise RuntimeError(f"near_vectors: the audit found a recall of {recall:.4f}, below {RECALL}")
    named = reps.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(links, "node", "left")
    low = named.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    marked = named.join(low, "comp").select("lab", "e", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id")
    linked = good.join(marked, ["lab", "e"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
            .withColumn("audit_recall", F.lit(recall).cast("double")))
