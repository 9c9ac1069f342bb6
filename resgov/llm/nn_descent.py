"""Embedding near-dedup by NN-descent.

Vectors are compared only within their label (and length).  Equal vectors are
one node with a weight.  Every node keeps a list of the nearest nodes known, K
at first.  Lists start from several random-plane orderings: nodes are sorted by
their sign codes and meet those sorted next to them.  Then, round by round, the
neighbours of each node (its list, and a sample of those that list it) are
joined with each other where one of the two is new since the last round, and
better ones enter the lists, until a round finds no new link.

A list that is linked to its last entry is saturated: it doubles, as often as
it takes for its last entry to fall below the threshold, up to ``LIST_MOST``.
A node with that many links and more makes its component dense.  Links between
two dense components need not be in any list, so dense components of a label are
held against each other (``bridges``): blocks of ``BLOCK`` nodes have a centre
and a largest angle to it, and only pairs of blocks that the triangle inequality
of angles rules out are not compared.  Components joined so are one, and each is
compared exactly in pairs of blocks, each pair one bounded group; only counts
come back, so a dense group of n costs no n * n rows.

Recall is audited: the nodes whose smallest vec_id is divisible by ``AUDIT_STEP``
(all nodes, if these are fewer than ``AUDIT_LEAST``) are compared with all nodes
by brute force, in waves of at most ``AUDIT_BYTES``.  While less than ``RECALL``
of their links are known, as a share of all and as a mean over the nodes with
links, the search goes on with twice as many orderings.  If ``MOST`` orderings
are not enough, all nodes of a label are compared in pairs of blocks, which is
exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, link with nothing; repeated rows are equal
vectors; a null vec_id takes part but is nobody's component_id unless it is
alone (then null, kept true); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .frames import components, prepared, sent, written

K, WINDOW, NEAR, TABLES, BITS = 8, 8, 4, 8, 60
BLOCK = 512
MOST = 8 * TABLES
LIST_MOST = 32
AUDIT_STEP, AUDIT_LEAST, AUDIT_BYTES, RECALL = 100, 200, 8 << 20, 0.98
EDGES = "u long, v long, sim double"


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length in double precision from float64 bytes of one length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def encoded(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw): raw holds the components as float64; null label and raw where the vector is unusable."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # a null component is nan
            known = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False) & (offsets[1:] > offsets[:-1])
            raws: list = [None] * batch.num_rows
            for i in np.flatnonzero(known):
                x = flat[offsets[i]:offsets[i + 1]]
                with np.errstate(over="ignore"):
                    if np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf:
                        raws[i] = x.tobytes()
            usable = pa.array([r is not None for r in raws], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(usable, batch.column(1), None), pa.array(raws, pa.binary())], ["vec_id", "label", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, raw binary")


def neighbours_by_order(nodes: DataFrame, table: int, parts: int, threshold: float) -> DataFrame:
    """(u, v, sim): for each node, of those sorted next to it by the signs of random projections, the NEAR nearest and all linked."""
    def code(batches):
        planes: dict = {}
        for batch in batches:
            codes = []
            for raw in batch.column(2).to_pylist():
                x = np.frombuffer(raw, np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(1000 * table + 17).normal(size=(len(x), BITS))
                bits = (x @ planes[len(x)] > 0).astype(np.int64)
                codes.append(int(bits @ (1 << np.arange(BITS, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], ["node", "label", "raw", "code"])

    def meet(batches):
        kept = None
        for batch in batches:
            ids, labels, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = [(a, len(r)) for a, r in zip(labels, raws)]
            new = len(ids)
            if kept is not None:  # the last ones of the batch before sit in front
                ids, keys, raws = np.append(kept[0], ids), kept[1] + keys, kept[2] + raws
            old = len(ids) - new
            us, vs, sims = [], [], []
            begin = 0
            while begin < len(ids):
                end = begin + 1
                while end < len(ids) and keys[end] == keys[begin]:
                    end += 1
                x, own, n = unit(raws[begin:end]), ids[begin:end], end - begin
                table_ = np.full((n, 2 * WINDOW), -2.0)
                other = np.zeros((n, 2 * WINDOW), dtype=np.int64)
                for step in range(1, min(WINDOW, n - 1) + 1):
                    s = np.einsum("ij,ij->i", x[step:], x[:-step])
                    fresh = np.arange(begin + step, end) >= old  # pairs of two old rows were met before
                    s = np.where(fresh, s, -2.0)
                    table_[step:, step - 1], other[step:, step - 1] = s, own[:-step]
                    table_[:-step, WINDOW + step - 1], other[:-step, WINDOW + step - 1] = s, own[step:]
                best = np.argsort(-table_, axis=1)
                row, nth = np.repeat(np.arange(n), best.shape[1]), np.tile(np.arange(best.shape[1]), n)
                s = table_[row, best.ravel()]
                keep = (s > -2) & ((nth < NEAR) | (s >= threshold))
                us.append(own[row][keep])
                vs.append(other[row, best.ravel()][keep])
                sims.append(s[keep])
                begin = end
            kept = (ids[-WINDOW:], keys[-WINDOW:], raws[-WINDOW:])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (us, vs, sims)], ["u", "v", "sim"])

    coded = nodes.select("node", "label", "raw").mapInArrow(code, "node long, label string, raw binary, code long")
    dealt = coded.repartitionByRange(parts, "label", F.octet_length("raw"), "code", "node").sortWithinPartitions("label", F.octet_length("raw"), "code", "node")
    return dealt.select("node", "label", "raw").mapInArrow(meet, EDGES)


def nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """The lists of (u, v, sim, born) edges: the K nearest, or twice as many as long as the last one is linked."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    linked = F.sum((F.col("sim") >= threshold).cast("int")).over(Window.partitionBy("u"))
    doubled = K * F.pow(F.lit(2.0), F.floor(F.log2(F.col("linked") / K)) + 1)
    size = F.when(F.col("linked") < K, F.lit(float(K))).otherwise(F.least(doubled, F.lit(float(LIST_MOST))))
    top = one.withColumn("nth", nth).where(F.col("nth") <= LIST_MOST).withColumn("linked", linked)
    return top.where(F.col("nth") <= size).select("u", "v", "sim", "born")


def joined_neighbours(lists: DataFrame, nodes: DataFrame, threshold: float, latest: int) -> DataFrame:
    """(u, v, sim) of neighbours of one node that would enter the list of u; one of the two entered in round ``latest``."""
    own = lists.withColumn("new", F.col("born") == latest)
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))
    back = own.withColumn("nth", nth).where(F.col("nth") <= K).select(F.col("v").alias("m"), F.col("u").alias("node"), "new")
    around = own.select(F.col("u").alias("m"), F.col("v").alias("node"), "new").unionByName(back).groupBy("m", "node").agg(F.max("new").alias("new"))
    last = lists.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("sim") >= threshold).alias("linked"), F.min("sim").alias("low"))
    # what a list takes in: links, while it grows; what is nearer than its last, when it is full
    low = F.when((F.col("linked") >= K) & (F.col("linked") < LIST_MOST), F.lit(threshold)).when(F.col("n") >= K, F.col("low")).otherwise(F.lit(-2.0))
    known = nodes.join(last, F.col("node") == F.col("u"), "left").select("node", "raw", low.alias("low"))

    def run(batches):
        kept: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0), np.zeros(0, bool)]

        def groups(m, ids, raws, low, new, final):
            us, vs, sims = [], [], []
            cuts = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(m))
            for b, e in zip(cuts, ends):
                if e == len(m) and not final:
                    return us, vs, sims, b
                x = unit(raws[b:e])
                s = x @ x.T
                np.fill_diagonal(s, -3.0)
                i, j = np.nonzero((s >= low[b:e][:, None]) & (new[b:e][:, None] | new[b:e][None, :]))
                us.append(ids[b:e][i])
                vs.append(ids[b:e][j])
                sims.append(s[i, j])
            return us, vs, sims, len(m)

        def out(us, vs, sims):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in ((us, np.int64), (vs, np.int64), (sims, np.float64))], ["u", "v", "sim"])

        for batch in batches:
            m, ids, low, new = (np.append(kept[i], batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 3, 4))
            raws = kept[2] + batch.column(2).to_pylist()
            us, vs, sims, rest = groups(m, ids, raws, low, new, False)
            kept = [m[rest:], ids[rest:], raws[rest:], low[rest:], new[rest:]]
            yield out(us, vs, sims)
        yield out(*groups(*kept, True)[:3])

    open_ = around.where("new").select("m").distinct()  # the others have no new pair
    met = around.join(open_, "m", "left_semi").join(known, "node").select("m", "node", "raw", "low", "new")
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(run, EDGES)


def in_blocks(members: DataFrame, *part: str) -> DataFrame:
    """members with their block, of about BLOCK rows, and the number of blocks of their part."""
    sizes = members.groupBy(*part).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return members.join(sizes, [*part]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components of (component, label, node, raw) that a link joins, one row a pair of linked blocks."""
    placed = written(in_blocks(members, "component").select("component", "block", "label", F.octet_length("raw").alias("size"), "node", "raw"), "placed")

    def ball(table: pa.Table) -> pa.Table:
        x = unit(table.column("raw").to_pylist())
        centre = x.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-6 else x[0]
        angle = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        one = table.slice(0, 1)
        return pa.table([one.column(c) for c in ("label", "size", "component", "block")] + [pa.array([centre.tobytes()], pa.binary()), pa.array([angle])], ["label", "size", "component", "block", "raw", "angle"])

    balls = written(placed.groupBy("component", "block").applyInArrow(ball, "label string, size int, component long, block int, raw binary, angle double"), "balls")
    cells = in_blocks(balls.select("label", "size", F.struct("component", "block").alias("node"), "raw", "angle"), "label", "size")
    paired = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", F.col("node.component").alias("component"), F.col("node.block").alias("nth"), "raw", "angle")
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def near(table: pa.Table) -> pa.Table:
        own, nth, cell, angle = (table.column(c).to_numpy() for c in ("component", "nth", "block", "angle"))
        x = unit(table.column("raw").to_pylist())
        close = np.arccos(np.clip(x @ x.T, -1, 1)) <= angle[:, None] + angle[None, :] + widest
        close &= own[:, None] < own[None, :]
        if cell.min() != cell.max():
            close &= cell[:, None] != cell[None, :]
        i, j = np.nonzero(close)
        return pa.table({"a": own[i], "m": nth[i], "b": own[j], "n": nth[j]})

    pairs = written(paired.groupBy("label", "size", "x", "y").applyInArrow(near, "a long, m int, b long, n int"), "pairs")
    left = pairs.join(placed.select(F.col("component").alias("a"), F.col("block").alias("m"), F.lit(0).alias("side"), "raw"), ["a", "m"])
    right = pairs.join(placed.select(F.col("component").alias("b"), F.col("block").alias("n"), F.lit(1).alias("side"), "raw"), ["b", "n"])

    def linked(table: pa.Table) -> pa.Table:
        x, side = unit(table.column("raw").to_pylist()), table.column("side").to_numpy()
        some = len(x) and (x[side == 0] @ x[side == 1].T >= threshold).any()
        return table.select(["a", "b"]).slice(0, int(some))

    return left.unionByName(right).groupBy("a", "m", "b", "n").applyInArrow(linked, "a long, b long")


def compared(members: DataFrame, threshold: float, *part: str) -> DataFrame:
    """(node, links, low) of (part, node, weight, raw), a row a node and pair of blocks of its part that hold it.

    links is the weight of the nodes linked with the node there; low the smallest node that links lead to there.
    """
    placed = in_blocks(members, *part)
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *part, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "weight", "raw")

    def run(table: pa.Table) -> pa.Table:
        ids, weight, block = (table.column(c).to_numpy() for c in ("node", "weight", "block"))
        x = unit(table.column("raw").to_pylist())
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        low = ids
        while True:
            least = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == low).all():
                break
            low = least
        return pa.table({"node": ids, "links": (linked @ weight.astype(np.int64)).astype(np.int64), "low": low})

    return paired.groupBy(*part, "x", "y").applyInArrow(run, "node long, links long, low long")


def dense_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): weight of the nodes linked with each of (component, node, weight, raw), inside its component."""
    return compared(members, threshold, "component").groupBy("node").agg(F.sum("links").alias("links"))


def exact(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (node, links) of all nodes, by comparing all nodes of a label."""
    found = written(compared(nodes.withColumn("size", F.octet_length("raw")), threshold, "label", "size"), "exact")
    groups = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("label", "component")
    return groups, written(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")


def true_links(nodes: DataFrame, chosen: list, threshold: float) -> DataFrame:
    """(node, truth): weight of the nodes linked with each of the chosen (node, label, raw) that has any; one map over all nodes."""
    model = sent(nodes.sparkSession, [tuple(r) for r in chosen])

    def run(batches):
        groups: dict = {}
        for node, label, raw in model():
            groups.setdefault((label, len(raw)), []).append((node, bytes(raw)))
        groups = {k: (np.array([n for n, _ in v]), unit([r for _, r in v])) for k, v in groups.items()}
        total: dict = {}
        for batch in batches:
            rows: dict = {}
            for node, label, raw, weight in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.setdefault((label, len(raw)), []).append((node, raw, weight))
            for key, found in rows.items():
                if key in groups:
                    ids, x = groups[key]
                    near = (x @ unit([r for _, r, _ in found]).T >= threshold) & (ids[:, None] != np.array([n for n, _, _ in found])[None, :])
                    sums = near @ np.array([w for _, _, w in found])
                    for n, w in zip(ids[sums > 0], sums[sums > 0]):
                        total[int(n)] = total.get(int(n), 0) + int(w)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "truth"])

    return nodes.select("node", "label", "raw", "weight").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def audit(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, truth) of the audited nodes that have links."""
    stated = nodes.where(F.col("first_id") % AUDIT_STEP == 0)
    chosen = written((stated if stated.count() >= AUDIT_LEAST else nodes).select("node", "label", "raw"), "audited")
    waves = max(1, -(-int(chosen.agg(F.sum(F.octet_length("raw") + 64)).first()[0] or 0) // AUDIT_BYTES))
    truth = None
    for wave in range(waves):
        some = chosen.where(F.pmod(F.xxhash64("node"), F.lit(waves)) == wave).collect()
        more = written(true_links(nodes, some, threshold), "truth")
        truth = more if truth is None else truth.unionByName(more)
    return truth


def recall(truth: DataFrame, counts: DataFrame) -> float:
    """Share of the audited links that counts (node, links) has: of all or as a mean over nodes, whichever is less; 1 if there are none."""
    known = F.least("truth", F.coalesce("links", F.lit(0)))
    row = truth.join(counts, "node", "left").agg(F.sum(known) / F.sum("truth"), F.avg(known / F.col("truth"))).first()
    return 1.0 if row[0] is None else float(min(row))


def searched(nodes: DataFrame, threshold: float, tables: range, lists: DataFrame | None, born: int) -> tuple[DataFrame, int]:
    """Neighbour lists after further orderings and rounds of joins, and the number of the last round."""
    # neighbours across a partition's end are not met: no fewer than 64 windows a partition
    parts = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // (64 * WINDOW)))
    for table in tables:
        more = neighbours_by_order(nodes, table, parts, threshold).withColumn("born", F.lit(born))
        lists = more if lists is None else lists.unionByName(more)
    lists = written(nearest(lists, threshold), "lists")
    known = lists.where(F.col("sim") >= threshold).count()
    while True:
        more = joined_neighbours(lists, nodes, threshold, born).withColumn("born", F.lit(born + 1))
        lists, born = written(nearest(lists.unionByName(more), threshold), "lists"), born + 1
        found = lists.where(F.col("sim") >= threshold).count()
        if found <= known:
            return lists, born
        known = found


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    prepared(vectors.sparkSession)
    rows = written(encoded(vectors), "vectors")
    nodes = written(rows.where("raw is not null").groupBy("label", "raw").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")
    truth = audit(nodes, threshold)
    lists, tables, born = None, TABLES, 0
    while True:
        lists, born = searched(nodes, threshold, range(0 if tables == TABLES else tables // 2, tables), lists, born + 1)
        links = lists.where(F.col("sim") >= threshold)
        groups = written(components(links, "u", "v"), "groups").withColumnRenamed("label", "component")
        full = links.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LIST_MOST).select(F.col("u").alias("node"))
        dense = groups.join(full, "node").select("component").distinct()
        members = written(groups.join(dense, "component").join(nodes, "node").select("component", "label", "node", "weight", "raw"), "members")
        joins = components(bridges(members, threshold)).select(F.col("node").alias("component"), F.col("label").alias("top"))
        groups, members = (rows_.join(joins, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top") for rows_ in (groups, members))
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        weights = nodes.select(F.col("node").alias("v"), "weight")
        listed = both.join(weights, "v").groupBy(F.col("u").alias("node")).agg(F.sum("weight").alias("links"))
        dense = written(dense_counts(members, threshold), "dense")
        counts = written(listed.join(dense.select("node"), "node", "left_anti").unionByName(dense), "counts")
        if recall(truth, counts) >= RECALL:
            break
        if tables >= MOST:
            groups, counts = exact(nodes, threshold)
            break
        tables *= 2
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "node", "left").select("label", "raw", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = rows.where("raw is not null").join(named, ["label", "raw"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
