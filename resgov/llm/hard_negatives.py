"""Hard negatives by slot-decomposed selection.

For an anchor and each of its nearest positives the hardest negatives are those
whose score lies in a window under the positive's score: share * p <= s <= p.
The windows of one anchor overlap.  The positives' scores, as upper limits, cut
the scores into disjoint slots; a combiner keeps the best k negatives of each
slot, and one merge of the slots from the lowest up answers every window: the
best k at or under a limit are the first k of its slot and all lower ones, less
those under the window's lower end.  So a negative is looked at once an anchor,
whatever the number of positives.

Anchors (ids divisible by ``step``) meet all rows in blocks: anchors go out in
waves of at most ``WAVE_BYTES``, a task holds one wave, one Arrow batch of rows
and k entries a slot, and scores a block by one matrix product.  Entries, not
pairs, are shuffled, and a window over (anchor, slot) with a rank limit keeps k
of them.  A wave's results are a written table.

Vectors are quantised: floor(scale * x) a component, x as double.  Scores are
integers: products below 2^53 in doubles, which are exact there, larger ones by
Python's integers (a score beyond 64 bits is cut to the largest long).

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; only vectors of equal length meet; ties go
to the smaller id; repeated rows count once; of rows that share an id with
different vectors each counts, none is a positive of its own id; negative
scores have no window; an anchor without positives or negatives gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import prepared, sent, written

SCALE, CLASSES, STEP = 256, 10, 100
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
WAVE_BYTES = 32 << 20
BLOCK = 256
LONG = 2**63 - 1


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, q): the rows that take part, with their quantised components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite


    def quantised(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)  # larger doubles are whole

    return rows.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", quantised).alias("q"))


def noisy_label(vec_id: Column, label: Column, every: int = 7, classes: int = CLASSES) -> Column:
    """Every seventh id carries the next class."""
    return F.when(vec_id % every == 0, (label + 1) % classes).otherwise(label)


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, components) of the vectors of each length."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    return [(rows, flat[offsets[rows][:, None] + np.arange(size)]) for size in np.unique(sizes) for rows in [np.flatnonzero(sizes == size)]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


class Best:
    """The best k of each (anchor, slot): score falling, then id rising; an entry counts once.

    ``limits``: for each anchor the upper limits of its slots, falling; missing
    ones are -LONG.  ``floor``: scores below it are of no use.
    """

    def __init__(self, limits: np.ndarray, floor: np.ndarray, k: int):
        self.limits, self.floor, self.k = limits, floor.copy(), k
        self.rows = np.zeros((0, 4), np.int64)  # anchor, slot, -score, id

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of anchors first, first + 1, ... (rows) with ids (columns)."""
        mine = slice(first, first + len(scores))
        row, column = np.nonzero(allowed & (scores <= self.limits[mine, :1]) & (scores >= self.floor[mine, None]))
        if len(row):
            s = scores[row, column]
            slot = (self.limits[first + row] >= s[:, None]).sum(axis=1) - 1
            self._keep(np.stack([first + row, slot, -s, ids[column]], axis=1))

    def _keep(self, more: np.ndarray) -> None:
        rows = np.concatenate([self.rows, more])
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        begin = np.flatnonzero(new)
        nth = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        self.rows = rows[nth < self.k]
        # k entries in the lowest slot: what scores less can enter no slot
        lowest = (self.limits > -LONG).sum(axis=1) - 1
        last = rows[(nth == self.k - 1) & (rows[:, 1] == lowest[rows[:, 0]])]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], -last[:, 2])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.rows * [1, 1, -1, 1]).T], names)


def few_copies(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows less the copies that cannot be chosen: of equal label and vector only the smallest ids can."""
    kinds = np.unique(np.column_stack([labels.astype(np.float64), vectors]), axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort([ids, kinds])
    new = np.append(True, kinds[order][1:] != kinds[order][:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return np.sort(order[nth < most])


def selected(rows: DataFrame, anchors: dict, k: int, same_label: bool) -> DataFrame:
    """(anchor, slot, score, id): the best k of every slot over all rows.

    ``anchors``: arrays key, id, label, limits, floor and the list of vectors.
    """
    model = sent(rows.sparkSession, anchors)
    names = ["anchor", "slot", "score", "id"]

    def run(batches):
        a = model()
        sizes = np.array([len(v) for v in a["vectors"]])
        order = np.argsort(sizes, kind="stable")
        groups = {size: order[sizes[order] == size] for size in np.unique(sizes)}
        # positions follow the order of lengths, so that a group of anchors is a range
        best = Best(a["limits"][order], a["floor"][order], k)
        begin = {size: int(np.searchsorted(sizes[order], size)) for size in groups}
        blocks = {size: np.array([a["vectors"][i] for i in g]).reshape(len(g), size) for size, g in groups.items()}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, vectors in matrix(batch.column(2)):
                size = vectors.shape[1]
                if size not in groups:
                    continue
                # copies of one id: with an anchor's own id out of the way k more remain
                some = few_copies(ids[at], labels[at], vectors, k + 1)
                own, own_labels, vectors = ids[at][some], labels[at][some], vectors[some]
                for first in range(0, len(groups[size]), BLOCK):
                    part = groups[size][first:first + BLOCK]
                    same = a["label"][part][:, None] == own_labels[None, :]
                    allowed = same & (a["id"][part][:, None] != own[None, :]) if same_label else ~same
                    best.add(begin[size] + first, products(blocks[size][first:first + BLOCK], vectors), own, allowed)
        best.rows[:, 0] = a["key"][order][best.rows[:, 0]]
        yield best.batch(names)

    found = rows.mapInArrow(run, "anchor long, slot long, score long, id long")
    # dense_rank: an entry that several tasks kept counts once
    rank = F.dense_rank().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("nth", rank).where(F.col("nth") <= k).drop("nth").distinct()


def packed(rows, key: str, limits=None, floor=None) -> dict:
    n = len(rows)
    return {"key": np.array([r[key] for r in rows], np.int64), "id": np.array([r["id"] for r in rows], np.int64), "label": np.array([r["label"] for r in rows], np.int64),
            "vectors": [np.array(r["q"], np.float64) for r in rows],
            "limits": np.full((n, 1), LONG) if limits is None else np.array(limits, np.int64).reshape(n, -1), "floor": np.full(n, -LONG) if floor is None else np.array(floor, np.int64)}


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, step: int = STEP, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of usable() rows (id, label, q).

    share * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    spark = prepared(rows.sparkSession)
    rows = written(rows, "vectors")
    chosen = written(rows.where(F.col("id") % step == 0).distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    total = chosen.agg(F.sum(8 * F.size("q") + 64)).first()[0] or 0
    waves = max(1, -(-int(total) // wave_bytes))
    out = None
    for wave in range(waves):
        own = chosen.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).orderBy("key").collect()
        near = written(selected(rows, packed(own, "key"), positives, True).select("anchor", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
        # slots: the distinct scores of an anchor's positives, at most `positives` a row of the wave
        limits = {r.anchor: sorted(r.limits, reverse=True) for r in near.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("limits")).collect()}
        own = [r for r in own if r["key"] in limits]
        if not own:
            continue
        table = np.full((len(own), positives), -LONG)
        for i, r in enumerate(own):
            table[i, :len(limits[r["key"]])] = limits[r["key"]]
        floor = [-(-share * limits[r["key"]][-1] // 100) for r in own]
        slots = selected(rows, packed(own, "key", table, floor), negatives, False)
        part = written(windows(near, slots, own, spark, negatives, share), "negatives")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def windows(near: DataFrame, slots: DataFrame, own, spark, k: int, share: int) -> DataFrame:
    """Each positive's window from the slots of its anchor: merged from the lowest slot up, cut at the window's lower end."""
    names = spark.createDataFrame([(int(r["key"]), int(r["id"])) for r in own], "anchor long, anchor_id long")
    held = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("less"), "id"))).alias("held"))
    # slots fall with their number: those from a positive's own slot on, in order, begin with the best at or under its limit
    under = F.slice(F.filter("held", lambda x: x["less"] >= -F.col("positive_score")), 1, k)
    lowest = -F.floor(F.col("positive_score").cast("decimal(20,0)") * -share / 100)
    inside = F.filter(under, lambda x: -x["less"] >= lowest)
    joined = near.where("positive_score >= 0").join(held, "anchor").join(F.broadcast(names), "anchor")
    return (joined.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "n"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.less")).alias("negative_score")))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of (vec_id, embedding, label) rows, every seventh id with the next class as its label."""
    prepared(embeddings.sparkSession)
    rows = usable(embeddings)
    return hard_negatives(rows.withColumn("label", noisy_label(F.col("id"), F.col("label"))))
