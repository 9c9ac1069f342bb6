"""MinHash near-dedup: one-permutation hashing with optimal densification.

One hash per shingle: its top bits name a bin and the bin keeps its smallest
hash.  An empty bin borrows from the bin that its own 2-universal probe
sequence reaches first (optimal densification), so bins fail independently
even for short texts.  Bins are banded into buckets.  In every bucket all
members are linked to one centre only (a star), so a bucket of n documents
makes n - 1 candidate pairs.  Candidates are confirmed on the full shingle
sets.  Most buckets are then one component.  In the others members are held
against each other in blocks: a bucket is cut into blocks of ``BLOCK`` members,
each pair of blocks goes to one task as one group of bounded size, and the task
returns only links that join two components, so no pair that could join two
components is left out and no list of pairs is made.

Documents with equal sets are one class from the start.  Rows: one a document.

Defined results: null, empty or white-space text has the empty set and links
with nothing; fewer words than a shingle make the whole sequence one element;
repeated rows give repeated result rows; a null doc_id takes part but never
becomes a component_id unless no member has an id (then null, kept true).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .frames import components, prepared, written
from .words import hash_words, mix64, shingle_hashes, text_pieces

BANDS, ROWS = 32, 8
PROBES = 64
BLOCK = 512
DENSE = 8
MAX_BROADCAST_IDS = 1_000_000  # 24 bytes each


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    if not len(words):
        return words
    if len(words) < k:
        return mix64(shingle_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, k))


def probe_table(bins: int) -> np.ndarray:
    """For each bin the bins it asks in turn when empty."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(PROBES, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mix64(at + np.uint64(7)) % np.uint64(bins)).astype(np.int64)


def bin_minima(members: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation minima of a non-empty ascending set, empty bins densified."""
    width = np.uint64(2**64 // bins)
    first = np.searchsorted(members, np.arange(bins, dtype=np.uint64) * width)
    values = members[np.minimum(first, len(members) - 1)]
    filled = (first < len(members)) & (np.minimum(values // width, np.uint64(bins - 1)) == np.arange(bins, dtype=np.uint64))
    empty = np.flatnonzero(~filled)
    if len(empty):
        found = filled[probes[empty]]
        donor = probes[empty, found.argmax(axis=1)]
        lost = np.flatnonzero(~found.any(axis=1))
        if len(lost):  # the probe sequence missed every filled bin: rank the filled bins by the same hash
            full = np.flatnonzero(filled).astype(np.uint64)
            for i in lost:
                donor[i] = full[mix64(full * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(empty[i])).argmin()]
        values[empty] = values[donor]
    return values


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in minima.reshape(bands, rows).T:
        key = mix64(key ^ column)
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, row_id: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, node, bands), and row_id: node is a 128-bit digest of the shingle set, null for the empty set."""
    carried = [] if row_id is None else [row_id]
    probes = probe_table(bands * rows)

    def run(batches):
        for batch in batches:
            counts, nodes, keys = [], [], []
            for _, offsets, raw in text_pieces(batch.column(1)):
                words, bounds = hash_words(offsets, raw)
                for i in range(len(bounds) - 1):
                    members = shingle_set(words[bounds[i]:bounds[i + 1]], k)
                    counts.append(len(members))
                    if len(members):
                        nodes.append(xxhash.xxh3_128_digest(members.tobytes()))
                        keys.append(band_keys(bin_minima(members, bands * rows, probes), bands, rows))
                    else:
                        nodes.append(None)
                        keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "n_shingles", "node", "bands", *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(run, "doc_id long, n_shingles long, node binary, bands array<long>" + "".join(f", {c} long" for c in carried))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, members) of the texts of docs that have words; node as in signatures."""

    def run(batches):
        for batch in batches:
            for _, offsets, raw in text_pieces(batch.column(0)):
                words, bounds = hash_words(offsets, raw)
                sets = [s for i in range(len(bounds) - 1) if len(s := shingle_set(words[bounds[i]:bounds[i + 1]], k))]
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "members"])

    return docs.select("text").mapInArrow(run, "node binary, members array<long>")


def wanted_sets(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(node, members) of the classes found (node, doc_id).

    The ids only choose the texts to look at (all those without id); which class a
    text belongs to is its set's digest.
    """
    small = found.count() <= MAX_BROADCAST_IDS
    ids, nodes = found.select("doc_id"), found.select("node")
    named = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    texts = named.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    return shingle_sets(texts, k).join(F.broadcast(nodes) if small else nodes, "node", "left_semi").dropDuplicates(["node"])


def able(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Drop pairs (a, b) whose set sizes alone rule the threshold out."""
    return (pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("p")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("size").alias("q")), "b")
            .where(F.least("p", "q") * 100 >= F.greatest("p", "q") * percent).select("a", "b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("m"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("n"))
    common = F.size(F.array_intersect("m", "n"))
    return pairs.join(left, "a").join(right, "b").where(
        common * 100 >= (F.size("m") + F.size("n") - common) * percent).select("a", "b")


def joining(nodes: list, labels: list, blocks: list, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between components among the members of one or two blocks, no more than join them (as label pairs).

    Common elements are counted for all pairs at once: columns of a 0/1 matrix for
    elements that many members have, lists of pairs for rare ones.
    """
    size, n = np.array([len(s) for s in sets]), len(sets)
    owner = np.repeat(np.arange(n), size)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), dtype=np.float32)
    wide = np.flatnonzero(times >= DENSE)
    place = np.full(len(values), -1)
    place[wide] = np.arange(len(wide))
    at = place[column]
    for begin in range(0, len(wide), 4096):
        inside = (at >= begin) & (at < begin + 4096)
        matrix = np.zeros((n, min(4096, len(wide) - begin)), dtype=np.float32)
        matrix[owner[inside], at[inside] - begin] = 1
        common += matrix @ matrix.T
    rare = np.flatnonzero((times[column] > 1) & (times[column] < DENSE))
    rare = rare[np.argsort(column[rare], kind="stable")]
    key, who = column[rare], owner[rare]
    for step in range(1, DENSE - 1):
        same = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, int)
        both = np.bincount(who[same] * n + who[same + step], minlength=n * n).reshape(n, n)
        common += both + both.T
    found = np.argwhere(np.triu(common * 100 >= percent * (size[:, None] + size[None, :] - common), 1))
    top = {label: label for label in labels}

    def root(label):
        while top[label] != label:
            top[label] = label = top[top[label]]
        return label

    cross, out = len(set(blocks)) > 1, []
    for i, j in found:
        if cross and blocks[i] == blocks[j]:
            continue
        x, y = root(labels[i]), root(labels[j])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((labels[i], labels[j]))
    return out


def block_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels joined by a link between members (bucket, node) of one bucket."""
    rest = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    whole = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("low <> high")
    # buckets of the same members, as bands of similar texts are, count once
    whole = whole.groupBy("n", "h", "g").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("label", "node"))
    placed = rest.join(whole, "bucket").withColumn("block", ((nth - 1) / BLOCK).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "label")
    # two blocks of one component have nothing to join
    open_ = paired.groupBy("bucket", "x", "y").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "x", "y")
    rows = paired.join(open_, ["bucket", "x", "y"]).join(sets, "node").select("bucket", "x", "y", "block", "node", "label", "members")

    def run(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("node", "label", "block")}
        sets_ = [np.asarray(m.values.to_numpy(zero_copy_only=False), np.int64) for m in table.column("members")]
        links = joining(columns["node"], columns["label"], columns["block"], sets_, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return rows.groupBy("bucket", "x", "y").applyInArrow(run, "a binary, b binary")


def grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (node, doc_id, label) of their classes: the class's smallest doc_id and its component."""
    prepared(docs.sparkSession)
    signed = written(signatures(docs, k, bands, rows, row_id), "signatures")
    members = signed.where("node is not null")
    classes = written(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1").select("bucket", "centre")
    active = written(buckets.join(shared, "bucket").where("node <> centre").select("bucket", "node", "centre"), "buckets")
    pairs = active.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    wanted = active.select("node").union(active.select("centre")).distinct()
    found = written(classes.select("node", "doc_id", "size").join(wanted, "node"), "candidates")
    close = written(able(pairs, found, percent), "pairs")
    sets = written(wanted_sets(docs, found, k), "sets")
    active = active.select("bucket", "node")
    labels = components(confirmed(close, sets, percent))
    joins = components(block_links(active, labels, sets, percent))
    label = F.coalesce("top", "label", "node")
    labels = (classes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
              .join(joins.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", label.alias("label")))
    return signed, classes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    signed, named = grouped(docs, k, percent, bands, rows)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    linked = signed.where("node is not null").select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, row_id: str, k: int = 5, percent: int = 80) -> DataFrame:
    """(row_id) of the rows that stay: of each component the one of smallest doc_id, then row_id; all without words.

    row_id names a column of docs, a long that is another in every row and the same whenever docs is read.
    """
    signed, named = grouped(docs, k, percent, BANDS, ROWS, row_id)
    first = F.min(F.struct(F.col("signed.doc_id").isNull().alias("none"), F.col("signed.doc_id").alias("doc_id"), F.col(row_id).alias("row")))
    one = signed.alias("signed").join(named.select("node", "label"), "node").groupBy("label").agg(first.alias("first"))
    return one.select(F.col("first.row").alias(row_id)).unionByName(signed.where("node is null").select(row_id))
