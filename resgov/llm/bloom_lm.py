"""LM scoring from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels (1, 2-3, 4-7, ...: the
binary logarithm) and an n-gram of level q enters the filter q times, once a
level.  A count is found by probing level 1, 2, ... until one is missing, so
rare n-grams cost one entry and a false positive adds a level at most rarely.
The probability of a word after another mixes the pair's count with the word's
own share:

    P(w | v) = (c(v, w) + MU * P1(w)) / (c(v) + MU),   P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

The filter has a fixed number of bits an entry, so it grows with the corpus and
soon is too large to send to every worker.  It is cut into segments, one a
range of hashes, whose number grows with the text; the probes go to the
segments instead, the same way at every size:

1. Texts are taken in chunks of about ``CHUNK_BYTES``, in the order a task
   reads them.  Each distinct n-gram of a chunk goes to its segment once, with
   its count in the chunk's training texts.
2. A segment adds up the counts, sets its bits, probes them for every chunk's
   n-grams and answers with levels (and exact counts of words), in the order of
   the keys, so no key travels back.
3. Chunk and answers meet; the chunk's n-grams are listed again, take their
   levels by position, and each text's probabilities are added up.

Nothing passes the driver but sums.  A task holds one chunk or one segment,
whatever the corpus.  A chunk must hold the same texts in steps 1 and 3, as it
does when docs are read from files; a sum over its keys is compared and a
chunk that changed is an error.

Words are 64-bit hashes of lower-cased (A-Z) words; every text ends with one
end token and its first word follows a start mark.  Null text is empty (one
token, the end); a null doc_id counts as held out; an empty training set gives
N = 0 and V = 0 and scores from P1 alone; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .frames import prepared, written
from .words import hash_words, mix64, text_pieces

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA24BAED4963EE407)
PAIR = np.uint64(0xD6E8FEB86659FD93)
MU = 2000.0
BITS, PROBES = 10, 4
LEVELS = 44
CHUNK_BYTES, SEGMENT_BYTES = 8 << 20, 4 << 20
WORDS, PAIRS = 1, 2


def is_held_out(doc_id, parts: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 0


def tokens(column: pa.Array):
    """Yield (bounds, words with ends, previous words, pair keys) of runs of whole texts."""
    for _, offsets, raw in text_pieces(column):
        words, bounds = hash_words(offsets, raw)
        words = np.insert(words, bounds[1:], END)
        bounds = bounds + np.arange(len(bounds))
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[bounds[:-1]] = START
        yield bounds, words, before, mix64((before * PAIR) ^ (words + END))


def amount(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; level 0 is 0."""
    return np.where(levels > 0, (np.exp2(levels - 1.0) + np.exp2(levels * 1.0) - 1) / 2, 0.0)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


# ------------------------------------------------------------------ filter

def places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit numbers that an n-gram of a level sets, a row a probe."""
    item = mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (item >> np.uint64(32)) | np.uint64(1)
    return np.stack([((item & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


def built(keys: np.ndarray, levels: np.ndarray, bits_an_entry: int = BITS) -> np.ndarray:
    """A filter in which key i is entered once a level from 1 to levels[i]."""
    bits = max(512, -(-int(levels.sum()) * bits_an_entry // 64) * 64)
    marks = np.zeros(bits, np.bool_)
    for level in range(1, int(levels.max(initial=0)) + 1):
        marks[places(keys[levels >= level], level, bits)] = True
    return np.packbits(marks, bitorder="little")


def probed(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Levels found by probing until one is missing."""
    levels = np.zeros(len(keys), dtype=np.uint8)
    alive, bits = np.arange(len(keys)), len(table) * 8
    for level in range(1, LEVELS + 1):
        hit = np.ones(len(alive), dtype=bool)
        for row in places(keys[alive], level, bits):
            hit &= (table[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        alive = alive[hit]
        if not len(alive):
            break
        levels[alive] = level
    return levels


# ------------------------------------------------------------------- bytes

def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small numbers cost next to nothing."""
    import zstandard
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(raw), dtype=np.uint64)


# ------------------------------------------------------------------ chunks

class Chunk:
    """Tokens of some texts and their distinct n-grams in ascending order.  The start mark counts as a word."""

    def __init__(self, column: pa.Array, held_out: np.ndarray):
        parts = list(tokens(column))
        sizes = np.concatenate([np.diff(p[0]) for p in parts]) if parts else np.zeros(0, int)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        words, before, both = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in (1, 2, 3))
        self.train = np.repeat(~held_out, sizes)
        self.first = np.zeros(len(words), bool)
        self.first[self.bounds[:-1]] = True
        self.texts = int((~held_out).sum())
        self.words, self.word_of = np.unique(np.append(words, START), return_inverse=True)
        self.pairs, self.pair_of = np.unique(both, return_inverse=True)
        self.word_of, self.start = self.word_of[:-1], int(self.word_of[-1])

    def lists(self):
        """(kind, keys, counts in training texts)."""
        counts = np.bincount(self.word_of[self.train], minlength=len(self.words))
        counts[self.start] += self.texts
        yield WORDS, self.words, counts
        yield PAIRS, self.pairs, np.bincount(self.pair_of[self.train], minlength=len(self.pairs))


def chunk_runs(batches, most: int = CHUNK_BYTES):
    """(chunk, columns) of runs of rows (doc_id, held_out, text) that hold about ``most`` bytes of text."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        sizes = batch.column(2).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]))
        begin, before = 0, 0
        while begin < batch.num_rows:
            end = min(int(np.searchsorted(ends, before + most - size)) + 1, batch.num_rows)
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1]) - before
            begin, before = end, int(ends[end - 1])
            if size >= most:
                yield (part << 32) + number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield (part << 32) + number, pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def check_sum(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix64(keys)).view(np.int64)) if len(keys) else 0


GRAMS = "segment int, chunk long, kind int, keys binary, counts binary"
ANSWERS = "chunk long, segment int, kind int, levels binary, counts binary, check long, total long, distinct long"


def grams(docs: DataFrame, segments: int, chunk_bytes: int) -> DataFrame:
    """The distinct n-grams of every chunk, a row a segment and kind."""
    shift = np.uint64(64 - (segments.bit_length() - 1)) if segments > 1 else None

    def run(batches):
        for chunk, table in chunk_runs(batches, chunk_bytes):
            found = Chunk(one_array(table.column("text")), one_array(table.column("held_out")).to_numpy(zero_copy_only=False))
            for kind, keys, counts in found.lists():
                owner = keys >> shift if shift is not None else np.zeros(len(keys), np.uint64)
                cuts = np.searchsorted(owner, np.arange(segments + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts))
                rows = [(int(s), packed_keys(keys[cuts[s]:cuts[s + 1]]), squeezed(counts[cuts[s]:cuts[s + 1]])) for s in used]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "chunk", "kind", "keys", "counts"])

    return docs.mapInArrow(run, GRAMS)


def answered(asked: DataFrame, bits_an_entry: int = BITS) -> DataFrame:
    """Each segment's filter, built from the counts it was sent and probed for every chunk's n-grams."""
    def run(table: pa.Table) -> pa.Table:
        chunk, kind, segment = (table.column(c).to_numpy() for c in ("chunk", "kind", "segment"))
        keys = [unpacked_keys(k.as_py()) for k in table.column("keys")]
        counts = [unsqueezed(c.as_py()).astype(np.int64) for c in table.column("counts")]
        known, exact, levels = {}, {}, {}
        for k in (WORDS, PAIRS):
            mine = [i for i in range(len(kind)) if kind[i] == k]
            all_keys = np.concatenate([keys[i] for i in mine]) if mine else np.zeros(0, np.uint64)
            known[k], back = np.unique(all_keys, return_inverse=True)
            exact[k] = np.bincount(back, np.concatenate([counts[i] for i in mine]) if mine else None, minlength=len(known[k])).astype(np.int64)
            levels[k] = level_of(exact[k])
        table_bits = built(np.concatenate([known[WORDS], known[PAIRS]]), np.concatenate([levels[WORDS], levels[PAIRS]]), bits_an_entry)
        out: list = [[], [], [], [], [], [], [], []]
        words = exact[WORDS][known[WORDS] != START]
        rows = [(-1, int(segment[0]), 0, None, None, 0, int(words.sum()), int((words > 0).sum()))]
        for i in range(len(kind)):
            found = squeezed(probed(keys[i], table_bits))
            count = squeezed(exact[WORDS][np.searchsorted(known[WORDS], keys[i])]) if kind[i] == WORDS else None
            rows.append((int(chunk[i]), int(segment[0]), int(kind[i]), found, count, check_sum(keys[i]), 0, 0))
        for row in rows:
            for column, value in zip(out, row):
                column.append(value)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["chunk", "segment", "kind", "levels", "counts", "check", "total", "distinct"])

    return asked.groupBy("segment").applyInArrow(run, ANSWERS)


def log_probability(own, before, both, total: float, distinct: float):
    """log10 P(w | v) from counts of w, v and the pair."""
    share = (own + 0.1) / (total + 0.1 * (distinct + 1))
    both = np.minimum(both, before)
    return np.log10((both + MU * share) / (before + MU))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, parts: int = 10, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES, bits_an_entry: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), parts).alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(0, (int(size) // segment_bytes).bit_length())
    answers = written(answered(grams(docs, segments, chunk_bytes), bits_an_entry), "levels")
    sums = answers.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v or 0)

    def chunked(batches):
        for chunk, table in chunk_runs(batches, chunk_bytes):
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * batch.num_rows, pa.int64()), *batch.columns], ["chunk", "doc_id", "held_out", "text"])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        held_out = one_array(texts.column("held_out")).to_numpy(zero_copy_only=False)
        chunk = Chunk(one_array(texts.column("text")), held_out)
        rows = sorted(zip(found.column("kind").to_pylist(), found.column("segment").to_pylist(), range(found.num_rows)))
        levels, counts, check = found.column("levels"), found.column("counts"), found.column("check")

        def joined(kind: int, column) -> np.ndarray:
            return np.concatenate([unsqueezed(column[i].as_py()) for k, _, i in rows if k == kind] or [np.zeros(0, np.uint64)])

        for kind, keys in ((WORDS, chunk.words), (PAIRS, chunk.pairs)):
            told = 0
            for k, _, i in rows:
                told ^= check[i].as_py() if k == kind else 0
            if told != check_sum(keys):
                raise RuntimeError("a chunk of texts changed between two reads of docs; pass a written table")
        own, both, exact = amount(joined(WORDS, levels).astype(np.int64)), amount(joined(PAIRS, levels).astype(np.int64)), joined(WORDS, counts).astype(np.int64)
        mine = own[chunk.word_of]
        before = np.where(chunk.first, own[chunk.start], np.append(0.0, mine[:-1]))
        logs = log_probability(mine, before, both[chunk.pair_of], total, distinct)
        base = (np.log10(exact + 0.1) - np.log10(total + 0.1 * (distinct + 1)))[chunk.word_of]
        cuts = chunk.bounds[:-1]
        return pa.Table.from_arrays([one_array(texts.column("doc_id")), pa.array(held_out), pa.array(np.diff(chunk.bounds)), pa.array(np.add.reduceat((exact > 0)[chunk.word_of].astype(np.int64), cuts)),
                                     pa.array(np.full(len(held_out), total, np.int64)), pa.array(np.add.reduceat(base, cuts)), pa.array(np.add.reduceat(logs, cuts))],
                                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = docs.mapInArrow(chunked, "chunk long, doc_id long, held_out boolean, text string")
    told = answers.where("chunk >= 0").select("chunk", "segment", "kind", "levels", "counts", "check")
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, SCORES)
