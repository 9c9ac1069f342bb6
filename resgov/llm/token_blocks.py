"""Token ids as binary files of patched frame-of-reference blocks.

Documents are put in ascending order of doc_id by one range exchange; each task
encodes its range and packs the ids, so the files in the order of their names
hold one stream of ids.  The stream is cut into segments of about
``SEGMENT_IDS`` ids (whole documents), a segment into blocks of ``BLOCK`` ids:

    block    minimum (4 bytes), width (1), exceptions (1), the ids less the
             minimum in width bits each, positions (1 byte) and values (4) of
             the exceptions
    segment  magic, part, number in the part, documents, ids, ids of the part
             before it, blocks, length; doc_ids and their null flags, ids a
             document, where each block starts, the blocks

The width is that of the ``PERCENTILE`` smallest of a block's values, so a few
large ids cost five bytes each and do not widen the others.  Block starts let a
reader unpack the blocks of a range and no more (``token_range``).

Spark's text sink writes the files: it adds one line feed a row, which ends a
segment, and leaves bytes as they are.  So tasks that are retried commit once,
and any file system that Spark reaches will do; the binary-file source reads
them.  ``part`` is the number of the writing task; where its ids begin in the
whole stream is a running sum over parts, a row a task.

Defined results: null and empty text have the end id only; a null doc_id comes
first; rows with one doc_id follow in the order of a hash of their text; repeated
rows are encoded each; an empty table writes no segment; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .frames import prepared, sent, written

BLOCK, PERCENTILE = 128, 0.9
SEGMENT_IDS, FILE_SEGMENTS = 1 << 20, 16
END_ID = 2
LONG_TEXT, TEXT_BYTES = 1 << 20, 4 << 20
HEADER = "<4siiIQQII"
MAGIC = b"TIB1"
# a place where no token can cross: before a space that a visible ASCII or Latin character follows
CUT = re.compile(" (?=[!-~\u00c0-\u024f])")
ODD_SPACE = re.compile(" (?![!-~\u00c0-\u024f])")
CACHE, WORD_CHARS, GROUP = 1_000_000, 32, 64
MARKS, TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 2000


# ------------------------------------------------------------------ blocks

def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each block starts and the end) of unsigned 32-bit ids."""
    ids = ids.astype(np.uint32, copy=False)
    blocks = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - len(ids))]).reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = padded - low[:, None]
    nth = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = bit_length(np.partition(rest, nth, axis=1)[:, nth])
    # values of more bits than the width
    row, position = np.nonzero(rest >= np.where(width < 32, np.left_shift(np.uint64(1), width.astype(np.uint64)), np.uint64(2**32))[:, None])
    exceptions = np.bincount(row, minlength=blocks)
    starts = np.concatenate([[0], np.cumsum(6 + width * (BLOCK // 8) + exceptions * 5)]).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    head = np.column_stack([low.astype("<u4").view(np.uint8).reshape(blocks, 4), width.astype(np.uint8), exceptions.astype(np.uint8)])
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        for part in np.array_split(mine, -(-len(mine) // 2048)):
            # the low bits of each value, first bit first, without those above the width
            low_bytes = rest[part].astype("<u2" if w <= 16 else "<u4").view(np.uint8).reshape(len(part), BLOCK, -1)
            bits = np.unpackbits(low_bytes, axis=2, bitorder="little")[:, :, :w]
            out[starts[part][:, None] + 6 + np.arange(w * (BLOCK // 8))] = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
    at = starts[row] + 6 + width[row] * (BLOCK // 8)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    out[at + turn] = position
    out[(at + exceptions[row] + 4 * turn)[:, None] + np.arange(4)] = rest[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def unpack(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, whole blocks."""
    blocks = len(starts)
    head = raw[starts[:, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.int64)
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        for part in np.array_split(mine, -(-len(mine) // 2048)):
            bits = np.unpackbits(raw[starts[part][:, None] + 6 + np.arange(w * (BLOCK // 8))], axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            for bit in range(w):
                rest[part] |= bits[:, :, bit].astype(np.int64) << bit
    row = np.repeat(np.arange(blocks), exceptions)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = starts[row] + 6 + width[row] * (BLOCK // 8)
    rest[row, raw[at + turn]] = np.ascontiguousarray(raw[(at + exceptions[row] + 4 * turn)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (rest + low[:, None]).ravel()


# ---------------------------------------------------------------- segments

def segment(part: int, number: int, before: int, doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    body, starts = pack(ids)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    tables = known + bytes(i is None for i in doc_ids) + np.array(sizes, "<u4").tobytes() + starts.astype("<u4").tobytes()
    head = struct.pack(HEADER, MAGIC, part, number, len(doc_ids), len(ids), before, len(starts) - 1, struct.calcsize(HEADER) + len(tables) + len(body))
    return head + tables + body.tobytes()


class Segment:
    """A segment in ``raw`` from ``at`` on; blocks are unpacked when ids are asked for."""

    def __init__(self, raw: np.ndarray, at: int = 0):
        magic, self.part, self.number, docs, self.size, self.before, blocks, self.length = struct.unpack(HEADER, raw[at:at + struct.calcsize(HEADER)].tobytes())
        if magic != MAGIC:
            raise ValueError("no segment of token ids")
        at += struct.calcsize(HEADER)

        def table(kind: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * count
            at += size
            return np.frombuffer(raw[at - size:at].tobytes(), kind)

        self.doc_ids, self.unnamed, self.sizes = table("<i8", docs), table("<u1", docs).astype(bool), table("<u4", docs).astype(np.int64)
        self.starts = table("<u4", blocks + 1).astype(np.int64)
        self.blocks = raw[at:at + self.starts[-1]]

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin ... end of the segment: only their blocks are unpacked."""
        end = self.size if end is None else min(end, self.size)
        if begin >= end:
            return np.zeros(0, np.int64)
        first, last = begin // BLOCK, -(-end // BLOCK)
        return unpack(self.blocks, self.starts[first:last])[begin - first * BLOCK:end - first * BLOCK]


def segments(content: bytes):
    """The segments of a file with where they begin; a line feed ends each."""
    raw, at = np.frombuffer(content, np.uint8), 0
    while at < len(raw):
        found = Segment(raw, at)
        yield at, found
        at += found.length + 1


# ---------------------------------------------------------------- encoding

class Encoder:
    """The tokenizer of a JSON file's text, with the ids of words seen before kept.

    A byte-level splitter begins a new word at a space that a visible character
    follows, whatever stands before, so a text cut there has the ids of its
    pieces.  Words that are new in a run of texts are joined (each begins with
    such a space) and encoded in one call; the tokens' places tell which word
    each belongs to.  For other kinds of tokenizers texts are encoded whole.
    """

    def __init__(self, text: str):
        self.text, self.made, self.seen, self.old, self.tails = text, None, {}, {}, {}
        spec = json.loads(text)
        split = spec.get("pre_tokenizer") or {}
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or " " in t["content"] for t in spec.get("added_tokens", []))
        self.cuts = plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)

    def __getstate__(self):
        return {**self.__dict__, "made": None, "seen": {}, "old": {}, "tails": {}}

    def _model(self):
        if self.made is None:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer
            self.made = Tokenizer.from_str(self.text)
        return self.made

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words (each with a space before it), a few hundred a text.

        Marks after a letter or digit are tokens of their own, so a word that ends in some is its bare word and the marks.
        """
        marked = {}
        for w in words:
            b = w.rstrip(MARKS)
            if len(b) < len(w) and b[-1:].isascii() and b[-1:].isalnum() and not any(t in w for t in self.special):
                marked[w] = b
        bare = [b for b in set(marked.values()).difference(words) if b not in self.seen]
        words = [w for w in words if w not in marked] + bare
        groups = [words[i:i + GROUP] for i in range(0, len(words), GROUP)]
        for some, found in zip(groups, self._model().encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            raw = np.array(found.ids, "<u4").tobytes()
            token_of, at, cuts = found.char_to_token, 0, []
            for w in some:
                cuts.append(4 * token_of(at))
                at += len(w) + 1
            cuts.append(len(raw))
            self.seen.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        for w, b in marked.items():
            tail = w[len(b):]
            if tail not in self.tails:
                self.tails = {tail: np.array(self._model().encode(tail, add_special_tokens=False).ids, "<u4").tobytes(), **(self.tails if len(self.tails) < TAILS else {})}
            self.seen[w] = self.seen[b] + self.tails[tail]

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:  # words met again move on to the new half, the others go with the next change
            self.old, self.seen = self.seen, {}
        parts, firsts, rows, counts = split_texts(texts)
        # the run's words as numbers of a small table: a word met often is looked up once
        coded = parts.dictionary_encode()
        number = coded.indices.to_numpy()[rows]
        met = np.zeros(len(coded.dictionary), bool)
        met[number] = True
        words = coded.dictionary.filter(pa.array(met)).to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.seen.get, words))
        new = [w for w, ids in zip(words, known) if ids is None]
        again = {w: self.old[w] for w in new if w in self.old}
        self.seen.update(again)
        self._learn([w for w in new if w not in again])
        found = [self.seen[w] if ids is None else ids for w, ids in zip(words, known)]
        for w in new:
            if len(w) > WORD_CHARS:
                del self.seen[w]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = (np.cumsum(met) - 1)[number]
        much = size[which]
        ends = np.concatenate([[0], np.cumsum(much)])
        # each word's ids: those from its place in the table on
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[which] - ends[:-1], much)
        ids = np.frombuffer(b"".join(found), "<u4")[places]
        ends = ends[np.cumsum([0, *counts])]
        begun = self._model().encode_batch(firsts, add_special_tokens=False)
        return [np.concatenate([np.array(first.ids, np.uint32), ids[a:b]]) for first, a, b in zip(begun, ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.cuts:
            return [np.array(e.ids, np.uint32) for e in self._model().encode_batch(texts, add_special_tokens=False)]
        if all(len(t) <= LONG_TEXT for t in texts):
            return self._run(texts)
        return [np.concatenate([self._run([part])[0] for part in pieces(t)]) for t in texts]


def cut(text: str) -> list[str]:
    """The text up to its first cut, then its words without the space before each."""
    return CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")


def split_texts(texts: list[str]) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """All parts that cut() makes of the texts, each text's first one, the places of the others in order of texts, how many a text has."""
    odd = np.fromiter((ODD_SPACE.search(t) is not None for t in texts), bool, len(texts))
    cuts = [pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " "), pa.array([cut(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))]
    parts = pa.concat_arrays([c.values for c in cuts])
    at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for c, mine, before in zip(cuts, (~odd, odd), (0, len(cuts[0].values))):
        offsets = c.offsets.to_numpy().astype(np.int64)
        at[mine], size[mine] = before + offsets[:-1], np.diff(offsets)
    counts = size - 1
    rows = np.arange(counts.sum()) + np.repeat(at + 1 - (np.cumsum(counts) - counts), counts)
    return parts, parts.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist(), rows, counts


def pieces(text: str, size: int = LONG_TEXT):
    """Parts of a long text, each cut at the first place after ``size`` code points where a word begins."""
    begin = 0
    while len(text) - begin > size:
        found = CUT.search(text, begin + size)
        if found is None:
            break
        yield text[begin:found.start()]
        begin = found.start()
    yield text[begin:]


def slices(texts: list[str], most: int = TEXT_BYTES):
    """Runs of texts of about ``most`` code points."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# ------------------------------------------------------------------- files

def write_ids(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode (doc_id, text) rows and write their ids below ``folder``, in ascending order of doc_id."""
    spark = prepared(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        model = sent(spark, Encoder(f.read()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # hash and row number only spread and order rows of one doc_id
    keys = ["doc_id", "tie", "row"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        encoder, part = model(), TaskContext.get().partitionId()
        number, before, held = 0, 0, 0
        names, sizes, ids = [], [], []

        def full():
            nonlocal number, before, held, names, sizes, ids
            out = segment(part, number, before, names, sizes, np.concatenate(ids))
            number, before, held, names, sizes, ids = number + 1, before + held, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["segment"])

        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for begin, end in slices(texts):
                for i, found in zip(doc_ids[begin:end], encoder.encode(texts[begin:end])):
                    names.append(i)
                    sizes.append(len(found) + 1)
                    ids.append(np.append(found, np.uint32(end_id)))
                    held += len(found) + 1
                    if held >= segment_ids:
                        yield full()
        if names:
            yield full()

    packed = ordered.mapInArrow(run, "segment binary")
    packed.select(F.col("segment").cast("string").alias("segment")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row a document of the files: file, at (of its segment), part, number, before, doc_id, n_tokens, ids_crc32."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                for at, found in segments(batch.column(1)[k].as_buffer()):
                    ids = found.ids().astype("<u4")
                    ends = np.cumsum(found.sizes)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - found.sizes, ends)]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *(pa.array(np.full(n, x, np.int64)) for x in (at, found.part, found.number)), pa.array(found.before + ends - found.sizes),
                                                      pa.array(found.doc_ids, mask=found.unnamed), pa.array(found.sizes), pa.array(crc, pa.int64())],
                                                     ["file", "at", "part", "number", "before", "doc_id", "n_tokens", "ids_crc32"])

    files = prepared(spark).read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, at long, part long, number long, before long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(documents: DataFrame) -> DataFrame:
    """read_documents() with start: the ids of all documents before, over all parts."""
    sums = documents.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    running = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("part", running.alias("offset"))  # a row a writing task
    return documents.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def segment_index(documents: DataFrame) -> DataFrame:
    """A row a segment of with_starts() rows: file, at, start, n_tokens, n_docs: where to find a range of ids."""
    return documents.groupBy("file", "at").agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))


def token_range(index: DataFrame, begin: int, end: int) -> DataFrame:
    """(start, ids) of the segments that hold ids begin ... end of the stream: other files are not read, other blocks not unpacked."""
    spark = index.sparkSession
    wanted = index.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    files = [r.file for r in wanted.select("file").distinct().collect()]  # as many as the range spans
    schema = "start long, ids array<long>"
    if not files:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for at, start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = Segment(np.frombuffer(raw.as_buffer(), np.uint8), at)
                first = max(begin - start, 0)
                yield pa.RecordBatch.from_arrays([pa.array([start + first], pa.int64()), pa.array([found.ids(first, end - start)], pa.list_(pa.int64()))], ["start", "ids"])

    return wanted.join(content, "file").select("at", "start", "content").mapInArrow(run, schema)


def stored(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids to a fresh folder below the shared one, read all back: doc_id, start, n_tokens, ids_crc32."""
    spark = prepared(docs.sparkSession)
    folder = shared_dir(spark, f"token-ids-{uuid.uuid4().hex}")
    write_ids(docs, folder, tokenizer_file, end_id)
    return with_starts(written(read_documents(spark, folder), "token-documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
