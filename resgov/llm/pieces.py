"""SentencePiece encoding and decoding with N-best segmentation.

The vocabulary and scores are those of a given SentencePiece model file (only
read, never trained); a segmentation's score is the sum of its pieces' scores.
A forward Viterbi pass over the lattice of pieces gives the best score of every
prefix.  A backward A* search from the end takes partial paths by (score so far
+ best score of the prefix left); as that estimate is exact, complete paths
leave the agenda in order of their scores: the N best segmentations.

No piece holds a space mark after another character and no piece crosses a
character that is unknown to the vocabulary, so a text's lattice falls apart
into segments (a word with its space mark, mostly).  The N best of a text
combine the N best of its segments; at most N - 1 segments with the least loss
can differ from the best, so A* runs on those only, and equal segments share
their Viterbi pass.  The passes of a run of texts go over all its new short
segments at once, place by place; long segments go one by one.

As in SentencePiece, a space mark stands for each space and one leads the text,
unknown characters become byte pieces, and text is not normalised further.  A
literal space mark (U+2581) is written as bytes, so decoding gives back every
text exactly.

Defined results: null and empty text have no pieces, score 0 and one
segmentation; null decodes to null; equal scores are ordered by where the
alternative begins; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import re
from functools import partial
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import free_name, prepared, sent

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 50_000  # a worker holds two halves of so many segments between tasks; more of them save little time for their memory
N_BEST = 4
LITERAL = MARK + MARK  # key of a mark that a text itself holds
SPACED = re.compile(f" {MARK}[^ ]*| +(?= {MARK})| +[^ ]*")
SHORT = 32  # characters of a segment that is passed over together with others
TOGETHER = 4096  # segments passed over together
RUN_ROWS, RUN_BYTES = 128, 1 << 18  # texts whose new segments are gathered; the one that reaches the bytes is the last


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.names, scores, self.bytes = {}, [], [], {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            self.names.append(name)
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name] = (i, float(model.get_score(i)))
                scores.append(float(model.get_score(i)))
        self.unknown = min(scores) - UNKNOWN_PENALTY
        # the bytes that a piece adds to a text
        says = [n.replace(MARK, " ").encode() for n in self.names]
        for b, i in self.bytes.items():
            says[i] = bytes([b])
        self.says, self.says_count = np.frombuffer(b"".join(says), np.uint8), np.array([len(x) for x in says])
        self.says_begin = np.cumsum(self.says_count) - self.says_count
        crossing = [n for n in self.ids if MARK in n.lstrip(MARK)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("pieces must hold space marks only in front, and all 256 bytes must be pieces")
        self.pairs = {n[k:k + 2] for n in self.ids for k in range(len(n) - 1)}
        known = {c for n in self.ids for c in n if c != MARK}
        # a known character that is no piece itself may stand alone at the price of an unknown one
        self.lattice = {n: (len(n), i, s) for n, (i, s) in self.ids.items()} | {c: (1, -1, self.unknown) for c in known if c not in self.ids}
        # segments: space marks and the known characters after them; one unknown character (or literal mark) each
        self.outside = "([^ " + "".join(re.escape(c) for c in sorted(known)) + "])"
        self.trie, self.coder = Trie(self.lattice), None


class Trie:
    """All places of pieces in a text, found for all its characters at once: a table of (state, next character)."""

    def __init__(self, names):
        known = sorted({c for name in names for c in name})
        self.kinds = len(known) + 1
        self.kind = np.zeros(ord(known[-1]) + 2, np.int64)  # 0: in no piece
        self.kind[[ord(c) for c in known]] = np.arange(1, self.kinds)
        states, steps, self.piece = {"": 0}, [], [-1]
        for number, name in enumerate(names):
            state = 0
            for k, kind in enumerate(self.kind[[ord(c) for c in name]].tolist(), 1):
                step, before = state * self.kinds + kind, len(states)
                state = states.setdefault(name[:k], before)
                if state == before:
                    steps.append(step)
                    self.piece.append(-1)
            self.piece[state] = number
        self.piece, steps = np.array(self.piece), np.array(steps)
        self.shift = np.uint64(64 - (4 * len(steps)).bit_length())
        self.step, self.to = np.full(1 << 64 - int(self.shift), -1), np.zeros(1 << 64 - int(self.shift), np.int32)
        slots, waiting = self._slot(steps), np.arange(len(steps))
        while len(waiting):  # those that find their slot taken try the next
            free = waiting[self.step[slots[waiting]] < 0]
            self.step[slots[free]] = steps[free]
            waiting = waiting[self.step[slots[waiting]] != steps[waiting]]
            slots[waiting] = (slots[waiting] + 1) % len(self.step)
        self.to[slots] = np.arange(1, len(steps) + 1)

    def _slot(self, steps: np.ndarray) -> np.ndarray:
        return (steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _next(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The states after one more character; 0: none."""
        steps = states * self.kinds + kinds
        slots = self._slot(steps)
        there = self.step[slots]
        out = np.where(there == steps, self.to[slots], 0)
        missed = np.flatnonzero((there != steps) & (there >= 0))
        while len(missed):
            slots[missed] = (slots[missed] + 1) % len(self.step)
            there = self.step[slots[missed]]
            same = there == steps[missed]
            out[missed[same]] = self.to[slots[missed[same]]]
            missed = missed[~same & (there >= 0)]
        return out

    def matches(self, texts: list[str]):
        """By length: (length, begins, numbers of pieces) in the texts, which are joined by one character between."""
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kinds = self.kind[np.minimum(codes, len(self.kind) - 1)]
        kinds[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0
        length, begins, states = 0, np.flatnonzero(kinds), 0
        while len(begins):
            length += 1
            states = self._next(states, kinds[begins + (length - 1)])
            begins, states = begins[states > 0], states[states > 0]
            pieces = self.piece[states]
            yield length, begins[pieces >= 0], pieces[pieces >= 0]
            more = kinds[begins + length] > 0
            begins, states = begins[more], states[more]


class Segments(dict):
    """Numbers of segments, given at first sight; by number score, loss of the second best, and the place of the ids among those of all."""

    def __init__(self):
        self.names: list[str] = []
        self.score, self.loss = np.empty(0), np.empty(0)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.n_ids = np.empty(0, np.int32), 0
        self.done = 0  # segments from this number on wait for their values

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self.names)
        self.names.append(key)
        return number

    def put(self, numbers, score, loss, count, ids) -> None:
        """Values of the segments of these numbers; ids one after another."""
        for name in ("score", "loss", "begin", "count"):
            setattr(self, name, _roomy(getattr(self, name), len(self.names)))
        self.ids = _roomy(self.ids, self.n_ids + len(ids))
        count = np.asarray(count, np.int64)
        self.score[numbers], self.loss[numbers], self.count[numbers] = score, loss, count
        self.begin[numbers] = self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def ids_of(self, numbers) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments one after another, and where each segment's begin, with the end."""
        return _joined(self.ids, self.begin[numbers], self.count[numbers])


def _joined(items: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of items one after another, and where each begins, with the end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return items[np.arange(total) + np.repeat(begin - ends + count, count)], np.concatenate([[0], ends])


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a copy with room for ``size`` values and as many again."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(2 * size - len(array), array.dtype)])


class Coder:
    """Encodes and decodes; segments seen before are looked up (two halves of CACHE, so that common ones stay)."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.v, self.seen, self.old, self.others = vocabulary, Segments(), Segments(), {}
        self.apart = partial(re.compile(vocabulary.outside).sub, f" {MARK}\\1 {MARK}")
        automaton = ahocorasick.Automaton()
        for name, piece in vocabulary.lattice.items():
            automaton.add_word(name, piece)
        automaton.make_automaton()
        self.matches = automaton.iter  # all (last position, (length, id, score)) by last position, longest first
        self.id = np.array([piece[1] for piece in vocabulary.lattice.values()], np.int32)
        self.price = np.array([piece[2] for piece in vocabulary.lattice.values()])

    def a_star(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first, as (score, ids)."""
        found = self.others.get((text, n))
        if found is not None:
            return found
        best, into = [0.0] + [float("-inf")] * len(text), [[] for _ in range(len(text) + 1)]
        for last, (size, i, s) in self.matches(text):
            start, end = last + 1 - size, last + 1
            into[end].append((start, i, s))
            best[end] = max(best[end], best[start] + s)
        # agenda: estimate, then nearer to the start first so that equal scores are followed to their end
        agenda, serial, out = [(-best[-1], len(text), 0, 0.0, ())], 0, []
        while agenda and len(out) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    i, path = path
                    ids.append(i)
                out.append((done, tuple(ids)))
                continue
            for start, i, s in into[at]:
                serial += 1
                heapq.heappush(agenda, (-(done + s + best[start]), start, serial, done + s, (i if i >= 0 else -2 - start, path)))
        if len(self.others) >= CACHE // 20:
            self.others.clear()
        found = self.others[text, n] = [(s, self._bytes(text, ids)) for s, ids in out]
        return found

    def _bytes(self, text: str, ids) -> tuple[int, ...]:
        if min(ids, default=0) >= 0:
            return tuple(ids)
        out: list[int] = []
        for i in ids:
            out += [i] if i >= 0 else [self.v.bytes[b] for b in text[-2 - i].encode()]
        return tuple(out)

    def _cuts(self, segment: str) -> list[int]:
        """Where the parts of a segment begin, and its end: no piece crosses from one to the next."""
        pairs = self.v.pairs
        return [0, *[k for k in range(1, len(segment)) if segment[k - 1:k + 1] not in pairs], len(segment)]

    def _fill(self) -> None:
        """Values of the segments that wait for them."""
        seen, old = self.seen, self.old
        names, number, known, short, texts, single, cut = seen.names, seen.done, [], [], [], [], []
        while number < len(names):  # parts of long segments join at the end
            key = names[number]
            text = segment_of(key)
            if key in old:
                known.append(number)
            elif key == LITERAL or not text or len(text) > SHORT and len(cuts := self._cuts(text)) == 2:
                single.append(number)
            elif len(text) <= SHORT:
                short.append(number)
                texts.append(text)
            else:
                cut.append((number, [seen[key_of(text[i:j])] for i, j in zip(cuts, cuts[1:])]))
            number += 1
        seen.done = number
        if known:
            before = [old[names[k]] for k in known]
            seen.put(known, old.score[before], old.loss[before], old.count[before], old.ids_of(before)[0])
        for at in range(0, len(short), TOGETHER):
            numbers = np.array(short[at:at + TOGETHER])
            done, *values = self._best_of(texts[at:at + TOGETHER])
            seen.put(numbers[done], *values)
            single += numbers[~done].tolist()
        values = [self._literal() if names[k] == LITERAL else self._best(segment_of(names[k])) for k in single]
        if single:
            seen.put(single, [v[1] for v in values], [v[2] for v in values], [len(v[0]) for v in values], list(chain.from_iterable([v[0] for v in values])))
        for number, parts in cut:  # best and loss of the parts make those of the whole
            ids = seen.ids_of(parts)[0]
            seen.put([number], sum(seen.score[parts].tolist()), seen.loss[parts].min(), [len(ids)], ids)

    def _best_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """_best of many segments: whether it is found here; scores, losses, counts of ids and ids of those where it is.

        Not found here: what has no way through the lattice, or has one by way of byte pieces.  Segments lie longest
        first; column p holds place p of all that have p or more characters, so an edge of a length leads from a
        stretch of one column to the stretch as long of another.
        """
        low, sizes = float("-inf"), np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        sizes, n, longest = sizes[order], len(texts), int(sizes.max())
        width = np.searchsorted(-sizes, -np.arange(longest + 1), side="right").tolist()
        base = np.concatenate([[0], np.cumsum(width)])
        owner = np.repeat(np.arange(n), sizes + 1)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        node = base[place] + owner
        found = list(self.v.trie.matches([texts[k] for k in order]))
        top = len(found)
        price, pieces = np.full((top, base[-1]), low), np.zeros((top, base[-1]), np.int32)
        any_edge = np.zeros((longest + 1, top + 1), bool)  # by place and length
        for length, first, piece in found:
            price[length - 1, node[first]], pieces[length - 1, node[first]] = self.price[piece], piece
            any_edge[place[first], length] = True
        any_edge, begins = any_edge.tolist(), base.tolist()
        forward, came = np.full(base[-1], low), np.zeros(base[-1], np.int8 if top < 128 else np.int64)
        forward[:n] = 0.0
        for p in range(1, longest + 1):
            w, here = width[p], begins[p]
            best, by = forward[here:here + w], came[here:here + w]
            for length in range(min(p, top), 0, -1):  # of equal ones the longest last piece
                if any_edge[p - length][length]:
                    b = begins[p - length]
                    total = forward[b:b + w] + price[length - 1, b:b + w]
                    more = total > best
                    np.copyto(best, total, where=more)
                    np.copyto(by, length, where=more)
        end = base[sizes] + np.arange(n)
        on, walk, at = np.zeros_like(came), np.flatnonzero(forward[end] > low), sizes
        at = at[walk]
        while len(walk):
            length = came[base[at] + walk]
            at = at - length
            on[base[at] + walk] = length
            walk, at = walk[at > 0], at[at > 0]
        # a second segmentation leaves the best path by some piece: the best of those through it
        back, second = np.full(base[-1], low), np.full(n, low)
        back[end] = 0.0
        for p in range(longest - 1, -1, -1):
            b = begins[p]
            for length in range(1, min(top, longest - p) + 1):
                if any_edge[p][length]:
                    w, e = width[p + length], begins[p + length]
                    through = back[e:e + w] + price[length - 1, b:b + w]
                    np.maximum(back[b:b + w], through, out=back[b:b + w])
                    through += forward[b:b + w]
                    through[on[b:b + w] == length] = low
                    np.maximum(second[:w], through, out=second[:w])
        node = np.flatnonzero(on)
        who = order[node - base[np.searchsorted(base, node, side="right") - 1]]
        turn = np.argsort(who, kind="stable")
        who, ids = who[turn], self.id[pieces[on[node].astype(np.int64) - 1, node]][turn]
        done = np.ones(n, bool)
        done[order[forward[end] == low]] = False
        done[who[ids < 0]] = False
        score, loss = np.empty(n), np.empty(n)
        with np.errstate(invalid="ignore"):
            score[order], loss[order] = forward[end], forward[end] - second
        return done, score[done], loss[done], np.bincount(who, minlength=n)[done], ids[done[who]]

    def _best(self, text: str) -> tuple[tuple[int, ...], float, float]:
        size, low = len(text), float("-inf")
        forward, came = [0.0] + [low] * size, [None] * (size + 1)
        edges = list(self.matches(text))
        if not text:
            return (), 0.0, float("inf")
        if not edges:  # one unknown character
            return self._bytes(text, (-2,)), self.v.unknown, float("inf")
        for edge in edges:
            last, (length, _, s) = edge
            total = forward[last + 1 - length] + s
            if total > forward[last + 1]:
                forward[last + 1], came[last + 1] = total, edge
        on, at, ids = set(), size, []
        while at:
            edge = came[at]
            length, i, _ = edge[1]
            on.add(id(edge))
            at -= length
            ids.append(i if i >= 0 else -2 - at)
        ids.reverse()
        # a second segmentation leaves the best path by some piece: the best of those through it
        back, second = [low] * size + [0.0], low
        for edge in reversed(edges):
            last, (length, _, s) = edge
            start = last + 1 - length
            through = back[last + 1] + s
            if through > back[start]:
                back[start] = through
            if forward[start] + through > second and id(edge) not in on:
                second = forward[start] + through
        return self._bytes(text, ids), forward[size], forward[size] - second

    def _literal(self) -> tuple[tuple[int, ...], float, float]:
        return tuple(self.v.bytes[b] for b in MARK.encode()), self.v.unknown, float("inf")

    def segments(self, text: str) -> list[str]:
        """Segments of a text by their keys: what follows the first space mark, further ones written as spaces; those without space marks after a mark."""
        if not text:
            return []
        apart = self.apart(text)
        if text[0] == " " or "  " in text:
            return [key[1:] for key in SPACED.findall(" " + apart)]
        return apart.split(" ")

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best segmentations one after another, where each text's begin, with the end; the same of the segments' numbers."""
        if len(self.seen) >= CACHE or self.seen.n_ids >= 16 * CACHE:  # segments met again move on to the new half, the others go with the next change
            self.old, self.seen = self.seen, Segments()
        number, numbers, cuts = self.seen.__getitem__, [], [0]
        for text in texts:
            numbers.append(np.fromiter(map(number, self.segments(text)), np.int64))
            cuts.append(cuts[-1] + len(numbers[-1]))
        self._fill()
        numbers = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        ids, begins = self.seen.ids_of(numbers)
        return ids, begins[cuts], numbers, np.array(cuts)

    def best_ways(self, numbers: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations of a text of these segments, as ways() gives them."""
        seen = self.seen
        score = sum(seen.score[numbers].tolist())
        if n == 1 or not len(numbers):
            return [(score, ())]
        losses = seen.loss[numbers]
        rows = np.argsort(losses, kind="stable")[:n - 1] if len(losses) < 64 else np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2])
        loss_of = dict(zip(rows.tolist(), losses[rows].tolist()))
        rows = sorted(sorted(loss_of, key=lambda k: (loss_of[k], k))[:n - 1])
        ends = np.cumsum(seen.count[numbers])
        # (loss, changes): combine the alternatives of the segments that may differ
        out: list = [(0.0, ())]
        for k in rows:
            if loss_of[k] == float("inf"):
                continue
            others, begin, end = self.a_star(segment_of(seen.names[numbers[k]]), n), int(ends[k - 1]) if k else 0, int(ends[k])
            out = sorted([(loss + others[0][0] - s, changes + (((begin, end, other),) if rank else ())) for loss, changes in out for rank, (s, other) in enumerate(others)], key=itemgetter(0))[:n]
        return [(score - loss, changes) for loss, changes in out]

    def ways(self, text: str, n: int) -> tuple[list[int], list[tuple[float, tuple]]]:
        """Ids of the best segmentation, and the n best, best first, as (score, changes): (begin, end, ids) put in place of the best's ids begin ... end."""
        ids, _, numbers, _ = self.coded([text])
        return ids.tolist(), self.best_ways(numbers, n)

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, best first, as (score, ids)."""
        ids, ways = self.ways(text, n)
        return [(score, changed(ids, changes)) for score, changes in ways]

    def decode(self, ids) -> str:
        """The text of a sequence of pieces; byte pieces in a row are UTF-8."""
        return self.decoded(np.asarray(ids, np.int64), [0, len(ids)])[0]

    def decoded(self, ids: np.ndarray, ends) -> list[str]:
        """The texts of sequences of pieces one after another; ends tells where each begins, with the end."""
        said, places = _joined(self.v.says, self.v.says_begin[ids], self.v.says_count[ids])
        said, places = said.tobytes(), places[ends].tolist()
        return [said[i + (said[i:i + 1] == b" " and i < j):j].decode("utf-8", "replace") for i, j in zip(places, places[1:])]


def segment_of(key: str) -> str:
    """The segment with its space marks."""
    return key[1:] if key[:1] == MARK else MARK + key.replace(" ", MARK)


def key_of(segment: str) -> str:
    return segment[1:].replace(MARK, " ") if segment[0] == MARK else MARK + segment


def changed(ids, changes) -> list[int]:
    """The ids of an alternative: (begin, end, ids) each in place of what the best has there."""
    out, at = [], 0
    for begin, end, other in changes:
        out += ids[at:begin]
        out += other
        at = end
    return out + list(ids[at:])


def _coder(model) -> Coder:
    """The worker's coder: what it has seen stays between tasks."""
    vocabulary = model()
    if vocabulary.coder is None:
        vocabulary.coder = Coder(vocabulary)
    return vocabulary.coder


def _runs(batch: pa.RecordBatch, texts: int):
    """Slices of a batch for a run each; ``texts`` is the place of the text column."""
    begin = size = 0
    for row, length in enumerate(pc.binary_length(batch.column(texts)).to_pylist(), 1):
        size += length or 0
        if row - begin == RUN_ROWS or size >= RUN_BYTES or row == batch.num_rows:
            yield batch.slice(begin, row - begin)
            begin, size = row, 0


def encode(docs: DataFrame, model_file: str, n: int = N_BEST) -> DataFrame:
    """doc_id, text, ids (best), scores (of the n best, best first) and nbest (ids of the others)."""
    spark = prepared(docs.sparkSession)
    model = sent(spark, Vocabulary(model_file))

    def run(batches):
        coder = _coder(model)
        for batch in batches:
            for part in _runs(batch, 1):
                ids, ends, numbers, cuts = coder.coded([t or "" for t in part.column(1).to_pylist()])
                ways = [coder.best_ways(numbers[i:j], n) for i, j in zip(cuts, cuts[1:])]
                others = [[changed(ids[i:j].tolist(), c) for _, c in w[1:]] for w, i, j in zip(ways, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array([[s for s, _ in w] for w in ways], pa.list_(pa.float64())), pa.array(others, pa.list_(pa.list_(pa.int32())))], ["doc_id", "text", "ids", "scores", "nbest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>, scores array<double>, nbest array<array<int>>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of ids."""
    spark = prepared(encoded.sparkSession)
    model = sent(spark, Vocabulary(model_file))

    def run(batches):
        coder = _coder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


#: An alternative segmentation: its score and the places where it leaves the best one.
ALTERNATIVES = "array<struct<score: double, changes: array<struct<begin: int, end: int, ids: array<int>>>>>"
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
NEW_COLUMNS = ("n_pieces", "score", "ids", "alternatives", "round_trip")


def corpus(docs: DataFrame, model_file: str, n: int = N_BEST) -> DataFrame:
    """The columns of docs but text, and of the n best segmentations: n_pieces, score and ids of the best, the alternatives, and whether the best decodes to the text.

    Alternatives are told by what they change, so they cost little; ``changed`` gives their ids.  A new column whose name
    docs has already gets underscores before its name.
    """
    spark = prepared(docs.sparkSession)
    model = sent(spark, Vocabulary(model_file))
    rest = [c for c in docs.columns if c != "text"]
    names: list[str] = []
    for name in NEW_COLUMNS:
        names.append(free_name(name, rest, names))

    def run(batches):
        coder = _coder(model)
        for batch in batches:
            for part in _runs(batch, 0):
                texts = [t or "" for t in part.column(0).to_pylist()]
                ids, ends, numbers, cuts = coder.coded(texts)
                found = [coder.best_ways(numbers[i:j], n) for i, j in zip(cuts, cuts[1:])]
                alternatives = [[{"score": s, "changes": [{"begin": b, "end": e, "ids": i} for b, e, i in c]} for s, c in ways[1:]] for ways in found]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(ends), pa.int64()), pa.array([ways[0][0] for ways in found], pa.float64()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(alternatives, _ALTERNATIVES),
                                                  pa.array([said == t for said, t in zip(coder.decoded(ids, ends), texts)], pa.bool_())], [*rest, *names])

    rows = docs.select("text", *[F.col(f"`{c}`") for c in rest])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, kinds + ", ".join(f"`{name}` {kind}" for name, kind in zip(names, ("long", "double", "array<int>", ALTERNATIVES, "boolean"))))


def segmentations(docs: DataFrame, model_file: str, n: int = N_BEST) -> DataFrame:
    """A row a document: doc_id, n_chars and what corpus() gives."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "text")
    return corpus(rows, model_file, n)
