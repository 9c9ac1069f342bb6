"""Personal data: base patterns, high-recall candidates, and boosted trees that choose among them.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind.  They are found from '@', '+' and the runs of digits,
so the time is linear in the text, whatever it holds.  Generators propose more
spans than that (digits grouped in other ways, numbers without a country mark,
written-out at signs), overlapping ones too.  For each kind, gradient-boosted
trees learn from format and context features of sampled candidates which of
them are like base spans.  Rows that are not come from the generators (parts of
chains of digit groups, shortened addresses, other numbers) and from
spoiled base spans (a digit changed, a part out of range, digits or the domain's
end cut).  A probability threshold calibrated on candidates the
trees did not see (precision ``PRECISION`` or more) selects additions.  What
would give the base rule away (the plus, the at sign) is no feature, so trees
carry over to spans without it; a card's check digits and an address's range
stay features.  Additions never overlap a base span or a likelier addition.

Training takes the candidates of at most ``SAMPLE_DOCS`` texts and
``SAMPLE_ROWS`` candidates (smallest hashes); all texts are searched whole, in
one map.  Offsets are code points, end exclusive.

Defined results: null and empty text have no spans (digest of the empty
string); without candidates to learn from nothing is added; repeated rows and
null ids are treated like any.
"""

from __future__ import annotations

from bisect import bisect_left, insort
import hashlib
from itertools import islice
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import prepared, sent

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 40_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 24
PRECISION = 0.98
MIN_EACH = 10
CHUNK = 20_000

_DIGITS = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_REST = re.compile(r"[ ().0-9-]+")
_AT = re.compile(r"@|[(\[]at[)\]]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WIDE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+")
_CUES = re.compile(r"(?i)tel|phone|call|fax|mobile|card|visa|account|mail|contact|\bip\b|host|server")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DIGITS.finditer(text)]


def _left(text: str, end: int, lowest: int) -> int:
    """Where the run of local-part characters that ends at ``end`` begins."""
    at = end
    while at > lowest and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    runs = _runs(text) if runs is None else runs
    found = []
    lowest, at = 0, text.find("@")
    while at >= 0:
        start = _left(text, at, lowest)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        lowest = at + 1
        if domain:
            found.append((start, domain.end(), "email"))
            lowest = domain.end()
        at = text.find("@", lowest)
    i = 0
    while i + 3 < len(runs):
        if all(runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] == "." for j in range(i, i + 3)):
            parts = [text[s:e].lstrip("0") for s, e in runs[i:i + 4]]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append((runs[i][0], runs[i + 3][1], "ip"))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 14 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[i:j + 1])):
            found.append((runs[i][0], runs[j][1], "card"))
        i = j + 1
    if runs:
        at = text.find("+")
        while at >= 0:
            after = at + 1
            if text[after:after + 1].isascii() and text[after:after + 1].isdigit():
                rest = _PHONE_REST.match(text, after + 1)
                if rest:
                    end = rest.end()
                    while end > after + 1 and not ("0" <= text[end - 1] <= "9"):
                        end -= 1
                    if end >= after + 3:
                        if 10 <= sum("0" <= c <= "9" for c in text[after:end]) <= 15:
                            found.append((at, end, "phone"))
                        after = end
            at = text.find("+", after)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, runs: list[tuple[int, int]]):
    """Yield high-recall spans: every run of digit groups of a fitting digit count under several joiners, and anything around an at sign."""
    for joiners, most, kind, low, high in ((" -./", 2, "card", 8, 24), (" ().-/", 3, "phone", 6, 15), (".-", 1, "ip", 4, 16)):
        for i, (start, end) in enumerate(runs):
            if kind == "phone" and start:
                start -= text[start - 1] == "("
                start -= start > 0 and text[start - 1] == "+"
            j, n = i, end - runs[i][0]
            while n <= high:
                if n >= low:
                    yield start, runs[j][1], kind
                j += 1
                if j == len(runs) or runs[j][0] - runs[j - 1][1] > most or any(c not in joiners for c in text[runs[j - 1][1]:runs[j][0]]):
                    break
                n += runs[j][1] - runs[j][0]
    found = set()
    for m in _AT.finditer(text):
        before = m.start() - (text[m.start() - 1:m.start()] == " " and m.group() != "@")
        start, domain = _left(text, before, max(0, before - 64)), _WIDE_DOMAIN.match(text, m.end())
        if start < before and domain:
            found.add((start, domain.end(), "email"))
            dot = text.rfind(".", m.end(), domain.end())
            if dot > m.end():
                found.add((start, dot, "email"))
            if (inner := text.rfind(".", start, before)) >= 0 and inner + 1 < before:
                found.add((inner + 1, domain.end(), "email"))
    yield from sorted(found)


def spoiled(span: str, kind: str) -> str:
    """A base span made wrong: what a near miss of its kind looks like."""
    if kind == "card":
        return span[:-1] + str((int(span[-1]) + 1) % 10)
    if kind == "ip":
        return "9" + span.rjust(11, "9")[-10:] if len(span) < 11 else "999" + span[span.index("."):]
    if kind == "phone":
        return span[:len(span) // 2 + 1]
    return span[:span.rindex(".")]


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:)" else 5


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    groups = _DIGITS.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    at = _AT.search(span)
    local, domain = (span[:at.start()], span[at.end():]) if at else ("", "")
    labels = domain.split(".")
    return [end - start, len(digits), sum(map(str.isalpha, span)), span.count(" "), span.count("."), span.count("-"), span.count("(") + span.count(")"), span.count("/"),
            len(groups), sizes[0], sizes[1] if len(sizes) > 1 else 0, sizes[-1], max(sizes), min(sizes), len(set(digits)), _side(text[start - 1:start]) if start else 0, _side(text[end:end + 1]),
            len(local), len(labels), len(labels[-1]), float(bool(_CUES.search(text, max(0, start - 24), start))),
            float(kind == "card" and luhn(digits)), float(kind == "ip" and all(len(g) < 4 and int(g) <= 255 for g in groups))]


class Trees:
    """Boosted regression trees on log loss, split on quantile bins."""

    def fit(self, rows: np.ndarray, label: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, rows.T)], axis=1)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        z = np.full(len(rows), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree: list = []
            self._grow(binned, label - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(rows)), DEPTH, tree)
            self.trees.append(tree)
            z += RATE * self._walk(tree, binned)
        return self

    def _grow(self, binned, slope, curve, at, depth, tree) -> int:
        me = len(tree)
        tree.append([-1, 0, 0, 0, slope[at].sum() / (curve[at].sum() + 1.0)])
        if depth and len(at) >= 8:
            g, h = slope[at].sum(), curve[at].sum()
            best = (1e-3, -1, 0)
            for f in range(binned.shape[1]):
                column = binned[at, f]
                left_g, left_h = (np.cumsum(np.bincount(column, w[at], minlength=BINS + 1))[:-1] for w in (slope, curve))
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
                cut = int(gain.argmax())
                if gain[cut] > best[0]:
                    best = (gain[cut], f, cut)
            if best[1] >= 0:
                go = binned[at, best[1]] <= best[2]
                if 0 < go.sum() < len(at):
                    left = self._grow(binned, slope, curve, at[go], depth - 1, tree)
                    right = self._grow(binned, slope, curve, at[~go], depth - 1, tree)
                    tree[me][:4] = [best[1], best[2], left, right]
        return me

    def _walk(self, tree, binned) -> np.ndarray:
        feature, cut, left, right = np.array([node[:4] for node in tree], dtype=np.int64).T
        at, rows = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            go = binned[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(feature[at] < 0, at, np.where(go, left[at], right[at]))
        return np.array([node[4] for node in tree])[at]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, rows.T)], axis=1)
        return self.base + RATE * sum(self._walk(t, binned) for t in self.trees)


class Chooser:
    """One kind's trees with a calibrated probability and threshold."""

    def __init__(self, rows: np.ndarray, label: np.ndarray):
        self.trees = None
        learn = np.arange(len(rows)) % 3 != 0
        if min(label[learn].sum(), label[~learn].sum(), (1 - label[learn]).sum(), (1 - label[~learn]).sum()) < MIN_EACH:
            return  # too little to learn or to calibrate on: nothing is added
        trees = Trees().fit(rows[learn], label[learn])
        z, y = trees.margin(rows[~learn]), label[~learn]
        self.a, self.b = 1.0, 0.0  # Platt scaling by gradient descent on the unseen third
        for _ in range(300):
            error = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30))) - y
            self.a, self.b = self.a - 0.1 * float((error * z).mean()), self.b - 0.1 * float(error.mean())
        p = self._scaled(z)
        order = np.argsort(-p)
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= PRECISION)
        if len(good) and good[-1] >= 4:
            self.trees, self.threshold = trees, max(0.5, float(p[order][good[-1]]))

    def _scaled(self, z):
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros(len(rows)) if self.trees is None else self._scaled(self.trees.margin(rows))


def fit_choosers(docs: DataFrame, size: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> dict[str, Chooser]:
    def out(kinds, values, labels):
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["kind", "values", "label"])

    def run(batches):
        for batch in batches:
            kinds, values, labels = [], [], []
            for text in batch.column(0).to_pylist():
                runs = _runs(text or "")
                if not runs and "@" not in (text or ""):
                    continue
                base = set(base_spans(text, runs))
                for s, e, k in candidates(text, runs):
                    kinds.append(k)
                    values.append(features(text, s, e, k))
                    labels.append(float((s, e, k) in base))
                    if len(kinds) >= CHUNK:
                        yield out(kinds, values, labels)
                        kinds, values, labels = [], [], []
                for s, e, k in base:
                    wrong = spoiled(text[s:e], k)
                    kinds.append(k)
                    values.append(features(text[:s] + wrong + text[e:], s, s + len(wrong), k))
                    labels.append(0.0)
            yield out(kinds, values, labels)

    some = docs.select("text", F.xxhash64("doc_id").alias("h")).where("text is not null")
    chosen = some.select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
    found = some.where(F.col("h") <= F.lit(chosen)).select("text").mapInArrow(run, "kind string, values array<double>, label double")
    got = found.orderBy(F.xxhash64("kind", "values"), "kind", "values", "label").limit(rows).toArrow()
    kind, values, label = got.column("kind").to_pylist(), got.column("values").to_pylist(), got.column("label").to_numpy()
    out = {}
    for k in KINDS:
        at = [i for i in range(len(kind)) if kind[i] == k]
        if at:
            out[k] = Chooser(np.array([values[i] for i in at]), label[at])
    return out


def all_spans(text: str, choosers: dict[str, Chooser]) -> tuple[list, list]:
    """(base spans, base spans and additions), both by start and then kind."""
    runs = _runs(text)
    if not runs and "@" not in text and "[at]" not in text and "(at)" not in text:
        return [], []
    base = base_spans(text, runs)
    covered = [(s, e) for s, e, _ in base]
    likely, proposed = [], candidates(text, runs)
    while some := list(islice(proposed, CHUNK)):
        more = [c for c in some if not any(c[0] < e and s < c[1] for s, e in covered)] if len(covered) < 64 else _apart(some, covered)
        for k in KINDS:
            own = [c for c in more if c[2] == k]
            chooser = choosers.get(k)
            if own and chooser is not None and chooser.trees is not None:
                p = chooser.probability(np.array([features(text, *c) for c in own]))
                likely += [(-float(q), c[0] - c[1], c) for q, c in zip(p, own) if q >= chooser.threshold]
    added: list = []  # in order; the likelier one stays, of equally likely ones the longer
    for _, _, c in sorted(likely):
        at = bisect_left(added, c)
        if (at == 0 or added[at - 1][1] <= c[0]) and (at == len(added) or c[1] <= added[at][0]):
            insort(added, c)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _apart(spans: list, covered: list) -> list:
    """Spans that overlap none of the covered ones, by one pass over both in order."""
    ends = np.maximum.accumulate([e for _, e in sorted(covered)])
    starts = np.array(sorted(s for s, _ in covered))
    return [c for c in spans if not (n := np.searchsorted(starts, c[1], side="left")) or ends[n - 1] <= c[0]]


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, choosers: dict[str, Chooser]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    model = sent(docs.sparkSession, choosers)

    def run(batches):
        choosers = model()
        for batch in batches:
            found = [all_spans(t or "", choosers) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def covered_text(text: str, spans: list) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, choosers: dict[str, Chooser]) -> DataFrame:
    """docs with personal data in ``text`` replaced; a null text stays null."""
    model = sent(docs.sparkSession, choosers)
    at = docs.columns.index("text")

    def run(batches):
        choosers = model()
        for batch in batches:
            texts = pa.array([None if t is None else covered_text(t, all_spans(t, choosers)[1]) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def personal_data(docs: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    return find(docs, fit_choosers(docs))
