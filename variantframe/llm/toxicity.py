"""Toxic documents by a subsequence string-kernel SVM with Nyström landmarks.

Windows of a sentence, of one or two neighbouring words and the white space
around them, are compared by their common subsequences of three characters,
each weighted by a decay to the power of the span it covers, so gaps and
inserted characters weaken a match but don't break it, and a match may cross
words.  Landmark windows span the feature space; a linear SVM on the Nyström
features separates insulting windows from others.  Seen from a text, the
trained machine is one weight for each subsequence, so a text is scored in one
pass and needs no landmark any more.  A sentence scores as its most insulting
window; a document is judged by its most insulting window and the most
insulting one apart from it, on a calibrated surface.

Training sentences carry their document's label, not their windows: windows
that toxic documents share and clean ones nearly lack are taken first, the
machine is trained, the windows of clean sentences that it finds hardest and
the best window of each toxic document join in, and it is trained again.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, ship

#: Labelled toxic documents that are collected to train on, and twice as many others; the bound of the sample.
SAMPLE = 1500
#: Parameters of training, not of the data read: windows that stand for insults at first, of these the ones that
#: also stand disguised, landmarks of each class, and windows of clean sentences trained against at first.
SEEDS, DISGUISED, LANDMARKS, CLEAN = 1500, 400, 150, 4000
DECAY, SPAN = 0.7, 5
#: Longest words that are one window; longer ones are seen through windows of this length.
LONGEST = 24
#: Subsequences are numbered by their letters, or hashed to so many bits where there are many letters.
BITS = 21
#: Characters scored at a time.
BLOCK = 1 << 20
#: Three or more single characters in a row: a word spelled out.
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
#: Between sentences: longer than a subsequence's span.
_BREAK = " " + "\n" * SPAN + " "

_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def sentences(text: str | None) -> list[str]:
    """Lower-cased sentences with single spaces; words spelled out by single characters are sentences of their own, joined."""
    if not text:
        return []
    text = text.lower()
    found = [" ".join(x.split()) for x in _SENTENCE.split(text)]
    return [x for x in found if x] + ["".join(m[0].split()) for m in _SPELLED.finditer(text)]


@dataclass
class Alphabet:
    """All letters learned, and the space; other characters match nothing."""

    letters: str
    points: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.points = np.sort(np.array([ord(c) for c in {*self.letters, " "}], np.uint32))
        self.none = len(self.points)
        self.bits = max(1, self.none.bit_length())
        self.size = 1 << min(BITS, 3 * self.bits)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), self.none - 1)
        return np.where(self.points[at] == points, at, self.none).astype(np.int32)

    def number(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Numbers of subsequences."""
        if 3 * self.bits <= BITS:
            return (x << 2 * self.bits) | (y << self.bits) | z
        h = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (z.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.size - 1)).astype(np.int64)


@dataclass
class Model:
    alphabet: Alphabet
    weights: np.ndarray  # by subsequence
    bias: float
    slopes: np.ndarray
    offset: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores @ self.slopes + self.offset, -30, 30)))


def windows(text: str, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every window of sentences joined by `_BREAK` (with one before and after them), in order of the first.

    A window is a word or two neighbours with the spaces around; a word longer
    than `LONGEST` is seen through windows of that length, half of it apart.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if joined is None else joined
    blank = (points == 32) | (points == 10)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    length = ends - starts - 1
    pair = (starts[1:] == ends[:-1]) & (length[1:] <= LONGEST) & (length[:-1] <= LONGEST)
    first, last = [starts, starts[:-1][pair]], [ends, ends[1:][pair]]
    for i in np.flatnonzero(length > LONGEST):
        at = np.arange(starts[i], ends[i] - LONGEST // 2, LONGEST // 2)
        first.append(at)
        last.append(np.minimum(at + LONGEST + 1, ends[i]))
    s, e = np.concatenate(first), np.concatenate(last)
    order = np.lexsort((e, s))
    return s[order], e[order]


def occurrences(codes: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """For each shape of a subsequence: its length less one, its weight, the number at each place, and whether its letters are known."""
    known = codes < alphabet.none
    for a, b in _GAPS:
        n = max(len(codes) - b, 0)
        x, y, z = codes[:n], codes[a : a + n], codes[b : b + n]
        yield b, DECAY ** (b + 1), alphabet.number(x, y, z), known[:n] & known[a : a + n] & known[b : b + n]


def score_windows(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of each window of joined sentences, and its signed distance from the machine's boundary."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s, e = windows(text, points)
    codes = model.alphabet.codes(text)
    dot, size = np.zeros(len(s)), np.zeros(len(s))
    del points
    for b, shapes in groupby(occurrences(codes, model.alphabet), key=lambda x: x[0]):  # one length's sums at a time
        value, square = np.zeros(max(len(codes) - b, 0) + 1), np.zeros(max(len(codes) - b, 0) + 1)
        for _, weight, u, known in shapes:
            value[1:] += np.where(known, model.weights[u], np.float32(0)) * weight
            square[1:] += known * weight**2
        to = np.maximum(e - b + 1, s)  # a subsequence ends within the window that it begins in
        for out, run in ((dot, value), (size, square)):
            np.cumsum(run, out=run)
            out += run[np.minimum(to, len(run) - 1)] - run[np.minimum(s, len(run) - 1)]
    return s, e, np.where(size > 1e-9, dot / np.sqrt(np.maximum(size, 1e-9)), 0.0) + model.bias


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of the most insulting window of each text, and of the most insulting one apart from it."""
    return np.array([x[:2] for x in best_windows(texts, model, False)]).reshape(-1, 2)


def best_windows(texts: list[str | None], model: Model, named: bool = True) -> list[tuple[float, float, str]]:
    """Of each text the score of its most insulting window, that of its most insulting one that shares no word with it, and the first one's characters.

    Where there is no such window the machine's bias, the score of a window that is like no landmark, stands for it.
    """
    out: list[tuple[float, float, str]] = []
    for part in _parts(texts):
        joined = _BREAK + "".join(x + _BREAK for own in part for x in own)
        until = len(_BREAK) + np.cumsum([sum(len(x) + len(_BREAK) for x in own) for own in part])
        s, e, score = score_windows(joined, model)
        begin = 0
        for end in np.searchsorted(s, until - 1).tolist():  # windows of each text
            first, second, name = model.bias, model.bias, ""
            if end > begin:
                k = begin + int(score[begin:end].argmax())
                first = float(score[k])
                if named:
                    name = joined[s[k] : e[k] + 1]
                apart = (s[begin:end] >= e[k]) | (e[begin:end] <= s[k])
                second = float(score[begin:end].max(where=apart, initial=model.bias))
            out.append((first, second, name))
            begin = end
    return out


def _parts(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Sentences of texts, a bounded number of characters at a time unless one text has more."""
    part: list[list[str]] = []
    held = 0
    for t in texts:
        part.append(sentences(t))
        held += len(t or "")
        if held > BLOCK:
            yield part
            part, held = [], 0
    if part:
        yield part


def features(window: str, alphabet: Alphabet) -> dict[int, float]:
    """Weights of a window's subsequences, divided by the norm of all their occurrences."""
    got: dict[int, float] = Counter()
    size = 0.0
    for _, weight, u, known in occurrences(alphabet.codes(window), alphabet):
        for x in u[known].tolist():
            got[x] += weight
        size += weight**2 * int(known.sum())
    return {x: v / math.sqrt(size) for x, v in got.items()} if size else {}


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def text_windows(text: str | None) -> set[str]:
    """Distinct windows of a text: words and neighbouring pairs, with a space at either end."""
    out = set()
    for x in sentences(text):
        words = x.split(" ")
        out.update(f" {w} " for w in words)
        out.update(f" {a} {b} " for a, b in zip(words, words[1:], strict=False))
    return out


def train(docs: list[tuple[str | None, int]]) -> Model | None:
    """Machine for texts with labels 0 and 1; None unless both labels occur."""
    # Near copies share both smallest hashes, and count as one witness.
    groups: dict[int, dict[tuple, np.ndarray | None]] = {0: {}, 1: {}}
    numbers: dict[str, int] = {}  # of toxic documents' windows, each text of which is held once
    letters: set[str] = set()
    for text, label in docs:
        words = set((text or "").lower().split())
        if not words:
            continue
        letters.update(c for w in words for c in w if c.isalpha())
        key = (min(map(_hash, words)), min(_hash(w + "#") for w in words))
        own = groups[label].setdefault(key, np.zeros(0, np.int32) if label else None)
        if label:
            groups[label][key] = np.union1d(own, np.array([numbers.setdefault(w, len(numbers)) for w in text_windows(text)], np.int32))
    n1, n0 = len(groups[1]), len(groups[0])
    if not n1 or not n0:
        return None
    toxic_groups = list(groups[1].values())
    names = list(numbers)
    del groups, numbers
    support = Counter(dict(zip(names, np.bincount(np.concatenate(toxic_groups), minlength=len(names)).tolist(), strict=True)))
    innocent: Counter[str] = Counter()  # of the windows that toxic documents have
    clean: Counter[str] = Counter()
    seen = set()
    for text, label in docs:
        if not label:
            found = text_windows(text)
            group = hash(frozenset(found))
            if group not in seen:
                seen.add(group)
                innocent.update(found & support.keys())
            clean.update(w for w in found if _hash(w) % 4 == 0 or " " not in w[1:-1])
    alphabet = Alphabet("".join(sorted(letters)))
    positive = sorted(_seeds(toxic_groups, names, support, innocent, clean, n1, n0), key=lambda w: (-support[w], w))[:SEEDS]
    del toxic_groups, names, seen
    negative = heapq.nsmallest(CLEAN // 2, clean, key=lambda w: (-clean[w], w))
    common = set(negative)
    negative += heapq.nsmallest(CLEAN // 2, (w for w in clean if w not in common), key=lambda w: (_hash(w), -clean[w], w))
    del common
    clean.clear()
    chosen = set(positive)
    negative = [w for w in negative if w not in chosen]
    if not positive or not negative:
        return None
    insults = [w for w in positive if " " not in w[1:-1]]
    positive += [v for w in insults[:DISGUISED] for v in _disguised(w)]
    model = _fit(positive, negative, alphabet, support)
    texts = {label: [t for t, k in docs if k == label and t] for label in (0, 1)}
    for _ in range(3):
        hard = sorted({w for _, _, w in sorted(best_windows(texts[0], model), reverse=True)[: CLEAN // 4] if w})
        more = sorted({w for v, _, w in best_windows(texts[1], model) if v > 0 and support[w] >= 2 and not innocent[w]})
        positive = list(dict.fromkeys(positive + more))
        taken = set(positive)
        negative = list(dict.fromkeys(negative + [w for w in hard if w not in taken]))
        model = _fit(positive, negative, alphabet, support)
    x = score_texts([t for t, _ in docs], model)
    y = np.array([label for _, label in docs], float)
    alone = [f" {w} {v.strip()} {w} " for v in insults[:100] for v in (v, *_disguised(v)) for w in _calm(negative)]
    model.slopes, model.offset = _calibrate(x, y, score_texts(alone, model))
    return model


def _calm(negative: list[str]) -> list[str]:
    """The commonest clean word, to set a lone insult in."""
    return [w.strip() for w in negative if " " not in w[1:-1]][:1]


def _runs(word: str) -> set[str]:
    """Runs of 4 and 5 characters; a shorter word is its own run."""
    word = word.strip()
    return {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)} or {word}


def _seeds(toxic_groups: list[np.ndarray], names: list[str], support: Counter[str], innocent: Counter[str], clean: Counter[str], n1: int, n0: int) -> set[str]:
    """Windows that stand for insults: those that toxic documents hold far more often than clean ones, and words with a run of letters that only toxic documents share.

    A window or run counts if so many toxic documents, near copies taken as
    one, would hold it by chance once in some hundred thousand.
    """
    rate = n1 / (n1 + n0)

    def stands_out(w: str) -> bool:
        t, c = support[w], innocent[w] + 0.5
        return t * math.log(max(t / (t + c) / rate, 1e-9)) >= 12 and t * min(n0, n1) >= 8 * c * n1 and sum(map(str.isalpha, w)) >= 3

    single = {w for w in support if " " not in w[1:-1]}
    strong = {w for w in single if stands_out(w)}
    pairs = {w for w in support if w not in single and stands_out(w) and not any(f" {x} " in strong for x in w.split())}
    held: Counter[str] = Counter()
    lone = [w in single and not innocent[w] for w in names]
    for group in toxic_groups:
        held.update({p for i in group.tolist() if lone[i] for p in _runs(names[i])})
    need = min(math.log(1e6) / math.log(1 / rate), max(2.0, n1 / 5))
    runs = {p for p, k in held.items() if k >= need and sum(map(str.isalpha, p)) >= 3}
    plain: Counter[str] = Counter()
    for w in clean:
        if " " not in w[1:-1]:
            plain.update(_runs(w) & runs)
    runs = {p for p in runs if plain[p] <= 0.002 * held[p]}
    return strong | pairs | {w for w in single if not innocent[w] and _runs(w) & runs}


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _packed(f: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of subsequences as arrays, a tenth of a dictionary's memory."""
    return np.fromiter(f.keys(), np.int32, len(f)), np.fromiter(f.values(), np.float64, len(f))


def _fit(positive: list[str], negative: list[str], alphabet: Alphabet, support: Counter[str]) -> Model:
    found = positive + negative
    feats = [_packed(features(w, alphabet)) for w in found]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    spread = lambda lo, hi: list(range(lo, hi, max(1, (hi - lo) // LANDMARKS)))[:LANDMARKS]
    marks = spread(0, len(positive)) + spread(len(positive), len(found))
    used = np.unique(np.concatenate([feats[i][0] for i in marks]))
    column = np.full(alphabet.size, -1, np.int32)
    column[used] = np.arange(len(used))
    z = np.zeros((len(marks), len(used)))
    for r, i in enumerate(marks):
        z[r, column[feats[i][0]]] = feats[i][1]
    kernel = np.zeros((len(found), len(marks)))
    for i, (u, v) in enumerate(feats):
        at = column[u]
        known = at >= 0
        if known.any():
            kernel[i] = z[:, at[known]] @ v[known]
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    cost = np.where(y > 0, 20.0 * len(negative) / len(found), 20.0 * len(positive) / len(found) + 0.5)
    most = max([support[w] for w in positive], default=1) or 1
    cost *= np.array([1 + 8 * support[w] / most for w in positive] + [1.0] * len(negative))
    w = _svm(kernel @ root, y, cost)
    weights = np.zeros(alphabet.size, np.float32)
    weights[used] = (root @ w[:-1]) @ z
    return Model(alphabet, weights, float(w[-1]), np.array([1.0, 0.0]), 0.0)


def _disguised(window: str) -> list[str]:
    """Forms of an insult with inserted characters: spelled with dots, and with one letter more in its midst."""
    word = window.strip()
    half = len(word) // 2
    return [f" {'.'.join(word)} ", f" {word[:half]}x{word[half:]} "] if 4 <= len(word) <= LONGEST // 2 else []


def _calibrate(x: np.ndarray, y: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic surface through documents' two scores and, with less weight, those of lone and disguised insults; slopes not negative.

    One half lies above nearly all clean training documents, so that a model
    learned from few examples rather misses than accuses.
    """
    clean = x[y == 0]
    every = max(len(alone), 1)
    alone = alone[alone[:, 0] > np.quantile(clean[:, 0], 0.998)]  # where clean documents hold the like, a lone one tells nothing
    weight = np.where(y > 0, 0.35 / max(y.sum(), 1), 0.5 / max(len(clean), 1)) * len(y)
    weight = np.concatenate([weight, np.full(len(alone), 0.15 / every * len(y))])
    x, y = np.concatenate([x, alone]), np.concatenate([y, np.ones(len(alone))])
    design = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 1.0, 0.0])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 0.05 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
        w[:2] = np.maximum(w[:2], [1e-3, 0.0])
    return w[:2], float(min(w[2], -np.quantile(clean @ w[:2], 0.998) - 0.1))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` toxic and twice as many other labelled documents of ``docs``, those with the smallest id hashes.

    ``allowed`` is a condition on ``labels`` (held-out rows stay out).  Null ids
    and labels are left out, as are labels of documents that ``docs`` lacks; of
    several labels of one id the largest counts, of several texts the first by
    code points.
    """
    known = labels if allowed is None else labels.where(allowed)
    known = known.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).alias("label"))
    known = known.join(docs.select(F.col(id).alias("doc")), F.col(id) == F.col("doc"), "left_semi")
    picked = None  # type: DataFrame | None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64(id), id).limit(sample if value else 2 * sample)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked.select(F.col(id).alias("picked_id"), "label"))  # at most 3 * sample rows
    rows = docs.select(F.col(id).alias("doc"), F.col(text).alias("words_of")).join(picked, F.col("doc") == F.col("picked_id"))
    seen: dict = {}
    for r in sorted(rows.select("doc", "words_of", "label").collect(), key=lambda r: (r["doc"], r["words_of"] or "")):
        seen.setdefault(r["doc"], (r["words_of"], int(r["label"])))
    model = train(list(seen.values()))
    del seen
    give_back()  # the driver goes on with other operators
    return model


def toxicity(df: DataFrame, model: Model | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into``: the probability (0 to 1) that each whole text is toxic.

    Null and empty texts get the score of a text without insults; without a
    model (no labels of both classes) every score is 0.  Repeated rows score
    alike; very long texts are read whole; an empty table stays empty; other
    columns are kept and ``into`` gets underscores if the name is taken.
    """
    into = fresh(df, into)
    if model is None:
        return df.withColumn(into, F.lit(0.0))
    ship(df.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.probability(score_texts(batch.to_pylist(), model)) if len(batch) else np.zeros(0), pa.float64())

    return df.withColumn(into, score.asNondeterministic()(F.col(text)))
