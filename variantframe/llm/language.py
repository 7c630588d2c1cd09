"""Languages of texts and of the spans inside mixed ones.

A word's script, told from character ranges, narrows its candidate languages;
a character model of each candidate scores the word once however often it
occurs; Viterbi over a text's words, with a penalty for every switch, labels
spans.  The text's language is the one whose spans hold most of its words.

A character model is one of 63 letter classes times one of letters within a
class.  The commonest letters are classes of their own, the others share the
rest by hash; no letter that was learned is left out, so scripts of thousands
of letters are told apart too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, ship

#: Documents of each language that are collected to learn from; the bound of the sample.
SAMPLE = 800
#: Cost of changing the language between two words, in nats.
SWITCH = 9.0
#: A word speaks against a language by so much at most.
FLOOR = -14.0
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.02
#: Documents labelled at a time, and word scores kept by a worker before it starts afresh.
BLOCK, KEPT = 2048, 350_000
#: Letter classes: 0 beyond a word's ends, the last for letters never seen; letters with a class of their own.
_CODES, OWN = 64, 48
#: Frequency steps to a doubling by which documents are picked.
STEPS = 16

#: First code points of script ranges, in order.
SCRIPTS = [
    (0x0000, "other"),
    (0x0041, "latin"),
    (0x0250, "other"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x30000, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_IDS = np.array([_NAMES.index(b) for _, b in SCRIPTS])


def script(character: str) -> str:
    return _NAMES[_IDS[np.searchsorted(_STARTS, ord(character), "right") - 1]]


@dataclass
class Model:
    languages: list[str]
    letters: str  # all letters learned, commonest first
    within: np.ndarray  # log probability of a letter in its class, by letter and language; the last row is for others
    tables: np.ndarray  # log probability of a class after two others, by language
    scripts: np.ndarray  # candidates: script by language
    points: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        found = np.array([ord(c) for c in self.letters] or [0], np.uint32)
        self.order = np.argsort(found)
        self.points = found[self.order]
        self.classes = np.append(letter_classes(self.letters), _CODES - 1).astype(np.int32)
        self.plain = not self.within.any()  # every letter is alone in its class

    def known(self, points: np.ndarray) -> np.ndarray:
        """Place of each code point among the letters; the number of letters for others."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.order[at], len(self.letters))


def letter_classes(letters: str) -> np.ndarray:
    """Classes of letters, commonest first: own ones for the first, shared ones by hash for the rest."""
    return np.array([i + 1 if i < OWN or len(letters) <= _CODES - 2 else OWN + 1 + ord(c) * 2654435761 % (1 << 32) % (_CODES - 2 - OWN) for i, c in enumerate(letters)], np.int32)


def core(word: str) -> str:
    """A lower-cased word without what is not a letter at its ends; empty if it has no letter."""
    word = word.lower()
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def _grid(words: list[str], width: int) -> np.ndarray:
    """Code points of words, 0 beyond their ends."""
    text = "".join([w.ljust(width, "\0") for w in words])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def _batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and code points of words of like length, a bounded number of characters at a time."""
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    at = 0
    while at < len(order):
        n = 4096
        while n > 1 and n * len(words[order[min(at + n, len(order)) - 1]]) > 400_000:
            n //= 2
        ids = order[at : at + n]
        yield ids, _grid([words[i] for i in ids], max(1, len(words[ids[-1]])))
        at += n


def score_words(words: list[str], model: Model) -> np.ndarray:
    """Log likelihood of each word by language, less the best one's; 0 for words without letters."""
    n, k = len(words), len(model.languages)
    out = np.zeros((n, k), np.float32)
    cores = [core(w) for w in words]
    flat = model.tables.reshape(k, -1)
    for ids, points in _batches(cores):
        real = points > 0
        letter = model.known(points)
        codes = np.where(real, model.classes[letter], 0)
        rows, width = codes.shape
        padded = np.zeros((rows, width + 3), np.int32)
        padded[:, 2 : width + 2] = codes
        context = (padded[:, :-2] << 12) | (padded[:, 1:-1] << 6) | padded[:, 2:]
        counts = np.ones((rows, width + 1), bool)
        counts[:, 1:] = real  # the characters, and the end after the last
        got = np.stack([(np.where(counts, t[context], 0)).sum(axis=1) for t in flat], axis=1)
        if not model.plain:
            got += np.stack([(np.where(real, model.within[:, j][letter], 0)).sum(axis=1) for j in range(k)], axis=1)
        which = _IDS[np.searchsorted(_STARTS, points[:, 0], "right") - 1]
        allowed = model.scripts[which]
        got[~allowed] = -1e9
        got[~allowed.any(axis=1)] = 0  # a script that no language has
        got -= got.max(axis=1)[:, None]
        got = np.maximum(got, FLOOR)
        got[~real[:, 0]] = 0
        out[ids] = got
    return out


def label_words(scores: np.ndarray, begins: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of all texts' words at once; text i has the words from begins[i] to begins[i + 1]."""
    lengths = np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = begins[:-1][order], lengths[order]
    n, k = scores.shape
    came = np.zeros(n, np.int16)  # best language before each word
    stay = np.zeros((n, k), bool)
    label = np.zeros(n, np.int16)
    live = int(np.searchsorted(-lengths, 0, "left"))
    value = np.zeros((live, k), np.float32)
    ends = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    for t, m in enumerate(ends.tolist()):
        at = starts[:m] + t
        now = value[:m]
        if t:
            best = now.argmax(axis=1)
            top = now[np.arange(m), best] - switch
            keep = now >= top[:, None]
            came[at], stay[at] = best, keep
            now = np.where(keep, now, top[:, None])
        value[:m] = now + scores[at]
    last = value.argmax(axis=1).astype(np.int16) if live else np.zeros(0, np.int16)
    # Back from each text's end; texts of one length enter together.
    for t in range(len(ends) - 1, -1, -1):
        m = ends[t]
        at = starts[:m] + t
        label[at] = last[:m]
        if t:
            last[:m] = np.where(stay[at, last[:m]], last[:m], came[at])
    return label


def text_cores(text: str | None) -> Counter:
    return Counter(filter(None, map(core, (text or "").split())))


def train(texts: list[tuple[str, str]]) -> Model | None:
    """Model from pairs of language and text; None without any letters."""
    words: dict[str, Counter] = {}
    for lang, text in texts:
        words.setdefault(lang, Counter()).update(text_cores(text))
    return train_words(words)


def train_words(words: dict[str, Counter]) -> Model | None:
    """Model from each language's words and their frequencies."""
    languages = sorted(lang for lang in words if words[lang])
    if not languages:
        return None
    share: Counter[str] = Counter()
    scripts = np.zeros((len(_NAMES), len(languages)), bool)
    own: list[Counter[str]] = []
    for j, lang in enumerate(languages):
        own.append(Counter())
        for w, n in words[lang].items():
            for c in w:
                own[j][c] += n
        total = sum(own[j].values())
        by = Counter()
        for c, n in own[j].items():
            if c.isalpha():
                by[script(c)] += n
                share[c] += n / total
        for name, n in by.items():
            scripts[_NAMES.index(name), j] = n >= SCRIPT_SHARE * total
    letters = "".join(c for c, _ in sorted(share.items(), key=lambda t: (-t[1], t[0])))
    k = len(languages)
    model = Model(languages, letters, np.zeros((len(letters) + 1, k)), np.zeros((k,) + (_CODES,) * 3, np.float32), scripts)
    size = np.bincount(model.classes, minlength=_CODES)  # letters of each class
    for j, lang in enumerate(languages):
        count = np.array([*[own[j][c] for c in letters], 0], float)
        total = np.bincount(model.classes, count, _CODES)
        p = (count + 0.5) / (total + 0.5 * size)[model.classes]
        model.within[:-1, j] = np.where(size[model.classes[:-1]] > 1, np.log(p[:-1]), 0.0)
        three = np.zeros((_CODES,) * 3)
        vocabulary = list(words[lang])
        counts = np.array([words[lang][w] for w in vocabulary], float)
        for ids, points in _batches(vocabulary):
            codes = np.where(points > 0, model.classes[model.known(points)], 0)
            padded = np.zeros((len(codes), codes.shape[1] + 3), np.int64)
            padded[:, 2:-1] = codes
            used = np.ones((len(codes), codes.shape[1] + 1), bool)
            used[:, 1:] = points > 0
            weight = np.broadcast_to(counts[ids][:, None], used.shape)[used]
            np.add.at(three, (padded[:, :-2][used], padded[:, 1:-1][used], padded[:, 2:][used]), weight)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * _CODES)
        p2 = (two + 3 * p1) / (two.sum(axis=1, keepdims=True) + 3)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        model.tables[j] = np.log(p3)
    model.plain = not model.within.any()
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their frequencies by language of a task's texts."""
    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(text_cores(text))
    for lang, words in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, allowed: Column | None = None, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` documents of each language, those with the smallest id hashes.

    Null languages, texts and ids are left out; rows that share an id are one
    pick and all learned from.  Documents are counted by language and by steps
    of their hash, and each language's steps are taken while they fit, so no
    task ranks a language.  Words are counted where the texts are; only words
    and frequencies are collected.
    """
    ship(docs.sparkSession)
    known = (docs if allowed is None else docs.where(allowed)).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull())
    # Steps from 0 (the smallest hashes) on are equal shares of a logarithm, fine where hashes are few.
    place = (F.pmod(F.xxhash64(id), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    known = known.select(F.col(lang).alias("lang_"), F.col(text).cast("string").alias("text_"), F.floor(F.log2(place) * STEPS).cast("int").alias("step_"))
    picked: dict[str, int] = {}
    taken: Counter[str] = Counter()
    full: set[str] = set()
    for r in known.groupBy("lang_", "step_").count().orderBy("lang_", "step_").collect():  # some hundred rows a language
        if r["lang_"] in full or taken[r["lang_"]] + r["count"] > sample and taken[r["lang_"]]:
            full.add(r["lang_"])
            continue
        taken[r["lang_"]] += r["count"]
        picked[r["lang_"]] = r["step_"]
    if not picked:
        return None
    steps = F.broadcast(docs.sparkSession.createDataFrame(list(picked.items()), "lang_ string, until_ int"))  # a row a language
    rows = known.join(steps, "lang_").where("step_ <= until_").select("lang_", "text_")
    words: dict[str, Counter] = {}
    for r in rows.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        words.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return train_words({lang: Counter(dict(sorted(w.items()))) for lang, w in words.items()})


RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))])
DDL = "struct<lang: string, score: double, spans: array<struct<first: int, last: int, lang: string>>>"


def identify_block(texts: list[str | None], model: Model, known: dict[str, np.ndarray], switch: float = SWITCH, spans: bool = True) -> list[dict]:
    """Languages of texts; ``known`` keeps word scores."""
    if len(known) > KEPT:
        known.clear()
    split = [t.split() if t else [] for t in texts]
    place: dict[str, int] = {}
    index = np.fromiter((place.setdefault(w, len(place)) for ws in split for w in ws), np.int64)
    vocabulary = list(place)
    new = [w for w in vocabulary if w not in known]
    fresh_scores = score_words(new, model)
    own = {w: i for i, w in enumerate(new)}
    table = np.zeros((len(vocabulary), len(model.languages)), np.float32)
    for i, w in enumerate(vocabulary):
        j = own.get(w)
        table[i] = fresh_scores[j] if j is not None else known[w]
    known.update((w, fresh_scores[i]) for w, i in own.items() if len(w) <= 40)
    lettered = np.fromiter((any(map(str.isalpha, w)) for w in vocabulary), bool, len(vocabulary))
    begins = np.cumsum([0, *map(len, split)])
    label = label_words(table[index], begins, switch) if len(index) else np.zeros(0, np.int16)
    counted = lettered[index] if len(index) else np.zeros(0, bool)
    speaks = counted & (table[index].min(axis=1) < 0) if len(model.languages) > 1 and len(index) else counted  # words that tell languages apart
    out = []
    for i in range(len(texts)):
        a, b = begins[i], begins[i + 1]
        votes = np.bincount(label[a:b][counted[a:b]], minlength=len(model.languages))
        if not votes.sum():
            out.append({"lang": "und", "score": 0.0, "spans": []})
            continue
        best = int(votes.argmax())
        told = np.bincount(label[a:b][speaks[a:b]], minlength=len(model.languages))[best]
        row = {"lang": model.languages[best], "score": float(told / votes.sum()), "spans": []}
        if spans:
            cut = [0, *(np.flatnonzero(np.diff(label[a:b])) + 1).tolist(), int(b - a)]
            row["spans"] = [{"first": p, "last": q - 1, "lang": model.languages[label[a + p]]} for p, q in zip(cut, cut[1:], strict=False)]
        out.append(row)
    return out


def identify(df: DataFrame, model: Model | None, text: str = "text", into: str = "language", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """Add struct ``into``: lang, score (share of words in it, of those that tell languages apart), spans (first and last word from 0, lang).

    A text that is null or has no letter, and every text if nothing was
    learned, is `und` with score 0.  Ties go to the language that sorts first; a
    text in a script that no language has scores 0.
    Repeated rows are labelled alike; very long texts are read whole; an empty
    table stays empty; other columns are kept and ``into`` gets underscores if
    the name is taken.
    """
    into = fresh(df, into)
    if model is None:
        return df.withColumn(into, F.expr("struct('und' AS lang, 0D AS score, cast(array() AS array<struct<first: int, last: int, lang: string>>) AS spans)"))
    ship(df.sparkSession)
    mark = hash((tuple(model.languages), model.letters, model.tables.tobytes(), model.within.tobytes()))

    @F.arrow_udf(DDL)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = hold(("language", mark), dict)
        for batch in batches:
            out: list[dict] = []
            for at in range(0, len(batch), BLOCK):
                out += identify_block(batch.slice(at, BLOCK).to_pylist(), model, known, switch, spans)
            yield pa.array(out, RESULT)

    return df.withColumn(into, label.asNondeterministic()(F.col(text)))
