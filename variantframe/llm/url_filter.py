"""URL filter: allow and block rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models are learned from URLs that rules
accept and reject.  A URL's score is the difference of its log likelihoods
under the two, by character; it is allowed from a threshold on that is
calibrated on labelled URLs the models have not seen.

Transitions are counted over all labelled URLs, and the threshold is set on all
that were held back.  What a worker holds is bounded: with more transitions
than that, URLs are scored by joins with the whole table of transitions.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, least_frequency, ship, store

#: Longest context, in characters.
ORDER = 5
#: Share of the labelled URLs that the threshold is calibrated on.
HELD = 5
#: Characters that a uniform guess chooses among.
ALPHABET = 256
#: Most transitions of a model.
TRANSITIONS = 400_000
#: Steps of the score that the threshold is chosen among, to a nat.
STEPS = 500
#: Transitions that a task gathers before it hands them on.
GATHERED = 300_000
#: Character ratios kept by a worker before it starts afresh.
KEPT = 500_000

Rule = tuple[str, str, str]  # verdict, host, path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def rule_match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are laid over shorter ones
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def transitions(text: str) -> Iterator[str]:
    """Each character of a URL, and its end, after contexts of 0 to ORDER characters: context and character as one text."""
    t = "\n" + text + "\n"
    for i in range(1, len(t)):
        for k in range(min(ORDER, i) + 1):
            yield t[i - k : i + 1]


class Markov:
    """Character model that blends contexts of 0 to ORDER characters by how many successors each has shown."""

    def __init__(self, counts: Mapping[str, int]):
        self.counts: dict[str, dict[str, int]] = {}
        for gram, n in counts.items():
            self.counts.setdefault(gram[:-1], {})[gram[-1]] = n
        self.totals = {c: sum(n.values()) for c, n in self.counts.items()}

    def probability(self, context: str, c: str) -> float:
        p = 1 / ALPHABET
        for k in range(len(context) + 1):
            part = context[len(context) - k :]
            seen = self.counts.get(part)
            if seen is None:
                break
            kinds = len(seen)
            p = (seen.get(c, 0) + kinds * p) / (self.totals[part] + kinds)
        return p


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0
    #: All transitions (verdict, gram, n), if the models hold only the most frequent.
    whole: DataFrame | None = None

    def score(self, text: str, known: dict[str, float]) -> float:
        """Log likelihood difference by character; 0 for an empty text."""
        if not text:
            return 0.0
        t = "\n" + text + "\n"
        total = 0.0
        for i in range(1, len(t)):
            key = t[max(0, i - ORDER) : i + 1]
            r = known.get(key)
            if r is None:
                context, c = key[:-1], key[-1]
                r = known[key] = math.log(self.accepted.probability(context, c) / self.rejected.probability(context, c))
            total += r
        if len(known) > KEPT:
            known.clear()
        return total / (len(text) + 1)


def url_text(url: str | None) -> str:
    """What the models read of a URL: all after the scheme, lower-cased."""
    return (url or "").split("://", 1)[-1].lower()


def choose_threshold(marks: list[tuple[int, int, int]]) -> float:
    """The score from which on URLs are allowed: the best mean of both classes' recalls, midway between its neighbours.

    ``marks`` are steps of the score with the numbers of accepted and rejected URLs there.
    """
    marks = sorted(marks)
    na, nr = max(1, sum(m[1] for m in marks)), max(1, sum(m[2] for m in marks))
    below_a = below_r = 0
    best, at = -1.0, 0.0
    for i in range(len(marks) + 1):
        value = below_r / nr + (na - below_a) / na
        if value > best + 1e-12:
            lo = marks[i - 1][0] if i else marks[0][0] - STEPS
            hi = marks[i][0] if i < len(marks) else marks[-1][0] + STEPS
            best, at = value, (lo + hi + 1) / 2 / STEPS
        if i < len(marks):
            below_a += marks[i][1]
            below_r += marks[i][2]
    return at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions of a task's URLs by class, and their frequencies; some come more than once."""
    seen: dict[str, Counter[str]] = {"allow": Counter(), "block": Counter()}

    def batch(name: str) -> pa.RecordBatch:
        c = seen[name]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["verdict", "gram", "n"])

    for b in batches:
        for name, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[name].update(transitions(url_text(url)))
        for name, c in seen.items():
            if len(c) > GATHERED:
                yield batch(name)
                c.clear()
    yield from map(batch, seen)


def fit(df: DataFrame, verdict: str, url: str = "url", most: int = TRANSITIONS) -> Model | None:
    """Learn from all distinct URLs whose column ``verdict`` is allow or block; None unless there are both.

    A fifth of them, by hash, are held back for the threshold; where that
    leaves a class without any URL to learn from, or to calibrate on, all serve
    for both.  ``most`` bounds the transitions that a model holds; where there
    are more, `url_scores` reads the rest from the stored table.
    """
    ship(df.sparkSession)
    known = df.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull()).select(F.col(verdict).alias("verdict"), F.col(url).alias("url")).distinct()
    known = store(known.withColumn("held", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HELD)) == 0), "labelled_urls")
    parts = {(r["verdict"], r["held"]): r["count"] for r in known.groupBy("verdict", "held").count().collect()}
    if len({v for v, _ in parts}) < 2:
        return None
    split = len(parts) == 4
    counts = store((known.where("not held") if split else known).select("verdict", "url").mapInArrow(_count, "verdict string, gram string, n bigint").groupBy("verdict", "gram").agg(F.sum("n").alias("n")), "transitions")
    models, sizes = {}, {r["verdict"]: r["count"] for r in counts.groupBy("verdict").count().collect()}
    for name in ("allow", "block"):
        own = counts.where(F.col("verdict") == name)
        frequent = own.where(F.col("n") >= least_frequency(own, most))  # at most `most` rows
        models[name] = Markov({r["gram"]: r["n"] for r in frequent.select("gram", "n").toLocalIterator()})
    model = Model(models["allow"], models["block"], whole=counts if max(sizes.values()) > most else None)
    scored = url_scores(known.where("held") if split else known, model, "url", "score")
    steps = scored.groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    model.threshold = choose_threshold([(r["step"], r["a"], r["r"]) for r in steps.where("step is not null").collect()])  # as many rows as there are steps of the score
    return model


def url_scores(df: DataFrame, model: Model | None, url: str = "url", into: str = "url_score") -> DataFrame:
    """Add ``into``: the model's score less its threshold; null for a null or empty URL, 0 without a model."""
    into = fresh(df, into)
    if model is None:
        return df.withColumn(into, F.when(F.length(url) > 0, F.lit(0.0)))
    ship(df.sparkSession)
    if model.whole is not None:
        return _joined_scores(df, model.whole, model.threshold, url, into)
    mark = uuid.uuid4().hex  # each model has its own ratios
    held = df.sparkSession.sparkContext.broadcast(model)
    threshold = model.threshold

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, model = hold(("url_filter", mark), dict), held.value
        for batch in batches:
            yield pa.array([model.score(url_text(u), known) - threshold if u else None for u in batch.to_pylist()], pa.float64())

    return df.withColumn(into, score.asNondeterministic()(F.col(url)))


def _ratios(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """The log ratio of both models for each distinct ``key`` (context and character), by all transitions."""
    k = keys.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("k")).withColumn("gram", F.expr("right(key, k)")).withColumn("part", F.expr("left(gram, length(gram) - 1)"))
    sides = [F.when(F.col("verdict") == v, F.col("n")) for v in ("allow", "block")]
    n = counts.groupBy("gram").agg(*[F.sum(s).alias(f"n{i}") for i, s in enumerate(sides)])
    part = F.expr("left(gram, length(gram) - 1)").alias("part")
    stats = counts.groupBy(part).agg(*[f(s).alias(f"{c}{i}") for i, s in enumerate(sides) for c, f in (("kinds", F.count), ("total", F.sum))])
    fields = ["n0", "kinds0", "total0", "n1", "kinds1", "total1"]
    found = k.join(n, "gram", "left").join(stats, "part", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", *fields))).alias("steps"))  # a key has few contexts

    def probability(i: int) -> Column:
        def blend(p: Column, x: Column) -> Column:  # a context that wasn't seen leaves it to shorter ones
            kinds = x[f"kinds{i}"]
            return F.when(kinds > 0, (F.coalesce(x[f"n{i}"], F.lit(0)) + kinds * p) / (x[f"total{i}"] + kinds)).otherwise(p)

        return F.aggregate("steps", F.lit(1 / ALPHABET), blend)

    return found.select("key", F.log(probability(0) / probability(1)).alias("ratio"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each character of a task's URLs with its context, their number in the URL's text, and the text's length."""
    for b in batches:
        ids, keys = [], []
        for i, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = "\n" + url_text(url) + "\n"
            for j in range(1, len(t)):
                ids.append(i)
                keys.append(t[max(0, j - ORDER) : j + 1])
                if len(ids) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])
                    ids, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])


def _joined_scores(df: DataFrame, counts: DataFrame, threshold: float, url: str, into: str) -> DataFrame:
    """The scores of `url_scores` by joins: no worker holds a model, and no transition is left out.

    Distinct URLs get numbers and their characters meet the ratios of distinct
    contexts, which come from all transitions.
    """
    some = df.where(F.length(url) > 0).select(F.col(url).alias("text")).distinct()
    numbered = store(some.withColumn("id", F.monotonically_increasing_id()), "scored_urls")
    keys = store(numbered.select("id", "text").mapInArrow(_keys, "id bigint, key string").groupBy("id", "key").agg(F.count("*").alias("times")), "url_contexts")
    sums = keys.join(_ratios(keys.select("key").distinct(), counts), "key").groupBy("id").agg(F.sum(F.col("times") * F.col("ratio")).alias("sum"), F.sum("times").alias("length"))
    key, value = fresh(df, "url_text_"), F.when(F.col("length") > 1, F.col("sum") / F.col("length")).otherwise(F.lit(0.0)) - threshold
    scores = numbered.join(sums, "id").select(F.col("text").alias(key), value.alias(into))
    return df.join(scores, F.col(url) == F.col(key), "left").select(*[F.col(f"`{c}`") for c in df.columns], into)


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", into: str = "judged", most: int = TRANSITIONS) -> DataFrame:
    """Add struct ``into``: host, path, rule, score, verdict (allow or block) of every URL.

    The longest fitting rule decides; without one the language models do, and
    a null or empty URL is blocked.  If the rules accept or reject nothing,
    there is nothing to learn and other URLs are allowed.  Repeated rows are
    judged alike; an empty table stays empty; other columns are kept and
    ``into`` gets underscores if the name is taken.
    """
    host, path = url_parts(F.col(url))
    name, verdict = rule_match(host, path, rules)
    v = fresh(df, "verdict_")
    model = fit(df.withColumn(v, verdict), v, url, most)
    s = fresh(df, "score_")
    scored = url_scores(df, model, url, s)
    final = F.coalesce(verdict, F.when(F.col(s) >= 0, "allow").otherwise("block"))
    made = F.struct(host.alias("host"), path.alias("path"), name.alias("rule"), F.col(s).alias("score"), final.alias("verdict"))
    return scored.withColumn(fresh(df, into), made).drop(s)
