"""Document quality by weak supervision, with DataFrame operations only.

Rules look at figures of a text and vote good (1), bad (-1) or abstain (0).
Documents are counted by their pattern of votes; expectation-maximisation over
the patterns estimates each rule's accuracy, and a document's quality is its
posterior probability of being good.  The prior share of good documents is a
parameter and not estimated: most kinds of junk are seen by one or two rules
only, and an estimated share, which is high, would outvote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, store, words

#: Fixed values of the base filter: fewest words, and percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Steps of expectation-maximisation, accuracy to start with, prior share of good documents.
STEPS, START_ACCURACY, PRIOR = 30, 0.85, 0.5
#: A document is kept from this posterior on.
KEEP = 0.5


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_figures(df: DataFrame, text: str = "text", into: str = "figures", window: int = 3, keep_text: bool = True) -> DataFrame:
    """Add struct ``into`` of long figures of the whole text.

    n_words, word_chars (code points in words), n_symbols, n_capitals, n_bangs,
    n_lines (with a word), n_dup_lines (equal to an earlier one) and
    n_repeat_words: words in windows of ``window`` words found twice or more.

    A text's windows are sorted as one array of longs, hash in the high bits
    and place in the low ones, so repeats stand side by side whatever the
    text's length; equal hashes are confirmed on the words.  Null text: zeros.
    The result is stored (without the text if ``keep_text`` is false): figures
    are used many times, and filters pushed below them would work them out anew.
    """
    names = {n: fresh(df, f"_{n}") for n in ("t", "w", "bits", "sorted", "lines", "at")}
    t, w, bits, srt, lines, at = (F.col(names[n]) for n in ("t", "w", "bits", "sorted", "lines", "at"))
    n = F.size(w)
    out = df.withColumn(names["t"], F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(names["w"], words(t))
    out = out.withColumn(names["lines"], F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0))
    out = out.withColumn(names["bits"], F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int"))
    places = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: F.call_function("shiftleft", F.xxhash64(*[F.get(w, i + j) for j in range(window)]), bits).bitwiseOR(i.cast("long")))
    out = out.withColumn(names["sorted"], F.sort_array(packed))

    def place(x: Column) -> Column:
        return x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)

    def same(x: Column, y: Column) -> Column:
        near = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        p, q = place(x).cast("int"), place(y).cast("int")
        for j in range(window):
            near &= F.get(w, p + j) == F.get(w, q + j)
        return F.coalesce(near, F.lit(False))

    hits = F.filter(srt, lambda x, k: same(x, F.get(srt, k - 1)) | same(x, F.get(srt, k + 1)))
    out = out.withColumn(names["at"], F.sort_array(F.transform(hits, place)))
    step = lambda x, k: F.least(F.lit(window).cast("long"), F.coalesce(F.get(at, k + 1) - x, F.lit(window).cast("long")))
    repeated = F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda a, x: a + x)
    made = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, _BLANK, "")),
        "n_symbols": _count(t, SYMBOLS),
        "n_capitals": _count(t, _CAPITALS),
        "n_bangs": _count(t, "!"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
    }
    into = fresh(df, into)
    kept = [c for c in df.columns if keep_text or c != text]
    figures = out.select(*[F.col(f"`{c}`") for c in kept], F.struct(*[v.cast("long").alias(k) for k, v in made.items()]).alias(into))
    return store(figures, "figures")


def base_failed(f: str) -> Column:
    """The base filter on a struct of figures."""
    return (F.col(f"{f}.n_words") < LEAST_WORDS) | (100 * F.col(f"{f}.n_repeat_words") > MOST_REPEATED * F.col(f"{f}.n_words"))


def rules(f: str) -> dict[str, Column]:
    """Votes by rule name: -1, 0 or 1."""
    g = {n: F.col(f"{f}.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words")}

    def over(x: str, percent: float, of: str) -> Column:
        return 100 * g[x] > percent * g[of]

    bad = {
        "symbol_words": over("n_symbols", 10, "n_words"),
        "symbol_chars": over("n_symbols", 3, "word_chars"),
        "shouting": over("n_capitals", 30, "word_chars"),
        "exclaiming": over("n_bangs", 20, "n_words"),
        "repeating": over("n_repeat_words", 40, "n_words"),
        "repeated_lines": (g["n_lines"] >= 4) & over("n_dup_lines", 30, "n_lines"),
        "word_length": over("n_words", 40, "word_chars") | over("word_chars", 1500, "n_words"),
    }
    good = {
        "calm": ~over("n_symbols", 2, "n_words") & ~over("n_bangs", 2, "n_words") & ~over("n_capitals", 15, "word_chars") & ~over("n_repeat_words", 25, "n_words"),
        "varied": ~over("n_repeat_words", 10, "n_words") & ~over("n_symbols", 5, "n_words") & ~over("n_bangs", 5, "n_words"),
        "plain_case": over("n_capitals", 0.2, "word_chars") & ~over("n_capitals", 10, "word_chars") & ~over("n_symbols", 5, "n_words") & ~over("n_repeat_words", 25, "n_words"),
    }
    votes = {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {k: F.when(v & (g["n_words"] > 0), 1).otherwise(0) for k, v in good.items()}
    return {k: v.cast("int") for k, v in votes.items()}


def fit_votes(patterns: DataFrame, n_rules: int, steps: int = STEPS, prior: float = PRIOR) -> list[float]:
    """Each rule's accuracy, by expectation-maximisation inside one SQL expression.

    ``patterns`` has votes (array) and n; rows are bounded by the number of
    vote patterns, not by documents.  Votes of a good document are taken to be
    1, of a bad one -1, with the rule's accuracy.  No rows: the starting values.
    """
    logit = lambda p: f"ln(({p}) / (1 - ({p})))"
    score = f"aggregate(p.votes, struct({logit(f'{prior}D')} AS s, 0 AS i), (a, v) -> struct(a.s + v * {logit('m[a.i]')} AS s, a.i + 1 AS i), a -> a.s)"
    q = f"transform(ps, p -> struct(p.votes AS votes, cast(p.n AS double) AS n, 1 / (1 + exp(-({score}))) AS q))"
    right = "aggregate(qs, 0D, (a, x) -> a + x.n * CASE x.votes[k] WHEN 1 THEN x.q WHEN -1 THEN 1 - x.q ELSE 0D END)"
    cast = "aggregate(qs, 0D, (a, x) -> a + x.n * abs(x.votes[k]))"
    step = f"transform(array({q}), qs -> transform(sequence(0, {n_rules - 1}), k -> least(0.999D, greatest(0.501D, ({right} + 8.5D) / ({cast} + 10)))))[0]"
    start = "array(" + ", ".join([f"{START_ACCURACY}D"] * n_rules) + ")"
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("ps"))
    got = one.select(F.expr(f"aggregate(sequence(1, {steps}), {start}, (m, s) -> {step})").alias("m")).first()
    return list(got["m"])


def judge(df: DataFrame, figures: str = "figures", into: str = "quality", steps: int = STEPS, prior: float = PRIOR) -> DataFrame:
    """Add struct ``into``: votes by rule, posterior (0 to 1), base_failed, kept.

    ``df`` has `text_figures`' struct and is read twice.
    kept: the base filter holds and the posterior is at least `KEEP`.  Texts
    without words fail the base filter.  An empty table stays empty; other
    columns are kept and ``into`` gets underscores if the name is taken.
    """
    votes = rules(figures)
    named = F.array(*votes.values())
    patterns = df.select(named.alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))
    accuracy = fit_votes(patterns, len(votes), steps, prior)
    score = F.ln(F.lit(prior) / F.lit(1 - prior))
    for v, a in zip(votes.values(), accuracy, strict=True):
        score = score + v * F.ln(F.lit(a) / F.lit(1 - a))
    posterior = 1 / (1 + F.exp(-score))
    failed = base_failed(figures)
    made = F.struct(F.struct(*[v.alias(k) for k, v in votes.items()]).alias("votes"), posterior.alias("posterior"), failed.alias("base_failed"), (~failed & (posterior >= KEEP)).alias("kept"))
    return df.withColumn(fresh(df, into), made)


def filter_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` that are kept.  Null and empty texts go."""
    figures = text_figures(df, text)
    name = figures.columns[-1]
    judged = judge(figures, name)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*[F.col(f"`{c}`") for c in df.columns])
