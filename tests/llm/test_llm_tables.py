"""Corpus operators on vectors and URLs, components, registered queries, the pipeline."""

import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from variantframe.llm import ann, common, components, minhash, mixing, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16)).astype(np.float32)
    y = ann.rotate(x, ann.Tables(16, 1).signs()[0, 0])
    assert np.allclose((y**2).sum(1), (x**2).sum(1), rtol=1e-4) and not np.allclose(x, y)
    h = ann.hadamard(np.eye(8, dtype=np.float32)) * np.sqrt(8)
    assert np.allclose(h @ h.T, 8 * np.eye(8), atol=1e-4) and set(np.round(np.unique(h))) == {-1.0, 1.0}


def exact(rows, queries_, k):
    out = {}
    for q in queries_:
        v = np.array(rows[q], float)
        d = sorted((float(np.sqrt(((np.array(w, float) - v) ** 2).sum())), i) for i, w in rows.items() if i != q)
        out[q] = d[:k]
    return out


def test_neighbours_of_test_vectors(spark):
    out = queries.op3_cross_polytope(spark, SF).collect()
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    e = {i: np.array(v, np.float32).astype(float) for i, v in e.items()}
    want = exact(e, [i for i in e if i % 100 == 0], 10)
    found = total = 0
    for q, near in want.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert [(r[2], r[1]) for r in own] == sorted((r[2], r[1]) for r in own)
        found += len({r[1] for r in own} & {i for _, i in near})
        total += 10
        for _, i, s in own:
            assert s == pytest.approx(np.sqrt(((e[i] - e[q]) ** 2).sum()), abs=1e-12)
    assert found / total >= 0.9


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<double>").withColumn("class", F.lit("x"))
    out = ann.nearest(df, df.where("vec_id in (0, 100, 110, 200)")).collect()
    for q in (100, 110):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        ids = [i for i in range(100, 140) if i != q][:10]
        assert own == [(k + 1, i, 0.0) for k, i in enumerate(ids)]
    assert {r["query_id"] for r in out} == {0, 100, 110}
    assert all(r["vec_id"] < 200 for r in out)
    assert ann.nearest(df.where("vec_id < 0"), df).count() == 0
    assert ann.nearest(df, df.where("vec_id < 0")).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 1"))
    assert sorted(r["vec_id"] for r in few.collect()) == [0, 2]


@pytest.mark.parametrize("n", [1, 2, 5, 11, 12, 40, 60])
def test_neighbours_of_small_tables_are_whole(spark, n):
    rng = np.random.default_rng(n)
    rows = {i: [float(x) for x in rng.normal(size=64)] for i in range(n)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    out = ann.nearest(df, df).collect()
    for q in rows:
        own = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == q)
        assert [r for r, _ in own] == list(range(1, min(10, n - 1) + 1))
    if n <= 11:
        assert {(r["query_id"], r["vec_id"]) for r in out} == {(a, b) for a in rows for b in rows if a != b}


@pytest.mark.parametrize("rotations", [1, 2])
def test_recall_of_fitted_probes(spark, rotations):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    e = {r["vec_id"]: np.array(r["embedding"], np.float32).astype(float) for r in vectors.collect()}
    asked = [i for i in e if i % 10 == 0]
    want = exact(e, asked, 10)
    fitted = [np.array([e[j] for _, j in want[q]]) for q in asked[::2]]
    sample = np.array([e[q] for q in asked[::2]])
    t = ann.Tables(64, rotations, 8)
    ranks = np.sort(np.concatenate([ann.probe_ranks(sample[i : i + 1], x, t)[0] for i, x in enumerate(fitted)]))
    t = ann.Tables(64, rotations, 8, int(ranks[int(0.97 * len(ranks))]) + 1)
    out = ann.nearest(vectors, vectors.where("vec_id % 10 = 0"), index=t).collect()
    found = sum(len({r["vec_id"] for r in out if r["query_id"] == q} & {j for _, j in want[q]}) for q in asked)
    assert found / (10 * len(asked)) >= 0.9


def test_probe_ranks_follow_the_buckets():
    x = np.random.default_rng(2).normal(size=(40, 12))
    for rotations in (1, 2):
        t = ann.Tables(12, rotations, 3, 50)
        got, where = ann.buckets(x[:5], t, 50), ann.buckets(x, t, 1)[:, :, 0]
        ranks = ann.probe_ranks(x[:5], x, t)
        for q in range(5):
            for r in range(40):
                at = [np.flatnonzero(got[q, i] == where[r, i]) for i in range(3)]
                first = min((int(a[0]) for a in at if len(a)), default=None)
                assert ranks[q, r] == first if first is not None else ranks[q, r] >= min(50, 32)


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://org/", "http://x.com/fr/", "http://notexample.org/es/1", "ftp://com", "http://a.com?x=://b/c", "http://h.net/p#f?x", "x://y://z/k"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.url_parts(F.col("url"))
    rule, verdict = url_filter.rule_match(host, path, queries.URL_RULES)
    got = {r[0]: tuple(r)[1:] for r in df.select("page_id", host, path, rule, verdict).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, None)
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "/", "org/", "allow") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[8] == ("com", "", None, None) and got[9] == ("a.com", "", None, None) and got[10][:2] == ("h.net", "/p") and got[11][:2] == ("y:", "//z/k")


def test_url_model_separates_unseen_urls(spark):
    rng = random.Random(2)
    good = [f"http://h{i}.org/{rng.choice(['news', 'science', 'culture'])}/{rng.randrange(9999)}" for i in range(300)]
    bad = [f"http://h{i}.com/de/{rng.choice(['win', 'cash', 'pills'])}-{rng.randrange(9999)}" for i in range(300)]
    free = [f"http://q{i}.net/science/{i}" for i in range(40)] + [f"http://q{i}.net/de/cash-{i}" for i in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + free)], "page_id long, url string").withColumn("judged", F.lit(0))
    out = url_filter.filter_urls(df, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "judged", "judged_"]
    rows = out.where("page_id >= 600").orderBy("page_id").select("judged_.verdict", "judged_.rule").collect()
    verdicts = [r[0] for r in rows]
    assert verdicts[:40].count("allow") >= 38 and verdicts[40:80].count("block") >= 38 and verdicts[80:] == ["block", "block"]
    assert url_filter.filter_urls(df.where("page_id < 0"), queries.URL_RULES).count() == 0
    assert {r[0] for r in url_filter.filter_urls(df.drop("judged"), []).where("url <> ''").select("judged.verdict").collect()} == {"allow"}


def test_markov_probabilities_sum_to_one():
    m = url_filter.Markov(Counter(g for t in ("abcab", "abd") for g in url_filter.transitions(t)))
    for context in ("", "a", "ab", "zab"):
        assert sum(m.probability(context, chr(c)) for c in range(256)) == pytest.approx(1)


def plain_url_verdicts(urls, rules_):
    """All of the URL filter by the book: contexts counted by scanning the texts, one URL at a time."""

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(u):
        host, path = parts(u)
        fit = [(len(h + p), h + p, v) for v, h, p in rules_ if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    text = lambda u: "\n" + u.split("://", 1)[-1].lower() + "\n"
    known = sorted({(rule(u)[1], u) for u in urls if u is not None and rule(u)[1]})
    held = [k for k in known if zlib.crc32(k[1].encode()) % url_filter.HELD == 0]
    learn = {v: [text(u) for w, u in known if w == v and (v, u) not in held] for v in ("allow", "block")}

    def p(texts, context, c):
        out = 1 / url_filter.ALPHABET
        for k in range(len(context) + 1):
            part = context[len(context) - k :]
            after = Counter(t[i + k] for t in texts for i in range(len(t) - k) if t[i : i + k] == part and i + k >= 1)
            if not after:
                break
            out = (after[c] + len(after) * out) / (sum(after.values()) + len(after))
        return out

    def score(u):
        t = text(u)
        return sum(math.log(p(learn["allow"], t[max(0, i - url_filter.ORDER) : i], t[i]) / p(learn["block"], t[max(0, i - url_filter.ORDER) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)

    marks = Counter()
    for v, u in held:
        marks[math.floor(score(u) * url_filter.STEPS), v] += 1
    steps = sorted({s for s, _ in marks})
    na, nr = (sum(n for (_, w), n in marks.items() if w == v) for v in ("allow", "block"))
    gain = [sum(marks[s, "block"] for s in steps[:i]) / nr + sum(marks[s, "allow"] for s in steps[i:]) / na for i in range(len(steps) + 1)]
    i = max(range(len(gain)), key=lambda k: (round(gain[k], 9), -k))
    lo = steps[i - 1] if i else steps[0] - url_filter.STEPS
    hi = steps[i] if i < len(steps) else steps[-1] + url_filter.STEPS
    threshold = (lo + hi + 1) / 2 / url_filter.STEPS
    return [(*parts(u), rule(u)[0], rule(u)[1] or ("allow" if u and score(u) >= threshold else "block")) for u in urls]


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda pool: "".join(rng.choice(pool) for _ in range(rng.randint(2, 6)))
    urls = [f"http://{word('abc')}.org/{word('news')}" for _ in range(25)] + [f"http://{word('xyz')}.com/de/{word('cash')}" for _ in range(25)]
    urls += [f"https://{word('abcxyz')}.net/{word('newscash')}" for _ in range(25)] + [None, "", "no scheme", "http://A.Example.ORG/es/x?q", "http://example.org/en/12#f", urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(df, queries.URL_RULES).orderBy("page_id").select("judged.host", "judged.path", "judged.rule", "judged.verdict").collect()
    assert [tuple(r) for r in got] == plain_url_verdicts(urls, queries.URL_RULES)


def test_url_models_are_bounded(spark):
    df = spark.createDataFrame([(f"http://h{i}.org/{i * 7919 % 1000}", "allow" if i % 2 else "block") for i in range(200)], "url string, verdict string")
    model = url_filter.fit(df, "verdict", most=300)
    assert 0 < sum(map(len, model.accepted.counts.values())) <= 300 and sum(map(len, model.rejected.counts.values())) <= 300
    assert math.isfinite(model.score("h3.org/21", {}))
    assert url_filter.fit(df.where("verdict = 'allow'"), "verdict") is None


def test_url_scores_by_joins_leave_no_transition_out(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/{i * 7919 % 1000}/ß😀?q" if i % 9 else "x://", "allow" if i % 2 else "block") for i in range(200)] + [(900, None, None), (901, "", None), (902, "http://H3.net/new", None), (902, "http://H3.net/new", None), (903, "n://", None)], "i long, url string, verdict string")
    whole, held = url_filter.fit(df, "verdict"), url_filter.fit(df, "verdict", most=300)
    assert whole.whole is None and held.whole is not None and held.threshold == pytest.approx(whole.threshold)
    a, b = ([tuple(r) for r in url_filter.url_scores(df, m).orderBy("i", "url").select("i", "url", "url_score").collect()] for m in (whole, held))
    assert [x[:2] for x in a] == [x[:2] for x in b] and len(b) == 205
    for x, y in zip(a, b, strict=True):
        assert x[2] == (None if y[2] is None else pytest.approx(y[2], abs=1e-9))
    one, other = ([tuple(r) for r in url_filter.filter_urls(df, [("allow", "org", "/1"), ("block", "org", "/2")], most=m).orderBy("i").select("i", "judged.verdict").collect()] for m in (url_filter.TRANSITIONS, 300))
    assert one == other


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(df.where("a < 0")).count() == 0


def test_crc_mod(spark):
    df = spark.createDataFrame([(0,), (17,), (123456,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(common.crc_mod(F.col("doc_id"), 5)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in (0, 17, 123456)] + [0]


@pytest.mark.parametrize("name,keys", [("op2_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op6_url_filter", {"page_id", "host", "path", "rule", "verdict"}), ("op7_html_extract", {"page_id", "url", "text", "n_chars"}), ("op10_bpe_roundtrip", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"})])
def test_registered_query_returns_whole_table(spark, name, keys):
    out = queries.QUERIES[name](spark, SF)
    table = "pages" if "page_id" in keys else "documents"
    assert keys <= set(out.columns) and out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "minhash_near_dedup", "mixing", "bpe"]
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    judged = quality.judge(quality.text_figures(docs))
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in judged.where("quality.kept").select("doc_id").collect()}
    clean = corpus_pipeline.toxicity_stage(spark, kept, SF)
    one = corpus_pipeline.near_dedup_stage(spark, kept, SF)
    groups = minhash.near_duplicates(kept).where("kept").select("doc_id")
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in groups.collect()}
    more = corpus_pipeline.mixing_stage(spark, one, SF)
    want = mixing.mixture(one).agg(F.sum("mix.copies")).first()[0]
    assert more.count() == want
    for df in (kept, clean, one, more):
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(kept, labels)
    scored = toxicity.toxicity(kept, model, into="s")
    assert clean.count() == scored.where("s < 0.5").count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("n_tokens > 0").count() == out.count()


def test_components_of_a_hot_root(spark):
    star = [(1, i) for i in range(2, 800)] + [(i, i + 1) for i in range(2, 100, 3)] + [(900, 901)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 800)} | {900: 900, 901: 900}


def test_pipeline_stages_on_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog while seven other animals watch from behind a tall green fence. "
    words_ = [f"Word{i} goes" for i in range(60)]
    rows = [(1, " ".join(words_), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " ".join(reversed(words_)), None, None), (None, " ".join(words_[5:]), "de", "b"), (1, " ".join(words_), "en", "a"), (5, text * 2000, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n_chars", "key", "mix", "bpe", "toxicity", "figures", "quality", "kept_id", "size_")})
    for df in (docs, docs.where("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.columns == (df.columns if name != "bpe" else ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"])
            n = out.count()
            assert n <= 3 * len(rows) if df is docs else n == 0
    assert corpus_pipeline.bpe_stage(spark, docs, SF).where("n_tokens = 0").count() == 2
    assert sorted(r[0] or 0 for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).select("doc_id").collect()) == [0, 1, 2, 3, 4, 5]
    kept = {r[0] for r in corpus_pipeline.quality_stage(spark, docs, SF).select("doc_id").collect()}
    assert {2, 3, 5}.isdisjoint(kept)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
