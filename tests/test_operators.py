"""Hand-made rows for the semantics that the driver tables can't show."""

import math
import random

import pytest
from pyspark.sql import functions as F

from variantframe.functions import alleles, columns, scalars
from variantframe.operators.common import running_sum
from variantframe.operators import annotation, cohort, gwas, linkage, matching, ranges, ranking, scoring, sets, statistics, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


CATALOG = [("1", 1, 100, "A", "G"), ("1", 2, 100, "A", "T"), ("1", 3, 200, "c", "t"), ("1", 4, 300, "AT", "A"), ("X", 5, 100, "A", "G")]
WEIGHTS = [
    (0, "1", 100, "G", "A", 0, 1.0),  # direct
    (1, "1", 100, "A", "G", 1, 2.0),  # effect is REF
    (2, "1", 100, "C", "T", 0, 3.0),  # other strand of A/G
    (3, "1", 200, "T", "C", 0, 4.0),  # lower-case catalog
    (4, "1", 999, "A", "G", 0, 5.0),  # no such position
    (5, "1", 200, "G", "T", 0, 6.0),  # other alleles
    (6, "1", 100, "T", "A", 0, 7.0),  # palindromic: direct and strand
]


@pytest.fixture(scope="module")
def match_tables(spark):
    return spark.createDataFrame(CATALOG, "CHROM string, zarr_idx long, POS long, REF string, ALT string"), spark.createDataFrame(WEIGHTS, "rowid long, CHROM string, POS long, EA string, OA string, IS_FLIP int, BETA double")


def test_match_best_and_exclusions(match_tables):
    catalog, weights = match_tables
    got = matching.match_best(catalog, weights)
    assert rows(got.select("rowid", "zarr_idx", "flip", "is_strand")) == [(0, 1, False, 0), (1, 1, True, 0), (2, 1, False, 1), (3, 3, False, 0), (6, 2, False, 0)]
    out = matching.exclusion_reasons(catalog, weights, got)
    assert rows(out.select("rowid", "reason")) == [(4, "position_missing"), (5, "allele_mismatch")]
    assert rows(matching.match_best(catalog, weights, drop_palindromic=True).select("rowid")) == [(0,), (1,), (2,), (3,)]


@pytest.mark.parametrize("policy,want", [("mean", {"a": -1.0, "b": 0.5}), ("zero", {"a": -1.0, "b": 0.0}), ("skip", {"a": -1.0, "b": 0.0})])
def test_missing_policies(spark, policy, want):
    matched = spark.createDataFrame([(1, False, 0.5), (2, True, -1.0), (3, False, 9.0)], "zarr_idx long, flip boolean, BETA double")
    dosage = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "a", 0.0), (2, "b", 2.0), (3, "a", None), (3, "b", None)], "zarr_idx long, sample_id string, dosage double")
    got = dict(scoring.score_samples(matched, dosage, policy).select("sample_id", "PRS").collect())
    want = {"a": 0.5 * 2 - 1.0 * 2, "b": {"mean": 0.5 * 2 + 0, "zero": 0.0, "skip": 0.0}[policy]}
    assert got == pytest.approx(want)


def test_array_scores_equal_long_scores(spark):
    rng = random.Random(1)
    matched = spark.createDataFrame([(i, i % 2 == 0, rng.uniform(-1, 1)) for i in range(30)], "zarr_idx long, flip boolean, BETA double")
    table = [(i, [rng.choice([0.0, 1.0, 2.0, None]) for _ in range(6)]) for i in range(40)]
    table[7] = (7, [None] * 6)
    arrays = spark.createDataFrame(table, "zarr_idx long, dosages array<double>")
    long = spark.createDataFrame([(i, s, d) for i, ds in table for s, d in enumerate(ds)], "zarr_idx long, sample_id long, dosage double")
    for policy in ("mean", "zero"):
        a = dict(scoring.score_arrays(matched, arrays, None, policy).collect())
        b = {r[0]: r[1] for r in scoring.score_samples(matched, long, policy).collect()}
        assert a == pytest.approx(b)


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "d double")
    t = F.lit(True)
    assert rows(df.select(alleles.flip_dosage(alleles.flip_dosage(F.col("d"), t), t).alias("d"))) == rows(df)


def test_range_join_and_nearest_equal_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice("ab"), rng.randrange(60_000)) for i in range(300)] + [(300, "c", 5)]
    ivs = []
    for i in range(120):
        b = rng.randrange(50_000)
        ivs.append((i, rng.choice("ab"), b, b + rng.choice([0, 1, 7, 300, 20_000])))
    points = spark.createDataFrame(pts, "point_id long, CHROM string, pos long")
    intervals = spark.createDataFrame(ivs, "iv long, CHROM string, begin long, end long")
    got = rows(ranges.range_join(points, intervals).select("point_id", "iv"))
    assert got == sorted((p, i) for p, c, x in pts for i, d, b, e in ivs if c == d and b <= x < e)
    real = [v for v in ivs if v[3] > v[2]]
    near = {r[0]: (r[1], r[2]) for r in ranges.nearest_interval(points, intervals.where("end > begin"), "iv", segment=7_000).collect()}
    for p, c, x in pts:
        dist = {i: (b - x if x < b else x - e + 1 if x >= e else 0) for i, d, b, e in real if d == c}
        if dist:
            assert near[p][1] == min(dist.values()) and dist[near[p][0]] == near[p][1]
        else:
            assert near[p] == (None, None)


def test_gap_clusters_and_interpolation(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 5, 20, 24)] + [("b", 3)], "g string, pos long")
    assert rows(ranges.gap_clusters(df, ["g"], "pos", 5)) == [("a", 1, 1), ("a", 5, 1), ("a", 5, 1), ("a", 20, 2), ("a", 24, 2), ("b", 3, 1)]
    grid = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0)], "g string, x long, y double")
    pts = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 15), (4, "a", 99), (5, "z", 1)], "point_id long, g string, pos long")
    assert rows(ranges.interpolate(pts, grid, ["g"])) == [(1, 1.0), (2, 1.0), (3, 1.5), (4, 2.0), (5, None)]


def test_windows_with_ties_and_flat_groups(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 3.0), (4, 1, 2.0), (5, 1, 2.0), (6, 0, None)], "id long, sex int, v double")
    assert rows(windows.percentile_rank(df, "v", "p", ["sex"]).select("id", F.round("p", 4))) == [(1, 50.0), (2, 50.0), (3, 100.0), (4, 75.0), (5, 75.0), (6, None)]
    z = dict(windows.zscore(df, "v", "z", ["sex"]).select("id", "z").collect())
    assert z[4] == 0 and z[5] == 0 and z[6] is None and z[3] > 0
    assert rows(windows.quantile_groups(df, "v", 2, "g").select("id", "g"))[:3] == [(1, 1), (2, 1), (3, 2)]
    empty = df.where("id < 0")
    assert windows.percentile_rank(empty, "v").count() == 0
    assert statistics.histogram(empty, "v").count() == 0
    assert windows.quantile_groups(empty, "v").count() == 0


def test_histogram_counts_sum(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 2, 10, 10)], "v double")
    h = rows(statistics.histogram(df, "v", 5), "bin")
    assert [r[2] for r in h] == [3, 1, 0, 0, 2]
    flat = rows(statistics.histogram(df.where("v = 0"), "v", 4), "bin")
    assert [r[2] for r in flat] == [2, 0, 0, 0]


def test_normal_tail_and_logistic(spark):
    df = spark.createDataFrame([(0.0,), (1.959963984540054,), (-1.959963984540054,), (None,)], "z double")
    p = [r[0] for r in df.select(statistics.two_sided_p("z")).collect()]
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(0.05) and p[2] == pytest.approx(0.05) and p[3] is None
    # Two groups with 30/100 and 60/100 cases: the odds ratio is known.
    data = [(1, 0.0)] * 30 + [(0, 0.0)] * 70 + [(1, 1.0)] * 60 + [(0, 1.0)] * 40
    fit = {r["term"]: r for r in statistics.logistic(spark.createDataFrame(data, "y int, x double"), "y", ["x"]).collect()}
    assert fit["x"]["odds_ratio"] == pytest.approx((60 / 40) / (30 / 70), rel=1e-6)
    assert fit["x"]["se"] == pytest.approx(math.sqrt(1 / 30 + 1 / 70 + 1 / 60 + 1 / 40), rel=1e-6)


def test_icd_cascade_and_flags(spark):
    codes = {"C33": "LUNG", "C349": "LUNG", "c50": "BREAST", "C61": "PROSTATE", "C53": "CERVICAL", "C169": "GI", "C76": "UNKNOWN", "C97": "UNKNOWN", "C81": "HEMATOLOGIC", "D32": "OTHER", "C5": "OTHER", "CXX": "OTHER", "": "UNKNOWN", None: "UNKNOWN"}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert dict(df.select("c", scalars.icd10_site(F.col("c"))).collect()) == codes
    flags = spark.createDataFrame([(None, None), (0, None), (2, 0)], "a int, b int")
    assert [r[0] for r in flags.select(scalars.any_flag([F.col("a"), F.col("b")])).collect()] == [0, 0, 1]


def test_gate_and_join_checks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id long, v string")
    gate = dict(cohort.validation_gate(df, {"known": F.col("v").isin("x", "y")}, "id", 4).collect())
    assert gate == {"known": 1, "row_count": 1, "unique_id": 1}
    with pytest.raises(ValueError):
        cohort.require(cohort.validation_gate(df, {"known": F.col("v").isNotNull()}))
    with pytest.raises(ValueError):
        cohort.join_keeping_rows(spark.createDataFrame([(1,)], "id long"), df, "id")
    with pytest.raises(ValueError):
        cohort.export(df)


def test_linkage_ties_and_windows(spark):
    cols = "link_id string, day string, sex int, height int, weight int, age int, birth_year int"
    left = spark.createDataFrame([(1, "A", "2020-01-01", 1, 170, 70, 50, 1970), (2, None, "2020-01-01", 1, 170, 70, 50, 1970), (3, "Z", "2020-01-01", 0, 1, 1, 1, 1)], "left_id long, " + cols)
    right = spark.createDataFrame([(10, "A", "2020-01-01", 1, 170, 70, 50, 1970), (11, "A", "2020-01-01", 1, 170, 70, 50, 1970), (12, "B", "2020-01-07", 1, 170, 70, 50, 1970), (13, "Z", "2020-01-20", 0, 1, 1, 1, 1)], "right_id long, " + cols)
    left, right = (d.withColumn("day", F.to_date("day")) for d in (left, right))
    by_id, by_traits = linkage.link_by_id(left, right), linkage.link_by_traits(left, right)
    assert rows(by_id.select("left_id", "right_id", "score")) == [(1, 10, 230)]
    assert rows(by_traits.select("left_id", "right_id")) == [(1, 10), (2, 10)]
    out = rows(linkage.arbitrate(left, by_id, by_traits).select("left_id", "right_id", "method", "confidence"))
    assert out == [(1, 10, "ID", "EXACT_ID"), (2, 10, "TRAITS", "EXACT"), (3, None, "NONE", "NONE")]


def test_codons_across_exons_and_strands(spark):
    seq = "CCATGAAACCCGTTTTAGCCCCTAACATCC"  # + strand: exons 2-6 and 10-19
    sequence = spark.createDataFrame([("1", i, seq[i * 10 : i * 10 + 10]) for i in range(3)], "chrom string, chunk_id long, seq string")
    cds = spark.createDataFrame([("1", "T", 2, 7, "+"), ("1", "T", 11, 18, "+"), ("1", "M", 22, 28, "-")], "CHROM string, transcript_id string, begin long, end long, strand string")
    v = [(1, "1", 2, "A", "G"), (2, "1", 5, "A", "C"), (3, "1", 11, "G", "A"), (4, "1", 12, "T", "TA"), (5, "1", 27, "T", "C"), (6, "1", 12, "T", "TAAA")]
    variants = spark.createDataFrame(v, "variant_id long, CHROM string, pos long, REF string, ALT string")
    got = {r["variant_id"]: r for r in annotation.codon_consequences(variants, cds, sequence, 10).collect()}
    assert (got[1]["codon_ref"], got[1]["codon_alt"], got[1]["consequence"]) == ("ATG", "GTG", "start_lost")
    assert (got[2]["codon_ref"], got[2]["consequence"]) == ("AAG", "missense_variant")
    assert (got[3]["codon_ref"], got[3]["codon_alt"], got[3]["consequence"]) == ("AAG", "AAA", "synonymous_variant")
    assert got[4]["consequence"] == "frameshift_variant" and got[6]["consequence"] == "inframe_insertion"
    assert (got[5]["codon_ref"], got[5]["codon_index"]) == ("ATG", 0) and got[5]["consequence"] == "start_lost"


def test_classifier_priorities(spark):
    f = [("1", "gene", 100, 500, "+", "A", "gA", "lncRNA", None), ("1", "gene", 150, 400, "+", "B", "gB", "protein_coding", None), ("1", "exon", 200, 300, "+", "B", "gB", "protein_coding", "tB"), ("1", "CDS", 210, 290, "+", "B", "gB", "protein_coding", "tB")]
    features = spark.createDataFrame(f, "CHROM string, feature string, begin long, end long, strand string, gene_name string, gene_id string, gene_type string, transcript_id string")
    variants = spark.createDataFrame([(1, "1", 250), (2, "1", 205), (3, "1", 160), (4, "1", 120), (5, "1", 900), (6, "2", 1)], "variant_id long, CHROM string, pos long")
    best = annotation.best_features(variants, features)
    assert rows(best.select("variant_id", "feature", "gene_name", "all_overlapping_genes")) == [(1, "CDS", "B", "B,A"), (2, "exon", "B", "B,A"), (3, "gene", "B", "B,A"), (4, "gene", "A", "A")]
    gene_d = spark.createDataFrame([(5, 401), (6, None)], "variant_id long, distance long")
    exon_d = spark.createDataFrame([(3, 2), (4, 8)], "variant_id long, distance long")
    out = annotation.classify(variants, best, gene_d, exon_d, splice=spark.createDataFrame([(3, "donor")], "variant_id long, splice_type string"))
    assert rows(out.select("variant_id", "region_class", "consequence", "is_lof")) == [
        (1, "coding", "coding_sequence_variant", False),
        (2, "non_coding_exon", "non_coding_exon_variant", False),
        (3, "intronic", "splice_donor_variant", True),
        (4, "splice_region", "splice_region_variant", False),
        (5, "near_gene", "upstream_gene_variant", False),
        (6, "intergenic", "intergenic_variant", False),
    ]


def test_ranking_edges(spark):
    df = spark.createDataFrame([("novel", "stop_gained", "60", "2", "AR", True, ""), ("zzz", None, "x", None, "ARX", None, "TFBS")], "rarity_class_effective string, consequence string, cadd_phred string, revel_score string, gene_name string, is_lof boolean, regulatory_element_type string")
    clinical = spark.createDataFrame([("ar",)], "gene_symbol string")
    got = [r[0] for r in ranking.ranking_score(df, clinical).orderBy("gene_name").select("rank_score").collect()]
    assert got == [pytest.approx(0.25 * 0.9 + 0.3 + 0.2 + 0.1 + 0.1 + 0.05), pytest.approx(0.25 * 0.5 + 0.3 * 0.35)]


def test_element_types_and_rarity(spark):
    names = {"PLS": "promoter", "CTCF": "insulator", "OREG123": "regulatory_region", "": "regulatory_element", "myEnhancer1": "enhancer", "q": "regulatory_element"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert dict(df.select("n", annotation.element_type(F.col("n"))).collect()) == names
    af = spark.createDataFrame([(None,), (0.0,), (1e-5,), (1e-4,), (1e-3,), (1e-2,)], "af double")
    assert [r[0] for r in af.select(scalars.rarity(F.col("af"))).collect()] == ["novel", "novel", "ultra_rare", "rare", "low_frequency", "common"]


def test_clump_equals_greedy(spark):
    rng = random.Random(3)
    p = {i: rng.random() for i in range(60)}
    pairs = [(i, j, rng.random()) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.08]
    near = {i: set() for i in p}
    for a, b, r in pairs:
        if r >= 0.2:
            near[a].add(b)
            near[b].add(a)
    left, want = set(p), set()
    for i in sorted(p, key=lambda i: (p[i], i)):
        if i in left:
            want.add(i)
            left -= near[i] | {i}
    got = gwas.clump(spark.createDataFrame(list(p.items()), "SNP long, P double"), spark.createDataFrame(pairs, "a long, b long, r2 double"), 0.2)
    assert {r[0] for r in got.collect()} == want


def test_columns_by_role():
    names = ["hm_chr", "chr_name", "hm_pos", "rsID", "effect_allele", "hm_inferOtherAllele", "effect_weight"]
    assert columns.resolve_columns(names)["chrom"] == "hm_chr"
    with pytest.raises(ValueError):
        columns.resolve_columns(["x"], required=["pos"])
    assert columns.score_column(["IID", "x_score", "PRS_a"]) == "PRS_a"
    assert columns.score_column(["IID", "value"]) == "value"


def test_overlap_ignores_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert tuple(sets.overlap(a, b, "k").first()) == (1, 1, 1, 3)


def test_running_sum_by_ranges_equals_one_window(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.randrange(40), rng.randrange(5)) for i in range(500)], "k long, x long, v long").repartition(3)
    order = [F.col("x").desc(), F.col("k")]
    assert rows(running_sum(df, order, F.col("v"), "s")) == rows(running_sum(df, order, F.col("v"), "s", limit=0))


def test_ntile_equals_sql(spark):
    for n in (0, 3, 9, 10, 11, 25):
        df = spark.range(n).select(F.col("id"), (F.col("id") * 7 % 5).alias("v"))
        from pyspark.sql import Window

        want = df.withColumn("decile", F.ntile(10).over(Window.orderBy("v", "id")))
        assert rows(windows.ntile(df, "v", "id")) == rows(want)


def test_segments_change_no_result(spark):
    import random

    from variantframe.operators import ranges

    rng = random.Random(4)
    rows = [("c%d" % rng.randrange(2), rng.randrange(3000), i) for i in range(300)] + [(None, 5, 900), (None, 7, 901)]
    df = spark.createDataFrame(rows, "CHROM string, pos long, point_id long")
    whole, cut = (sorted((r["point_id"], r["cluster"]) for r in ranges.gap_clusters(df, ["CHROM"], "pos", 9, segment=s).collect()) for s in (1 << 20, 64))
    assert whole == cut and max(c for _, c in whole) > 5
    grid = spark.createDataFrame([("c0", x, float(x % 700)) for x in range(300, 2500, 333)] + [("c1", 40, 1.0)], "CHROM string, x long, y double")
    whole, cut = (sorted((r["point_id"], r["y"]) for r in ranges.interpolate(df, grid, ["CHROM"], segment=s).where("y is not null").collect()) for s in (1 << 20, 64))
    assert dict(whole) == pytest.approx(dict(cut)) and len(whole) == 300


def test_exact_quantiles_equal_percentile(spark):
    import math

    import numpy as np

    from variantframe.operators import common, statistics

    df = spark.range(997).selectExpr("id * 7919 % 1000 / 8.0 AS v").unionAll(spark.sql("SELECT CAST(NULL AS DOUBLE) AS v"))
    shares = [0.0, 0.05, 0.5, 0.951, 1.0]
    assert common.exact_quantiles(df, "v", shares) == pytest.approx(df.selectExpr(*[f"percentile(v, {q})" for q in shares]).first())
    assert common.exact_quantiles(df.where("v < 0"), "v", [0.5]) == [None]
    x = np.array([0.0, 0.3, 1.9, 2.0, 3.5, 8.0, 26.0, 50.0, np.nan])
    got = statistics.erfc(x)
    assert got[:-2] == pytest.approx([math.erfc(v) for v in x[:-2]], rel=1e-10) and got[-2] == 0 and np.isnan(got[-1])


def _features(spark, rng, n, width):
    kinds = ["gene", "transcript", "exon", "CDS", "five_prime_UTR", "other"]
    f = []
    for i in range(n):
        b = rng.randrange(width)
        g = rng.choice(["G1", "G2", "G3", "G4", None])
        f.append((rng.choice(["1", "2"]), rng.choice(kinds), b, b + rng.choice([0, 3, 40, 700]), "+", rng.choice([g, None, ""]), g, rng.choice(["protein_coding", "lncRNA", None]), rng.choice([None, f"T{i % 7}"])))
    return f, spark.createDataFrame(f, "CHROM string, feature string, begin long, end long, strand string, gene_name string, gene_id string, gene_type string, transcript_id string")


def _plain_features(variants, features):
    """Best feature by scanning all of them for each variant."""
    low = lambda v: (v is not None, v if v is not None else "")
    found = {}
    for v, c, p in variants:
        genes = found.setdefault(v, {})
        for chrom, kind, b, e, strand, name, gid, gtype, t in features:
            if chrom == c and p is not None and b <= p < e:
                gene = gid if gid is not None else name if name is not None else "?"
                other = None if gtype is None else int(gtype != "protein_coding")
                key = (annotation.FEATURE_RANK.get(kind, 999), (other is not None, other or 0), gene, t or "", kind, strand, low(name), low(gid), low(gtype))
                genes[gene] = min(genes.get(gene, (key,)), (key,), key=lambda x: x[0])
    out = {}
    for v, genes in found.items():
        hits = sorted(k[0] for k in genes.values())
        if hits:
            out[v] = (hits[0][4], hits[0][6][1] if hits[0][6][0] else None, hits[0][3], len(hits), ",".join(h[6][1] for h in hits if h[6][1]), ",".join(h[3] for h in hits if h[3]), ",".join(annotation.REGION.get(h[4], "intergenic") for h in hits))
    return out


@pytest.mark.parametrize("rows_kept,cells", [(1 << 17, 1 << 22), (7, 16)])
def test_best_features_equal_a_scan_and_make_no_pairs(spark, monkeypatch, rows_kept, cells):
    def no_pairs(*_):
        raise AssertionError("pairs of variants and features became rows")

    monkeypatch.setattr(annotation, "range_join", no_pairs)
    monkeypatch.setattr(ranges, "COVER_ROWS", rows_kept)
    monkeypatch.setattr(ranges, "COVER_CELLS", cells)
    rng = random.Random(11)
    f, features = _features(spark, rng, 1500, 9000)
    v = [(i, rng.choice(["1", "2", "3", None]), rng.choice([None, rng.randrange(9500)])) for i in range(60)] + [(100 + i, "1", 4095 + i % 3) for i in range(9)]
    best = annotation.best_features(spark.createDataFrame(v, "variant_id long, CHROM string, pos long"), features)
    got = {r[0]: tuple(r[1:]) for r in best.select("variant_id", "feature", "gene_name", "transcript_id", "n_overlapping_genes", "all_overlapping_genes", "all_overlapping_transcripts", "all_region_classes").collect()}
    assert got == _plain_features(v, f) and len(got) > 20


def test_hits_of_repeated_variants_are_merged(spark):
    rng = random.Random(12)
    f, features = _features(spark, rng, 80, 900)
    v = [(i % 25, rng.choice(["1", "2"]), rng.randrange(900)) for i in range(40)]
    variants = spark.createDataFrame(v, "variant_id long, CHROM string, pos long")
    best = annotation.best_features(variants, features)
    got = {r[0]: tuple(r[1:]) for r in best.select("variant_id", "feature", "gene_name", "transcript_id", "n_overlapping_genes", "all_overlapping_genes", "all_overlapping_transcripts", "all_region_classes").collect()}
    assert got == _plain_features(v, f) and best.count() == len(got)


def test_classes_of_regions_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(annotation, "range_join", lambda *_: 1 / 0)
    features = spark.createDataFrame([("1", "CDS" if i % 2 else "gene", 0, 1000 + i, "+", "A", f"g{i % 5}", "lncRNA", f"t{i}") for i in range(400)], "CHROM string, feature string, begin long, end long, strand string, gene_name string, gene_id string, gene_type string, transcript_id string")
    variants = spark.range(1500).selectExpr("id AS variant_id", "'1' AS CHROM", "id AS pos")
    out = annotation.classify(variants, annotation.best_features(variants, features)).groupBy("region_class").count()
    assert dict(map(tuple, out.collect())) == {"coding": 1399, "intergenic": 101}


def test_regulatory_hits_equal_a_scan_and_make_no_pairs(spark, monkeypatch):
    rng = random.Random(13)
    e = [(rng.choice(["1", "2"]), b, b + rng.choice([0, 5, 300]), rng.choice(["n", "m"]), "s", "promoter", rng.choice(["", f"R{i}", None]), rng.choice([None, 1, 2])) for i, b in enumerate(rng.randrange(9000) for _ in range(400))]
    elements = spark.createDataFrame(e, "chrom string, start long, end long, name string, source string, element_type string, element_id string, priority int")
    v = [(i, rng.choice(["1", "2", None]), rng.randrange(9000)) for i in range(80)]

    def plain(rows_):
        out = {}
        for i, c, p in rows_:
            for x in e:
                if x[0] == c and x[1] <= p < x[2]:
                    key = (x[7] is None, x[7] or 0, x[1], x[6] is not None, x[6] or "", x[3])
                    out[i] = min(out.get(i, (key, x[6] or x[3])), (key, x[6] or x[3]))
        return sorted((i, x[1]) for i, x in out.items())

    frame = lambda r: spark.createDataFrame(r, "variant_id long, CHROM string, pos long")
    again = [(i % 50, c, p) for i, c, p in v]
    assert rows(annotation.regulatory_hits(frame(again), elements).select("variant_id", "element_id")) == plain(again)
    monkeypatch.setattr(annotation, "range_join", lambda *_: 1 / 0)
    assert rows(annotation.regulatory_hits(frame(v), elements).select("variant_id", "element_id")) == plain(v)


def test_interpolation_frames_are_not_added_up_anew(spark):
    grid = spark.createDataFrame([("c", 10, 1.0), ("c", 30, 3.0)], "g string, x long, y double")
    points = spark.createDataFrame([(1, "c", 10), (2, "c", 20), (3, "c", 40), (4, "c", 0)], "point_id long, g string, pos long")
    out = ranges.interpolate(points, grid, ["g"])
    assert rows(out) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 1.0)]
    plan = out._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("columns_at_once,gathered", [(1 << 14, 1 << 18), (5, 8)])
def test_trait_links_equal_a_scan_and_make_no_pairs(spark, monkeypatch, columns_at_once, gathered):
    import datetime

    monkeypatch.setattr(linkage, "COLUMNS", columns_at_once)
    monkeypatch.setattr(linkage, "GATHERED", gathered)
    rng = random.Random(14)

    def some(n, first):
        pick = lambda *v: rng.choice([*v, None])
        return [(first + i, pick(*[datetime.date(2020, 1, 1) + datetime.timedelta(days=d) for d in (0, 3, 15, 16, 17, 21)]), pick(0, 1), pick(*range(170, 175)), pick(60, 61, 64), pick(*range(50, 56)), pick(1970, 1972)) for i in range(n)]

    cols = " long, day date, sex int, height int, weight int, age int, birth_year int"
    l, r = some(70, 0), some(90, 1000)
    tier = lambda d, tiers, beyond=None: 0 if d is None else next((p for m, p in tiers if d <= m), beyond[1] if beyond and d > beyond[0] else 0)
    diff = lambda a, b: None if a is None or b is None else abs(a - b)
    want = []
    for i, day, sex, *a in l:
        found = []
        for j, on, s, *b in r:
            if None in (day, on, sex, s) or sex != s or not 0 <= (on - day).days <= 5:
                continue
            dh, dw, da, db = map(diff, a, b)
            if da is None or da <= 3:
                found.append((-(10 + tier((on - day).days, linkage.TRAIT_DATE) + tier(da, linkage.TRAIT_AGE) + tier(dh, linkage.TRAIT_MEASURE, (3, -10)) + tier(dw, linkage.TRAIT_MEASURE, (3, -10)) + tier(db, linkage.TRAIT_BIRTH, (2, -15))), j))
        if found and min(found)[0] < 0:
            want.append((i, min(found)[1], -min(found)[0]))
    out = linkage.link_by_traits(spark.createDataFrame(l, "left_id" + cols), spark.createDataFrame(r, "right_id" + cols))
    assert rows(out.select("left_id", "right_id", "score")) == want and len(want) > 20
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_arbitration_joins_no_pairs_by_traits(spark):
    left = spark.sql("SELECT id AS left_id, CAST(NULL AS STRING) AS link_id, DATE'2020-01-01' AS day, 1 AS sex, 170 AS height, 70 AS weight, 50 AS age, 1970 AS birth_year FROM range(1500)")
    right = left.withColumnRenamed("left_id", "right_id")
    out = linkage.arbitrate(left, linkage.link_by_id(left, right), linkage.link_by_traits(left, right))
    assert "(sex" not in " ".join(l for l in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in l)
    assert rows(out.groupBy("right_id", "score", "method").count()) == [(0, 140, "TRAITS", 1500)]


def test_linkage_stats_join_no_pairs_by_traits(spark):
    from variantframe.plans import registry

    plan = registry.QUERIES["linkage_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("sex" in x or "try_day" in x for x in joins)


def test_ids_are_counted_as_bits(spark):
    ids = lambda x, t="long": spark.createDataFrame([(i,) for i in x], f"variant_id {t}")
    for t in ("long", "int"):
        assert annotation._distinct_ids(ids([0, 63, 64, -1, -64, -65, 127, None], t))
        assert not annotation._distinct_ids(ids([5, -1, 70, -1], t)) and not annotation._distinct_ids(ids([None, 1, None], t))
    assert annotation._distinct_ids(ids(["a", "b"], "string")) and not annotation._distinct_ids(ids(["a", "a"], "string"))
    assert not annotation._distinct_ids(ids([2**63 - 1, -(2**63), 2**63 - 1])) and annotation._distinct_ids(ids([2**63 - 1, -(2**63)]))


def test_classes_of_regions_join_nothing_by_id(spark):
    from variantframe.plans import registry

    plan = registry.QUERIES["classify_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 1 and "pos" in joins[0]


def test_every_variant_keeps_its_rows(spark):
    features = spark.createDataFrame([("1", "CDS", 0, 10, "+", "A", "g", "lncRNA", "t")], "CHROM string, feature string, begin long, end long, strand string, gene_name string, gene_id string, gene_type string, transcript_id string")
    v = spark.createDataFrame([(1, "1", 5), (2, "1", 50), (3, None, 5), (4, "1", None), (5, "1", 5), (5, "1", 60), (6, "1", 70), (6, "2", 5)], "variant_id long, CHROM string, pos long")
    got = annotation.best_features(v, features, every=True).select("variant_id", "feature").orderBy("variant_id", "feature").collect()
    assert [tuple(r) for r in got] == [(1, "CDS"), (2, None), (3, None), (4, None), (5, "CDS"), (5, "CDS"), (6, None), (6, None)]


def test_rows_to_link_are_packed_before_they_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(linkage, "PACKED", 7)
    left = spark.sql("SELECT id AS left_id, DATE'2020-01-01' + CAST(id % 40 AS INT) AS day, CAST(id % 2 AS INT) AS sex, 170 AS height, 70 AS weight, 50 AS age, 1970 AS birth_year FROM range(60)")
    right = left.withColumnRenamed("left_id", "right_id").orderBy(F.desc("right_id"))
    out = linkage.link_by_traits(left, right)
    assert [r[:3] for r in rows(out.select("left_id", "right_id", "score"))] == [(i, i % 40, 140) for i in range(60)]
    dealt = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(dealt) == 1 and plan.count("MapInArrow") == 2


def test_linkage_stats_deal_out_packed_rows(spark):
    from variantframe.plans import registry

    plan = registry.QUERIES["linkage_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "MapInArrow" in x and "body" in x]


@pytest.mark.parametrize("most_points, most_pairs", [(1 << 14, 1 << 17), (5, 7)])
def test_overlaps_equal_brute_force_and_compare_no_pairs(spark, monkeypatch, most_points, most_pairs):
    monkeypatch.setattr(ranges, "OVERLAP_POINTS", most_points)
    monkeypatch.setattr(ranges, "OVERLAP_PAIRS", most_pairs)
    rng = random.Random(21)
    p = [(i, rng.choice(["1", "2", None]), rng.choice([None, 7, rng.randrange(-300, 9000)])) for i in range(300)]
    iv = [(f"i{i % 60}", rng.choice(["1", "2", "3", None]), b, b + rng.choice([-1, 0, 1, 9, 5000])) for i, b in enumerate(rng.randrange(-300, 9000) for _ in range(90))]
    points = spark.createDataFrame(p, "point_id long, CHROM string, pos long")
    intervals = spark.createDataFrame(iv, "iv string, CHROM string, b long, e long")
    want = sorted((k, i) for k, c, x in p for i, d, b, e in iv if None not in (c, x) and c == d and b <= x < e)
    assert rows(ranges.overlaps(points, intervals, "point_id", "iv", begin="b", end="e")) == want and len(want) > 100


def test_range_overlap_joins_no_pairs(spark):
    from variantframe.plans import registry

    assert "Join" not in registry.QUERIES["range_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_regulatory_hits_need_no_join_and_no_pairs_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(annotation, "range_join", lambda *_: 1 / 0)
    elements = spark.createDataFrame([("1", 0, 50, "n", "s", "t", "b", 2), ("1", 20, 90, "n", "s", "t", "a", 1), ("2", 0, 9000, "n", "s", "t", None, None)], "chrom string, start long, end long, name string, source string, element_type string, element_id string, priority int")
    v = [(1, "1", 10), (2, "1", 30), (3, "1", 30), (4, "1", 90), (5, "2", 8999), (6, None, 5)]
    hits = annotation.regulatory_hits(spark.createDataFrame(v, "variant_id long, CHROM string, pos long"), elements)
    assert rows(hits.select("variant_id", "element_id")) == [(1, "b"), (2, "a"), (3, "a"), (5, "n")]
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    again = spark.createDataFrame([*v, (1, "1", 60), (5, "1", 49), (4, "2", 1)], "variant_id long, CHROM string, pos long")
    assert rows(annotation.regulatory_hits(again, elements).select("variant_id", "element_id")) == [(1, "a"), (2, "a"), (3, "a"), (4, "n"), (5, "a")]


def test_criteria_travel_as_bits(spark):
    left = spark.sql("SELECT 1 AS left_id, 'a' AS link_id, DATE'2020-01-01' AS day, 1 AS sex, 170 AS height, 70 AS weight, 50 AS age, 1970 AS birth_year")
    right = left.withColumnRenamed("left_id", "right_id").withColumn("weight", F.lit(80))
    for link, want in ((linkage.link_by_id, "ID,DATE,HEIGHT,AGE"), (linkage.link_by_traits, "SEX,DATE,AGE,HEIGHT,BIRTH_YEAR")):
        out = link(left, right)
        assert out.first()["criteria"] == want
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = [i for i, x in enumerate(plan) if "Window" in x][0]
        assert not any("array_join" in x for x in plan[below:])
