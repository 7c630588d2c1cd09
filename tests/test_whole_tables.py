"""Queries take whole tables: no row is left out of what they work on."""

from test_oracles import SF, duck, norm  # noqa: F401

from variantframe.operators import scoring
from variantframe.plans import registry, scores
from variantframe.plans.roles import role
from variantframe.sources import genomics


def both(spark, duck, name):  # noqa: F811
    """Rows of a query, after they are found equal to its SQL's."""
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())
    assert got == sorted(repr(tuple(map(norm, r))) for r in duck.sql(registry.ORACLES[name]).select(", ".join(f'"{c}"' for c in cols)).fetchall())
    return got


def test_array_scores_hold_all_samples(spark, duck):  # noqa: F811
    want = scoring.score_samples(scores.best(lambda n: role(spark, SF, n)), role(spark, SF, "dosage"), "skip").count()
    assert len(both(spark, duck, "prs_array_layout")) == want > 40


def test_long_to_arrays_fills_gaps(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "e", 1.0), (2, "a", 0.0), (2, "c", None), (3, "x", 1.0)], "zarr_idx long, sample_id string, dosage double")
    got = {r[0]: r[1] for r in genomics.long_to_arrays(df, list("abcde")).collect()}
    assert got == {1: [None, 2.0, None, None, 1.0], 2: [0.0, None, None, None, None], 3: [None] * 5}


def test_offsets_hold_all_intervals(spark, duck):  # noqa: F811
    assert len(both(spark, duck, "cds_offsets")) == role(spark, SF, "intervals").count()


def test_offsets_of_equal_begins_and_high_ids(spark, monkeypatch):
    rows = [(iv, 10, 10 + iv) for iv in (301, 351)] + [(401, 5, 8)]
    cut = spark.createDataFrame([(302, 7, 9), *rows], "iv long, b long, e long")
    monkeypatch.setattr("variantframe.plans.common.role", lambda *a: cut)
    got = {r["iv"]: r["cds_offset"] for r in registry.QUERIES["cds_offsets"](spark, SF).collect()}
    assert got == {302: 0, 401: 0, 301: 3, 351: 304}


def test_mapping_holds_all_orders(spark, duck):  # noqa: F811
    assert len(both(spark, duck, "chained_mapping")) == role(spark, SF, "orders").count()


def test_sessions_hold_all_trials(spark, duck):  # noqa: F811
    assert len(both(spark, duck, "attach_session")) == role(spark, SF, "lineitem").count()


def test_array_layout_grows_with_known_dosages_and_makes_no_header(spark, monkeypatch):
    used = spark.createDataFrame([(1, 10**12, 1.0), (1, 5, 2.0), (1, 5, 0.0), (2, 10**12, None), (2, -7, 1.0), (3, 5, 1.0)], "zarr_idx long, sample_id long, dosage double")
    arrays = genomics.long_to_cells(used)
    assert sorted((z, s, d) for z, some, more in arrays.collect() for s, d in zip(some, more, strict=True)) == [(1, 5, 0.0), (1, 5, 2.0), (1, 10**12, 1.0), (2, -7, 1.0), (3, 5, 1.0)]
    matched = spark.createDataFrame([(1, False, 0.5), (1, False, 0.5), (2, True, 3.0)], "zarr_idx long, flip boolean, BETA double")
    want = sorted(map(tuple, scoring.score_samples(matched, used, "skip").collect()))
    assert sorted(map(tuple, scoring.score_cells(matched, arrays).collect())) == want == [(-7, 3.0, 1), (5, 2.0, 2), (10**12, 1.0, 1)]
    monkeypatch.setattr(type(used), "collect", lambda _: 1 / 0)
    scores.array_scores(lambda name: role(spark, "/root/testdata/sf0.001", name))
