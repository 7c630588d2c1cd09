"""Scalar helpers: tolerant parsing, classification by thresholds, list text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders in which sources are asked for an allele frequency.
ANNOTATOR_PRIORITY = ("mcps_mex", "mcps_raw", "gnomad", "dbsnp")
SERVICE_PRIORITY = ("mcps_raw", "gnomad", "dbsnp")


def digits(c: Column) -> Column:
    """Only the digits of a text; null if there are none."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(d != "", d)


def parse_date(c: Column, formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")) -> Column:
    """First format that fits; null if none does."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats])


def sex_code(c: Column) -> Column:
    """1 for men, 0 for women: from 1/2, M/F and H/M words; null otherwise."""
    t = F.upper(F.trim(c))
    return F.when(t.isin("1", "M", "MALE", "H", "HOMBRE", "MASCULINO"), 1).when(t.isin("2", "0", "F", "FEMALE", "MUJER", "FEMENINO"), 0)


def clean_number(c: Column) -> Column:
    """Number in a free text with units or decimal commas; null if there is none."""
    return F.regexp_extract(F.regexp_replace(c, ",", "."), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def whole(c: Column) -> Column:
    """Integer part of a numeric text, rounded down."""
    return F.floor(c.try_cast("double")).cast("int")


def not_nan(c: Column) -> Column:
    """NaN and infinities as null, as JSON has no such values."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def any_flag(flags: Sequence[Column]) -> Column:
    """1 if any flag is positive, 0 else; nulls count as 0."""
    top = F.greatest(*flags) if len(flags) > 1 else flags[0]
    return F.least(F.coalesce(top, F.lit(0)), F.lit(1)).cast("int")


def cascade(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the last rule that holds: later rules override earlier ones."""
    out = None
    for condition, label in reversed(list(rules)):
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def icd10_site(code: Column) -> Column:
    """Cancer site of an ICD-10 code by its letter and number."""
    t = F.upper(F.trim(code))
    num = F.substring(t, 2, 2).try_cast("int")
    c = F.when(t.isNull() | (t == ""), "UNKNOWN").when((F.length(t) < 3) | (F.substring(t, 1, 1) != "C") | num.isNull(), "OTHER")
    c = c.when(num.isin(33, 34), "LUNG").when(num == 50, "BREAST").when(num == 61, "PROSTATE").when(num == 53, "CERVICAL")
    return c.when(num.between(15, 26), "GI").when(num.between(81, 96), "HEMATOLOGIC").when(num.isin(76, 80, 97), "UNKNOWN").otherwise("OTHER")


def rarity(af: Column, missing: str = "novel") -> Column:
    """Rarity class by allele frequency thresholds; absent or zero is ``missing``."""
    return F.when(af.isNull() | (af == 0), missing).when(af < 0.0001, "ultra_rare").when(af < 0.001, "rare").when(af < 0.01, "low_frequency").otherwise("common")


def effective_frequency(sources: dict[str, Column], priority: Sequence[str] = ANNOTATOR_PRIORITY) -> tuple[Column, Column]:
    """First frequency that is present by priority (zero counts as present), and its source's name."""
    names = [n for n in priority if n in sources]
    value = F.coalesce(*[sources[n] for n in names])
    source = F.coalesce(*[F.when(sources[n].isNotNull(), n) for n in names])
    return value, source


def first_listed(c: Column, separator: str = ";") -> Column:
    """First entry of a list text that is neither empty nor a dot."""
    return F.get(F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda v: ~v.isin("", ".")), 0)


def info_map(c: Column, pair: str = ";", equals: str = "=") -> Column:
    """Map of a `k=v;k=v` text; a key without value maps to null, later repeats are dropped."""
    parts = F.filter(F.split(c, pair), lambda x: F.trim(x) != "")
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, equals, 1)).alias("k"), F.when(F.instr(x, equals) > 0, F.substring(x, F.instr(x, equals) + 1, F.length(x))).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), F.greatest(i, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def population_frequencies(ac: Column, an: Column, names: Column) -> Column:
    """Struct of overall frequency, greatest population frequency and summary text from arrays of counts."""
    pairs = F.arrays_zip(names.alias("n"), ac.alias("ac"), an.alias("an"))
    used = F.filter(pairs, lambda p: (p["an"] > 0) & p["ac"].isNotNull())
    total = lambda f: F.aggregate(used, F.lit(0.0), lambda a, p: a + p[f])
    text = F.array_join(F.transform(used, lambda p: F.concat(p["n"], F.lit("="), F.format_string("%.6f", p["ac"] / p["an"]))), ";")
    return F.struct((total("ac") / F.nullif(total("an"), F.lit(0.0))).alias("af"), F.array_max(F.transform(used, lambda p: p["ac"] / p["an"])).alias("max_af"), text.alias("summary"))


def body_mass_index(weight: Column, height_cm: Column) -> Column:
    return F.try_divide(weight, F.pow(height_cm / 100, 2))


def effective_n(cases: Column, controls: Column) -> Column:
    return F.try_divide(4.0 * cases * controls, cases + controls)


def t2d_status(baseline: Column, hba1c: Column, drugs: Sequence[Column], cut: float = 6.5) -> Column:
    """Three-valued status: true by diagnosis, HbA1c or a drug; false if all known say no; null if undecided."""
    any_drug = drugs[0] == 1
    for d in drugs[1:]:
        any_drug = any_drug | (d == 1)
    case = (baseline == 1) | (hba1c >= cut) | any_drug
    return F.when(case, F.lit(1)).when(~case, F.lit(0))


def pgs_id_valid(c: Column) -> Column:
    return c.rlike(r"^PGS\d{6}$")


def gene_symbol_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,29}$"), F.lit(False))


def trait_names(c: Column) -> Column:
    """Names of a trait field in any shape: null, text, list of texts or list of objects with a label."""
    t = F.trim(c)
    objects = F.from_json(t, "array<struct<label: string, name: string>>")
    texts = F.from_json(t, "array<string>")
    named = F.filter(F.transform(objects, lambda o: F.coalesce(o["label"], o["name"])), lambda x: x.isNotNull())
    return (
        F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
        .when(t.startswith("[{"), named)
        .when(t.startswith("["), F.filter(texts, lambda x: x.isNotNull()))
        .otherwise(F.array(t))
    )
