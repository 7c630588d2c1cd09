"""Registered queries and their SQL, by operator."""

from __future__ import annotations

from variantframe.plans import annotation, cohort, files, gwas, linkage, ranges, records, scores, statistics

MODULES = (scores, statistics, ranges, annotation, cohort, linkage, gwas, records, files)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

FLAGSHIP = "prs_percentile_by_sex"
