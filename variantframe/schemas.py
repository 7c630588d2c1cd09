"""Canonical table schemas as DDL strings."""

from __future__ import annotations

BETAMAP = "PRS_ID string, CHROM string, POS bigint, ID string, EFFECT_ALLELE string, OTHER_ALLELE string, BETA double, IS_FLIP tinyint"
CATALOG = "CHROM string, zarr_idx bigint, POS bigint, REF string, ALT string"
DOSAGE = "zarr_idx bigint, sample_id string, dosage double"
CADD = "CHR string, POS int, REF string, ALT string, PHRED float"
GNOMAD = "pos int, ref string, alt string, af_raw float, af_afr float, af_amr float, af_eas float, af_nfe float, af_sas float, af_mid float, an int, nhomalt int"
CLINVAR = "chrom string, pos bigint, ref string, alt string, clnsig string, clndn string, clnrevstat string, alleleid string, clnvc string, rsid string"
FEATURE = "chrom string, feature string, begin bigint, end bigint, strand string, gene_name string, gene_id string, gene_type string, transcript_id string, transcript_type string"
ELEMENT = "chrom string, start bigint, end bigint, name string, source string, element_type string, element_id string, priority int"
GWAS = "CHROM string, GENPOS bigint, ID string, ALLELE0 string, ALLELE1 string, A1FREQ double, INFO double, N double, BETA double, SE double, P double"
CATALOG_INDEX = "pgs_id string, name string, trait string, n_variants bigint, updated_at timestamp"
#: Fixed value: column order of the cohort export.
COHORT = [
    "PATID",
    "IID_EXOME",
    "IID_WGS",
    "HAS_EXOME",
    "HAS_WGS",
    "GENOMIC_QC_FLAG",
    "AGE",
    "MALE",
    "EVIDENCE_BASELINE",
    "EVIDENCE_MORTALITY",
    "CANCER_SOURCE",
    "CANCER_SITE",
    "PHENOTYPE_CANCER_STATUS",
]
