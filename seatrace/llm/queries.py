"""Queries of this subpackage and their SQL."""

from . import decontamination, divergence, fingerprints, jaccard, language, lm, manifest, packing, quality, repeats, token_files, toxicity, urls


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_lm_scoring": lm.op2,
        "op3_suffix_dedup": repeats.op3,
        "op4_url_filters": urls.op4,
        "op5_quality": quality.op5,
        "op6_jaccard_join": jaccard.op6,
        "op7_language": language.op7,
        "op8_decontamination": decontamination.op8,
        "op9_packing": packing.op9,
        "op10_fingerprints": fingerprints.op10,
        "op11_merkle_manifest": manifest.op11,
        "op12_token_files": token_files.op12,
        "op13_source_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": repeats.ORACLE, "op4_url_filters": urls.ORACLE, "op6_jaccard_join": jaccard.ORACLE, "op8_decontamination": decontamination.ORACLE, "op10_fingerprints": fingerprints.ORACLE, "op11_merkle_manifest": manifest.ORACLE, "op13_source_divergence": divergence.ORACLE}
