"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, language_id, licenses, mixing, near_dedup, quality_rules, rule_ensemble, secrets, sharding, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": rule_ensemble.op3_quality_classifier,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_secrets": secrets.op5_secrets,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": language_id.op9_language_id,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    # the parts that SQL can say of operators that it cannot say whole
    "mix_targets": mixing.mix_targets,
    "license_places": licenses.license_places,
    "shard_law": sharding.shard_law,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op5_secrets": secrets.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "mix_targets": mixing.MIX_TARGETS_SQL,
    "license_places": licenses.LICENSE_PLACES_SQL,
    "shard_law": sharding.SHARD_LAW_SQL,
}
