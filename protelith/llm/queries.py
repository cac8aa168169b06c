"""The corpus operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, divergence, licenses, packing, passages, quality, repair, rules, sharding, simhash, suffixes, toxicity, urlfilter

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_rules": rules.query,
    "op3_sharding": sharding.query,
    "op4_decontaminate": decontaminate.query,
    "op5_licenses": licenses.query,
    "op6_toxicity": toxicity.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_urlfilter": urlfilter.query,
    "op10_suffixes": suffixes.query,
    "op11_divergence": divergence.query,
    "op12_repair": repair.query,
    "op13_passages": passages.query,
}

SQL: dict[str, str] = {
    "op2_rules": rules.SQL,
    "op5_licenses": licenses.SQL,
    "op9_urlfilter": urlfilter.SQL,
    "op11_divergence": divergence.SQL,
    "op12_repair": repair.SQL,
}
