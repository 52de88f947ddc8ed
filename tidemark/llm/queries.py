"""The registered queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, licenses, mixing, neardup, pii, secrets, sharding, toxicity, urls, vectors

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_licenses": licenses.op3_licenses,
    "op4_url_filter": urls.op4_url_filter,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_nearest": vectors.op6_nearest,
    "op7_secrets": secrets.op7_secrets,
    "op8_neardup": neardup.op8_neardup,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
}

#: Without an entry, SQL can't express the result (CRC-32, fitted models, hashed surrogates): tests hold it against brute force.
ORACLES = {
    "op4_url_filter": urls.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op6_nearest": vectors.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op8_neardup": neardup.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
