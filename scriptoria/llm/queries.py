"""Registry of the training-data operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from scriptoria.llm import bin_slack, decontaminate, id_matrix, language, licenses, line_chunks, mjpeg, near_dup, pseudonyms, url_rules

QUERIES = {
    "op1_feistel_pseudonyms": pseudonyms.query,
    "op2_avi_mjpeg": mjpeg.query,
    "op3_order_minhash": near_dup.query,
    "op4_winnowing": decontaminate.query,
    "op5_license_bands": licenses.query,
    "op6_bin_slack": bin_slack.query,
    "op7_byte_cnn": language.query,
    "op8_id_matrix": id_matrix.query,
    "op9_url_rules": url_rules.query,
    "op10_line_chunks": line_chunks.query,
}


def oracles() -> dict[str, str]:
    return {"op4_winnowing": decontaminate.ORACLE, "op5_license_bands": licenses.oracle(), "op9_url_rules": url_rules.ORACLE}
