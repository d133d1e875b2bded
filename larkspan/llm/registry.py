"""The queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from larkspan.llm import decontaminate, lattice, licenses, mixing, pii, quality, secrets, sharding, simhash, substrings

QUERIES = {
    "op1_raked_mix": mixing.op1_raked_mix,
    "op2_license_diagonals": licenses.op2_license_diagonals,
    "op3_simhash_ball": simhash.op3_simhash_ball,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_markov_secrets": secrets.op5_markov_secrets,
    "op6_winnow_decontaminate": decontaminate.op6_winnow_decontaminate,
    "op7_crf_personal": pii.op7_crf_personal,
    "op8_lattice_score": lattice.op8_lattice_score,
    "op9_virtual_slots": sharding.op9_virtual_slots,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}
#: The others' methods have no SQL form; tests hold them against brute force.
SQL = {
    "op2_license_diagonals": licenses.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op6_winnow_decontaminate": decontaminate.OP6_SQL,
    "op9_virtual_slots": sharding.OP9_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
}
