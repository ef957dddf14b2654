"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, exact, langid, licenses, manifest, minhash, mixing, quality_model, repeats, rules, tokenfile, trie


def queries() -> dict:
    return {
        "op1_repeated_strings": repeats.op1_repeated_strings,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_token_files": tokenfile.op3_token_files,
        "op4_quality_model": quality_model.op4_quality_model,
        "op5_near_duplicates": minhash.op5_near_duplicates,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_source_mix": mixing.op7_source_mix,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_language_id": langid.op9_language_id,
        "op10_license_digests": licenses.op10_license_digests,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_rotated_bits": ann.op12_rotated_bits,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact.ORACLE,
        "op7_source_mix": mixing.ORACLE,
        "op10_license_digests": licenses.oracle(),
        "op11_prefix_trie": trie.ORACLE,
        "op12_rotated_bits": ann.ORACLE,
        "op13_merkle_manifest": manifest.oracle(),
    }
