"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import exact_dedup, html_text, language, licenses, media, mixing, negatives, packing, periodic, pieces, simhash, suffixes, warc

QUERIES = {
    "op1_media_fingerprints": media.op1_media_fingerprints,
    "op2_main_text": html_text.op2_main_text,
    "op3_language_id": language.op3_language_id,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_remove_repeats": suffixes.op5_remove_repeats,
    "op6_pack": packing.op6_pack,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_simhash": simhash.op8_simhash,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {**exact_dedup.SQL, **licenses.SQL, **mixing.SQL, **negatives.SQL, **warc.SQL}
