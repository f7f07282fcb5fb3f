"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from . import bpe, linededup, media, mixing, multiindex, packing, simhash, suffix, tokenfile, toxicity


def queries() -> dict:
    return {
        "op1_media_columns": media.op1,
        "op2_embedding_near_dedup": multiindex.op2,
        "op3_line_dedup": linededup.op3,
        "op4_token_id_output": tokenfile.op4,
        "op5_lm_scoring": mixing.op5,
        "op6_toxicity": toxicity.op6,
        "op7_suffix_array_dedup": suffix.op7,
        "op8_bpe_encoding": bpe.op8,
        "op9_best_fit_packing": packing.op9,
        "op10_simhash_near_dedup": simhash.op10,
    }


def oracle_sql() -> dict:
    return {"op3_line_dedup": linededup.ORACLE_SQL}
