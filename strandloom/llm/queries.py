"""Queries of this subpackage and their SQL; __spark_entry__.py adds them."""

from __future__ import annotations

from strandloom.llm.chat_format import OP5_SQL, op5_perspective_rotation
from strandloom.llm.decontaminate import op10_fm_index
from strandloom.llm.jaccard_join import op1_chosen_path
from strandloom.llm.license_scan import OP7_SQL, op7_license_dice
from strandloom.llm.line_dedup import op2_fuzzy_lines
from strandloom.llm.packing import op4_best_fit_packing
from strandloom.llm.secret_scan import OP8_SQL, op8_entropy_secrets
from strandloom.llm.spelling import OP12_SQL, op12_pivotal_grams
from strandloom.llm.substring_dedup import op9_aho_corasick
from strandloom.llm.token_files import op13_token_files
from strandloom.llm.topk import OP6_SQL, op6_maxscore
from strandloom.llm.toxicity import op3_noisy_channel
from strandloom.llm.vector_codes import OP11_SQL, op11_resident_lloyd


def queries() -> dict:
    return {
        "op1_chosen_path": op1_chosen_path,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_noisy_channel": op3_noisy_channel,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_perspective_rotation": op5_perspective_rotation,
        "op6_maxscore": op6_maxscore,
        "op7_license_dice": op7_license_dice,
        "op8_entropy_secrets": op8_entropy_secrets,
        "op9_aho_corasick": op9_aho_corasick,
        "op10_fm_index": op10_fm_index,
        "op11_resident_lloyd": op11_resident_lloyd,
        "op12_pivotal_grams": op12_pivotal_grams,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_perspective_rotation": OP5_SQL,
        "op6_maxscore": OP6_SQL,
        "op7_license_dice": OP7_SQL,
        "op8_entropy_secrets": OP8_SQL,
        "op11_resident_lloyd": OP11_SQL,
        "op12_pivotal_grams": OP12_SQL,
    }
