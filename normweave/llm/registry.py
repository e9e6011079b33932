"""Queries opN_<name> and their SQL."""

from __future__ import annotations

from . import ans_store, bpe_lexicon, chat_events, collocations, jaccard_join, language_id, quality_ranking, quality_rules, repeat_index, shard_balance, source_mixing, telephony_audio, whitening


def queries() -> dict:
    return {
        "op1_lexicon_bpe": bpe_lexicon.op1_lexicon_bpe,
        "op2_lsh_forest_join": jaccard_join.op2_lsh_forest_join,
        "op3_ans_token_files": ans_store.op3_ans_token_files,
        "op4_chat_events": chat_events.op4_chat_events,
        "op5_label_shards": shard_balance.op5_label_shards,
        "op6_pairwise_quality": quality_ranking.op6_pairwise_quality,
        "op7_line_quality": quality_rules.op7_line_quality,
        "op8_golden_mix": source_mixing.op8_golden_mix,
        "op9_telephony_audio": telephony_audio.op9_telephony_audio,
        "op10_ecoc_language": language_id.op10_ecoc_language,
        "op11_run_length_repeats": repeat_index.op11_run_length_repeats,
        "op12_collocations": collocations.op12_collocations,
        "op13_tiled_whitening": whitening.op13_tiled_whitening,
    }


def oracle_sql() -> dict:
    return {
        "op4_chat_events": chat_events.OP4_SQL,
        "op7_line_quality": quality_rules.OP7_SQL,
        "op12_collocations": collocations.OP12_SQL,
    }
