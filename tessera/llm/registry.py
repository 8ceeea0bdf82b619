"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import chat_format, chat_repair, katz, language_id, line_dedup, minhash, mixing, mtree, nn_descent, pieces, resampling, secret_scan, sharding

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_katz": katz.op2_katz,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_formatting": chat_format.op4_chat_formatting,
    "op5_mixing": mixing.op5_mixing,
    "op6_nn_descent": nn_descent.op6_nn_descent,
    "op7_mtree": mtree.op7_mtree,
    "op8_minhash": minhash.op8_minhash,
    "op9_language_id": language_id.op9_language_id,
    "op10_pieces": pieces.op10_pieces,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_resampling": resampling.op12_resampling,
    "op13_chat_repair": chat_repair.op13_chat_repair,
}

SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_chat_formatting": chat_format.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_nn_descent": nn_descent.OP6_SQL,
    "op7_mtree": mtree.OP7_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_chat_repair": chat_repair.OP13_SQL,
}
