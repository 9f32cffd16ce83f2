"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lumidex.llm import blocks, chat_collapse, decontamination, drake, hilbert, longdup, minhash, packing, qda, repetition, secrets, turn_repair, warc

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secrets,
        warc.op2_warc,
        decontamination.op3_decontamination,
        minhash.op4_minhash,
        repetition.op5_quality_rules,
        blocks.op6_html_extraction,
        qda.op7_quality_qda,
        longdup.op8_suffix_dedup,
        chat_collapse.op9_chat_collapse,
        packing.op10_packing,
        drake.op11_centroids,
        hilbert.op12_neighbours,
        turn_repair.op13_turn_repair,
    )
}

SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_minhash": minhash.OP4_SQL,
    "op9_chat_collapse": chat_collapse.OP9_SQL,
    "op11_centroids": drake.OP11_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
