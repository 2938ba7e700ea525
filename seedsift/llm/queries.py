"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from seedsift.llm import alignment, bpe, chat, conversations, decontaminate, html_text, licenses, line_templates, minhash, quality_knn, quality_rules, token_counts, url_filter


def queries():
    return {
        "op1_near_duplicates": minhash.op1_near_duplicates,
        "op2_line_templates": line_templates.op2_line_templates,
        "op3_chat_format": chat.op3_chat_format,
        "op4_quality_knn": quality_knn.op4_quality_knn,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_bpe_codec": bpe.op6_bpe_codec,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_html_text": html_text.op12_html_text,
        "op13_token_alignment": alignment.op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_near_duplicates": minhash.OP1_SQL,
        "op3_chat_format": chat.OP3_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_conversation_repair": conversations.OP11_SQL,
    }
