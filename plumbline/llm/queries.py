"""The queries of this package, and SQL for the ones that SQL can express."""

from . import byte_cnn, chat, codes, lexical, media, mixing, near_dedup, neighbours, packing, pii, quality_rules, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_pii": pii.op2_pii,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality_classifier": byte_cnn.op4_quality_classifier,
    "op5_packing": packing.op5_packing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_media_columns": media.op9_media_columns,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_nearest": neighbours.op12_nearest,
    "op13_vector_codes": codes.op13_vector_codes,
}
SQL = {
    "op3_chat_format": chat.SQL, "op7_url_filter": url_filter.SQL, "op10_mixing": mixing.SQL,
    "op11_lexical_search": lexical.SQL, "op12_nearest": neighbours.SQL, "op13_vector_codes": codes.SQL,
}
