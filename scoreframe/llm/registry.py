"""Queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from scoreframe.llm.byte_bpe import op10_byte_bpe
from scoreframe.llm.containment import OP7_SQL, op7_decontaminate
from scoreframe.llm.filter_audit import OP12_SQL, op12_filter_audit
from scoreframe.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from scoreframe.llm.license_scan import OP2_SQL, op2_license_scan
from scoreframe.llm.near_duplicates import OP6_SQL, op6_near_duplicates
from scoreframe.llm.personal_data import op5_personal_data
from scoreframe.llm.prefix_counts import op9_token_counts
from scoreframe.llm.quality_rules import op1_quality_rules
from scoreframe.llm.shard_ring import OP13_SQL, op13_ring_shards
from scoreframe.llm.toxicity import op8_toxicity
from scoreframe.llm.url_filter import OP4_SQL, op4_url_filter
from scoreframe.llm.warc_zip import OP3_SQL, op3_warc


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_warc": op3_warc,
        "op4_url_filter": op4_url_filter,
        "op5_personal_data": op5_personal_data,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_decontaminate": op7_decontaminate,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_filter_audit": op12_filter_audit,
        "op13_ring_shards": op13_ring_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": OP2_SQL, "op3_warc": OP3_SQL, "op4_url_filter": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op7_decontaminate": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_ring_shards": OP13_SQL}
