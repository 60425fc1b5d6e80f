"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bm25_pack, chat_trees, decontaminate, filter_audit, html_wrapper, jump_shards, language_id, license_scan, line_quality, line_runs, minhash_icws, source_divergence, suffix_family
from .common import sized


def _sized(query):
    def run(spark, sf_dir):
        return sized(query(spark, sf_dir))

    return run


_OWN = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_wrapper": html_wrapper.op2_html_wrapper,
    "op3_bm25_pack": bm25_pack.op3_bm25_pack,
    "op4_chat_reply_trees": chat_trees.op4_chat_reply_trees,
    "op5_line_runs": line_runs.op5_line_runs,
    "op6_line_frequency": line_quality.op6_line_frequency,
    "op7_suffix_family": suffix_family.op7_suffix_family,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_icws": minhash_icws.op9_icws,
    "op10_language_id": language_id.op10_language_id,
}
QUERIES = {name: _sized(query) for name, query in _OWN.items()} | {
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_jump_shards": jump_shards.op12_jump_shards,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {
    "op1_decontaminate": decontaminate.sql(),
    "op4_chat_reply_trees": chat_trees.OP4_SQL,
    "op5_line_runs": line_runs.OP5_SQL,
    "op6_line_frequency": line_quality.OP6_SQL,
    "op8_license_scan": license_scan.sql(),
    "op11_source_divergence": source_divergence.OP11_SQL,
    "op12_jump_shards": jump_shards.sql(),
    "op13_filter_audit": filter_audit.OP13_SQL,
}
