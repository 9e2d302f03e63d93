"""Registered queries of the subpackage."""

from __future__ import annotations

from strandline.llm import decontaminate, exact_topk, filter_audit, html_extract, line_dedup, mixing, near_dedup, periodic_runs, pipeline, quality, suffix_dedup, token_count, toxicity, warc
from strandline.llm.common import documents

QUERIES = {
    "op1_line_dedup": lambda spark, d: line_dedup.op1(documents(spark, d)),
    "op2_quality_rules": lambda spark, d: quality.op2(documents(spark, d)),
    "op3_near_dedup": lambda spark, d: near_dedup.op3(documents(spark, d)),
    "op4_toxicity": lambda spark, d: toxicity.op4(documents(spark, d), documents(spark, d, "labels")),
    "op5_token_counts": lambda spark, d: token_count.op5(documents(spark, d)),
    "op6_source_mixing": lambda spark, d: mixing.op6(documents(spark, d), documents(spark, d, "labels")),
    "op7_decontamination": lambda spark, d: decontaminate.op7(documents(spark, d), documents(spark, d, "benchmark")),
    "op8_html_extraction": lambda spark, d: html_extract.op8(documents(spark, d, "pages")),
    "op9_warc_revisits": lambda spark, d: warc.op9(documents(spark, d, "pages")),
    "warc_revisits_all_pages": lambda spark, d: warc.op9(documents(spark, d, "pages"), every=1),
    "op10_suffix_dedup": lambda spark, d: suffix_dedup.op10(documents(spark, d)),
    "op11_periodic_runs": lambda spark, d: periodic_runs.op11(documents(spark, d)),
    "op12_exact_topk": lambda spark, d: exact_topk.op12(documents(spark, d, "embeddings")),
    "op13_filter_audit": lambda spark, d: filter_audit.op13(documents(spark, d), documents(spark, d, "labels")),
    "pipeline": pipeline.run,
}
ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE_OP1,
    "op2_quality_rules": quality.ORACLE_OP2,
    "op9_warc_revisits": warc.ORACLE_OP9,
    "warc_revisits_all_pages": warc.ORACLE_OP9_ALL,
    "op12_exact_topk": exact_topk.ORACLE_OP12,
    "op13_filter_audit": filter_audit.ORACLE_OP13,
}
