"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .code_compression import OP11_SQL, op11_code_compression
from .decontaminate import op8_decontamination
from .fill_middle import OP13_SQL, op13_fill_in_middle
from .impact_index import OP12_SQL, op12_exact_top_k
from .line_dedup import op5_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .paragraph_dedup import op9_paragraph_dedup
from .pii import OP10_SQL, op10_personal_data
from .quality import OP3_SQL, op3_quality_rules
from .secrets import OP4_SQL, op4_secret_scan
from .token_counts import op6_token_counts
from .warc import OP7_SQL, op7_warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_code_compression": op11_code_compression,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

SQL = {"op1_ngram_join": OP1_SQL, "op2_mixing": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_secret_scan": OP4_SQL, "op7_warc": OP7_SQL, "op10_personal_data": OP10_SQL, "op11_code_compression": OP11_SQL, "op12_exact_top_k": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
