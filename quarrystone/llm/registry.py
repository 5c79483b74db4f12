"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quarrystone.llm import (
    ann, archives, clustering, exact_dedup, html_text, langid, mixing, ngram_join, packing, substring_dedup, token_files, toxicity, whitening,
)

QUERIES = {
    f.__name__: f
    for f in (
        html_text.op1_html_text,
        exact_dedup.op2_exact_dedup,
        archives.op3_warc_archives,
        packing.op4_pack_sequences,
        mixing.op5_source_mixing,
        ann.op6_nearest_neighbours,
        token_files.op7_token_files,
        substring_dedup.op8_substring_dedup,
        ngram_join.op9_ngram_jaccard_join,
        langid.op10_language_id,
        whitening.op11_embedding_whitening,
        clustering.op12_centroid_clustering,
        toxicity.op13_toxicity,
    )
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_warc_archives": archives.OP3_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_ngram_jaccard_join": ngram_join.OP9_SQL,
    "op12_centroid_clustering": clustering.OP12_SQL,
}
