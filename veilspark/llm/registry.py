"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, exact_topk, huffman, lines, mixing, packing, postings, quality, secrets, simhash, trie, urlfilter, whitening


def op4(spark, sf_dir):
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries():
    return {
        "op1_quality_cotraining": quality.op1,
        "op2_exact_topk_kdtree": exact_topk.op2,
        "op3_ann_anisotropic": ann.op3,
        "op4_simhash_popcount": op4,
        "op5_line_chunk_dedup": lines.op5,
        "op6_mixing_histograms": mixing.op6,
        "op7_secret_entropy": secrets.op7,
        "op8_packing_mixture": packing.op8,
        "op9_huffman_ids": huffman.op9,
        "op10_url_filter": urlfilter.op10,
        "op11_prefix_trie": trie.op11,
        "op12_whitening_jacobi": whitening.op12,
        "op13_decontamination_index": postings.op13,
    }


def oracle_sql():
    return {"op2_exact_topk_kdtree": exact_topk.OP2_SQL, "op6_mixing_histograms": mixing.OP6_SQL, "op11_prefix_trie": trie.OP11_SQL, "op13_decontamination_index": postings.OP13_SQL}
