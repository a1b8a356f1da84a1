"""The operators of this subpackage as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from probatum.llm import align, bpe, common, epsjoin, licenses, lines, mixing, negatives, secrets, simhash, suffix, tokenfile, topk, toxicity


def _over(*names):
    """A query that applies an operator to whole tables."""

    def with_(operator):
        return lambda spark, sf_dir: operator(*[common.table(spark, sf_dir, n) for n in names])

    return with_


def queries() -> dict:
    return {
        "op1_secret_scan": _over("documents")(secrets.op1_secrets),
        "op2_source_mixing": _over("documents")(mixing.op2_mixing),
        "op3_toxicity": _over("documents", "labels")(toxicity.op3_toxicity),
        "op4_suffix_dedup": _over("documents")(suffix.op4_suffix_dedup),
        "op5_embedding_dedup": _over("embeddings")(epsjoin.op5_near_embeddings),
        "op6_byte_bpe": _over("documents")(bpe.op6_byte_bpe),
        "op7_token_file": _over("documents")(tokenfile.op7_token_file),
        "op8_license_scan": _over("documents")(licenses.op8_licenses),
        "op9_topk": _over("embeddings")(topk.op9_top_products),
        "op10_simhash": _over("documents")(simhash.op10_simhash),
        "op11_line_dedup": _over("documents")(lines.op11_line_dedup),
        "op12_hard_negatives": _over("embeddings")(negatives.op12_hard_negatives),
        "op13_alignment": _over("documents")(align.op13_alignment),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.OP1_SQL, "op2_source_mixing": mixing.OP2_SQL, "op9_topk": topk.OP9_SQL, "op5_embedding_dedup": epsjoin.OP5_SQL, "op11_line_dedup": lines.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
