"""The queries of this subpackage, and SQL for those that it can express."""

from . import html, langid, mixing, phrases, pieces, quality, runs, sharding, simhash, substrings, topk, toxicity, transport

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_reshard_flow,
        html.op2_html_tree_model,
        langid.op3_naive_bayes_langid,
        simhash.op4_simhash_bktree,
        mixing.op5_mix_sources,
        pieces.op6_sentencepiece,
        transport.op7_transport_streams,
        topk.op8_impact_topk,
        toxicity.op9_gru_toxicity,
        quality.op10_pu_quality,
        substrings.op11_substrings,
        phrases.op12_phrases,
        runs.op13_runs,
    )
}
ORACLE_SQL = {"op5_mix_sources": mixing.SQL, "op8_impact_topk": topk.SQL, "op12_phrases": phrases.SQL}
