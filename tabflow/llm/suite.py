"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tabflow.llm.archives import OP7_SQL, op7_arc_to_warc
from tabflow.llm.chunk_codec import op5_chunk_codec
from tabflow.llm.conversation_repair import OP13_SQL, op13_repair
from tabflow.llm.mixing import OP12_SQL, op12_source_mix
from tabflow.llm.near_dedup import OP1_SQL, op1_minhash_forest
from tabflow.llm.ngram_model import op6_kneser_ney
from tabflow.llm.packing import op2_retrieval_packing
from tabflow.llm.sharding import op4_minimax_shards
from tabflow.llm.spelling import OP11_SQL, op11_spelling
from tabflow.llm.stream_dedup import OP9_SQL, op9_stream_dedup
from tabflow.llm.token_counts import op3_token_counts
from tabflow.llm.topk_search import OP8_SQL, op8_topk_search
from tabflow.llm.toxicity import op10_toxic_spans

QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_token_counts": op3_token_counts,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_chunk_codec": op5_chunk_codec,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_topk_search": op8_topk_search,
    "op9_stream_dedup": op9_stream_dedup,
    "op10_toxic_spans": op10_toxic_spans,
    "op11_spelling": op11_spelling,
    "op12_source_mix": op12_source_mix,
    "op13_repair": op13_repair,
}

ORACLE_SQL = {
    "op1_minhash_forest": OP1_SQL,
    "op7_arc_to_warc": OP7_SQL,
    "op8_topk_search": OP8_SQL,
    "op9_stream_dedup": OP9_SQL,
    "op11_spelling": OP11_SQL,
    "op12_source_mix": OP12_SQL,
    "op13_repair": OP13_SQL,
}
