"""The queries of the training-data operators, by name, and their SQL where there is one."""

from __future__ import annotations

from tessera.llm.chat import OP4_SQL, op4_chat_format
from tessera.llm.extraction import op2_main_text
from tessera.llm.hnsw import op9_nearest
from tessera.llm.mixing import OP7_SQL, op7_mixing
from tessera.llm.neardup import op10_near_duplicates
from tessera.llm.quality import OP6_SQL, op6_quality
from tessera.llm.streaming_viterbi import op8_sentencepiece
from tessera.llm.token_files import op3_token_ids
from tessera.llm.trie_counts import op5_token_counts
from tessera.llm.warc import OP1_SQL, op1_warc_index


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_main_text": op2_main_text,
    "op3_token_ids": op3_token_ids,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest": op9_nearest,
    "op10_near_duplicates": op10_near_duplicates,
    "pipeline": _pipeline,
}
ORACLES = {
    "op1_warc_index": OP1_SQL,
    "op4_chat_format": OP4_SQL,
    "op6_quality": OP6_SQL,
    "op7_mixing": OP7_SQL,
}
