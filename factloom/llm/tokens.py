"""Token counts by a public byte-level tokenizer, whose vocabulary file and pattern are parameters."""

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary file lies unless a caller says otherwise.
DEFAULT_VOCABULARY = os.environ.get("FACTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how byte-level vocabularies of this kind part a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY = 64 << 20


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id long, text); a null text has 0 tokens.

    The driver reads the vocabulary, of at most MAX_VOCABULARY bytes, and broadcasts it, so executors need no file.
    """
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
