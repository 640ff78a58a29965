"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are filled to about equal bytes, and long texts are cut at safe boundaries. A byte-level BPE without
normalizer is encoded by the batch encoder of bpe.py, which meets a distinct word once; any other vocabulary
by its own library, whole texts in batches of equal bytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder_of

BATCH_BYTES = 1 << 22
#: The pattern that byte-level pre-tokenizers split by.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def lengths_of(raw: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """texts -> their numbers of tokens, under the vocabulary in raw."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
    spec = json.loads(raw)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in spec.get("added_tokens", []))
    bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if plain and bare and model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        coder = coder_of(raw, "json", BYTE_LEVEL)
        return lambda texts: [len(x) // 4 for x in coder.encode(texts)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(raw)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in batches that end once they have `most` bytes."""
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t.encode())
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row a document: key, n_bytes, n_tokens, over_limit. Null texts count as empty, repeated rows and rows without a key like any others.

    Very long texts: the byte-level encoder cuts them at safe blanks; other libraries get them whole, as a cut could
    change their tokens, one batch each once they pass BATCH_BYTES.

    vocabulary: a .json file of tokenizers or a .model file of sentencepiece, read on the driver and sent to
    the workers (its size is that of a vocabulary, whatever the data).
    """
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    kind = vocabulary.rpartition(".")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths = lengths_of(raw.value, kind)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [x for part in by_bytes(texts, BATCH_BYTES) for x in lengths(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(key, F.col(text).alias("__value")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
