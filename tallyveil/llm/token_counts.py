"""Token counts without token ids: Arrow batches in, lengths out.

``count_tokens`` counts what the ``tokenizers`` library gives for a byte-level BPE file with the default
handling of special strings inside texts, no added special tokens, no truncation and no padding. The merge
ranks are read from that same JSON file and run by ``tiktoken``, whose merges are the same and which takes a
fifth of the time; a file that is not a plain byte-level BPE is encoded by ``tokenizers`` itself.

Batches are balanced by bytes: rows are gathered until they hold ``batch_bytes`` of text. A text longer than
``split_bytes`` is cut where the pre-tokenizer always ends a piece, so the parts' counts add up to the whole
text's count; a text without such a place stays whole. Parts with very long runs of white space are encoded by ``tokenizers``.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted row by row; extra
columns are left out unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import by_bytes, table, worker_kept
from tallyveil.llm.pieces import byte_alphabet

#: The pre-tokenizer pattern of the published byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space beyond what the pattern engine of ``tiktoken`` can take; parts that hold one go to the library.
LONG_SPACE = re.compile(r"\s{50000}")
#: A space between an ASCII letter and an ASCII letter always starts a piece.
SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def _plain_byte_level(spec: dict) -> bool:
    """True for a byte-level BPE whose ids follow the order of its merges, with no other step around it."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return False
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:]))


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for the tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    spec, by_library = json.load(open(path, encoding="utf-8")), _library_counter(path)
    if _plain_byte_level(spec):
        import tiktoken

        letters, added = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda texts: [len(own.encode(t, allowed_special="all")) if len(t) < 50_000 or not LONG_SPACE.search(t) else by_library([t])[0] for t in texts]
    return by_library


def _library_counter(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def safe_parts(text: str, size: int) -> list[str]:
    """The text in parts of about ``size`` characters, cut only where a piece ends whatever stands around it."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        parts.append(text[start:cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def count_tokens(
    docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 20, split_bytes: int = 1 << 16,
) -> DataFrame:
    """The ``keep`` columns with ``n_bytes`` and ``n_tokens`` of each row's whole text."""
    splits = path.endswith(".json") and _plain_byte_level(json.load(open(path, encoding="utf-8")))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_kept("token counter", path, lambda: piece_counter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            tokens = np.zeros(len(texts), np.int64)
            for a, b in by_bytes(sizes, batch_bytes):
                parts = [safe_parts(t, split_bytes) if splits else [t] for t in texts[a:b]]
                owners = np.repeat(np.arange(a, b), [len(p) for p in parts])
                np.add.at(tokens, owners, count([x for p in parts for x in p]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(tokens)], names=[*keep, "n_bytes", "n_tokens"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(lengths, schema)


def op8_token_counts(spark, folder: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {"op8_token_counts": op8_token_counts}
