"""Token counts of texts by a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import os
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

#: Folder of the public vocabularies; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a whole text; special token strings count as ordinary text. 0 for empty texts, null for null."""

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(path)._core_bpe.encode_to_tiktoken_buffer  # ids as bytes, four each: no list is made of them
        return pa.array([None if t is None else memoryview(encode(t, set())).nbytes // 4 for t in texts.to_pylist()], pa.int32())

    return count(text)


def pair_tokens(prompt: Column, target: Column, path: str = VOCABULARY, joint: str = " ", eos: int = 50256) -> Column:
    """(condition_ids, response_ids, consistent): ids of a prompt and of ``joint`` + target with a closing eos.

    ``consistent`` tells whether both together are the ids of the joined text, which callers assert. Null for a null part.
    """
    kind = StructType([StructField("condition_ids", ArrayType(IntegerType())), StructField("response_ids", ArrayType(IntegerType())), StructField("consistent", BooleanType())])

    @F.arrow_udf(kind)
    def run(prompts: pa.Array, targets: pa.Array) -> pa.Array:
        encode, out = encoding(path)._core_bpe.encode_ordinary, []
        for p, t in zip(prompts.to_pylist(), targets.to_pylist()):
            if p is None or t is None:
                out.append(None)
                continue
            a, b = encode(p), encode(joint + t)
            out.append({"condition_ids": a, "response_ids": [*b, eos], "consistent": a + b == encode(p + joint + t)})
        return pa.array(out, pa.struct([("condition_ids", pa.list_(pa.int32())), ("response_ids", pa.list_(pa.int32())), ("consistent", pa.bool_())]))

    return run(prompt, target)
