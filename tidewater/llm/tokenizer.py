"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding at the starts of white-space runs. The split pattern never
matches from a visible character on into white space, so its matches end there anyway and the ids
are those of the whole text; a text without white space is not split.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points after which a long text is split at the next safe boundary.
PIECE = 1 << 16

_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
_encodings: dict = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file, loaded once a worker."""
    import tiktoken

    key = (path, pattern)
    if key not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE):
    """The text in parts of about ``size`` code points, cut only where no match of the pattern crosses."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(enc, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in pieces(text, size):
        out += enc.encode_ordinary(part)
    return out


def decode(enc, ids) -> bytes:
    """The raw bytes of ids; a cut inside a character gives a partial UTF-8 sequence."""
    return enc.decode_bytes(ids)


def encode_documents(documents: DataFrame, path: str, pattern: str, text: str = "text", size: int = PIECE, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    Null and empty texts have no tokens; repeated rows give repeated results; other columns are not
    read. ``path`` is a rank file that every executor has.
    """
    import pyspark.sql.types as T

    fields = [("doc_id", documents.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField(*x) for x in fields])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value in batch.column(1):
                ids = encode(enc, value.as_py() or "", size)
                packed = np.asarray(ids, "<u4")
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(packed.tobytes()).hexdigest())
                columns[2].append(hashlib.sha256(decode(enc, ids)).hexdigest())
                columns[3].append(packed.astype(np.int32))
            out = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if with_ids:
                lengths = np.concatenate(([0], np.cumsum(columns[0]))).astype(np.int32)
                flat = np.concatenate(columns[3]) if columns[3] else np.empty(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[x[0] for x in fields])

    return documents.select("doc_id", text).mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
