"""Byte-level BPE through tiktoken with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwave.llm.common import map_texts

LONG = 1 << 16
#: Between a character that is no white space and a blank, every match of the split pattern ends and another begins.
BOUNDARY = re.compile(r"(?<=\S)(?= )")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as ranks:
        pairs = dict((base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, ranks))
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def parts(text: str, longest: int = LONG):
    """The text cut at safe boundaries into parts of about `longest` characters; a part without such a boundary stays whole."""
    start = 0
    while len(text) - start > longest:
        found = BOUNDARY.search(text, start + longest)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str, enc) -> np.ndarray:
    if not text:
        return np.zeros(0, "<u4")
    got = [enc.encode_to_numpy(p, disallowed_special=()) for p in parts(text)]
    return (got[0] if len(got) == 1 else np.concatenate(got)).astype("<u4", copy=False)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=None) -> DataFrame:
    """Adds `ids`, little-endian unsigned 32-bit, as binary. Null or empty text: no ids. `path` names the rank file on every executor."""
    return map_texts(docs, lambda texts: {"ids": [encode(t, encoding(path, pattern)).tobytes() for t in texts]}, "ids binary", text, keep)


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", keep=None) -> DataFrame:
    """Adds `bytes`: the raw bytes of the ids, which need not be valid text. Null ids: no bytes."""
    import pyarrow as pa
    from pyspark.sql import types as T

    carried = [c for c in (rows.columns if keep is None else keep) if c != "bytes"]
    source = rows.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("__ids"))

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*carried, "bytes"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("bytes", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=None) -> DataFrame:
    """Encodes and decodes in one pass and keeps digests only: n_tokens, ids_sha256, decoded_sha256."""
    def digests(texts):
        enc = encoding(path, pattern)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            ids = encode(t, enc)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
        return out

    return map_texts(docs, digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, keep)
