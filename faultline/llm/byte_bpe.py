"""Byte-level BPE by a local rank file: encoding in safe pieces, decoding to raw bytes.

Method. Texts are encoded with the tiktoken library, no special tokens. A long text is first cut
where a match of the pattern must end: between a letter or digit and a blank or line feed, since
no alternative of the pattern goes on from one into the other, and since its look-ahead only looks
to the right. The pieces' ids follow one another, so memory in the library is bounded by a piece.
Decoding joins the bytes of the ids, which need not end at a character.

Defined results. A null text is an empty one: no ids, no bytes. A text without a safe boundary is
one piece. Null identifiers and repeated rows pass as they are. No rows give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

PIECE_CHARS = 20_000
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut where the pattern must start anew."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Codec:
    """The tiktoken encoding of a rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [self.encoding.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _coded(ranks_path: str, pattern: str) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches(source):
            ids = [own.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([own.decode(x) for x in ids], pa.binary()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return run


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (the bytes those ids stand for)."""
    return texts(docs, id_col, text_col).mapInArrow(
        _coded(ranks_path, pattern), "doc_id long, ids binary, decoded binary"
    )


def coding_digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
