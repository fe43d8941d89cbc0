"""Byte-level BPE through a sentencepiece model that is serialised straight from the vocabulary."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, own_names, release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
"""Pre-tokens whose ids a task remembers at a time; a matter of speed only."""


def byte_letters() -> list[str]:
    """A visible character for each byte: itself where printable, else the next free code point from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: a normal piece per token, its bytes as letters, scored by negative rank; <unk> comes last.

    Normalisation is the identity: no dummy prefix, no removed or escaped white space.
    """
    letters = byte_letters()
    pieces = b""
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        pieces += _field(1, _field(1, piece) + b"\x15" + np.float32(-rank).tobytes())
    pieces += _field(1, _field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _field(3, 2))
    minus = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, minus) + _field(42, minus) + _field(43, minus)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts; ids are the ranks of the vocabulary."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        split, known = [self.split(t) for t in texts], self.known
        new = list(set().union(*split).difference(known))
        if new:
            if len(known) + len(new) > CACHE:
                known = self.known = {}
                new = list(set().union(*split))
            mapped = [w.encode().decode("latin-1").translate(self.to_letters) for w in new]
            for w, ids in zip(new, self.sp.encode(mapped, num_threads=1), strict=True):
                known[w] = array("i", ids).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, column: str = "text") -> DataFrame:
    """docs with tokens ARRAY<INT>, n_tokens INT and round_trip BOOLEAN (decoding gives the text back); columns of these names are replaced.

    A text is cut into pre-tokens by `pattern`, each is encoded by the model of `model_bytes`, and decoding maps ids to
    their bytes. Null text gives null in all three; empty text gives no tokens and true. Whole texts are encoded, whatever
    their length; special tokens' strings are ordinary text. Other values play no part; an empty table gives none.

    Scale: no shuffle. The vocabulary (a file the driver reads; its size is fixed) travels with the tasks.
    """
    bounded(docs.sparkSession)
    docs, names = own_names(docs)
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value, pattern)
        for texts in batches:
            starts, flat, back = [0], [], []
            texts = texts.to_pylist()
            a = 0
            while a < len(texts):  # runs of about a million characters
                b, n = a, 0
                while b < len(texts) and (b == a or n < 1_000_000):
                    n += len(texts[b] or "")
                    b += 1
                for t, ids in zip(texts[a:b], codec.encode_many([t or "" for t in texts[a:b]]), strict=True):
                    back.append(None if t is None else codec.decode(ids) == t)
                    flat.append(ids)
                    starts.append(starts[-1] + len(ids))
                a = b
            null = pa.array([t is None for t in back])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=null if len(null) else None)
            sizes = pa.array([None if t is None else n for t, n in zip(back, np.diff(starts).tolist(), strict=True)], pa.int32())
            yield pa.StructArray.from_arrays([lists, sizes, pa.array(back, pa.bool_())], ["tokens", "n_tokens", "round_trip"])
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    coded = F.arrow_udf(run, "tokens array<int>, n_tokens int, round_trip boolean")
    own = [c for c in docs.columns if c.lower() not in ("tokens", "n_tokens", "round_trip")]
    return docs.withColumn("_pl_coded", coded(F.col(column))).select(*own, "_pl_coded.tokens", "_pl_coded.n_tokens", "_pl_coded.round_trip").withColumnsRenamed(names)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
