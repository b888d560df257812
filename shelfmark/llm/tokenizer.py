"""Token ids of every text by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as model_pb2

#: Fixed value: the vocabulary's own rule for cutting text before any merge.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_VOCABULARY = os.environ.get("SHELFMARK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

#: Bytes of a vocabulary file at most.
MOST_BYTES = 64 << 20

#: Distinct pre-tokens whose ids a worker keeps; beyond it the memory starts anew.
CACHE = 400_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairs:
    """A sentencepiece BPE model made straight from a rank file.

    Each vocabulary entry is a piece of byte letters whose score is its negative rank, so the best
    merge is the one of least rank, and the model neither normalises nor marks words. Piece numbers
    are mapped to ranks; a piece that no merge reaches still has its place.
    """

    def __init__(self, vocabulary: bytes):
        letters = byte_letters()
        pairs = [line.split() for line in vocabulary.splitlines() if line.strip()]
        self.bytes_of = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
        proto = model_pb2.ModelProto()
        proto.pieces.add(piece="<unk>", score=0.0, type=model_pb2.ModelProto.SentencePiece.UNKNOWN)
        order = sorted(self.bytes_of)
        for rank in order:
            proto.pieces.add(piece="".join(letters[b] for b in self.bytes_of[rank]), score=-float(rank), type=model_pb2.ModelProto.SentencePiece.NORMAL)
        proto.trainer_spec.model_type = model_pb2.TrainerSpec.BPE
        proto.trainer_spec.vocab_size = len(order) + 1
        proto.trainer_spec.byte_fallback = False
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.escape_whitespaces = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = np.array([-1, *order], np.int32)
        self.table = {b: letters[b] for b in range(256)}
        self.cut = regex.compile(PRE_TOKENS).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Lists of ids; empty for empty and null texts."""
        cut, known = self.cut, self.known
        words = [cut(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws}.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = {w for ws in words for w in ws}
        if new:
            new = list(new)
            # latin-1 turns the bytes into characters of the same number, which translate() then maps
            pieces = self.model.encode([w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in new], num_threads=1)
            known.update(zip(new, (self.ids[p].tolist() for p in pieces)))
        flat: list[int] = []
        ends = [0]
        for ws in words:
            for w in ws:
                flat += known[w]
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def shipped(spark: SparkSession, path: str) -> Callable[[], BytePairs]:
    """What gives a worker the encoder of a vocabulary file that only the driver need have: its bytes go along once per executor, a megabyte or so."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > MOST_BYTES:
        raise ValueError(f"no vocabulary: {path}")
    name, shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def load() -> BytePairs:
        if name not in _loaded:
            _loaded[name] = BytePairs(shared.value)
        return _loaded[name]

    return load


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and ids (array of int) of every row, without special tokens; what looks like one is ordinary text.

    Null and empty texts have an empty list; null and repeated keys are kept as they are, one row per
    row. Whole texts, however long. One pass over the two columns, no shuffle; the vocabulary goes to
    the workers with the job.
    """
    load = shipped(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The texts of lists of ids, the inverse of encode_corpus but for null texts, which come back empty."""
    load = shipped(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
