"""SentencePiece encoding and decoding by streaming Viterbi.

A text is fed in parts and encoded left to right in a window bounded by the longest
piece; ids are committed whenever all surviving backpointer paths meet on one
boundary, and only what lies behind the last such boundary is kept.  Between words
the window is always empty (no piece lies across), so the ids that a word went
through the window to get are remembered for its next occurrence.  Neither the
window nor what is remembered grows with the text.

Defined results: null text encodes to no ids, as the empty text does; repeated
rows are encoded alike; an empty table gives an empty result; texts of any length
are encoded whole; other columns are ignored by ``encode`` and kept by
``append_ids``.  Decoding restores the text exactly, save that U+2581 (the
model's own mark for a blank) comes back as a blank.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm import pieces
from logtide.llm.common import held

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of texts and bytes of ids in one output batch.
BATCH_CHARS = 4_000_000


class Encoder:
    """Encodes and decodes whole texts; ids are kept as packed 32-bit integers."""

    def __init__(self, model: bytes):
        self.v = pieces.load_vocabulary(model)
        self.window = pieces.StreamingViterbi(self.v)
        self.of_chunk = pieces.Remembered(self._chunk)
        self.of_word = pieces.Remembered(self._word, 250_000)

    def _chunk(self, chunk: str) -> bytes:
        return array("i", self.window.stream(chunk)).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.of_chunk.__getitem__, pieces.parts(self.v, word)))

    def encode(self, text: str | None) -> bytes:
        return self.feed(pieces.slices(text or ""))

    def feed(self, parts) -> bytes:
        """Ids of a text that comes in parts."""
        out: list[bytes] = []
        for words, torn, ended in pieces.streamed(self.v, parts):
            out.extend(map(self.of_word.__getitem__, words))
            for i in range(0, len(torn), pieces.SLICE):
                out.append(array("i", self.window.push(torn[i : i + pieces.SLICE])).tobytes())
            if ended:
                out.append(array("i", self.window.finish()).tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.v.pieces.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def _encoder(model: bytes) -> Encoder:
    return held(("codec", model), lambda: Encoder(model))


def read_model(spark, path: str) -> bytes:
    """Bytes of a model file that the driver can read; executors get them with the task."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(model, with_decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done = 0
            while done < len(texts):
                rows, chars, same, start = [], 0, [], done
                while done < len(texts) and chars < BATCH_CHARS:
                    text = texts[done].as_py() or ""
                    packed = enc.encode(text)
                    rows.append(packed)
                    chars += len(text) + len(packed)
                    if with_decode:
                        same.append(enc.decode(np.frombuffer(packed, np.int32).tolist()) == text)
                    done += 1
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                out = [keys.slice(start, done - start), pa.array(np.diff(offsets).astype(np.int64)), ids]
                names = ["key", "n_tokens", "ids"]
                if with_decode:
                    out.append(pa.array(same, pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode(docs: DataFrame, model_path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """Ids of every row of ``docs`` (key, text), their number, and whether decoding them gives the text again."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))
    rows = docs.select(docs[key].alias("key"), docs["text"])
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean"
    return rows.mapInArrow(_encoded(model, True), schema).withColumnRenamed("key", key)


def append_ids(docs: DataFrame, model_path: str = MODEL, into: str = "ids") -> DataFrame:
    """``docs`` with the ids as a column of the given name (an equally named column is replaced) and their number as ``n_tokens``."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model_path))
    names = [c for c in docs.columns if c not in (into, "n_tokens")]
    packed = docs.select(F.struct(*(docs[c] for c in names)).alias("key"), docs["text"].alias("text"))
    schema = f"key {packed.schema['key'].dataType.simpleString()}, n_tokens long, ids array<int>"
    out = packed.mapInArrow(_encoded(model, False), schema)
    return out.select(*(F.col("key")[c].alias(c) for c in names), F.col("ids").alias(into), "n_tokens")


def decode(encoded: DataFrame, model_path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """Texts of rows of ids (key, ids); null ids give null."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(encoded.sparkSession, model_path))
    rows = encoded.select(encoded[key].alias("key"), encoded["ids"].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
