"""Token counts of whole texts with a sentencepiece model, by overlap resynchronisation.

A text of up to one chunk is encoded by the library as it is. A longer one is
encoded in overlapping chunks; the offsets of a chunk's tokens are the running
sums of their pieces' UTF-8 lengths. Two neighbouring encodings are spliced at
an offset inside their overlap that is a token boundary in both and *proven
stable*: no piece of the vocabulary holds the two characters around it side by
side, so no merge can cross it, whatever stands left or right, and the tokens of
the whole are those of the two sides. A boundary that is only shared proves
nothing, as both encodings may still depend on their cut ends.

When an overlap holds no such boundary it is doubled. Once it has grown to the
last splice, which is proven itself, the right chunk replaces the left one and
the next is twice as long, so a text without any proven boundary is in the end
encoded whole and work stays within a constant factor of that.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
count each; an empty table gives an empty result; other columns are ignored.
Memory is bounded by one Arrow batch and the encodings of two chunks, except
where a longer stretch has no proven boundary: that stretch is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: UTF-8 bytes of a chunk, and of the first overlap of two chunks.
CHUNK = 1 << 16
OVERLAP = 512
SPACE = "▁"
#: A line feed is a token of its own in the models taken, so one before a chunk keeps the library's leading space from it.
SHIELD = "\n"


class Counter:
    """Counts tokens exactly as the library does for whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = self.replaced = self.splices = 0
        ids = range(self.model.get_piece_size())
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for i in ids]
        pieces = [self.model.id_to_piece(i) if use else "" for i, use in zip(ids, plain, strict=True)]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: UTF-8 length of each piece; a byte piece stands for one byte.
        self.length = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], dtype=np.int64)
        if not any(self.model.is_byte(i) for i in ids) or any(SHIELD in p for p in pieces):
            raise ValueError("offsets need a model with byte fallback and no piece with a line feed")
        self.shield = len(self.model.encode(SHIELD, num_threads=1))

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        short = [i for i, x in enumerate(texts) if x and len(x) <= self.chunk // 4]
        out = [0] * len(texts)
        for i, tokens in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(tokens)
        for i, x in enumerate(texts):
            if x and len(x) > self.chunk // 4:
                out[i] = self.count(x)
        return out

    def count(self, text: str) -> int:
        # as the library sees it: spaces are marked and one mark stands before the text
        data = (SPACE + text.replace(" ", SPACE)).encode()
        if len(data) <= self.chunk:
            return len(self.model.encode(text, num_threads=1)) if text else 0
        return self.spliced(data)

    def encode(self, data: bytes, start: int, end: int) -> np.ndarray:
        """Offsets in data at which the tokens of data[start:end] begin, and end itself."""
        ids = self.model.encode(SHIELD + data[start:end].decode(), num_threads=1)[self.shield :]
        return start + np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(self.length[ids])))

    def stable(self, data: bytes, at: int) -> bool:
        """Whether the boundary of characters before data[at] is proven stable."""
        if not 0 < at < len(data) or not begins(data, at):
            return False
        pair = data[at_character(data, at - 1) : after_character(data, at)].decode()
        return pair not in self.joined

    def splice(self, data: bytes, left: np.ndarray, right: np.ndarray, lap: int, end: int) -> int | None:
        """The last offset strictly inside the overlap that both encodings share and that is proven stable."""
        shared = np.intersect1d(left[(left > lap) & (left < end)], right[(right > lap) & (right < end)], assume_unique=True)
        return next((int(at) for at in shared[::-1] if self.stable(data, int(at))), None)

    def spliced(self, data: bytes) -> int:
        total, begin, reach = 0, 0, self.chunk  # begin: the last splice; tokens from there on aren't counted yet
        end = at_character(data, reach)
        left = self.encode(data, 0, end)
        while end < len(data):
            overlap, at = self.overlap, None
            while at is None:
                lap = at_character(data, max(begin, end - overlap))
                further = at_character(data, min(len(data), end + reach))
                right = self.encode(data, lap, further)
                if lap <= begin:
                    break
                at = self.splice(data, left, right, lap, end)
                if at is None:
                    self.widened += 1
                    overlap *= 2
            if at is None:  # from the last splice on, right is what left was, and longer
                self.replaced += 1
                reach *= 2
            else:
                self.splices += 1
                total += int(np.searchsorted(left, at) - np.searchsorted(left, begin))
                begin, reach = at, self.chunk
            left, end = right, further
        return total + len(left) - 1 - int(np.searchsorted(left, begin))


def begins(data: bytes, at: int) -> bool:
    """Whether a character begins at data[at]."""
    return data[at] & 0xC0 != 0x80


def at_character(data: bytes, at: int) -> int:
    """The start of the character that holds data[at], or at itself at the end."""
    while 0 < at < len(data) and not begins(data, at):
        at -= 1
    return at


def after_character(data: bytes, at: int) -> int:
    """The end of the character that begins at data[at]."""
    at += 1
    while at < len(data) and not begins(data, at):
        at += 1
    return at


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; path: the model file, present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            counts = pa.array(counter.count_all(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
