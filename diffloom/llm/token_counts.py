"""Token counts with overlap resynchronisation for huge texts.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two
neighbours are spliced where both start a token and where no token of the
vocabulary can reach across: before a run of spaces that follows another
character. Nothing on either side of such a place changes the other side. If
an overlap holds no such place it is doubled, up to the rest of the text.

Null texts count as empty. Rows keep their ids, null or repeated; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

CHUNK, OVERLAP = 32_768, 256
MARK = "▁"


def crosses(processor) -> bool:
    """Whether some piece has a space mark behind another character; then no place is proven stable."""
    return any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def _starts(processor, text: str) -> list[int]:
    """Where tokens start, in code points; the library gives bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return place[[p.begin for p in processor.encode(text, return_type="proto").pieces]].tolist()


def splice_point(left: list[int], right: list[int], text: str, begin: int, end: int) -> int | None:
    """The last place in (begin, end) that is proven stable and where both encodings start a token."""
    both = set(left) & set(right)
    for p in range(end - 1, begin, -1):
        if text[p] == " " and text[p - 1] not in " " + MARK and p in both:
            return p
    return None


def count_spliced(processor, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    total, begin, end = 0, 0, min(chunk, len(text))
    left, counted = _starts(processor, text[:end]), 0
    while end < len(text):
        width = overlap
        while True:
            start = max(begin + 1, end - overlap)
            stop = min(len(text), max(end, start) + width - overlap)
            if stop > end:  # widened: the left chunk reaches further
                left, end = [begin + x for x in _starts(processor, text[begin:stop])], stop
                if end == len(text):
                    return total + sum(x >= counted for x in left)
            after = min(len(text), start + chunk + width)
            right = [start + x for x in _starts(processor, text[start:after])]
            at = splice_point(left, right, text, start, end)
            if at is not None:
                break
            width *= 2
        total += sum(counted <= x < at for x in left)
        begin, end, left, counted = start, after, right, at
    return total + sum(x >= counted for x in left)


def count_tokens(processor, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, spliced: bool = True) -> list[int]:
    out = [0] * len(texts)
    short = [k for k, x in enumerate(texts) if x and (len(x) <= chunk or not spliced)]
    for at in range(0, len(short), 64):
        group = short[at : at + 64]
        for k, ids in zip(group, processor.encode([texts[k] for k in group], num_threads=1), strict=True):
            out[k] = len(ids)
    for k, x in enumerate(texts):
        if len(x) > chunk and spliced:
            out[k] = count_spliced(processor, x, chunk, overlap)
    return out


def token_counts(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of docs (doc_id, text). model: the vocabulary file on every worker."""

    def run(batches):
        import sentencepiece

        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spliced = not crosses(processor)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(count_tokens(processor, texts, chunk, overlap, spliced), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
