"""Byte-level BPE with a public rank file: parallel chunk encoding with stitching, and byte decoding.

Pre-tokens are found by the pattern and encoded one by one, the same way for all texts. A text of at most `chunk_chars` code
points is one chunk, whose ids need no stitching. A longer one is cut into chunks
that overlap; chunk tasks pre-tokenise and encode their chunk wherever they run, and one stitching step per distinct
text walks the true pre-token boundaries from one chunk into the next until they meet a boundary that the next chunk
found too. The pattern never looks behind, so from such a point on both agree and the chunk's own ids hold. Where they
never meet (one pre-token longer than a chunk), the walk simply goes on through the following chunk.

Defined cases: a null text is an empty text and gives no ids; repeated rows give one output row each; a null or repeated
identifier is carried through; other columns of the input are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: A boundary this close to a cut may still move: the longest fixed alternative of the pattern has three characters.
UNSURE = 4
#: Distinct pre-tokens whose ids a worker keeps.
KEPT = 200_000


class Vocabulary(NamedTuple):
    """A rank file in tiktoken's format and the pattern that cuts text into pre-tokens."""

    ranks_path: str
    pattern: str
    chunk_chars: int = 32_768
    overlap_chars: int = 512


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding_of(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("scrubjay", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def pattern_of(pattern: str):
    import regex

    return regex.compile(pattern)


class Pieces:
    """Ids of single pre-tokens, with a bounded memory of those already seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.encode = encoding_of(vocabulary.ranks_path, vocabulary.pattern).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def __call__(self, token: str) -> list[int]:
        ids = self.known.get(token)  # most pre-tokens are words seen before
        if ids is None:
            ids = self.encode(token)
            if len(self.known) >= KEPT:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = ids
        return ids


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of each chunk; each but the first begins `overlap` characters before the last one's end."""
    return [(max(0, at - overlap), text[max(0, at - overlap) : at + chunk]) for at in range(0, max(1, len(text)), chunk)]


def encode_short(text: str, pattern, pieces: Pieces) -> bytes:
    """Ids of a text that is one chunk: those of its pre-tokens, with no boundaries to note."""
    ids: list[int] = []
    known = pieces.known
    for token in pattern.findall(text) if not pattern.groups else (m.group() for m in pattern.finditer(text)):
        found = known.get(token)
        ids += pieces(token) if found is None else found
    return np.array(ids, "<u4").tobytes()


def encode_chunk(text: str, start: int, pattern, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the pre-tokens in the whole text, the ids up to each end, and all ids."""
    ends, upto, ids = [], [], []
    for match in pattern.finditer(text):
        ids += pieces(match.group())
        ends.append(start + match.end())
        upto.append(len(ids))
    return np.array(ends, "<u4"), np.array(upto, "<u4"), np.array(ids, "<u4")


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]], pattern, pieces: Pieces) -> np.ndarray:
    """Ids of a whole text from (start, chunk, ends, upto, ids) of its chunks in order."""
    out: list[np.ndarray] = []
    at, loose = 0, ""  # all before `at` is done; `loose` is the text from there to the end of the chunks seen
    for k, (start, text, ends, upto, ids) in enumerate(chunks):
        last = k == len(chunks) - 1
        begin = 0
        if k:
            seen_to = at + len(loose)
            loose += text[seen_to - start :]
            stop, walked, begin = at + len(loose), [], None
            known = set(ends.tolist())
            for match in pattern.finditer(loose):
                end = at + match.end()
                if end > stop - UNSURE and not last:
                    break
                walked.append((match.group(), end))
                if end in known:
                    begin = int(np.searchsorted(ends, end)) + 1
                    break
            out.append(np.array([i for token, _ in walked for i in pieces(token)], "<u4"))
            done = walked[-1][1] if walked else at
            loose, at = loose[done - at :], done
            if begin is None:
                continue
        # This chunk's boundaries hold from here; what follows the next chunk's start is left to the walk.
        limit = start + len(text) if last else min(chunks[k + 1][0], start + len(text) - UNSURE)
        stop = max(begin, int(np.searchsorted(ends, limit, side="right")))
        first = int(upto[begin - 1]) if begin else 0
        if stop > begin:
            out.append(ids[first : int(upto[stop - 1])])
            at = int(ends[stop - 1])
        loose = text[at - start :]
    return np.concatenate(out) if out else np.array([], "<u4")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, `ids` (little-endian unsigned 32-bit) of every row's whole text."""
    docs = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    id_type = dict(docs.dtypes)["row_id"]
    fits = F.char_length("body") <= vocabulary.chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pattern = Pieces(vocabulary), pattern_of(vocabulary.pattern)
        for part in slices(batches, 1):
            ids = [encode_short(text, pattern, pieces) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["row_id", "ids"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            for row in part.to_pylist():
                pieces = cut(row["body"], vocabulary.chunk_chars, vocabulary.overlap_chars)
                yield pa.RecordBatch.from_pydict({"digest": [row["digest"]] * len(pieces), "k": list(range(len(pieces))), "start": [s for s, _ in pieces], "chunk": [t for _, t in pieces]}, pa.schema([("digest", pa.string()), ("k", pa.int64()), ("start", pa.int64()), ("chunk", pa.string())]))

    def pre_tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pattern = Pieces(vocabulary), pattern_of(vocabulary.pattern)
        for part in slices(batches, 3, 1 << 20):
            found = [encode_chunk(text, start, pattern, pieces) for start, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in range(3))], names=["digest", "k", "start", "chunk", "ends", "upto", "ids"])

    def stitched(table: pa.Table) -> pa.Table:
        pieces, pattern = Pieces(vocabulary), pattern_of(vocabulary.pattern)
        rows = table.sort_by("k").to_pylist()
        ids = stitch([(r["start"], r["chunk"], *(np.frombuffer(r[c], "<u4") for c in ("ends", "upto", "ids"))) for r in rows], pattern, pieces)
        return pa.table({"digest": [rows[0]["digest"]], "ids": pa.array([ids.tobytes()], pa.binary())})

    short = docs.where(fits).mapInArrow(whole, f"row_id {id_type}, ids binary")
    # Long texts: each distinct one once, its chunks dealt over the cluster, its copies joined again by digest.
    long = docs.where(~fits).withColumn("digest", F.sha2("body", 256))
    once = long.select("row_id", "body", "digest").dropDuplicates(["digest"])
    parts = once.mapInArrow(chunked, "digest string, k long, start long, chunk string").repartition("digest", "k")
    parts = parts.mapInArrow(pre_tokenised, "digest string, k long, start long, chunk string, ends binary, upto binary, ids binary")
    whole_ids = parts.groupBy("digest").applyInArrow(stitched, "digest string, ids binary")
    copies = long.select("row_id", "digest").join(whole_ids, "digest").select("row_id", "ids")
    return short.unionByName(copies).withColumnRenamed("row_id", id_col)


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, `bytes`: the raw bytes of the ids, concatenated. A null list of ids is an empty one."""
    tokens = tokens.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    id_type = dict(tokens.dtypes)["row_id"]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {rank: token for token, rank in ranks_of(vocabulary.ranks_path).items()}
        for part in slices(batches, 1):
            texts = [b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["row_id", "bytes"])

    return tokens.mapInArrow(raw, f"row_id {id_type}, bytes binary").withColumnRenamed("row_id", id_col)
