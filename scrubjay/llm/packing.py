"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are tokenised where they lie and dealt by a random key, so every partition is a random sample of all. A
partition is read in the order of that key and cut into groups of about `group_tokens` tokens, whatever the partition's size;
each group is packed by itself. Documents longer than a sequence fill whole ones first, and their rests join the others. In
a group, pieces go by falling length to the first sequence with room, which the tree finds in logarithmic time.

Words are tokenised once per Arrow batch: distinct words only, letters and trailing punctuation apart where the
tokenizer's own pattern separates them, and what isn't plain Latin by the tokenizer as it stands.

Defined cases: a null text is an empty one and still has its end token; repeated rows, and null or repeated identifiers,
are documents of their own; texts of any length are cut into pieces; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, string_parts, words_of

KEPT = 150_000
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Settings(NamedTuple):
    tokenizer_path: str
    end_id: int = 2
    capacity: int = 4096
    group_tokens: int = 2_000_000
    seed: int = 20_25


class Tree:
    """Tournament tree: each inner node has the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The leftmost bin with room for `need`, which then has less."""
        free, at, size = self.free, 1, self.size
        while at < size:
            at *= 2
            if free[at] < need:
                at += 1
        free[at] -= need
        found = at - size
        while at > 1:
            at >>= 1
            left, right = free[2 * at], free[2 * at + 1]
            most = left if left > right else right
            if free[at] == most:
                break
            free[at] = most
        return found


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each position of each document is in exactly one."""
    out, rests, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((doc, start, capacity, sequence, 0))
            start, sequence = start + capacity, sequence + 1
        if n > start:
            rests.append((n - start, doc, start))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, used = Tree(max(1, len(rests)), capacity), {}
    for size, doc, start in rests:
        k = tree.first_fit(size)
        offset = used.get(k, 0)
        out.append((doc, start, size, sequence + k, offset))
        used[k] = offset + size
    return out


@lru_cache(maxsize=1)
def tokenizer_of(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """Characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds:
    """Token ids of words. Words hold no white space, so a text's ids are those of its words one after the other."""

    def __init__(self, path: str):
        self.tokenizer, self.letters, self.known = tokenizer_of(path), byte_letters(), {}
        self.model = self.tokenizer.model

    def plain(self, letters: str) -> bytes:
        """Ids of lower-case Latin letters, or of ASCII punctuation: one pre-token each."""
        if not letters.isascii():
            letters = "".join([self.letters[b] for b in letters.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets) of distinct words."""
        if not len(words):
            return np.array([], "<u4"), np.zeros(1, np.int64)
        lower = pc.utf8_lower(words)
        stems = pc.ascii_rtrim(lower, TAIL)
        at = string_parts(lower)[0].astype(np.int32)
        cut = at[:-1] + pc.binary_length(stems).to_numpy(zero_copy_only=False).astype(np.int32)
        both = np.empty(2 * len(words) + 1, np.int32)
        both[0::2], both[1::2] = at, cut
        parts = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both.tobytes()), lower.buffers()[2])
        # Letters up to U+017F but for the dotted I are lower-cased and composed alike everywhere.
        simple = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) | (cut == at[:-1])
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(simple & ~plain):
            if max(w := words[int(i)].as_py()) > "\u017f" or "\u0130" in w:
                simple[i] = False
        coded = parts.dictionary_encode()
        codes, table = coded.indices.to_numpy(), [None] * len(coded.dictionary)
        wanted = np.zeros(len(table), bool)
        wanted[codes.reshape(-1, 2)[simple].ravel()] = True
        known = self.known
        for i, part in enumerate(coded.dictionary.to_pylist()):
            if wanted[i]:
                ids = known.get(part)
                if ids is None:
                    ids = self.plain(part)
                    if len(known) >= KEPT:
                        known.clear()
                    known[part] = ids
                table[i] = ids
        odd = np.flatnonzero(~simple)
        if len(odd):
            texts = words.take(pa.array(odd)).to_pylist()
            table += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            codes = codes.copy()
            codes[2 * odd], codes[2 * odd + 1] = np.arange(len(table) - len(odd), len(table)), len(table)
        table = [t or b"" for t in table] + [b""]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        ids, offsets = gathered(flat, np.concatenate([[0], np.cumsum(sizes)]), codes)
        return ids, offsets[::2]


def gathered(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[offsets[c]:offsets[c + 1]] for every c of codes, one after the other, and their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(ends[-1]) + np.repeat(offsets[:-1][codes] - ends[:-1], sizes)
    return flat[place], ends


def tokenised(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """row_id, ids (little-endian unsigned 32-bit, the end token last), deal (random key) of every row."""
    docs = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("place"))
    docs = docs.select("row_id", F.xxhash64(F.lit(settings.seed), F.col("row_id"), F.col("place")).alias("deal"), "body")
    id_type = dict(docs.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds(settings.tokenizer_path)
        end = np.array([settings.end_id], "<u4").tobytes()
        for part in slices(batches, 2, 2 << 20):
            rows, codes, words = words_of(part.column(2))
            flat, offsets = word_ids(words)
            ids, ends = gathered(flat, offsets, codes)
            ends = ends[rows]
            found = [ids[a:b].tobytes() + end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["row_id", "deal", "ids"])

    return docs.mapInArrow(run, f"row_id {id_type}, deal long, ids binary")


def pack(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece: id_col, start, length, ids (of the piece), doc_tokens, sequence_id, offset."""
    rows = tokenised(docs, settings, id_col, text_col)
    id_type = dict(rows.dtypes)["row_id"]
    arrow_names = ["row_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36  # sequences of this partition
        held: list[pa.RecordBatch] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = group.column(2)
            lengths = (pc.binary_length(texts).to_numpy(zero_copy_only=False) // 4).tolist()
            pieces = pack_lengths(lengths, settings.capacity)
            for k in range(0, len(pieces), 2048):
                doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces[k : k + 2048], strict=True))
                views = [texts[d].as_buffer() for d in doc.tolist()]
                ids = [memoryview(v)[4 * s : 4 * (s + n)].tobytes() for v, s, n in zip(views, start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([group.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.array(lengths, np.int64)[doc]), pa.array(base + sequence), pa.array(offset)], names=arrow_names)
            base += max(p[3] for p in pieces) + 1

        for part in slices(batches, 2, 4 << 20):
            held.append(part)
            tokens += part.column(2).nbytes // 4
            if tokens >= settings.group_tokens:
                yield from packed()
                held, tokens = [], 0
        if held:
            yield from packed()

    dealt = rows.repartition("deal").sortWithinPartitions("deal")
    out = dealt.mapInArrow(run, f"row_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("row_id", id_col)
