"""Language identification by a linear-chain conditional random field over words.

Each word is a node with a label, the languages seen in training. A node's score comes from its affixes, its byte n-grams
and whether it is in a lexicon of frequent training words; an edge's from learned transitions. Training maximises the
likelihood of sequences that also switch language in the middle, spliced from sentences of different languages, so the
transitions know both staying and switching. Forward-backward gives every word its marginals. A document's language is
that with the largest share of its words, wherever they stand, and its score is the share. Sequences are sentences, cut at `longest` words.

A text's shares add up to 1 whatever it is, so they cannot tell that it is in none of the languages. Its familiarity can: the share of its
words that are mostly made of trigrams that two training texts have. `known` says whether it is at least half of what is usual among the
training texts of the label found, each judged by the others. A label with one training text has nothing to judge by and rejects none.

The model is fitted on a bounded sample, everything else covers all rows: at most `sample_docs` documents a language, drawn by hash, and at
most `sample_words` words of them together. Short documents give all their words and the long ones equal shares of what is left, so
no document uses the others' room up; none gives more than `sample_chars` characters, cut before they leave the executors.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; rows without language, id or
text are never learned from; ties go to the language that sorts first; repeated rows are predicted each; with nothing to learn
from every row is `und`; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, string_parts, words_of

UNKNOWN = "und"
#: The share of a word's trigrams that makes it familiar, and of the usual familiarity that makes a text known.
FAMILIAR = 0.75
KNOWN = 0.5


class Settings(NamedTuple):
    sample_docs: int = 128
    sample_words: int = 24_000
    sample_chars: int = 40_000
    buckets_log2: int = 16
    longest_gram: int = 4
    lexicon_words: int = 2_000
    longest: int = 48
    epochs: int = 24
    rate: float = 0.15
    l2: float = 1e-4
    seed: int = 11


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # one row a feature: hashed affixes and n-grams, then the lexicon
    lexicon: np.ndarray  # sorted hashes of its words
    transitions: np.ndarray  # log scale, from row to column
    settings: Settings
    seen: np.ndarray = np.array([], np.uint64)  # sorted trigrams that at least two training texts have
    usual: np.ndarray = np.zeros(1)  # by label, the median familiarity of its training texts


MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


def windows(words: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each window, offsets of each word's windows, hash of each word) of distinct words.

    Words are lower-cased and framed by two marks, so the windows that hold a mark are prefixes and suffixes.
    """
    framed = pc.binary_join_element_wise("\x02", pc.utf8_lower(words), "\x03", "")
    offsets, data = string_parts(framed)
    data, offsets = data[offsets[0] : offsets[-1]].astype(np.uint64), offsets - offsets[0]
    size, n = len(data), settings.longest_gram
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(size)  # bytes from here to the word's end
    grams = np.full((size, n), -1, np.int64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h[: size - k] = (h[: size - k] ^ data[k:]) * STEP + np.uint64(k + 1)
        mixed = (h * MIX) >> np.uint64(64 - settings.buckets_log2)
        fits = left > k
        grams[fits, k] = mixed[fits].astype(np.int64)
    flat = grams.ravel()
    kept = flat >= 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets * n]
    powers = data + np.uint64(1)
    place = (np.arange(size) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    parts = (powers * MIX) ^ ((place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    parts = (parts ^ (parts >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = np.add.reduceat(parts, offsets[:-1]) if size else np.array([], np.uint64)
    return flat[kept], ends, hashes


def has_letter(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of each word, offsets of each word's) of distinct words: of their letters alone, lower-cased and framed."""
    bare = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{M}]+", ""))
    sizes = pc.utf8_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    framed = pc.binary_join_element_wise("\x02", bare, "\x03", "")
    points = np.frombuffer("".join(framed.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(2 * np.arange(len(sizes)), sizes)  # a frame is two points longer than its word
    return points[at] << np.uint64(42) | points[at + 1] << np.uint64(21) | points[at + 2], ends


def familiar_words(words: pa.Array, seen: np.ndarray) -> np.ndarray:
    """Whether each of distinct words is mostly made of trigrams seen."""
    grams, ends = trigrams(words)
    hits = np.concatenate([[0], np.cumsum(np.isin(grams, seen))])[ends]
    return np.diff(hits) >= FAMILIAR * np.maximum(1, np.diff(ends))


def familiarity(rows: np.ndarray, codes: np.ndarray, lettered: np.ndarray, familiar: np.ndarray) -> np.ndarray:
    """The share of each text's words with letters that are familiar."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[lettered]
    known = np.bincount(owner, familiar[codes[lettered]], len(rows) - 1)
    return known / np.maximum(1, np.bincount(owner, minlength=len(rows) - 1))


def shared_trigrams(rows: np.ndarray, codes: np.ndarray, words: pa.Array, texts: list[str]) -> np.ndarray:
    """Sorted trigrams that two different texts have: what one text alone has, garbled or not, is no evidence for it."""
    grams, ends = trigrams(words)
    own = []
    for i in {t: i for i, t in enumerate(texts)}.values():
        c = np.unique(codes[rows[i] : rows[i + 1]])
        own.append(np.unique(np.concatenate([grams[ends[k] : ends[k + 1]] for k in c])) if len(c) else grams[:0])
    found, n = np.unique(np.concatenate(own), return_counts=True) if own else (grams[:0], np.array([], np.int64))
    return found[n > 1]


def emissions(words: pa.Array, model_weights: np.ndarray, lexicon: np.ndarray, settings: Settings) -> np.ndarray:
    """Scores of distinct words by label; nothing for words without a letter."""
    out = np.zeros((len(words), model_weights.shape[1]), np.float32)
    for a in range(0, len(words), 8_000):
        part = words.slice(a, 8_000)
        grams, ends, hashes = windows(part, settings)
        summed = np.add.reduceat(model_weights[grams], ends[:-1], axis=0)
        summed /= np.maximum(1, np.diff(ends))[:, None] ** 0.5
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
            known = lexicon[at] == hashes
            summed[known] += model_weights[(1 << settings.buckets_log2) + at[known]]
        out[a : a + len(part)] = summed
    out[~has_letter(words)] = 0
    return out


def sequences(rows: np.ndarray, codes: np.ndarray, ends_sentence: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each sequence: a text's sentences, cut at `longest` words."""
    n = len(codes)
    if not n:
        return np.array([], np.int64), np.array([], np.int64)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first[1:n] |= ends_sentence[codes[:-1]]
    first[0] = True
    starts = np.flatnonzero(first[:n])
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    starts = np.flatnonzero(place % longest == 0)
    return starts, np.diff(np.append(starts, n))


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Marginals of every position, the log likelihood's normaliser by sequence, and with `pairs` the summed pair marginals.

    All sequences advance together; those already ended have sorted to the end and drop out.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels, most = scores.shape[1], int(lengths[0]) if len(lengths) else 0
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    t = np.exp(transitions)
    alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.empty(len(e), e.dtype)
    live = [int(np.searchsorted(-lengths, -k, side="left")) for k in range(most)]
    for k in range(most):
        at = starts[: live[k]] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        z = a.sum(axis=1)
        alpha[at], norm[at] = a / z[:, None], z
    joint = np.zeros((labels, labels))
    for k in range(most - 1, -1, -1):
        at = starts[: live[k]] + k
        b = np.full((len(at), labels), 1.0, e.dtype)
        if k + 1 < most:
            nxt = at[: live[k + 1]] + 1
            weighted = beta[nxt] * e[nxt] / norm[nxt][:, None]
            b[: live[k + 1]] = weighted @ t.T
            if pairs:
                joint += (alpha[nxt - 1].T @ weighted) * t
        beta[at] = b
    marginals = alpha * beta
    marginals /= np.maximum(marginals.sum(axis=1, keepdims=True), 1e-30)
    return marginals, float(np.log(norm).sum() + top.sum()), joint


def sentence_ends(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"[.!?]$").to_numpy(zero_copy_only=False)


def fit(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model:
    """Learn weights and transitions by gradient ascent on the conditional likelihood."""
    labels = sorted(set(langs))
    size = 1 << settings.buckets_log2
    if not labels:
        return Model([], np.zeros((size, 1), np.float32), np.array([], np.uint64), np.zeros((1, 1), np.float32), settings)
    rng = np.random.default_rng(settings.seed)
    rows, codes, words = words_of(pa.array(texts, pa.string()))
    codes = codes.astype(np.int64)
    doc_label = np.array([labels.index(x) for x in langs])
    gold = np.repeat(doc_label, np.diff(rows))
    starts, lengths = sequences(rows, codes, sentence_ends(words), settings.longest)
    # Half of the sentences stay as they are; the others are spliced in twos and threes whatever their language.
    shuffled = rng.permutation(len(starts))
    groups, k = [], 0
    while k < len(shuffled):
        take = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
        groups.append(shuffled[k : k + take])
        k += take
    parts = [np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in g]) for g in groups]
    order = np.concatenate(parts) if parts else np.array([], np.int64)
    seq_len = np.array([len(p) for p in parts], np.int64)
    seq_start = np.concatenate([[0], np.cumsum(seq_len)[:-1]]).astype(np.int64) if parts else seq_len
    word, gold = codes[order], gold[order]
    grams, ends, hashes = windows(words, settings)
    lettered = has_letter(words)
    top: set[int] = set()
    for label in range(len(labels)):
        counts = np.bincount(word[gold == label], minlength=len(words)) * lettered
        top |= {int(i) for i in np.argsort(-counts, kind="stable")[: settings.lexicon_words] if counts[i] > 1}
    lexicon = np.sort(hashes[sorted(top)]) if top else np.array([], np.uint64)
    at = np.minimum(np.searchsorted(lexicon, hashes), max(0, len(lexicon) - 1))
    known = (lexicon[at] == hashes) if len(lexicon) else np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    scale = 1 / np.maximum(1, np.diff(ends)) ** 0.5
    n_labels = len(labels)
    params = [np.zeros((size + len(lexicon), n_labels)), np.zeros((n_labels, n_labels))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gold_pairs = np.zeros((n_labels, n_labels))
    inner = np.ones(len(word), bool)
    inner[seq_start] = False
    np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    hot = np.zeros((len(word), n_labels))
    hot[np.arange(len(word)), gold] = 1
    for epoch in range(1, settings.epochs + 1):
        score = np.add.reduceat(params[0][grams], ends[:-1], axis=0) * scale[:, None]
        score[known] += params[0][size + at[known]]
        score[~lettered] = 0
        marginals, _, joint = forward_backward(score[word], seq_start, seq_len, params[1], pairs=True)
        missed = hot - marginals
        by_word = np.stack([np.bincount(word, missed[:, c], len(words)) for c in range(n_labels)], axis=1) / max(1, len(word))
        by_word[~lettered] = 0
        g = np.empty_like(params[0])
        weighted = by_word * scale[:, None]
        for c in range(n_labels):
            g[:, c] = np.bincount(grams, weighted[owner, c], len(g))
            g[:, c] += np.bincount(size + at[known], by_word[known, c], len(g)) if known.any() else 0
        grads = [g - settings.l2 * params[0] / size, (gold_pairs - joint) / max(1, len(word)) - settings.l2 * params[1]]
        for i, grad in enumerate(grads):  # Adam
            m, v = moments[i]
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            params[i] += settings.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.98**epoch)) + 1e-8)
    model = Model(labels, params[0].astype(np.float32), lexicon, params[1].astype(np.float32), settings)
    of_letters = lettered[codes] if len(codes) else np.array([], bool)
    seen = shared_trigrams(rows, codes, words, texts)
    familiar = familiarity(rows, codes, of_letters, familiar_words(words, seen))
    judged = np.bincount(np.repeat(np.arange(len(texts)), np.diff(rows))[of_letters], minlength=len(texts)) > 0
    usual = np.array([np.median(familiar[own]) if (own := judged & (doc_label == c)).any() else 0.0 for c in range(n_labels)])
    return model._replace(seen=seen, usual=usual)


def fair_share(lengths: list[int], budget: int) -> int:
    """The largest cap under which the lengths, each cut at it, stay within the budget together."""
    left, ordered = budget, sorted(lengths)
    for k, n in enumerate(ordered):
        if n * (len(ordered) - k) > left:
            return left // (len(ordered) - k)
        left -= n
    return ordered[-1] if ordered else 0


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows given: those of the least hash in each of `sample_docs` cells a language."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang")).where("row_id IS NOT NULL AND lang IS NOT NULL AND body IS NOT NULL")
    key = F.xxhash64(F.lit(settings.seed), F.col("row_id").cast("string"))
    cells = rows.select("lang", "row_id", key.alias("key")).groupBy("lang", F.pmod("key", F.lit(settings.sample_docs)).alias("cell")).agg(F.min(F.struct("key", "row_id")).alias("least"))
    picked = cells.select(F.col("lang").alias("of"), F.col("least.row_id").alias("picked")).distinct()
    # At most sample_docs rows a language, so they may be sent to every task.
    sample = rows.join(F.broadcast(picked), (F.col("row_id") == F.col("picked")) & (F.col("lang") == F.col("of"))).select("lang", "row_id", "body")
    sample = sample.groupBy("lang", "row_id").agg(F.min(F.left("body", F.lit(settings.sample_chars))).alias("body")).toPandas().sort_values(["lang", "row_id"])
    texts, langs = [], []
    for lang, group in sample.groupby("lang"):
        split = [re.findall(r"\s*\S+", text) for text in group["body"]]
        most = fair_share([len(words) for words in split], settings.sample_words)
        texts += ["".join(words[:most]) for words in split]
        langs += [lang] * len(split)
    return fit(texts, langs, settings)


def labelled(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row offsets, codes, marginals of each word, whether it has a letter, distinct words) of a batch of texts."""
    rows, codes, words = words_of(texts)
    score = emissions(words, model.weights, model.lexicon, model.settings)
    starts, lengths = sequences(rows, codes, sentence_ends(words), model.settings.longest)
    marginals, _, _ = forward_backward(score[codes], starts, lengths, model.transitions)
    return rows, codes, marginals, has_letter(words)[codes] if len(words) else np.array([], bool), words


def document_labels(rows: np.ndarray, marginals: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, its share, words with letters) of each text, from the marginals of its words."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))[lettered]
    own = marginals[lettered]
    counts = np.bincount(owner, minlength=n)
    share = np.stack([np.bincount(owner, own[:, c], n) for c in range(marginals.shape[1])], axis=1) / np.maximum(1, counts)[:, None]
    best = share.argmax(axis=1)
    return best, np.minimum(1.0, share[np.arange(n), best]), counts


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", inside: bool = False, judge: bool = False) -> DataFrame:
    """id_col, `lang_pred`, `score` of every row's whole text. inside: text_col is a field of the struct id_col, so no text goes twice.
    judge: also `known`, whether the text is in a learned language at all.
    """
    docs = docs.select(F.col(id_col).alias("row_id"), *([] if inside else [F.col(text_col).alias("body")]))
    id_type = dict(docs.dtypes)["row_id"]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(text_col)], names=["row_id", "body"]) if inside else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, UNKNOWN], object)
        for part in slices(paired(batches), 1, 1 << 20):
            rows, codes, marginals, lettered, words = labelled(part.column(1), model)
            best, score, counts = document_labels(rows, marginals, lettered)
            none = (counts == 0) | (not model.labels)
            out = {"row_id": part.column(0), "lang_pred": pa.array(names[np.where(none, len(model.labels), best)], pa.string()), "score": pa.array(np.where(none, 0.0, score))}
            if judge:
                familiar = familiarity(rows, codes, lettered, familiar_words(words, model.seen))
                out["known"] = pa.array(~none & (familiar >= KNOWN * model.usual[best]))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.mapInArrow(run, f"row_id {id_type}, lang_pred string, score double" + ", known boolean" * judge).withColumnRenamed("row_id", id_col)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, position, word, `label` and its marginal of every word of every row, for text that switches language."""
    docs = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    id_type = dict(docs.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, UNKNOWN], object)
        for part in slices(batches, 1, 2 << 20):
            rows, codes, marginals, lettered, words = labelled(part.column(1), model)
            best = np.where(lettered & bool(model.labels), marginals.argmax(axis=1), len(model.labels))
            owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            place = np.arange(len(codes)) - rows[:-1][owner]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(place.astype(np.int64)), words.take(pa.array(codes)), pa.array(names[best], pa.string()), pa.array(marginals.max(axis=1).astype(np.float64))], names=["row_id", "position", "word", "label", "marginal"])

    return docs.mapInArrow(run, f"row_id {id_type}, position long, word string, label string, marginal double").withColumnRenamed("row_id", id_col)
