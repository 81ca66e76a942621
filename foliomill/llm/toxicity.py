"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A text is cut
into windows (its words; a word over WINDOW_CHARS characters gives several), each window is
compressed with either dictionary, and the difference of the two lengths is held against
calibrated thresholds.  The shares of windows beyond the thresholds give a score from 0 to 1.

A window is framed by blanks and each of its bytes is written WIDEN times, so that a match in a
dictionary outweighs the fixed costs of a compressed block.  The toxic dictionary also holds
the ordinary one, so windows of common material cost the same in both.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import SPACE_CLASS, id_crc32, sub_batches, text_or_empty

WINDOW_CHARS = 48
WIDEN = 3
MARKS = ".,;:!?*%$&#|<>\"'()[]{}"
THRESHOLDS = (2, 4, 6, 8, 10, 12, 15, 18, 22)
LEVEL, TABLE_LOG = 13, 17
ORDINARY_BYTES, TOXIC_BYTES = 96 << 10, 32 << 10
#: Parts for calibration.
FOLDS = 3
#: What makes a window toxic: so many times the rate of ordinary texts (smoothed), and a likelihood ratio (G) that chance rarely gives.
RATIO, EVIDENCE = 8, 15


@dataclass
class ToxicityModel:
    """What a worker needs: two dictionaries' bytes, and the weights of the thresholds."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    constant: float | None = None  # the score where one class has no training rows

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def distances(self, windows: pa.Array) -> np.ndarray:
        """Bytes that each window takes with the ordinary dictionary beyond those with the toxic one."""
        if len(windows) == 0:
            return np.zeros(0, np.int64)
        if self._compressors is None:
            self._compressors = [_compressor(self.ordinary), _compressor(self.toxic + self.ordinary)]
        framed = pc.binary_join_element_wise(pa.scalar(" "), windows.cast(pa.string()), pa.scalar(" "), "")
        offsets = np.frombuffer(framed.buffers()[1], np.int32, len(framed) + 1, framed.offset * 4).astype(np.uint64) * WIDEN
        data = np.repeat(np.frombuffer(framed.buffers()[2], np.uint8, int(offsets[-1]) // WIDEN), WIDEN)
        segments = np.stack([offsets[:-1], np.diff(offsets)], 1)
        source = zstandard.BufferWithSegments(data.tobytes(), segments.tobytes())
        ordinary, toxic = (_lengths(c.multi_compress_to_buffer(source, threads=0)) for c in self._compressors)
        return ordinary - toxic

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text and threshold: the share of windows beyond it, and the logarithm of their number."""
        words, owner = window_words(texts)
        coded = words.dictionary_encode()
        distance = self.word_distances(coded.dictionary)[coded.indices.to_numpy()]
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.stack([np.bincount(owner, weights=distance >= t, minlength=len(texts)) for t in THRESHOLDS], 1)
        return np.concatenate([100 * hits / (n[:, None] + 10), np.log1p(hits)], 1)

    def word_distances(self, words: pa.Array) -> np.ndarray:
        """The greatest distance among the windows of each word."""
        long = pc.greater(pc.utf8_length(words), WINDOW_CHARS).to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        out[~long] = self.distances(words.filter(pa.array(~long)))
        for i in np.flatnonzero(long):
            word = words[int(i)].as_py()
            parts = pa.array([word[a : a + WINDOW_CHARS] for a in range(0, len(word), WINDOW_CHARS)])
            out[i] = self.distances(parts).max()
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, hash_log=TABLE_LOG, chain_log=TABLE_LOG)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


def _lengths(collection: zstandard.BufferWithSegmentsCollection) -> np.ndarray:
    return np.fromiter((len(collection[i]) for i in range(len(collection))), np.int64, len(collection))


def window_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts without marks at their ends, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = pc.utf8_trim(lists.flatten(), characters=MARKS)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def _trained(counts: dict[str, int], size: int, least: int, most: int) -> bytes:
    """A trained dictionary's bytes from windows, each as often as it occurs in texts."""
    samples = [bytes(np.repeat(np.frombuffer(f" {w} ".encode(), np.uint8), WIDEN)) for w, n in sorted(counts.items()) if n >= least for _ in range(min(n, most))]
    random.Random(7).shuffle(samples)
    whole = b"".join(samples)
    if len(samples) < 50 or len(whole) < 4 * size:
        return whole[:size]  # too little to train on: the windows themselves are the dictionary
    return zstandard.train_dictionary(size, samples, k=16 * WIDEN, d=8).as_bytes()


def _widened(words: list[str], size: int) -> bytes:
    return b"".join(bytes(np.repeat(np.frombuffer(f" {w} ".encode(), np.uint8), WIDEN)) for w in words)[:size]


def _tells(in_texts: list[np.ndarray], texts: tuple[int, int]) -> np.ndarray:
    """Which windows tell toxic from ordinary texts, by how many texts of either class have them."""
    (m, n), (ordinary, toxic) = in_texts, texts
    ratio = (n + 0.5) / (toxic + 1) / ((m + 0.5) / (ordinary + 1))
    both, share = np.maximum(m + n, 1), toxic / (ordinary + toxic)
    g = 2 * (n * np.log(np.maximum(n, 1) / (both * share)) + m * np.log(np.maximum(m, 1) / (both * (1 - share))))
    return (ratio >= RATIO) & (g >= EVIDENCE)


def _dictionaries(table: pa.Array, y: np.ndarray) -> tuple[bytes, bytes]:
    """Train the ordinary and the toxic dictionary on labelled texts."""
    words, owner = window_words(table)
    coded = words.dictionary_encode()
    vocabulary, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    seen = np.unique(owner * len(vocabulary) + codes)
    in_texts = [np.bincount(seen[(y == k)[seen // len(vocabulary)]] % len(vocabulary), minlength=len(vocabulary)) for k in (0, 1)]
    tells = _tells(in_texts, (int((y == 0).sum()), int((y == 1).sum())))
    ordinary = _trained({w: int(n) for w, n, t in zip(vocabulary, in_texts[0], tells) if not t}, ORDINARY_BYTES, 3, 30)
    toxic = _trained({w: int(n) for w, n, t in zip(vocabulary, in_texts[1], tells) if t}, TOXIC_BYTES, 1, 1000)
    # Windows that come out on the wrong side join the dictionary of their class, and the next pass sees them.
    for _ in range(2):
        distance = ToxicityModel(ordinary, toxic, np.zeros(1)).word_distances(coded.dictionary)
        false = np.flatnonzero((distance >= THRESHOLDS[1]) & (in_texts[0] > 0) & ~tells)
        missed = np.flatnonzero((distance < THRESHOLDS[4]) & tells)
        false = false[np.argsort(-in_texts[0][false], kind="stable")]
        missed = missed[np.argsort(-in_texts[1][missed], kind="stable")]
        ordinary = _widened([vocabulary[i] for i in false], ORDINARY_BYTES // 2) + ordinary
        toxic = toxic + _widened([vocabulary[i] for i in missed], TOXIC_BYTES // 2)
    return ordinary, toxic


def fit(texts: list[str], labels: list[int], toxic_share: float | None = None) -> ToxicityModel:
    """Train the dictionaries and calibrate the thresholds on labelled texts.

    Equal texts count once.  The thresholds are calibrated on distances that come from
    dictionaries trained without the texts at hand (FOLDS parts in turn); the final dictionaries
    see all texts.  toxic_share: share of toxic texts to calibrate for; that of `labels` by default.
    """
    once = {t: int(v) for t, v in zip(texts, labels)}
    texts, y = list(once), np.array(list(once.values()), float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(b"", b"", np.zeros(1), float(y[0]) if len(y) else 0.0)
    table, fold = pa.array(texts, pa.string()), np.zeros(len(y), np.int64)
    for k in (0, 1):  # either class is dealt evenly
        own = np.flatnonzero(y == k)
        fold[own] = np.random.default_rng(5).permutation(len(own)) % FOLDS
    features = np.zeros((len(y), 2 * len(THRESHOLDS)))
    for f in range(FOLDS):
        held = fold == f
        if held.any() and y[~held].sum() not in (0, (~held).sum()):
            features[held] = ToxicityModel(*_dictionaries(table.filter(pa.array(~held)), y[~held]), np.zeros(1)).features(table.filter(pa.array(held)))
    share = y.mean() if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return ToxicityModel(*_dictionaries(table, y), _logistic(features, y, weight))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Weights (constant first) of a penalised logistic fit by Newton's method."""
    scale = x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), x / scale], 1)
    w = np.zeros(z.shape[1])
    ridge = penalty * weight.sum() / len(w) * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = 5, max_rows_per_class: int = 2000, max_sample_chars: int = 40_000) -> ToxicityModel:
    """Fit a model on a bounded sample of labelled rows.

    Only ids whose crc32 (of their decimal text) mod `folds` is not 0 are learnt from.  Of those,
    at most max_rows_per_class per label, in the order of a hash of the id, and about
    max_sample_chars characters of a text: of a longer one every k-th word, from its beginning to its
    end.  These bounds are for the fit alone; scoring reads everything.  An id with several labels
    counts as toxic if one of them says so; of several texts of an id the last in order is taken.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (id_crc32(id_col) % folds != 0))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label")))
    totals = {int(r["_label"]): r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_label = 1").orderBy(*by_hash).limit(max_rows_per_class).unionAll(
        known.where("_label = 0").orderBy(*by_hash).limit(max_rows_per_class))
    sample = (docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
              .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most 2 * max_rows_per_class rows
              .withColumn("_text", _thinned(F.col("_text"), max_sample_chars))
              .groupBy("_id", "_label").agg(F.max("_text").alias("_text")).orderBy("_id"))
    rows = sample.select("_text", "_label").collect()
    texts, values = [r["_text"] for r in rows], [r["_label"] for r in rows]
    del rows
    model = fit(texts, values, totals.get(1, 0) / max(1, sum(totals.values())))
    pa.default_memory_pool().release_unused()
    return model


def _thinned(text: Column, most: int) -> Column:
    """A text of up to `most` characters, or every k-th word of a longer one."""
    step = F.array(F.ceil(F.length(text) / F.lit(float(most))).cast("int"))  # in an array, so that it is computed once
    picked = F.element_at(F.transform(step, lambda k: F.array_join(F.filter(F.split(text, SPACE_CLASS + "+"), lambda w, i: i % k == 0), " ")), 1)
    return F.when(F.length(text) <= most, text).otherwise(picked)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """Add the toxicity score of each whole text.

    Null and empty texts have no windows and get the score of a text without any hit; texts of any
    length are scored whole.  All other columns of `docs` (or those in `keep`) stay, one named
    `out_col` is replaced; repeated rows are scored each for itself.  An empty table gives an empty
    result.  Without labelled rows the score is 0, with one class alone that class's.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, len(kept)):
                scores = shared.value.scores(batch.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*kept, out_col])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(F.col(f"`{text_col}`")).alias("__tox_text"))
    return source.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out_col, T.DoubleType()))
