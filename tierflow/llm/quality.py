"""Quality filter by importance resampling over hashed n-grams.

Two bag-of-n-grams models over ``BUCKETS`` hashed buckets are estimated: one of
target texts, one of all raw texts.  The weight of a document is the ratio of
its likelihoods under the two; adding Gumbel noise to the log weights and taking
the ``k`` largest samples ``k`` documents without replacement in proportion to
their weights.

The target model is fitted on at most ``TARGET_ROWS`` labelled documents of good
quality, those with the smallest hash of their id.  The raw model counts every
document: a task sums its own counts, so the shuffle gets a row per bucket and
task.  Log ratios are rounded to 2^-20, which makes sums independent of the order
of rows, and noise is drawn from the document's id, so a run can be repeated.

The k-th largest score is found by counting scores by their 16 leading bits, then
the next 16 within the one value that holds it, and so on: four passes over one
column, 65,536 counts at most to the driver, no sort.

Nulls: a null or empty text has no n-grams and log weight zero; a null id draws
the noise of one fixed number.  Repeated rows score alike.  Ties with the k-th
score are kept, so ties may keep more than ``k``.  Without labels, or without
rows, nothing is known against a document and all are kept.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import append_columns, bounds, encoded, forget, slices, stored

BUCKETS = 10_000
TARGET_ROWS = 20_000
SEED = 7
#: Added to every count of both models, in shares of the mean count.
SMOOTHING = 0.01

_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SCALE = 1 << 20


def hashed_ngrams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, and each text's share.

    Text ``i`` has the buckets from ``edges[i]`` to ``edges[i + 1]``.
    """
    tokens = [_TOKEN.findall(text.lower()) for text in texts]
    hashes = np.concatenate(
        [np.zeros(0, np.uint64)]
        + [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in tokens]
    )
    edges = bounds(map(len, tokens))
    pairs = hashes.copy()
    pairs[1:] = (hashes[:-1] * _PAIR) ^ hashes[1:]
    pairs ^= pairs >> np.uint64(32)
    both = np.stack([hashes, pairs], axis=1) % np.uint64(buckets)
    use = np.ones(both.shape, bool)
    use[edges[:-1][np.diff(edges) > 0], 1] = False
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(use.sum(axis=1))])
    return both[use].astype(np.int64), kept[edges]


def ngram_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """How often each bucket occurs in all texts: ``bucket``, ``n``."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for piece in slices(batches, text):
            found, _ = hashed_ngrams(encoded(piece.column(text)), buckets)
            counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"]
        )

    rows = docs.select(text).mapInArrow(run, "bucket int, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Scaled log of target over raw probability per bucket, zero if either is empty."""
    models = []
    for counts in (target, raw):
        model = np.zeros(buckets)
        for row in counts.collect():
            model[row.bucket] = row.n
        if not model.sum():
            return np.zeros(buckets, np.int64)
        model += SMOOTHING * model.mean()
        models.append(np.log(model / model.sum()))
    return np.rint((models[0] - models[1]) * _SCALE).astype(np.int64)


def with_scores(docs: DataFrame, ratios: np.ndarray, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``log_weight``, ``score`` (with noise) and ``rank_key``.

    ``rank_key`` is the score as a long of the same order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batch):
        ratio = shared.value
        found, edges = hashed_ngrams(encoded(batch.column(text)), len(ratio))
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(ratio[found])])
        weight = (sums[edges[1:]] - sums[edges[:-1]]) / _SCALE
        score = weight + _gumbel(batch.column(doc))
        bits = (score + 0.0).view(np.int64)
        key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
        return {"log_weight": pa.array(weight), "score": pa.array(score), "rank_key": pa.array(key)}

    made = {"log_weight": "double", "score": "double", "rank_key": "bigint"}
    return append_columns(docs, made, run, text)


def _gumbel(ids: pa.Array) -> np.ndarray:
    """Gumbel noise by a hash of the id, the same wherever the row is read."""
    x = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    x = x.view(np.uint64) + np.uint64(SEED * int(_PAIR) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return -np.log(-np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52))


def kth_largest(keys: DataFrame, k: int, column: str = "rank_key") -> int | None:
    """The ``k``-th largest value of a long column, None if it has fewer rows."""
    low = 0
    for shift in (48, 32, 16, 0):
        rows = keys if shift == 48 else keys.where(F.shiftright(column, shift + 16) == low)
        counts = rows.groupBy(F.shiftright(column, shift).alias("digit")).count().collect()
        for row in sorted(counts, key=lambda r: -r.digit):
            if k <= row["count"]:
                low = row.digit
                break
            k -= row["count"]
        else:
            return None
    return low


def target_ids(labels: DataFrame, limit: int = TARGET_ROWS) -> tuple[DataFrame, float]:
    """Ids of good documents, at most ``limit``, and the share of good ones in all labels.

    A document with several labels is good if all say so.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    judged = judged.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = judged.where("quality = 1")
    total, n_good = judged.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("int"))).first()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")
    return chosen, (n_good or 0) / total if total else 1.0


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    target_rows: int = TARGET_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The ``share`` of ``docs`` that is chosen, with ``log_weight`` and ``score``.

    Without ``share``, it is that of good documents among all labelled ones.
    Columns of ``docs`` with the names of the new ones are replaced.
    """
    ids, good = target_ids(labels, target_rows)
    share = good if share is None else share
    ids = F.broadcast(ids.withColumnRenamed("doc_id", "__llm_target"))  # at most target_rows
    target = docs.join(ids, docs["doc_id"] == ids["__llm_target"], "left_semi")
    ratios = log_ratios(ngram_counts(target, buckets=buckets), ngram_counts(docs, buckets=buckets), buckets)
    scored = with_scores(docs, ratios)
    keys = stored(scored.select("rank_key"), "scores")
    least = kth_largest(keys, max(1, ceil(keys.count() * share)))
    forget(keys)
    chosen = scored if least is None or not ratios.any() else scored.where(F.col("rank_key") >= least)
    return chosen.drop("rank_key")
