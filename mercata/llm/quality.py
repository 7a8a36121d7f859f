"""Quality classifier on supervised subword embeddings.

A text's features are its words, the character n-grams of each word (with
marks at its ends) and a mark for a word that repeats the one before it, all
hashed into one table of learned vectors. Their average passes a softmax over
two classes. Vectors and output are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands for "the word before, again" among the words.
AGAIN = "\x00="
#: Words whose parts a task remembers, and texts it looks up together.
REMEMBERED, TOGETHER = 300_000, 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dims: int = 8
    grams: tuple[int, ...] = (2, 3)
    epochs: int = 8
    rate: float = 4.0
    seed: int = 11


@dataclass
class Model:
    """What a text's score needs: each bucket's part of the difference of the two outputs."""

    settings: Settings
    parts: np.ndarray
    bias: float

    def score(self, total: float, n: int) -> float:
        z = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, with the word each belongs to.

    All words' code points, marked at both ends, stand in one array, so that
    the n-grams of all of them are hashed at once.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), sizes)
    hashed = [np.fromiter((xxhash.xxh3_64_intdigest(w) % settings.buckets for w in words), np.int64, len(words))]
    owners = [np.arange(len(words))]
    for n in settings.grams:
        span = max(0, len(codes) - n + 1)
        gram = np.full(span, n, np.uint64)
        for k in range(n):
            gram = (gram ^ codes[k : k + span]) * _MIX
            gram ^= gram >> np.uint64(32)
        inside = owner[:span] == owner[n - 1 :]
        hashed.append((gram[inside] % np.uint64(settings.buckets)).astype(np.int64))
        owners.append(owner[:span][inside])
    return np.concatenate(hashed), np.concatenate(owners)


def feature_count(words: list[str], settings: Settings) -> int:
    """How many features the words have: each one, and its n-grams with the two marks."""
    lengths = Counter(map(len, words))
    return sum(n * (1 + sum(max(0, size + 3 - g) for g in settings.grams)) for size, n in lengths.items())


def words_of(text: str | None) -> list[str]:
    """Words of a text, with AGAIN after each that repeats the one before it."""
    words = (text or "").split()
    again = list(compress(words, map(eq, words, words[1:])))
    return words + [AGAIN] * len(again)


def train(samples: list[tuple[dict[str, int], int]], settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on (word counts, label) pairs; without any, every score is 0.5."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dims, 1 / settings.dims, (settings.buckets, settings.dims))
    weights, bias = np.zeros((2, settings.dims)), np.zeros(2)
    rows = []
    for counts, label in samples:
        if counts:
            ids, owner = features(list(counts), settings)
            at, back = np.unique(ids, return_inverse=True)
            share = np.bincount(back, weights=np.array(list(counts.values()), dtype=np.float64)[owner])
            rows.append((at.astype(np.int32), (share / share.sum()).astype(np.float32), label))
    steps = max(1, settings.epochs * len(rows))
    step = 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, share, label = rows[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[at]
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = p @ weights
            weights -= 0.1 * rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[at] -= rate * share[:, None] * back
    return Model(settings, vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            counts = Counter(words_of(text.as_py()))
            yield pa.record_batch(
                [
                    pa.array([list(counts)], pa.list_(pa.string())),
                    pa.array([list(counts.values())], pa.list_(pa.int64())),
                    pa.array([label], pa.int32()),
                ],
                names=["words", "counts", "label"],
            )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int
) -> list[tuple[dict[str, int], int]]:
    """Word counts and label of at most ``fit_rows`` labelled rows, the same at every run.

    The rows are those with the smallest hashes of their ids, of all labels
    whose id ``docs`` has; a label other than 0 or 1 is no label. Their ids,
    at most ``fit_rows``, are broadcast.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "id")
        .select("text", "label", "id")
        .orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
        .limit(fit_rows)
        .mapInArrow(_counts, "words array<string>, counts array<long>, label int")
    )
    return [(dict(zip(r["words"], r["counts"], strict=True)), r["label"]) for r in rows.toLocalIterator()]


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, float] = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(begin, TOGETHER)
                texts = [words_of(t) for t in b.column(1).to_pylist()]
                new = list(set().union(*texts).difference(sums))
                at, owner = features(new, model.settings)
                sums.update(zip(new, np.bincount(owner, model.parts[at], len(new)).tolist(), strict=True))
                scores = [
                    model.score(sum(map(sums.__getitem__, words)), feature_count(words, model.settings)) for words in texts
                ]
                yield pa.record_batch([b.column(0), pa.array(scores, pa.float64())], names=["row", "score"])
                if len(sums) > REMEMBERED:
                    sums.clear()

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    fit_rows: int = 3000,
    held_out: int = 5,
    settings: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    ``score`` (0 to 1) is higher the likelier label 1 is; ``predicted`` is 1
    if it is at least ``threshold``. Columns of these names are replaced. A
    row is held out if crc32 of its id (as text) is a multiple of
    ``held_out``; labels are learned only from other rows, at most
    ``fit_rows`` of them, from their texts alone. Every row is scored on its
    whole text.

    Null, empty and blank texts have no features and get the score of the
    bias alone; a null id isn't held out and teaches nothing. Rows that repeat
    are scored alike. Of several labels of an id the smallest counts. Without
    usable labels every score is 0.5. An empty table gives an empty result.
    """
    number = F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out
    apart = F.coalesce(number == 0, F.lit(False))
    teach = labels.where(~F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out == 0, F.lit(True)))
    model = train(labelled_sample(docs, teach, id_col, text_col, label_col, fit_rows), settings)
    added = ("held_out", "score", "predicted")
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], apart.alias("_apart")).alias("row"), F.col(text_col).alias("text")
    )
    scored = rows.mapInArrow(_scorer(model), StructType().add("row", rows.schema["row"].dataType).add("score", "double"))
    return scored.select(
        *[F.col(f"row.`{c}`") for c in kept],
        F.col("row._apart").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
