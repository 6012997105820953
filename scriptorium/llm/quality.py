"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded (byte and byte-pair histograms, shape
and repetition figures), projected, weighted by gated attention and averaged; a logistic layer scores the average:
  h = tanh(W x);  a = softmax(w . (tanh(V h) * sigmoid(U h)));  score = sigmoid(c . sum(a h) + d)
Labels exist for documents only; the weights of passages are learnt from them.

Fitting uses a bounded sample of labelled rows: about `sample_docs` a class, of `sample_bytes` together, each with all its
passages. Scoring reads all passages of all documents and is map-only.

Null or empty text: one all-zero passage, scored like any other. No labelled rows: the score is 0.5. Rows whose label
repeats are used as often as they occur, also with different labels; which rows a sample takes is decided by the hash of doc_id,
so rows that share an id are taken or left together. A score of 0.5 counts as 1. Extra columns are ignored by `score`, kept by `keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import smallest_hashes
from .shared import release_memory

PASSAGE_BYTES = 1_024
PAIRS = 256
EXTRA = 10
WIDTH = 256 + PAIRS + EXTRA
HIDDEN, ATTENTION = 32, 16
#: Bounds of the training sample, per class: rows, and bytes of their texts.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 16 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 64, 0.01, 1e-4, 7


def passages(raw: bytes, size: int = PASSAGE_BYTES) -> list[bytes]:
    """Near-equal passages of at most `size` bytes that cover the whole text; one empty passage for an empty text."""
    n = max(1, -(-len(raw) // size))
    step = max(1, -(-len(raw) // n))
    return [raw[i : i + step] for i in range(0, len(raw), step)] or [b""]


def encode(parts: list[bytes]) -> np.ndarray:
    """Feature rows of passages."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(parts)), lengths)
    single = np.bincount(of * 256 + flat, minlength=256 * len(parts)).reshape(-1, 256).astype(np.float32)
    pair = (flat[:-1] * 131 + flat[1:] * 7919) % PAIRS
    same = of[:-1] == of[1:]
    double = np.bincount(of[:-1][same] * PAIRS + pair[same], minlength=PAIRS * len(parts)).reshape(-1, PAIRS).astype(np.float32)
    n = np.maximum(lengths, 1)[:, None].astype(np.float32)
    extra = np.zeros((len(parts), EXTRA), np.float32)
    for i, p in enumerate(parts):
        words = p.split()
        k = len(words) or 1
        extra[i] = (
            len(zlib.compress(p, 1)) / max(1, len(p)) if p else 0,
            len(set(words)) / k,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
            np.log1p(len(p)) / 7,
            len(p) / k / 20,
            p.count(b"\n") / k,
            sum(not w.isalnum() and not w[:-1].isalnum() for w in words) / k,
            sum(w.isupper() for w in words) / k,
            max(map(len, words), default=0) / 100,
            len({w[-3:] for w in words}) / k,
        )
    return np.concatenate([np.sqrt(single / n), np.sqrt(double / n), np.minimum(extra, 3)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated-attention pooling over passage features, with its own gradients."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": init(WIDTH, HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1), "c": init(HIDDEN, 1), "d": np.zeros(1, np.float32)}
        self.fitted = False

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags, one bag after the other; starts: first row of each bag."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((tv * su) @ p["w"])[:, 0]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "tv": tv, "su": su, "a": a, "bag": bag, "pooled": pooled, "score": _sigmoid(pooled @ p["c"] + p["d"])[:, 0]}

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)["score"] if self.fitted else np.full(len(starts), 0.5)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f, p = self.forward(x, starts), self.p
        g = ((f["score"] - y) * weight / len(y))[:, None].astype(np.float32)
        pooled = g @ p["c"].T
        per = pooled[f["bag"]]
        dot = (per * f["h"]).sum(1)
        e = f["a"] * (dot - np.add.reduceat(f["a"] * dot, starts)[f["bag"]])
        gate = e[:, None] @ p["w"].T
        gv, gu = gate * f["su"] * (1 - f["tv"] ** 2), gate * f["tv"] * f["su"] * (1 - f["su"])
        h = (f["a"][:, None] * per + gv @ p["V"].T + gu @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ h, "V": f["h"].T @ gv, "U": f["h"].T @ gu, "w": (f["tv"] * f["su"]).T @ e[:, None], "c": f["pooled"].T @ g, "d": g.sum(0)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        if not bags:
            return self
        weight = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        positive = float(np.clip(np.average(y, weights=weight), 0.02, 0.98))
        self.p["d"][:] = np.log(positive / (1 - positive))
        r, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                sizes = [len(bags[i]) for i in part]
                grads = self.gradients(np.concatenate([bags[i] for i in part]), np.cumsum([0, *sizes[:-1]]), y[part], weight[part])
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= (rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * self.p[k])).astype(np.float32)
        self.fitted = True
        return self


def fit(labelled: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on about `sample_docs` documents a class of (doc_id, text, quality), of `sample_bytes` at most; executors encode the bags.

    labels: (doc_id, quality), where `labelled` has none itself. Sizes and hashes are taken before the two are joined, so that choosing the
    sample moves no texts.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = [encode(passages((text or "").encode("utf-8"))).astype(np.float16).tobytes() for text in b["text"]]
            yield pd.DataFrame({"k": b["k"], "quality": b["quality"], "bag": bags})

    sized = labelled.select("*", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), F.xxhash64("text").alias("tag"))
    sized = sized if labels is None else sized.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    rows = sized.where("quality is not null").select("doc_id", "tag", "text", "n_bytes", F.col("quality").cast("int").alias("quality"))
    chosen = smallest_hashes(rows, "quality", ["doc_id", "tag"], sample_docs, F.col("n_bytes"), sample_bytes).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "text", "quality")
    got = sorted(chosen.mapInPandas(each, "k string, quality int, bag binary").collect(), key=lambda r: (r.k, r.quality, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in got]
    y = np.array([r.quality for r in got], np.float32)
    every = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}  # the sample is balanced; weights give the classes' true shares
    weight = np.array([every[int(q)] / max(1, (y == q).sum()) for q in y], np.float32)
    model = Model().fit(bags, y, weight / max(1e-9, weight.mean()) if len(y) else weight)
    del got, bags
    release_memory()  # the driver goes on with other stages
    return model


def score(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id (or all columns), score, predicted. The model is a broadcast of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep_columns else docs.select("doc_id", "text")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for at in range(0, len(texts), 64):
            bags = [passages((t or "").encode("utf-8")) for t in texts.iloc[at : at + 64]]
            starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
            out.append(m.scores(encode([p for b in bags for p in b]), starts))
        return pd.Series(np.concatenate(out).astype(float) if out else [], dtype=float)

    scored_rows = rows.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored_rows if keep_columns else scored_rows.drop("text")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, columns unchanged."""
    scored = score(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", "text"), model, keep_columns=True)
    return scored.where(F.col("score") >= threshold).select("_row.*")
