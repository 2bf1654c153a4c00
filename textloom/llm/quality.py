"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions of low rank, in
time linear in a document's features, by the sum-of-squares identity. The features are: words and word shapes, hashed to `buckets`
(weight log(1 + count), scaled to unit length); statistics of the whole text's structure; and metadata (the stated number of
characters). labels, lang, source and doc_id are no features.

The model is fitted on the driver, on at most `sample` labelled documents, chosen by a hash of their id; that bound is the
parameter, whatever the corpus' size. Scoring reads each whole text once, without a shuffle; the model is a broadcast of fixed size.
Rows whose crc32(id) mod 5 is 0 are held out: they are never fitted on.

Defined cases. Null text counts as empty and is scored by its structure. A null id is held out. A document labelled more than once
has its lowest label. Without labels, or with one label only, every score is the smoothed rate of label 1. Repeated rows repeat their
score; other columns are kept by `classify`, which replaces only held_out, score and predicted. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import meeting
from textloom.llm.storage import column, small_batches

SAMPLE, BUCKETS, RANK, THRESHOLD, SEED = 3000, 1 << 15, 8, 0.3, 11
EPOCHS, RATE, L2, BATCH = 30, 0.08, 2e-4, 256
#: The columns that `classify` adds.
OWN = ("held_out", "score", "predicted")
SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
STATS = (
    "log words", "log characters", "word length", "distinct words", "commonest word", "equal neighbours", "distinct pairs", "upper case", "digits", "log symbols", "symbols", "log bars", "log exclamation marks",
    "letters beyond ASCII", "full stops", "commas", "line breaks", "distinct lines", "longest word", "words with a symbol", "words in capitals", "stated characters",
)
_symbolic = re.compile(r"[#$%&*+<=>@\[\\\]^_`{|}~!]")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Featuriser:
    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.at: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if len(self.at) > 150_000:
            self.at.clear()
        b = self.at[word] = zlib.crc32(word.encode("utf-8", "replace")) % self.buckets
        return b

    def _shape(self, word: str) -> str:
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        return "\x00" + "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])

    def __call__(self, text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, size = len(words), max(1, len(raw))
        count = Counter(words)
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
        symbols = int(seen[list(SYMBOLS)].sum())
        odd = caps = 0
        shapes: Counter = Counter()
        for w, k in count.items():
            if not w.isalpha():
                if _symbolic.search(w):
                    odd += k
                shapes[self._shape(w)] += k
            if len(w) > 1 and w.isupper():
                caps += k
        at = self.at
        ids = np.fromiter((at[w] if w in at else self._bucket(w) for w in words), np.int64, n)
        pairs = ids[:-1] * self.buckets + ids[1:]
        stats = np.array([
            np.log1p(n) / 5, np.log1p(len(text)) / 7, len(text) / max(1, n) / 6, len(count) / max(1, n), max(count.values(), default=0) / max(1, n), float((ids[1:] == ids[:-1]).sum()) / max(1, n), len(np.unique(pairs)) / max(1, n - 1),
            seen[65:91].sum() / size * 5, seen[48:58].sum() / size * 5, np.log1p(symbols) / 3, symbols / size * 5, np.log1p(seen[124]) / 3, np.log1p(seen[33]) / 3, seen[128:].sum() / size * 2,
            seen[46] / max(1, n) * 3, seen[44] / max(1, n) * 3, np.log1p(seen[10]) / 3, len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, count), default=0)) / 4, odd / max(1, n), caps / max(1, n), np.log1p(max(0, stated if stated is not None else len(text))) / 7,
        ], np.float32)
        of_shapes = np.fromiter((at[s] if s in at else self._bucket(s) for s in shapes), np.int64, len(shapes))
        own, back = np.unique(np.concatenate([ids, of_shapes]), return_inverse=True)
        k = np.bincount(back, np.concatenate([np.ones(n), np.fromiter(shapes.values(), float, len(shapes))]), len(own))
        x = np.log1p(k).astype(np.float32)
        return own.astype(np.int32), x / max(1e-6, float(np.sqrt((x * x).sum()))), stats


class FactorisationMachine:
    """Parameters: w0, w (a weight each feature) and v (a row of factors each feature); the statistics come behind the buckets."""

    def __init__(self, features: int, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.float32(0), np.zeros(features, np.float32), rng.normal(0, 0.03, (features, rank)).astype(np.float32)

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, batch: int = BATCH, seed: int = SEED) -> FactorisationMachine:
        """Logistic loss, AdaGrad, mini-batches in a fixed order."""
        rng, features, rank = np.random.default_rng(seed), len(self.w), self.v.shape[1]
        p = min(max(labels.mean(), 0.01), 0.99)
        self.w0 = np.float32(np.log(p / (1 - p)))
        g0, gw, gv = 1e-6, np.full(features, 1e-6, np.float32), np.full((features, rank), 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                ids, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
                doc = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                starts = np.searchsorted(doc, np.arange(len(some)))
                vx = self.v[ids] * x[:, None]
                s = np.add.reduceat(vx, starts, axis=0)
                m = self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[some]).astype(np.float32) / len(some)
                ex = e[doc] * x
                used, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, ex, len(used)).astype(np.float32) + l2 * self.w[used]
                pull = ex[:, None] * (s[doc] - vx)
                dv = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(rank)], 1).astype(np.float32) + l2 * self.v[used]
                g0 += float(e.sum()) ** 2
                self.w0 -= np.float32(rate * e.sum() / np.sqrt(g0))
                gw[used] += dw * dw
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                gv[used] += dv * dv
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def _joined(f: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    ids, x, stats = f
    return np.concatenate([ids, np.arange(buckets, buckets + len(stats), dtype=np.int32)]), np.concatenate([x, stats])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """From at most `sample` labelled documents that aren't held out."""
    import pyarrow as pa

    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).cast("int").alias("__label"))
        .where(~held_out("__id"))
        .orderBy(F.xxhash64("__id", F.lit(SEED)), "__id")
        .limit(sample)
    )
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), stated.alias("stated")).join(F.broadcast(chosen), "__id").select("__id", "text", "stated", "__label")

    def features(batches):
        f = Featuriser(buckets)
        for batch in batches:
            ids, xs = [], []
            for text, n in zip(batch.column(1), batch.column(2), strict=True):
                i, x = _joined(f(text.as_py(), n.as_py()), buckets)
                ids.append(i.astype("<i4").tobytes())
                xs.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "label": batch.column(3), "ids": pa.array(ids, pa.binary()), "x": pa.array(xs, pa.binary())})

    # repeated documents are fitted on once, so no more than `sample` rows arrive
    found = sorted(rows.dropDuplicates(["__id"]).mapInArrow(features, "id string, label int, ids binary, x binary").collect(), key=lambda r: r.id)
    model = FactorisationMachine(buckets + len(STATS), rank)
    y = np.array([r.label for r in found], np.float32)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        model.w0, model.v = np.float32(np.log(p / (1 - p))), np.zeros_like(model.v)
        return model
    return model.fit([(np.frombuffer(r.ids, "<i4"), np.frombuffer(r.x, "<f4")) for r in found], y)


def classify(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", own: tuple[str, ...] = OWN) -> DataFrame:
    """docs with held_out, score and predicted, or as `own` names them."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on buckets and rank alone
    kept = [c for c in docs.columns if c.lower() not in own]
    stated = kept.index("n_chars") if "n_chars" in kept else None
    at = kept.index(text_col)

    def scored(batches):
        f, m = Featuriser(buckets), shared.value
        for batch in batches:
            numbers = batch.column(stated) if stated is not None else None
            scores = [1 / (1 + np.exp(-np.clip(m.margin(*_joined(f(t.as_py(), numbers[k].as_py() if numbers is not None else None), buckets)), -30, 30))) for k, t in enumerate(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
        f.at.clear()
        meeting.released()

    # numbered columns for the way through Python, which takes plain names only
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]).add("score", "double")
    out = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)]).mapInArrow(scored, schema)
    added = (held_out(f"c{kept.index(id_col)}"), F.col("score"), (F.col("score") >= threshold).cast("int"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[c.alias(n) for c, n in zip(added, own, strict=True)])


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of threshold or more, with the columns of docs."""
    # the caller's columns travel as one struct, so none of their names can clash with those of the scores
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    return classify(rows, model, threshold).where("predicted = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
