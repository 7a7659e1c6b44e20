"""Quality classifier: attention-based multiple-instance learning over passages (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmatch.llm.common import table

#: Words of a passage, hashed byte pairs, and units of the encoder and of the attention.
PASSAGE, PAIRS, HIDDEN, ATTENTION = 64, 48, 24, 12
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def _classes() -> np.ndarray:
    """Class of every byte: other, lower, capital, digit, blank, newline, sentence mark, symbol, non-ASCII."""
    kind = np.zeros(256, np.int64)
    for at, members in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), (10,), b".,;:'\"-()", b"#*$%&|<>!?{}[]\\/=_~^@+", range(128, 256)), 1):
        kind[list(members)] = at
    return kind


KIND = _classes()
WIDTH = 9 + PAIRS + 4


def passages(data: bytes | None) -> np.ndarray:
    """One row of shares per passage of 64 words; a text without words is one passage of zeros."""
    words = (data or b"").split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    octets = np.frombuffer(data, np.uint8)
    blank = BLANK[octets]
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    of = np.maximum(0, np.cumsum(begins) - 1) // PASSAGE
    n = (len(words) + PASSAGE - 1) // PASSAGE
    size = np.bincount(of, minlength=n)[:, None]
    kinds = np.bincount(of * 9 + KIND[octets], minlength=9 * n).reshape(n, 9) / size
    pair = (octets[:-1].astype(np.int64) * 31 + octets[1:] * 17) % PAIRS
    pairs = np.sqrt(np.bincount(of[:-1] * PAIRS + pair, minlength=PAIRS * n).reshape(n, PAIRS) / size)
    more = np.empty((n, 4))
    for i in range(n):
        own = words[i * PASSAGE : (i + 1) * PASSAGE]
        more[i] = len(set(own)) / len(own), sum(map(len, own)) / len(own) / 10, len(own) / PASSAGE, own[1:].count(own[0]) / len(own)
    return np.hstack([kinds, pairs, more]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and score: all weights are learned from document labels only."""

    def __init__(self, width: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        shapes = {"w": (width, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (draw.normal(0, 1 / np.sqrt(s[0]), s) * (k not in "bd")) for k, s in shapes.items()}

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``rows`` of all documents; a document's passages begin at its entry of ``starts``."""
        p = self.p
        sizes = np.diff(np.append(starts, len(rows)))
        x = (rows - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"]), "sizes": sizes}

    def gradients(self, f: dict[str, np.ndarray], labels: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(labels)
        dy = (f["y"] - labels) / n
        dz = np.repeat(dy[:, None] * p["c"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        gate = f["t"] * f["s"]
        dg = de[:, None] * p["a"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "w": f["x"].T @ dx, "b": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": gate.T @ de,
            "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }

    def fit(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Full-batch Adam on the mean log loss."""
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-3
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            grads = self.gradients(self.forward(rows, starts), labels, starts)
            for k, g in grads.items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, data: bytes | None) -> tuple[float, int, int]:
        """Score, number of passages, and the passage with the most attention."""
        rows = passages(data)
        f = self.forward(rows, np.zeros(1, np.int64))
        return float(f["y"][0]), len(rows), int(f["a"].argmax())


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_labelled: int = 4000, most_passages: int = 64,
) -> Model:
    """A model of at most ``most_labelled`` labelled documents outside the held-out fold.

    They are chosen by the hash of their identifier among those of up to ``most_passages`` passages,
    which bounds what the driver learns from (62 MB at most, far less as a rule). Null labels and
    identifiers, and identifiers with both labels, are left out. Without labels all scores are even.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna().where(~held_out("__id"))
        .groupBy("__id").agg(F.min("__label").alias("__low"), F.max("__label").alias("__label")).where("__low = __label")
        .orderBy(F.xxhash64("__id"), "__id").limit(most_labelled).select("__id", F.col("__label").cast("int").alias("__label"))
    )
    ours = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(t.as_py()) for t in batch.column(1)]
            keep = [i for i, r in enumerate(rows) if len(r) <= most_passages]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([rows[i].tobytes() for i in keep], pa.binary())], names=["label", "rows"]
            )

    # The identifiers are at most most_labelled numbers, so they are sent to every task.
    found = ours.join(F.broadcast(chosen), "__id").select("__label", "__text").mapInArrow(run, "label int, rows binary").collect()
    model = Model(WIDTH)
    if not found:
        return model
    found.sort(key=lambda r: (r["rows"], r["label"]))
    parts = [np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH) for r in found]
    sizes = np.array([len(x) for x in parts])
    return model.fit(np.concatenate(parts), np.cumsum(sizes) - sizes, np.array([r["label"] for r in found], float))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score of every whole text: ``doc_id, held_out, score, predicted, n_passages, top_passage``.

    Null and blank texts are one passage without words. Identifiers may be null (held out as the
    empty string is) or repeat; rows are independent. Only the text enters the score.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(2)]
            columns = list(zip(*found)) or [[], [], []]
            kinds = pa.float64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "held_out", "score", "n_passages", "top_passage"],
            )

    schema = T.StructType([
        T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("n_passages", T.LongType()), T.StructField("top_passage", T.LongType()),
    ])
    rows = df.select(F.col(id_col).alias("__id"), held_out(id_col).alias("__held"), F.col(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(run, schema).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage"
    )


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
