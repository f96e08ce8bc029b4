"""Quality classifier by Bradley-Terry ranking: a linear score learned from pairs of a better and a worse document.

The chance that one document is better than another is the logistic function of the difference of their scores, so
the weights come from a logistic loss on differences of feature vectors, without an intercept, over a bounded sample.
The threshold is the quantile of the scores of all training documents that rejects as large a share as is labelled bad;
scores are then mapped to 0..1 so that this quantile stands at the wanted cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import crc_bucket, id_and_text, map_arrow
from loomstone.plans.session import written

#: Bound of the labelled sample that the classifier is fitted on (rows, per label), and of the pairs drawn from it.
SAMPLE_ROWS, PAIRS = 6000, 60_000
#: Bounds of what the driver gets for a quantile: bins of a histogram, and values of the bin that holds the rank.
BINS, FEW = 1024, 10_000
CUT = 0.7
SEED = 20_240_229

NAMES = (
    "log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeated_next", "upper_letters", "capital_words", "digits", "punctuation",
    "odd_marks", "decorated_words", "double_marks", "bars", "pipes_per_line", "lines", "words_per_line", "repeated_lines", "short_lines", "sentence_ends", "non_ascii",
)
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
ODD = b"#$%&*!@^~|<>{}[]\\"
MARKS = ODD + b".,;:?'\"()-_/+="
ABOVE = bytes(range(128, 256))


def features(text: str) -> list[float]:
    """Shape of a text: repetition, case, marks, lines; every value is finite, also for an empty text."""
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, size, m = len(words), max(1, len(raw)), len(lines)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    w1 = max(1, n)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    letters = max(1, len(raw) - len(raw.translate(None, LETTERS)))
    return [
        math.log1p(n),
        min(30, size / w1),
        sum(len(w) > 15 for w in words) / w1,
        len(counts) / w1 ** 0.9,
        max(counts.values(), default=0) / w1,
        sum(map(bytes.__eq__, words, words[1:])) / w1,
        (len(raw) - len(raw.translate(None, UPPER))) / letters,
        sum(w.isupper() for w in words) / w1,
        share(DIGITS),
        share(MARKS),
        share(ODD),
        sum(w[-1] in ODD for w in words) / w1,
        sum(raw.count(c * 2) for c in (b"!", b"#", b"$", b"%", b"&", b"*")) / w1,
        counts.get(b"|", 0) / w1,
        math.log1p(counts.get(b"|", 0) / m),
        math.log1p(m),
        math.log1p(n / m),
        1 - len(set(lines)) / m,
        sum(len(x) < 20 for x in lines) / m,
        sum(w[-1] in b".!?" for w in words) / w1,
        share(ABOVE),
    ]


def fit(x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights from preference pairs; with one label only, weights of zero.

    Pairs are drawn with a fixed seed from the cross product of both labels; Newton's method with a small penalty.
    """
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(len(NAMES)), x.std(axis=0) + 1e-6 if len(x) else np.ones(len(NAMES))
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([z, np.abs(z), z * z / 4])
    good, bad = z[label == 1], z[label == 0]
    w = np.zeros(z.shape[1] if len(x) else 3 * len(NAMES))
    if len(good) and len(bad):
        rng = np.random.default_rng(SEED)
        d = good[rng.integers(0, len(good), PAIRS)] - bad[rng.integers(0, len(bad), PAIRS)]
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = d.T @ p / len(d) - 1e-3 * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    return {"mean": mean, "scale": scale, "w": w}


def linear(model: dict, x: np.ndarray) -> np.ndarray:
    """Row by row, so that a document's score is the same in every batch."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return (np.hstack([z, np.abs(z), z * z / 4]) * model["w"]).sum(axis=1)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """0 to 1; CUT where the linear score is at the threshold."""
    return 1 / (1 + np.exp(-np.clip(4 * (linear(model, x) - model["threshold"]) / model["spread"] + math.log(CUT / (1 - CUT)), -30, 30)))


def at_rank(values: DataFrame, rank: int) -> float:
    """The value of a rank (from 0) of the column ``s``, by histograms that narrow down to the rank's bin."""
    part, low = values.select("s"), None
    while True:
        if low is not None:
            part = values.select("s").where(F.col("s").between(low, high))
        least, most, n = part.agg(F.min("s"), F.max("s"), F.count(F.lit(1))).first()
        if least == most:
            return least
        if n <= FEW:
            return sorted(r.s for r in part.collect())[rank]
        place = F.floor((F.col("s") - least) / (most - least) * BINS)
        for b in sorted(part.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if rank < b.n:
                low, high = b.low, b.high
                break
            rank -= b.n


def thresholds(docs: DataFrame, known: DataFrame, model: dict) -> dict[str, float]:
    """The quantile of all training documents' scores at the share of bad labels, between both sides of it, so that ties fall
    on neither; and the spread of these scores. No text is dealt out."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(linear(model, x))], ["label_id", "s"])

        return fn

    scored = map_arrow(docs.where("doc_id is not null"), make, "label_id long, s double")
    scored = written(scored.join(known.select("label_id", "label").hint("merge"), "label_id").select("label", "s"), "quality-scores")
    n, bad, spread = scored.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0), F.stddev_pop("s")).first()
    if not n:
        return {"threshold": 0.0, "spread": 1.0}
    threshold = (at_rank(scored, max(0, bad - 1)) + at_rank(scored, min(bad, n - 1))) / 2
    return {"threshold": threshold, "spread": float(f"{spread:.9g}") or 1.0}  # the last digits hang on the order of the sum


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on at most SAMPLE_ROWS labelled documents of each label, chosen by the hash of the id, whose crc32 bucket is not held out;
    the threshold is over all of those that are not held out.

    Labels that are null, neither 0 nor 1, or contradict each other for one id are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    known = known.where(crc_bucket(F.col("label_id"), 4) != 2).groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    # A bounded sample of ids, spread by their hash, settled before any text is read.
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_ROWS).select("label_id", "label")
        picked = part if picked is None else picked.unionByName(part)
    rows = id_and_text(docs, id_col, text_col)
    chosen = rows.join(F.broadcast(picked), rows.doc_id == picked.label_id)
    chosen = chosen.groupBy("label_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")  # one row for each id, also where documents repeat it

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

        return fn

    sample = map_arrow(chosen, make, "label int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = np.array(sample.column("label").to_pylist(), np.int64)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the same weights however the rows arrive
    model = fit(x[order], y[order])
    return model | thresholds(rows, known, model)


def quality_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= CUT). Only the text is scored; a null text counts
    as empty and has a score too; repeated rows and null ids have theirs; other columns are left out. No shuffle."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, x))], ["doc_id", "score"])

        return fn

    scored = map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id long, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that the classifier does not reject. Whole rows pass through one narrow step."""
    place = docs.columns.index(text_col)

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t or "") for t in batch.column(place).to_pylist()], np.float64).reshape(-1, len(NAMES))
            return batch.filter(pa.array(score(model, x) >= CUT))

        return fn

    return map_arrow(docs, make, docs.schema)

