"""Quality classifier: a factorisation machine.

Features of a text: its distinct lower-cased words hashed into BUCKETS (presence, scaled to unit length),
structure statistics (shares of marks, capitals, digits, repeats and so on, from 0 to 1), and as metadata its size
class and line-count class. The score is the logistic of
``w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]``, in time linear in the features.

Training is data-parallel on a sample of labelled rows outside the held-out fold (MAX_ROWS on average at most):
in each round every partition runs AdaGrad passes from the same start, and the partitions' parameters are averaged
by their row counts. A partition returns one parameter vector, whose size doesn't depend on the data.

Cases: null and empty texts have the constant and size features alone and get a score like any other; a null id
counts as an empty text in the fold rule; repeated rows get equal scores and are trained on once; without training rows
the score is 0.5; a very long text is scored with its distinct words' features alone; an empty table gives an empty result; other input columns don't matter.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curves.llm.common import held_out, stored, table, training_rows

BUCKETS, FACTORS, MAX_ROWS, ROUNDS, PASSES, RATE, DECAY = 1 << 14, 8, 10_000, 5, 2, 0.1, 1e-5
ROWS_A_PARTITION, MINIBATCH, SCORED_AT_ONCE = 2_500, 32, 256
N_STATS, N_CLASSES = 10, 12
SIZE = BUCKETS + 1 + N_STATS + 2 * N_CLASSES


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the features of a text."""
    ws = text.split()
    n, chars = max(len(ws), 1), max(len(text), 1)
    distinct = set(ws)
    hashed = np.fromiter({zlib.crc32(w.encode()) % BUCKETS for w in {w.lower() for w in distinct}}, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(1 for w in ws if len(w) > 1 and w.isupper())
    marks = sum(text.count(c) for c in "#*$%&|<>")
    stats = [
        marks / chars * 5, text.count("!") / chars * 5, upper / n, sum(1 for w in ws if not any(c.isalpha() for c in w)) / n,
        1 - len(distinct) / n, sum(map(str.__eq__, ws, ws[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1),
        min(chars / n / 20, 1.0), sum(1 for x in lines if x.rstrip()[-1] in ".!?") / max(len(lines), 1), n < 20,
    ]
    classes = [min(int(n).bit_length(), N_CLASSES - 1), N_CLASSES + min(len(lines).bit_length(), N_CLASSES - 1)]
    idx = np.concatenate([hashed, BUCKETS + np.arange(1 + N_STATS), BUCKETS + 1 + N_STATS + np.array(classes)])
    val = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(len(hashed), 1))), [1.0], np.clip(stats, 0, 1), [0.5, 0.5]])
    return idx.astype(np.int32), val.astype(np.float32)


def raw_scores(params: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    """(scores, and what the gradient needs) of feature rows; params: a row for each feature, (w, v_1 .. v_k)."""
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    lens = np.array([len(r[0]) for r in rows])
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    px = params[idx] * val[:, None]
    sums = np.add.reduceat(px, at, axis=0)
    squares = np.add.reduceat(px[:, 1:] ** 2, at, axis=0)
    return sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1), idx, val, lens, px, sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(params: np.ndarray, grads: np.ndarray, rows: list, labels: np.ndarray, seed: int) -> None:
    """PASSES of AdaGrad over the rows, in place. grads: sums of squared gradients."""
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), MINIBATCH):
            part = order[k : k + MINIBATCH]
            y, idx, val, lens, px, sums = raw_scores(params, [rows[i] for i in part])
            g = np.repeat((logistic(y) - labels[part]) / len(part), lens)
            full = np.empty_like(px)
            full[:, 0] = g * val
            full[:, 1:] = (g * val)[:, None] * (np.repeat(sums[:, 1:], lens, axis=0) - px[:, 1:])
            used, where = np.unique(idx, return_inverse=True)
            total = np.zeros((len(used), params.shape[1]), np.float32)
            np.add.at(total, where, full)
            total += DECAY * params[used]
            grads[used] += total**2
            params[used] -= RATE * total / np.sqrt(grads[used] + 1e-8)


def _start() -> np.ndarray:
    params = np.zeros((SIZE, 1 + FACTORS), np.float32)
    params[:, 1:] = np.random.default_rng(7).normal(0, 0.02, (SIZE, FACTORS))
    return params


def train(docs: DataFrame, labels: DataFrame, folds: int, fold: int, max_rows: int = MAX_ROWS) -> np.ndarray | None:
    """The parameters, or None without training rows."""
    rows, expected = training_rows(docs, labels, "quality", folds, fold, max_rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"].astype("float32"), "idx": [r[0] for r in got], "val": [r[1] for r in got]})

    made = rows.filter("label in (0, 1)").mapInPandas(extract, "label float, idx array<int>, val array<float>")
    parts = max(1, round(expected / ROWS_A_PARTITION))  # dealt and ordered by content, so that every run trains alike
    sample = stored(made.withColumn("h", F.xxhash64("idx", "val")).repartition(parts, "h").sortWithinPartitions("h", "label").drop("h"))
    params = _start()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts)
        own, grads = now.copy(), np.full(now.shape, 0.1, np.float32)
        fit(own, grads, list(zip(pdf["idx"], pdf["val"], strict=True)), pdf["label"].to_numpy(), turn)
        yield pd.DataFrame({"n": [len(pdf)], "params": [own.tobytes()]})

    for turn in range(ROUNDS):
        now = params
        got = sample.mapInPandas(local, "n long, params binary").collect()
        if not got:
            return None
        weight = sum(r["n"] for r in got)
        params = sum(np.frombuffer(r["params"], np.float32).reshape(now.shape) * np.float32(r["n"] / weight) for r in got)
    return params


def scorer(params: np.ndarray | None):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if params is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            out = [np.zeros(0)]
            for k in range(0, len(texts), SCORED_AT_ONCE):
                out.append(logistic(raw_scores(params, [features(t) for t in texts.iloc[k : k + SCORED_AT_ONCE]])[0]))
            yield pd.Series(np.concatenate(out).astype("float64"))

    return score


def quality(docs: DataFrame, labels: DataFrame, folds: int, fold: int, max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = scorer(train(docs, labels, folds, fold, max_rows))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_fm(spark, sf_dir):
    """Quality score of every document, learned outside fold 1 of 3."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3, 1)
