"""Language identification by a byte convolutional network, trained and applied in numpy.

Byte embeddings, filters of several widths, max pooling over fixed-length windows and a softmax.
The network is fitted on a bounded sample of labelled rows. It is then applied to all windows of
every text; a text's score is the mean of its windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNDETERMINED = "und"


@dataclass(frozen=True)
class Net:
    """Parameters of the network and of its training. The sample has about ``per_language`` rows of
    each label, chosen by a hash, and ``sample_rows`` at most, so that fewer are read of each where
    there are many labels; of a row ``per_text`` windows are read. A label is learned if it holds
    one in ``sample_rows`` of the labelled rows or more; rarer ones have no share in such a sample."""

    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    per_language: int = 1500
    sample_rows: int = 96_000
    per_text: int = 4
    epochs: int = 8
    steps: int = 1000  # at least so many batches, however small the sample
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # by offset: byte to all filters, as scaled integers
    scale: float
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    window: int


def _windows(body: bytes, net: Net) -> np.ndarray:
    """All windows of a text, overlapping by the widest filter less one; zeros fill the last."""
    step = net.window - max(net.widths) + 1
    count = max(1, -(-(len(body) - max(net.widths) + 1) // step))
    padded = np.zeros(count * step + net.window - step, np.uint8)
    padded[:len(body)] = np.frombuffer(body, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, net.window)[::step]


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], net: Net) -> Model:
    """Train by Adam on windows ``x`` (rows of bytes) with labels ``y``."""
    rng = np.random.default_rng(net.seed)
    e, f, n = net.embedding, net.filters, len(net.widths) * net.filters
    params = {"emb": rng.normal(0, 0.3, (256, e)), "w": rng.normal(0, 0.2, (n, len(langs))),
              "b": np.zeros(len(langs)), "c": np.zeros(n)}
    for k in net.widths:
        params[f"k{k}"] = rng.normal(0, 1 / np.sqrt(k * e), (k, e, f))
    params = {k: v.astype(np.float32) for k, v in params.items()}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    places = net.window - max(net.widths) + 1
    step, epochs = 0, max(net.epochs, -(-net.steps * net.batch // max(1, len(x))))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), net.batch):
            own = order[at:at + net.batch]
            codes, truth = x[own], y[own]
            rows = np.arange(len(own))
            embedded = params["emb"][codes]
            pooled, best = [], []
            for k in net.widths:
                maps = sum(embedded[:, j:j + places] @ params[f"k{k}"][j] for j in range(k))
                top = maps.argmax(axis=1)
                best.append(top)
                pooled.append(np.take_along_axis(maps, top[:, None], 1)[:, 0])
            hidden = np.concatenate(pooled, axis=1) + params["c"]
            active = np.maximum(hidden, 0)
            logits = active @ params["w"] + params["b"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[rows, truth] -= 1
            prob /= len(own)
            back = (prob @ params["w"].T) * (hidden > 0)
            grads = {"w": active.T @ prob, "b": prob.sum(axis=0), "c": back.sum(axis=0),
                     "emb": np.zeros_like(params["emb"])}
            for i, k in enumerate(net.widths):
                part = back[:, i * f:(i + 1) * f]
                grad = np.zeros_like(params[f"k{k}"])
                for j in range(k):
                    bytes_at = codes[rows[:, None], best[i] + j]
                    grad[j] = np.einsum("bfe,bf->ef", params["emb"][bytes_at], part)
                    np.add.at(grads["emb"], bytes_at,
                              part[:, :, None] * params[f"k{k}"][j].T[None])
                grads[f"k{k}"] = grad
            step += 1
            rate = net.rate * (1 - epoch / epochs)
            for name, grad in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                params[name] -= rate * (first[name] / (1 - 0.9**step)) / (
                    np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    widest = max(net.widths)
    tables = np.zeros((widest, 256, n), np.float32)
    for i, k in enumerate(net.widths):
        for j in range(k):
            tables[j, :, i * f:(i + 1) * f] = params["emb"] @ params[f"k{k}"][j]
    scale = 32000.0 / max(1e-6, float(np.abs(tables).max(axis=1).sum(axis=0).max()))
    return Model(langs, list(np.round(tables * scale).astype(np.int16)), scale, params["c"],
                 params["w"], params["b"], net.window)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Softmax of each window. A filter's value at a place is a sum of table entries, one for each
    pair of neighbouring bytes, so that a window costs a few look-ups a byte."""
    if not hasattr(model, "_pairs"):
        odd = len(model.tables) % 2
        tables = [*model.tables, *[np.zeros_like(model.tables[0])] * odd]
        model._pairs = [(tables[j][:, None, :] + tables[j + 1][None, :, :]).reshape(65536, -1)
                        for j in range(0, len(tables), 2)]
    places = model.window - len(model.tables) + 1
    out = np.empty((len(x), len(model.langs)), np.float64)
    for at in range(0, len(x), 1024):
        part = np.zeros((len(x[at:at + 1024]), model.window + 1), np.uint16)
        part[:, :-1] = x[at:at + 1024]
        pairs = (part[:, :-1] << 8) | part[:, 1:]
        maps = model._pairs[0][pairs[:, :places]]
        for j, table in enumerate(model._pairs[1:], 1):
            maps += table[pairs[:, 2 * j:2 * j + places]]
        hidden = np.maximum(maps.max(axis=1) / model.scale + model.bias, 0)
        logits = hidden @ model.weights + model.offset
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[at:at + 1024] = prob / prob.sum(axis=1, keepdims=True)
    return out


def train(docs: DataFrame, net: Net = Net(), id_col: str = "doc_id", text: str = "text",
          lang: str = "lang", learn: Column | None = None) -> Model | None:
    """Fit on the bounded sample of the rows that ``learn`` allows. None without labelled text."""
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"),
                       docs[lang].cast("string").alias("lang"),
                       (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where(F.col("learn") & F.col("lang").isNotNull() & (F.col("text") != ""))
    # the row of all labels comes first; so many labels at most can hold their share of the rows
    counts = rows.rollup("lang").count().orderBy(F.desc("count"), "lang").limit(
        net.sample_rows + 1).collect()
    if len(counts) < 2:
        return None
    total = counts[0]["count"]
    sizes = {r["lang"]: r["count"] for r in counts[1:] if r["count"] * net.sample_rows >= total}
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    share = min(net.per_language, net.sample_rows / len(langs))
    bounds = F.create_map(*[F.lit(x) for name in langs for x in (
        name, min(1 << 30, int((1 << 30) * share / sizes[name])))])
    chosen = draw < F.coalesce(F.element_at(bounds, F.col("lang")), F.lit(0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, parts = [], []
            for i in range(batch.num_rows):
                body = batch.column(2)[i].as_py().encode()
                rng = np.random.default_rng(batch.column(0)[i].as_py())
                for _ in range(net.per_text):
                    at = int(rng.integers(0, max(1, len(body) - net.window + 1)))
                    # half of the windows are short ones: short texts have to be known as well
                    size = net.window if rng.random() < 0.5 else int(rng.integers(6, net.window))
                    own.append(i)
                    parts.append(body[at:at + size])
            own = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own),
                 pa.array(parts, pa.binary())], ["draw", "lang", "part"])

    sample = rows.where(chosen).select(draw.alias("draw"), "lang", "text").mapInArrow(
        cut, "draw long, lang string, part binary").toPandas()
    sample = sample.sort_values(["draw", "lang", "part"])
    x = np.zeros((len(sample), net.window), np.uint8)
    for i, part in enumerate(sample["part"]):
        x[i, :len(part)] = np.frombuffer(bytes(part), np.uint8)
    y = sample["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
    return fit(x, y, langs, net)


_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = np.zeros(256, np.float32)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def predict(docs: DataFrame, model: Model | None, net: Net = Net(), id_col: str = "doc_id",
            text: str = "text") -> DataFrame:
    """All columns of the rows and ``lang_pred`` and ``score``, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there is
    no model. Null ids, repeated rows and further columns are kept as they are; input columns
    with the names of the two new ones give way to them.
    """
    docs = docs.drop("lang_pred", "score")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            names, scores = [UNDETERMINED] * len(values), np.zeros(len(values))
            waiting: list[tuple[int, np.ndarray]] = []
            size = 0

            def flush() -> None:
                nonlocal waiting, size
                if not waiting:
                    return
                x = np.concatenate([w for _, w in waiting])
                weight = _LETTERS[x].sum(axis=1)[:, None] + 1e-3
                starts = np.cumsum([0] + [len(w) for _, w in waiting])[:-1]
                mean = (np.add.reduceat(probabilities(model, x) * weight, starts)
                        / np.add.reduceat(weight, starts))
                for (i, _), p in zip(waiting, mean):
                    names[i], scores[i] = model.langs[int(p.argmax())], min(1.0, float(p.max()))
                waiting, size = [], 0

            for i, value in enumerate(values):
                body = value.as_py()
                if model is None or not body or not _LETTER.search(body):
                    continue
                waiting.append((i, _windows(body.encode(), net)))
                size += len(waiting[-1][1])
                if size >= 4096:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    added = StructType().add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(label, StructType([*docs.schema.fields, *added.fields]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning; rows without id are neither held out nor learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, net: Net = Net(), id_col: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred and score of each row; learns from the rows not held out."""
    learn = ~held_out(id_col) & F.col(id_col).isNotNull()
    model = train(docs, net, id_col, text, lang, learn)
    labelled = predict(docs.select(id_col, text), model, net, id_col, text)
    return labelled.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
