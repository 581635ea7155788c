"""Quality by hierarchical empirical Bayes.

A small classifier gives each document evidence of its own. Documents are then grouped
by host and by path within the host: a path's mean is shrunk towards its host's, and a
host's towards the global prior, the less rows it has the more. How strongly is learned
from all groups at once: the precision of the beta prior follows from how far the groups'
means spread beyond what chance explains. A document's posterior odds are its own odds
moved by how far its site's posterior lies from the prior. That site's posterior is taken
over the other documents there, so no document's evidence counts twice; one that is alone
on its site moves with nothing but the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import masked, unmasked
from .fitting import labelled, logistic, with_label
from .storage import cut
from .words import steps, words

FEATURES = ("upper", "signs", "digits", "pipes", "shouts", "repeats", "distinct", "length", "word_length", "line_repeats")
#: Means are held in millionths, so that sums don't depend on their order.
UNIT = 1_000_000
#: The weight of the site's evidence against the document's own.
SITE_WEIGHT = 0.5
#: Posteriors stay this far from 0 and 1.
EDGE = 1e-4

_byte = np.arange(256)
_upper = (_byte >= 65) & (_byte <= 90)
_letter = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_digit = (_byte >= 48) & (_byte <= 57)
_sign = np.isin(_byte, list(b"#$%&*<>{}[]\\^_~=+@|/"))
_pipe = _byte == 124
_shout = _byte == 33


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; 0 throughout for a text without words."""
    cut = words(texts)
    size = np.diff(cut.at)
    n = np.diff(cut.first)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[cut.data])))
        return total[cut.at[1:]] - total[cut.at[:-1]]

    letters = np.maximum(count(_letter), 1)
    same = np.zeros(len(cut.code) + 1, np.int64)
    if len(cut.code) > 1:
        of = cut.of()
        same[2:] = np.cumsum((cut.code[1:] == cut.code[:-1]) & (of[1:] == of[:-1]))
    repeats = same[cut.first[1:]] - same[np.minimum(cut.first[:-1] + 1, len(cut.code))]
    distinct, lines = np.zeros(len(n)), np.zeros(len(n))
    breaks = np.flatnonzero(cut.data == 10)
    for i in np.flatnonzero(n):
        distinct[i] = len(np.unique(cut.text(i))) / n[i] ** 0.8
        a, b = np.searchsorted(breaks, (cut.at[i], cut.at[i + 1]))
        if b - a > 1:
            held = cut.data[cut.at[i] : cut.at[i + 1]].tobytes().split(b"\n")
            lines[i] = 1 - len(set(held)) / len(held)
    many = np.maximum(n, 1)
    out = np.column_stack((count(_upper) / letters, count(_sign) / np.maximum(size, 1), count(_digit) / np.maximum(size, 1), count(_pipe) / many, count(_shout) / many, np.maximum(repeats, 0) / many, distinct, np.log1p(n) / 5, letters / many / 10, lines))
    out[n == 0] = 0
    return out


class Classifier(NamedTuple):
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.middle) / self.scale
        x = np.column_stack((x, np.minimum(x * x, 9)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int | None = None) -> Classifier | None:
    """Fit on at most `rows` labelled documents (fitting.SAMPLE_ROWS by default); None if the sample doesn't hold both labels."""
    sample = labelled(labels, label, key, **({} if rows is None else {"rows": rows}))
    if len(set(sample.values())) < 2:
        return None
    chosen = with_label(docs.select(key, F.col(text).cast("string").alias("_text")), sample, key).select("_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_text"):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    held = chosen.mapInArrow(run, "x array<double>, y int").collect()  # at most the sample
    y = np.array([r[1] for r in held], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r[0] for r in held])
    x, y = x[order := np.lexsort((*x.T, y))], y[order]
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - middle) / scale
    return Classifier(middle, scale, logistic(np.column_stack((z, np.minimum(z * z, 9))), y))


def evidence(docs: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """`docs`, its text replaced by ``evidence``: the classifier's probability in millionths, half without a classifier."""
    kept = [c for c in docs.columns if c not in (text, "evidence")]
    df = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "_text"), T.StructField("evidence", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in steps(batch, "_text"):
                p = np.full(part.num_rows, 0.5) if model is None else model(features(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.rint(p * UNIT).astype(np.int64))], schema.fieldNames())

    return df.mapInArrow(run, schema)


def precision(groups: DataFrame, n: str, total: str, mean: float) -> float:
    """Rows that the prior of these groups weighs as much as, by the method of moments over all groups."""
    share = F.col(total) / F.col(n) / UNIT
    row = groups.agg(F.sum(F.col(n) * (share - mean) ** 2).alias("spread"), F.sum(n).alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n).cast("double") * F.col(n)).alias("squares")).first()
    chance = mean * (1 - mean)
    if not row["groups"] or row["groups"] < 2 or chance <= 0:
        return 10.0
    between = max((row["spread"] - (row["groups"] - 1) * chance) / max(row["rows"] - row["squares"] / row["rows"], 1e-9), 0.0)
    return float(round(min(max(chance / between - 1 if between > 0 else 1e6, 1.0), 1e6), 6))


def classify(docs: DataFrame, model: Classifier | None, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """`docs` without its text and with ``document_quality``, ``host_quality``,
    ``path_quality``, ``quality`` (the posterior, 0 to 1) and ``keep`` (0.5 or more).

    Host and path posteriors are those of the whole site, ``quality`` takes that of the
    site's other documents. A null host or path is a group of its own. Null and empty texts
    are scored as texts without words; very long ones in one task, whole. Repeated rows
    count as often as they stand there and get equal results; an evidence of 0.5 is kept.
    An empty table gives no rows. Groups are summed before they are shuffled, and the
    sums (one row a path) are joined back by equality on host and path.
    """
    made = ("document_quality", "host_quality", "path_quality", "quality", "keep")
    rows, inner = masked(docs, [c for c in docs.columns if c == text or c not in made])
    scored = cut(evidence(rows, model, inner.pop(text)))
    host, path = inner[host], inner[path]
    paths = scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("_n"), F.sum("evidence").alias("_sum"))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_host_n"), F.sum("_sum").alias("_host_sum"))
    rows, total = hosts.agg(F.sum("_host_n"), F.sum("_host_sum")).first()
    prior = min(max((total or 0) / UNIT / rows, EDGE), 1 - EDGE) if rows else 0.5
    k_host = precision(hosts, "_host_n", "_host_sum", prior)
    k_path = precision(paths, "_n", "_sum", prior)
    own_host = hosts.withColumnRenamed("_host", "_own_host")
    sites = paths.join(own_host, paths["_host"].eqNullSafe(own_host["_own_host"])).select("_host", "_path", "_n", "_sum", "_host_n", "_host_sum")

    def logit(c):
        held = F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
        return F.log(held / (1 - held))

    def posteriors(own, one):
        """Host's and path's posteriors without evidence `own` of `one` documents."""
        host = (F.col("_host_sum") / UNIT - own + k_host * prior) / (F.col("_host_n") - one + k_host)
        return host, (F.col("_sum") / UNIT - own + k_path * host) / (F.col("_n") - one + k_path)

    own = F.col("evidence") / UNIT
    joined = scored.join(sites, scored[host].eqNullSafe(sites["_host"]) & scored[path].eqNullSafe(sites["_path"]))
    odds = logit(own) + SITE_WEIGHT * (logit(posteriors(own, 1)[1]) - F.lit(float(np.log(prior / (1 - prior)))))
    posterior = 1 / (1 + F.exp(-odds))
    host_quality, path_quality = posteriors(0, 0)
    return unmasked(joined, inner, own.alias("document_quality"), host_quality.alias("host_quality"), path_quality.alias("path_quality"), posterior.alias("quality"), (posterior >= 0.5).alias("keep"))
