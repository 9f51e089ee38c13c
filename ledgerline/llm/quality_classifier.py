"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two logistic models over words and a few shape features, fitted on a bounded
sample of labelled documents, give each document the evidence that it is good
(high quality and not toxic).  Grouped sums of that evidence over all documents
give every host a posterior shrunk toward the global mean, and every path a
posterior shrunk toward its host; how strongly follows from the spread between
groups (method of moments), so sparse sites fall back on their prior.  A
document's posterior odds are its own odds times the odds of its path, without
the document itself, relative to the global odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import (
    NOT_ALNUM,
    ascii_lower,
    batches,
    joined,
    lists,
    materialize,
    offsets,
    prefix_hash,
    range_hash,
    spread_join,
    text_of,
    with_row_id,
    word_spans,
)

#: Shape features after the words: bias, and shares of the text or logarithms.
SHAPES = 8


@dataclass(frozen=True)
class ClassifierConfig:
    """sample_rows bounds the labelled documents that are fitted, sample_words the
    different words and beginnings taken of each (those that hash lowest, the
    same for all documents), features the words of the models."""

    sample_rows: int = 4000
    sample_words: int = 1 << 14
    features: int = 40_000
    min_docs: int = 4
    steps: int = 300
    l2: float = 1e-4
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    quality: np.ndarray  # weights of the words, then of the shapes
    toxic: np.ndarray


def _shapes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: bias, symbol, upper-case, digit and exclamation shares, log length, word length, repeated words."""
    size = np.diff(bounds)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1)
        np.cumsum(flag, out=total[1:])
        return np.diff(total[bounds])

    start, end, at = word_spans(data, bounds)
    n = np.diff(at)
    words = np.maximum(n, 1)
    owner = text_of(at)
    h = range_hash(prefix_hash(data), start, end)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    letters = np.maximum(size, 1)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    out = np.zeros((len(size), SHAPES))
    out[:, 0] = 1
    out[:, 1] = count(symbol) / letters * 10
    out[:, 2] = count((data >= 65) & (data <= 90)) / letters * 5
    out[:, 3] = count((data >= 48) & (data <= 57)) / letters * 5
    out[:, 4] = count(data == 33) / words * 5
    out[:, 5] = np.log1p(n) / 5
    out[:, 6] = np.minimum(letters / words / 10, 3)
    out[:, 7] = np.bincount(owner, same, len(size)) / words * 5
    return out


#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
_PREFIX_SALT = np.uint64(0x5851F42D4C957F2D)


def _features(data: np.ndarray, bounds: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without punctuation and of their beginnings, and the text of each.

    known: 2**22 flags by low bits; hashes outside are left out early.
    """
    start, end, at = word_spans(data, bounds, NOT_ALNUM)
    prefix, owner = prefix_hash(ascii_lower(data)), text_of(at)
    found, owners = [], []
    for k in (0, *PREFIXES):
        own = np.arange(len(start)) if not k else np.flatnonzero(end - start > k)
        h = range_hash(prefix, start[own], start[own] + k if k else end[own])
        h = h ^ _PREFIX_SALT if k else h
        if known is not None:
            hit = np.flatnonzero(known[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            h, own = h[hit], own[hit]
        found.append(h)
        owners.append(owner[own])
    return np.concatenate(found), np.concatenate(owners)


def _sample_features(limit: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label, quality, toxic, text = batch.columns
        data, bounds = joined(text)
        h, owner = _features(data, bounds)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
        at = np.searchsorted(owner[fresh], np.arange(batch.num_rows + 1))
        place = np.arange(len(fresh)) - at[:-1][owner[fresh]]
        fresh = fresh[place < limit]
        at = np.searchsorted(owner[fresh], np.arange(batch.num_rows + 1))
        shapes = _shapes(data, bounds)
        content = range_hash(prefix_hash(data), bounds[:-1], bounds[1:]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [label, quality, toxic, pa.array(content), lists(h[fresh].view(np.int64), at), lists(shapes.ravel(), np.arange(0, shapes.size + 1, SHAPES))],
            ["label_id", "quality", "toxic", "content", "words", "shapes"],
        )

    return run


def _known_words(words: np.ndarray):
    """Replace the words of a sampled document by their numbers among the model's."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        h = column.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(column)), np.diff(offsets(column)))
        where = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        hit = words[where] == h if len(words) else np.zeros(len(h), bool)
        cols = lists(where[hit].astype(np.int32), np.searchsorted(owner[hit], np.arange(len(column) + 1)))
        return pa.RecordBatch.from_arrays([cols, *batch.columns[1:]], ["cols", "shapes", "quality", "toxic"])

    return run


def _fit(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, c: ClassifierConfig) -> np.ndarray:
    """Logistic regression by gradient steps with momentum, over words scaled by their log-count ratio."""
    n = len(y)
    if not 0 < y.mean() < 1:
        return np.r_[np.zeros(width), 10.0 * (y.mean() > 0) - 5.0, np.zeros(SHAPES - 1)]
    a, total = np.bincount(cols, y[rows], width), np.bincount(cols, minlength=width)
    ratio = np.log((a + 0.3) / (y.sum() + 1)) - np.log((total - a + 0.3) / (n - y.sum() + 1))
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    value = (ratio[cols] * scale[rows]).astype(np.float32)
    w, v = np.zeros(width + SHAPES), np.zeros(width + SHAPES)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(c.steps):
        z = np.bincount(rows, w[cols] * value, n) + dense @ w[width:]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n
        grad = np.r_[np.bincount(cols, g[rows] * value, width), dense.T @ g] + c.l2 * w
        v = 0.9 * v - 1.0 * grad
        w = w + v
    return np.r_[w[:width] * ratio, w[width:]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, c: ClassifierConfig) -> Model | None:
    """Fit on the ``sample_rows`` labelled documents whose identifiers hash lowest; None without labels.

    Of rows with one identifier the text that hashes lowest is fitted.  The
    choice of words is a grouped count; the driver gets the words of the model
    and, of each sampled document, which of them it has.
    """
    lab = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    )
    lab = lab.distinct()
    picked = lab.orderBy(F.xxhash64("label_id"), "label_id", "quality", "toxic").limit(c.sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample has at most sample_rows rows of three numbers.
    sample = texts.join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("label_id", "quality", "toxic", "text")
    kind = dict(sample.dtypes)["label_id"]
    found = sample.mapInArrow(
        batches(_sample_features(c.sample_words)), f"label_id {kind}, quality int, toxic int, content long, words array<long>, shapes array<double>"
    )
    one = found.groupBy("label_id", "quality", "toxic").agg(F.min(F.struct("content", "words", "shapes")).alias("x"))
    sample = materialize(one.select("label_id", "quality", "toxic", "x.words", "x.shapes"), "sample", c.sample_rows)
    total = sample.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("quality") > 0).cast("int")), F.lit(0)).alias("quality"),
        F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("toxic"),
    ).first()
    n = total["n"]
    if not n:
        return None
    # The most telling words of either label, among those in several documents.
    words = sample.select(F.explode("words").alias("word"), *[(F.col(y) > 0).cast("int").alias(y) for y in ("quality", "toxic")])
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))

    def tell(y: str) -> Column:
        p, q = (F.col(y) + 0.5) / (total[y] + 1), (F.col("count") - F.col(y) + 0.5) / (n - total[y] + 1)
        return F.abs(F.log(p / q)) * F.sqrt("count")

    told = counts.filter(F.col("count") >= c.min_docs).withColumn("tell", F.greatest(tell("quality"), tell("toxic")))
    chosen = np.sort(told.orderBy(F.desc("tell"), "word").limit(c.features).select("word").toArrow()["word"].to_numpy().view(np.uint64))
    got = sample.select("words", "shapes", "quality", "toxic", "label_id").orderBy(F.xxhash64("label_id"), "label_id", "quality", "toxic").drop("label_id")
    got = got.mapInArrow(batches_of(_known_words(chosen)), "cols array<int>, shapes array<double>, quality int, toxic int").toArrow()
    cols_ = got["cols"].combine_chunks()
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets(cols_)))
    cols = cols_.flatten().to_numpy()
    dense = got["shapes"].combine_chunks().flatten().to_numpy().reshape(n, SHAPES)
    quality, toxic = (got[k].to_numpy() > 0 for k in ("quality", "toxic"))
    del got, cols_
    return Model(chosen, *(_fit(owner, cols, dense, y.astype(float), len(chosen), c) for y in (quality, toxic)))


def batches_of(fn):
    def run(stream):
        for batch in stream:
            if batch.num_rows:
                yield fn(batch)

    return run


def _evidence(model: Model):
    known = np.zeros(1 << 22, bool)
    known[(model.words & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = joined(batch.column(batch.num_columns - 1))
        n, width = len(bounds) - 1, len(model.words)
        h, owner = _features(data, bounds, known)
        where = np.minimum(np.searchsorted(model.words, h), max(width - 1, 0))
        hit = model.words[where] == h if width else np.zeros(len(h), bool)
        pair = np.unique(owner[hit] * max(width, 1) + where[hit])
        owner, col = np.divmod(pair, max(width, 1))
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        shapes = _shapes(data, bounds)
        out = []
        for w in (model.quality, model.toxic):
            z = np.bincount(owner, w[col], n) * scale + shapes @ w[width:]
            out.append(pa.array(1 / (1 + np.exp(-np.clip(z, -15, 15)))))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *out], [*batch.schema.names[:-1], "p_quality", "p_toxic"]
        )

    return score


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-count of the prior: how much evidence a group needs to move away from it.

    groups: (n, good, prior) of every group.  The between-group variance is
    what the spread of group means has beyond sampling.
    """
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("spread"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return 1e3
    inner = max(mean * (1 - mean), 1e-6)
    room = row["n"] - row["n2"] / row["n"]
    between = max((row["spread"] - (row["k"] - 1) * inner) / max(room, 1e-9), 1e-6)
    return round(float(min(max(inner / between - 1, 1.0), 1e6)), 6)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    config: ClassifierConfig = ClassifierConfig(),  # noqa: B008
) -> DataFrame:
    """Judge every document.

    Returns per row: _rid, id, host, path, p_quality, p_toxic, evidence,
    host_posterior, path_posterior, posterior, kept.

    Null text is an empty text; null hosts and paths are groups of their own.
    ``labels`` (doc_id, quality, toxic) may be empty or lack documents: without
    any label every document has evidence 0.5 and is kept.  A label row with a
    null is skipped; repeated labels count once.  Repeated rows are documents
    of their own; texts of any length are judged whole; a posterior at the
    threshold is kept.  An empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, config)
    rows = with_row_id(docs).select(
        F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"),
        F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"),
    )
    kind = dict(rows.dtypes)["id"]
    if model is None:
        seen = rows.drop("text").withColumns({"p_quality": F.lit(0.5), "p_toxic": F.lit(0.0)})
    else:
        schema = f"rid long, id {kind}, host string, path string, p_quality double, p_toxic double"
        seen = materialize(rows.mapInArrow(batches(_evidence(model)), schema), "evidence")
    seen = seen.withColumn("evidence", F.col("p_quality") * (1 - F.col("p_toxic")))

    # Evidence is added in millionths, as integers, so that sums do not depend on their order.
    paths = seen.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("evidence") * 1e6).cast("long")) / 1e6).alias("good")
    )
    paths = materialize(paths, "paths", None if model is None else seen.count())
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = round(total["good"] / total["n"], 9) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(mean))
    strong = _strength(hosts, mean)
    hosts = hosts.withColumn("host_posterior", (F.col("good") + strong * mean) / (F.col("n") + strong)).select(
        F.col("host").alias("h"), F.col("host_posterior").alias("prior")
    )
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    inner = _strength(sites, mean)
    # One row per path comes to documents already aggregated; a document leaves itself out of its path.
    key = F.struct(*[x for c in ("host", "path") for x in (F.col(c).isNull().alias(f"no_{c}"), F.coalesce(c, F.lit("")).alias(f"{c}_"))])
    sites = sites.select(key.alias("site"), "n", "good", "prior", F.col("n").alias("site_rows"))
    own = spread_join(seen.withColumn("site", key), sites, "site", "site_rows", total["n"] or 0)
    path_posterior = (F.col("good") - F.col("evidence") + inner * F.col("prior")) / (F.col("n") - 1 + inner)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean)))))
    return (
        own.withColumn("path_posterior", path_posterior)
        .withColumn("posterior", posterior)
        .select(
            F.col("rid").alias("_rid"), "id", "host", "path", "p_quality", "p_toxic", "evidence",
            F.col("prior").alias("host_posterior"), "path_posterior", "posterior", (F.col("posterior") >= config.threshold).alias("kept"),
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without the documents the classifier rejects; all columns as they were."""
    kept = classify(docs, labels, **columns).filter("kept").select(F.col("_rid").alias("_kept_rid"))
    numbered = with_row_id(docs, "_row_rid")
    return numbered.join(kept, numbered["_row_rid"] == kept["_kept_rid"], "left_semi").drop("_row_rid")
