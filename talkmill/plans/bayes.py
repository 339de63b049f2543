"""Multinomial naive Bayes for many weightings of the same rows at once.

A naive Bayes model of word counts is a table of sums. So bags, folds and text lengths differ only in how often each occurrence of a
term counts: every row, or every term of it, carries one number per *member*, and one aggregation by label and term sums
them all. What reaches the driver is the models: per member at most ``max_features`` terms, a number for each class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.text import word_tokens
from talkmill.plans.features import ClassIndexModel, TermVectorsModel
from talkmill.plans.models import LinesModel, Spec
from talkmill.session import checkpointed

SMOOTHING = 0.1


def closed_form(spec: Spec, options: dict) -> bool:
    """Whether a pipeline is naive Bayes of single words, which needs nothing but sums."""
    plain = spec.features == "counts" and spec.classifier == "multinomial_nb" and spec.high == 1 and spec.min_df == 1
    return plain and set(spec.options) | set(options) <= {"smoothing"}


def _sums(times: Column, members: int) -> list[Column]:
    return [F.sum(F.get(times, F.lit(j))).alias(f"m{j}") for j in range(members)]


def _by_member(df: DataFrame, members: int, *keys: str) -> DataFrame:
    """``(*keys, member, n)`` of a table with a column of sums per member, without zeros."""
    cells = F.posexplode(F.array(*[f"m{j}" for j in range(members)])).alias("member", "n")
    return df.select(*keys, cells).where("n > 0")


def fit_members(terms: DataFrame, docs: DataFrame, members: int, spec: Spec, label: str = "label", **options) -> list[PipelineModel]:
    """One fitted pipeline per member.

    ``terms`` has ``(label, term, times)`` and ``docs`` ``(label, times)``, ``times`` being an array with the number of every
    member. The vocabulary of a member is its most frequent terms, ties by term.
    """
    alpha = {**spec.options, **options}.get("smoothing", SMOOTHING)
    counted = terms.groupBy("label", "term").agg(*_sums(F.col("times"), members))
    counts = checkpointed(_by_member(counted, members, "label", "term"))
    totals = counts.groupBy("member", "term").agg(F.sum("n").alias("total"))
    place = F.row_number().over(W.partitionBy("member").orderBy(F.desc("total"), "term"))
    known = totals.withColumn("place", place).where(F.col("place") <= spec.max_features).select("member", "term")
    # At most members * max_features * classes rows: the models themselves.
    kept = counts.join(known, ["member", "term"]).select("member", "term", "label", "n").toPandas()
    rows = _by_member(docs.groupBy("label").agg(*_sums(F.col("times"), members)), members, "label").toPandas()
    out = []
    for j in range(members):
        cells, own = kept[kept["member"] == j], rows[rows["member"] == j]
        names = sorted(own["label"])
        words = sorted(set(cells["term"]))
        if not words:
            raise ValueError("no terms left in the vocabulary")
        at, of = {w: i for i, w in enumerate(words)}, {c: i for i, c in enumerate(names)}
        table = np.zeros((len(names), len(words)))
        table[[of[c] for c in cells["label"]], [at[w] for w in cells["term"]]] = cells["n"]
        sizes = np.array([float(own["n"][own["label"] == c].iloc[0]) for c in names])
        prior = np.log(sizes + alpha) - np.log(sizes.sum() + alpha * len(names))
        theta = np.log(table + alpha) - np.log(table.sum(axis=1, keepdims=True) + alpha * len(words))
        index = ClassIndexModel(names, (sizes.sum() / (len(names) * sizes)).tolist())
        index._set(labelCol=label)
        vectors = TermVectorsModel(words, [1.0] * len(words))
        vectors._set(inputCol="text", outputCol="features", kind="counts", low=1, high=1)
        out.append(PipelineModel([index, vectors, LinesModel(np.hstack([theta, prior[:, None]]))]))
    return out


def fit_weighted(rows: DataFrame, times: Column, members: int, spec: Spec, text: str, label: str, **options) -> list[PipelineModel]:
    """Members that count every row as often as ``times``, an array with a number per member, says."""
    own = rows.select(F.col(label).alias("label"), word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"), times.alias("times"))
    own = own.where(F.exists("times", lambda t: t > 0))
    terms = own.select("label", F.explode("words").alias("term"), "times")
    return _named(fit_members(terms, own.select("label", "times"), members, spec, label, **options), text)


def fit_lengths(
    rows: DataFrame, lengths: Sequence[int], strategy: str, spec: Spec, text: str, label: str, **options
) -> list[PipelineModel]:
    """Members that see texts cut to each of ``lengths`` white-space words: every word is read once, and counts for the lengths it is in."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"((?U)\S+)"), F.lit(1))
    split = rows.select(F.col(label).alias("label"), words.alias("words"))
    placed = split.select("label", F.size("words").alias("size"), F.posexplode("words").alias("place", "word"))

    def inside(n: int) -> Column:
        if strategy == "head":
            return F.col("place") < n
        head = (n + 1) // 2
        return (F.col("size") <= n) | (F.col("place") < head) | (F.col("place") >= F.col("size") - (n - head))

    times = F.array(*[inside(n).cast("int") for n in lengths])
    terms = placed.select("label", F.explode(word_tokens("word")).alias("term"), times.alias("times"))
    once = F.array(*[F.lit(1)] * len(lengths))
    docs = rows.select(F.col(label).alias("label"), once.alias("times"))
    return _named(fit_members(terms, docs, len(lengths), spec, label, **options), text)


def _named(models: list[PipelineModel], text: str) -> list[PipelineModel]:
    for m in models:
        m.stages[1]._set(inputCol=text)
    return models
