"""Text features: n-gram counts and TF-IDF, as long tables and as pipeline stages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.columns import literal_array
from talkmill.functions.text import keyword_flags, term_counts, word_ngrams, word_tokens
from talkmill.plans import terms
from talkmill.plans.saved import Saved
from talkmill.session import checked_broadcast, checkpointed, distinct_values


def _terms(df: DataFrame, text: str, low: int, high: int, *keep: str) -> DataFrame:
    """Distinct terms of each text with their counts, without a shuffle."""
    tokens = df.select(*keep, word_tokens(text).alias("__tokens"))
    grams = tokens.select(*keep, word_ngrams("__tokens", low, high).alias("__terms"))
    return grams.select(*keep, F.inline(term_counts("__terms")))


def term_rows(df: DataFrame, text: str = "text", row_id: str = "row_id", low: int = 1, high: int = 1) -> DataFrame:
    """Term counts per row ``(row_id, term, tf)``."""
    return _terms(df, text, low, high, row_id)


def vocabulary(
    df: DataFrame,
    text: str = "text",
    low: int = 1,
    high: int = 1,
    max_features: int | None = None,
    min_df: int = 1,
) -> DataFrame:
    """Corpus and document frequency per term; the most frequent terms, ties by term.

    Counts are combined inside each task before the only shuffle, which carries terms, not rows.
    """
    return top_terms(_terms(df, text, low, high), max_features, min_df)


def top_terms(terms: DataFrame, max_features: int | None = None, min_df: int = 1) -> DataFrame:
    """``vocabulary`` of a table ``(term, tf)`` with one row per text and term."""
    counts = (
        terms.groupBy("term")
        .agg(F.sum("tf").alias("corpus_count"), F.count("*").alias("df"))
        .where(F.col("df") >= min_df)
    )
    if max_features is None:
        return counts
    return counts.orderBy(F.desc("corpus_count"), "term").limit(max_features)


def smooth_idf(df_count, rows):
    return F.log((1 + rows) / (1 + df_count)) + 1


def tfidf_rows(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    low: int = 1,
    high: int = 1,
    max_features: int | None = None,
    min_df: int = 1,
) -> DataFrame:
    """TF-IDF ``(row_id, term, weight)``: ``1 + ln tf``, smooth idf, rows scaled to length 1.

    Every text is tokenised once; the number of rows, the vocabulary and the weights are taken from the
    written term lists. One shuffle brings the terms of a row together for its length.
    """
    tokens = df.select(row_id, word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("__tokens"))
    grams = tokens.select(row_id, word_ngrams("__tokens", low, high).alias("__t"))
    lists = checkpointed(grams.select(row_id, term_counts("__t").alias("__terms")))
    rows = lists.count()
    terms = lists.select(row_id, F.inline("__terms"))
    vocab = top_terms(terms, max_features, min_df)
    weights = vocab.select("term", smooth_idf(F.col("df"), F.lit(rows)).alias("idf"))
    raw = terms.join(checked_broadcast(weights), "term").select(
        row_id, "term", ((F.log("tf") + 1) * F.col("idf")).alias("w")
    )
    # The terms of one text, summed in term order so that the length is the same on every run.
    cells = raw.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["w"] * c["w"]))
    return cells.withColumn("norm", norm).select(row_id, "norm", F.inline("cells")).select(
        row_id, "term", (F.col("w") / F.col("norm")).alias("weight")
    )


class _Text(HasInputCol, HasOutputCol):
    low = Param(Params._dummy(), "low", "smallest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "largest n-gram", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "rows a term needs", TypeConverters.toInt)
    kind = Param(Params._dummy(), "kind", "counts or tfidf", TypeConverters.toString)

    def tokens(self, df: DataFrame) -> DataFrame:
        """The rows with their words, or texts to find them in, in ``__tokens``."""
        return df.withColumn("__tokens", terms.words_column(F.coalesce(F.col(self.getInputCol()), F.lit(""))))


class TermVectors(Estimator, _Text):
    """Counts or TF-IDF of word n-grams over the most frequent terms, as sparse vectors."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="features", kind="tfidf", low=1, high=1,
                 maxFeatures=15_000, minDF=1):
        super().__init__()
        self._setDefault(
            inputCol="text", outputCol="features", kind="tfidf", low=1, high=1, maxFeatures=15_000, minDF=1
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TermVectorsModel":
        return self.fit_tokens(self.tokens(df))

    def fit_tokens(self, lists: DataFrame) -> "TermVectorsModel":
        """Fit on rows whose words are in ``__tokens`` already, as ``tokens`` makes them."""
        opt = self.getOrDefault
        rows = lists.count()
        # No more than maxFeatures rows.
        known = terms.frequent(lists, opt("low"), opt("high"), opt("maxFeatures"), opt("minDF"))
        if known is None:
            grams = lists.select(word_ngrams(terms.word_lists(F.col("__tokens")), opt("low"), opt("high")).alias("__terms"))
            found = top_terms(grams.select(F.inline(term_counts("__terms"))), opt("maxFeatures"), opt("minDF"))
            known = [(r["term"], r["df"]) for r in found.collect()]
        known.sort()
        idf = [float(np.log((1 + rows) / (1 + df)) + 1) for _, df in known]
        return self._copyValues(TermVectorsModel([t for t, _ in known], idf))


class TermVectorsModel(Model, _Text, Saved):
    """Fitted ``TermVectors``: words come from the JVM, terms are counted and scaled in Arrow batches."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float]):
        super().__init__()
        self.terms, self.idf = list(terms), list(idf)

    def _state(self) -> dict:
        return {"terms": self.terms, "idf": self.idf}

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.vectors(self.tokens(df))

    def vectors(self, lists: DataFrame) -> DataFrame:
        """Vectors of rows whose words are in ``__tokens``."""
        opt = self.getOrDefault
        if not self.terms:
            raise ValueError("no terms left in the vocabulary")
        idf = None if opt("kind") == "counts" else np.asarray(self.idf)
        levels = terms.Levels.of(self.terms, opt("low"), opt("high"))
        shared = lists.sparkSession.sparkContext.broadcast((levels, len(self.terms), idf))

        def vectors(words: pa.Array) -> pa.Array:
            return terms.vectors(words, *shared.value)

        return lists.withColumn(self.getOutputCol(), F.arrow_udf(vectors, VectorUDT())("__tokens")).drop("__tokens")


class KeywordFlags(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Commercial and technical wording as a vector of two flags."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="keywords"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="keywords")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        flags = F.array(*keyword_flags(F.coalesce(F.col(self.getInputCol()), F.lit(""))))
        return df.withColumn(self.getOutputCol(), array_to_vector(flags))


class WordList(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Lower-case whitespace words, as input for word vectors."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="words"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="words")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(
            F.lower(F.coalesce(F.col(self.getInputCol()), F.lit(""))), F.lit(r"((?U)\S+)"), F.lit(1)
        )
        return df.withColumn(self.getOutputCol(), words)


class ClassIndex(Estimator, HasLabelCol):
    """Number of a class in sort order as ``label_idx`` and its balanced weight as ``weight``."""

    @keyword_only
    def __init__(self, *, labelCol="label", balanced=True):
        super().__init__()
        self.balanced = balanced
        self._set(labelCol=labelCol)

    def _fit(self, df: DataFrame) -> "ClassIndexModel":
        label = self.getLabelCol()
        names = distinct_values(df, label)
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # len(names) rows
        total = sum(counts.values())
        weights = [total / (len(names) * counts[n]) if self.balanced else 1.0 for n in names]
        return self._copyValues(ClassIndexModel(names, weights))


class ClassIndexModel(Model, HasLabelCol, Saved):
    def __init__(self, names: Sequence, weights: Sequence[float]):
        super().__init__()
        self.names, self.weights = list(names), list(weights)

    def _state(self) -> dict:
        return {"names": self.names, "weights": self.weights}

    def _transform(self, df: DataFrame) -> DataFrame:
        label = self.getLabelCol()
        if label not in df.columns:
            return df
        place = F.array_position(literal_array(self.names, dict(df.dtypes)[label]), F.col(label))
        weight = F.get(literal_array(self.weights, "double"), (place - 1).cast("int"))
        return df.withColumn("label_idx", (place - 1).cast("double")).withColumn(
            "weight", F.coalesce(weight, F.lit(1.0))
        )
