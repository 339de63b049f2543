"""Label columns: aliases, remaps, filters, data-set variants and counts."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.functions.columns import ColumnLike, col, is_blank, strip
from talkmill.functions.text import clean_filename
from talkmill.session import checked_broadcast, checkpointed

GROUP_ALIASES = ("assigned_group", "assig_group")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available columns: {df.columns}")
    return df


def _lookup(aliases: Mapping[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, key)


def normalise_label(
    label: ColumnLike,
    aliases: Mapping[str, str],
    empty: Sequence[str] = tuple(fixed.EMPTY_LABELS),
) -> Column:
    """Lower-case trimmed label by its alias; unknown labels stay, suspicious ones become ""."""
    key = F.lower(strip(label))
    return F.when(key.isin(list(empty)), "").otherwise(F.coalesce(_lookup(aliases, key), key))


def unknown_labels(
    df: DataFrame,
    column: str,
    aliases: Mapping[str, str],
    empty: Sequence[str] = tuple(fixed.EMPTY_LABELS),
) -> DataFrame:
    """Labels without an alias and how often they occur."""
    key = F.lower(strip(column))
    return (
        df.select(key.alias("label"))
        .where(~F.col("label").isin([*aliases, *empty]))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def suspicious_rows(df: DataFrame, column: str, text: str = "text") -> DataFrame:
    """Rows whose label will be cleared, with the start of their text."""
    hit = F.lower(strip(column)).isin(fixed.EMPTY_LABELS)
    return df.where(hit).withColumn("text_start", F.substring(text, 1, 80))


def normalise_labels(
    df: DataFrame,
    priority: Mapping[str, str] = fixed.PRIORITY_ALIASES,
    call_purpose: Mapping[str, str] = fixed.CALL_PURPOSE_ALIASES,
    assigned_group: Mapping[str, str] = fixed.ASSIGNED_GROUP_ALIASES,
) -> DataFrame:
    """Normalise the three label columns of a transcript table; absent ones are skipped."""
    tables = {"priority": priority, "call_purpose": call_purpose, "assigned_group": assigned_group}
    present = {c: normalise_label(c, a) for c, a in tables.items() if c in df.columns}
    return df.withColumns(present)


def remap_labels(df: DataFrame, column: str, mapping: Mapping[str, str] = fixed.EVAL_REMAP) -> DataFrame:
    """Replace exact label values."""
    return df.replace(dict(mapping), subset=[column])


def remap_counts(df: DataFrame, column: str, mapping: Mapping[str, str] = fixed.EVAL_REMAP) -> DataFrame:
    """Rows per label before and after a remap."""
    pair = F.explode(
        F.array(
            F.struct(F.lit("before").alias("stage"), F.col(column).alias("label")),
            F.struct(
                F.lit("after").alias("stage"),
                F.coalesce(_lookup(mapping, F.col(column)), F.col(column)).alias("label"),
            ),
        )
    )
    return (
        df.select(pair.alias("p"))
        .groupBy("p.stage", "p.label")
        .agg(F.count("*").alias("n"))
    )


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per label; null and blank labels are counted under ""."""
    label = F.when(is_blank(column), "").otherwise(F.col(column))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent per class."""
    counts = label_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") * 100.0 / total).alias("percent"))


def training_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows marked for training, if the mark column exists, that have text."""
    if "is_training_sample" in df.columns:
        df = df.where(strip("is_training_sample") == "1")
    return df.where(~is_blank(text))


def eval_rows(df: DataFrame, text: str, target: str) -> DataFrame:
    """Rows with text and target, both trimmed; an error if there are none."""
    require_columns(df, text, target)
    out = df.withColumns({text: strip(text), target: strip(target)})
    return not_empty(out.where((F.col(text) != "") & (F.col(target) != "")), "evaluation rows")


def not_empty(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def keep_ready_rows(
    df: DataFrame, keep_all: bool = False, strict_reference: bool = False
) -> DataFrame:
    """Ready data set: rows with a target, short file names, the fixed columns.

    The group column has two names in use. ``assigned_group`` is accepted for ``assig_group``
    unless ``strict_reference`` asks for the old behaviour, which drops it.
    """
    out = require_columns(df, "call_purpose").where(~is_blank("call_purpose"))
    if "filename" in out.columns:
        out = out.withColumn("filename", clean_filename("filename"))
    if keep_all:
        return out
    if not strict_reference and "assig_group" not in out.columns and "assigned_group" in out.columns:
        out = out.withColumnRenamed("assigned_group", "assig_group")
    missing = [c for c in fixed.READY_COLUMNS if c not in out.columns]
    if missing:
        warnings.warn(f"columns {missing} are not in the table and are left out", stacklevel=2)
    return out.select(*[c for c in fixed.READY_COLUMNS if c in out.columns])


def ready_counts(df: DataFrame) -> DataFrame:
    """Rows before, dropped and after the target filter, in one pass."""
    kept = F.count_if(~is_blank("call_purpose"))
    return df.agg(
        F.count("*").alias("before"),
        (F.count("*") - kept).alias("dropped"),
        kept.alias("after"),
    )


def drop_rare_classes(df: DataFrame, target: str, min_samples: int = 5) -> DataFrame:
    """Trim the target, drop empty ones and classes with fewer than ``min_samples`` rows.

    An error if no class is left; that is seen from the class counts.
    """
    rows = df.withColumn(target, strip(target)).where(F.col(target) != "")
    if min_samples <= 1:
        return not_empty(rows, "rows with a target")
    frequent = rows.groupBy(target).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_samples)
    frequent = not_empty(checkpointed(frequent), f"class with {min_samples} rows")
    return rows.join(checked_broadcast(frequent.select(target)), target, "left_semi")


def multiclass_variant(
    df: DataFrame,
    target: str = "call_purpose",
    min_samples: int = 5,
    spam_label: str = "spam",
    include_spam: bool = False,
) -> DataFrame:
    if not include_spam and "call_purpose" in df.columns:
        df = df.where(F.lower(strip("call_purpose")) != spam_label)
    return drop_rare_classes(df, target, min_samples)


def binary_spam_variant(
    df: DataFrame,
    target: str = "call_purpose",
    min_samples: int = 5,
    spam_label: str = "spam",
    other_label: str = "non_spam",
) -> DataFrame:
    if target != "call_purpose":
        raise ValueError("the binary variant needs the target call_purpose")
    require_columns(df, "call_purpose")
    label = strip(target)
    two = F.when(label == "", "").when(F.lower(label) == spam_label, spam_label).otherwise(other_label)
    return drop_rare_classes(df.withColumn(target, two), target, min_samples)


def dataset_variant(df: DataFrame, variant: str, target: str = "call_purpose", **options) -> DataFrame:
    if variant == "multiclass":
        return multiclass_variant(df, target, **options)
    if variant == "multiclass_with_spam":
        return multiclass_variant(df, target, include_spam=True, **options)
    if variant == "binary_spam":
        return binary_spam_variant(df, target, **options)
    raise ValueError(f"unknown data-set variant '{variant}'")


def only_known_labels(rows: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Rows whose label occurs in the training table."""
    labels = train.select(target).distinct()
    return rows.join(checked_broadcast(labels), target, "left_semi")


def unseen_labels(rows: DataFrame, known: DataFrame, target: str) -> DataFrame:
    """Labels of ``rows`` that ``known`` lacks."""
    return rows.select(target).distinct().join(known.select(target).distinct(), target, "left_anti")


def new_rows(rows: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def is_synthetic(flag: ColumnLike) -> Column:
    return F.lower(strip(F.coalesce(col(flag).cast("string"), F.lit("")))).isin(fixed.SYNTHETIC_WORDS)


def with_subsets(df: DataFrame, flag: str | None = "is_synthetic") -> DataFrame:
    """Repeat each row for the subsets it belongs to: all, and real or synthetic."""
    if flag is None or flag not in df.columns:
        return df.withColumn("subset", F.lit("all"))
    names = F.array(F.lit("all"), F.when(is_synthetic(flag), "synthetic").otherwise("real"))
    return df.withColumn("subset", F.explode(names))


def subset_rows(df: DataFrame, subset: str, flag: str = "is_synthetic") -> DataFrame:
    if subset not in ("all", "real", "synthetic"):
        raise ValueError(f"unknown subset '{subset}'")
    if subset == "all" or flag not in df.columns:
        return df
    return df.where(is_synthetic(flag) if subset == "synthetic" else ~is_synthetic(flag))


def binary_labels(df: DataFrame, label: str, positive: str, negative: str) -> DataFrame:
    """Trimmed rows with a label; an error names labels other than the two expected."""
    rows = df.withColumn(label, strip(F.col(label).cast("string"))).where(F.col(label) != "")
    bad = rows.where(~F.col(label).isin(positive, negative)).select(label).distinct()
    shown = [r[0] for r in bad.orderBy(label).limit(50).collect()]
    if shown:
        raise ValueError(
            f"unexpected labels in '{label}': {shown}; expected only {sorted([positive, negative])}"
        )
    return not_empty(rows, "labelled rows")


def collapse_spam(label: ColumnLike, spam_label: str = "spam", other_label: str = "non_spam") -> Column:
    return F.when(col(label) == spam_label, spam_label).otherwise(other_label)
