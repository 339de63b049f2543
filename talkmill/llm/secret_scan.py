"""Secrets in texts: fixed patterns, and strings that a character Markov model finds random.

Everything is column expressions; the model is a table of at most 2 * 68 * 68 character pairs.

Two first-order Markov chains over characters are counted, one from strings labelled random and one from
ordinary identifiers. A candidate, a run of at least 16 identifier characters, is a secret when its mean
log-likelihood ratio exceeds 0 and the middle between the medians of both kinds of samples. Medians are used
because unlabelled secrets lie among the ordinary samples.

Null texts count as empty and have no spans. Repeated rows are scanned each on its own. Without samples
of both kinds the model adds nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.expressions import let, matches

# Fixed patterns of the three kinds; a failing match is dropped, not tried again.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# A match of these is a whole run, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
CANDIDATE_CHARS = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SAMPLE_WEIGHT = 16.0
EDGE = len(ALPHABET)  # stands before the first and after the last character

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted spans of the fixed patterns: array of ``struct<start, rank, end>``, rank as in ``KINDS``."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)
    found = F.concat(_spans(assign, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2))
    return F.array_sort(found)


def scanned(df: DataFrame, text: str = "text", base: str = "base", candidates: str = "candidates") -> DataFrame:
    """Add the pattern spans and the candidates of the model to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({base: base_spans(body), candidates: matches(body, CANDIDATE)})


def _overlaps(spans: Column, m: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))


def samples(rows: DataFrame, base: str = "base", candidates: str = "candidates") -> DataFrame:
    """Labelled samples ``(value, random)`` from scanned rows.

    Candidates inside a pattern span are samples of random strings, all others of ordinary identifiers.
    """
    labelled = F.transform(
        candidates, lambda m: F.struct(m["value"].alias("value"), _overlaps(F.col(base), m).alias("random"))
    )
    return rows.select(F.inline(labelled))


def _pairs(value: Column) -> Column:
    """Numbers of the character pairs of a string, with an edge at both ends."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def of(p: Column) -> Column:
        inner = F.transform(p, lambda x, i: F.coalesce(F.get(p, i - 1), F.lit(EDGE)) * (EDGE + 1) + x)
        return F.concat(inner, F.array(F.element_at(p, -1) * (EDGE + 1) + EDGE))

    return let(places, of)


@dataclass
class RandomStrings:
    """Log-likelihood ratios of character pairs and the mean that a random string must exceed."""

    ratios: list[float] | None
    threshold: float = 0.0

    def mean_ratio(self, value: Column) -> Column:
        """Mean log-likelihood ratio of a string, positive when it looks random."""
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")  # folded into one literal
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.size(p)
        return let(_pairs(value), total)


def fit(labelled: DataFrame) -> RandomStrings:
    """Markov chains with add-half smoothing from samples ``(value, random)``.

    Samples are characters of ``ALPHABET``, as ``CANDIDATE`` finds them. Equal samples count once and every sample
    weighs ``SAMPLE_WEIGHT`` pairs, so neither copies nor a very long run decide the model.
    """
    different = labelled.distinct().withColumn("pairs", _pairs(F.col("value")))
    weight = F.lit(SAMPLE_WEIGHT) / F.size("pairs")
    pairs = different.select("random", weight.alias("weight"), F.explode("pairs").alias("pair"))
    rows = pairs.groupBy("random", "pair").agg(F.sum("weight").alias("n")).collect()  # at most 2 * 68 * 68 rows
    width = EDGE + 1
    counts = {kind: [0.5] * (width * width) for kind in (True, False)}
    for r in rows:
        counts[r.random][r.pair] += r.n
    if len({r.random for r in rows}) < 2:
        return RandomStrings(None)
    logs = {}
    for kind, table in counts.items():
        totals = [sum(table[a * width : (a + 1) * width]) for a in range(width)]
        logs[kind] = [math.log(c / totals[i // width]) for i, c in enumerate(table)]
    model = RandomStrings([round(a - b, 6) for a, b in zip(logs[True], logs[False])])
    ratios = different.select("random", model.mean_ratio(F.col("value")).alias("ratio"))
    medians = ratios.groupBy("random").agg(F.percentile_approx("ratio", F.lit(0.5)).alias("median")).collect()
    model.threshold = max(0.0, sum(r.median for r in medians) / 2)
    return model


def uncovered(spans: Column, candidates: Column) -> Column:
    """Candidates, and of those that overlap a pattern span the parts outside that are long enough to be one."""

    def parts(m: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

        def gaps(b: Column) -> Column:
            # How far the spans before each one reach; a gap lies between that and the next start.
            reach = F.aggregate(
                b, F.array(m["start"]), lambda done, s: F.concat(done, F.array(F.greatest(F.element_at(done, -1), s["end"])))
            )
            ends = F.concat(F.transform(b, lambda s: s["start"]), F.array(m["end"]))
            pairs = F.filter(
                F.arrays_zip(reach.alias("start"), ends.alias("end")), lambda g: g["end"] - g["start"] >= CANDIDATE_CHARS
            )
            return F.transform(
                pairs,
                lambda g: F.struct(
                    g["start"].alias("start"),
                    g["end"].alias("end"),
                    F.substring(m["value"], g["start"] - m["start"] + 1, g["end"] - g["start"]).alias("value"),
                ),
            )

        whole = F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return let(inside, lambda b: F.when(F.size(b) == 0, whole).otherwise(gaps(b)))

    return F.flatten(F.transform(candidates, parts))


def all_spans(model: RandomStrings, base: str = "base", candidates: str = "candidates") -> Column:
    """Pattern spans of a scanned row and those the model adds, sorted; none of the former is lost."""
    if model.ratios is None:
        return F.col(base)
    added = F.filter(
        uncovered(F.col(base), F.col(candidates)), lambda m: model.mean_ratio(m["value"]) > model.threshold
    )
    return F.array_sort(F.concat(F.col(base), _spans(added, 3)))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""

    def of(b: Column) -> Column:
        body, s = b["text"], b["spans"]
        reach = F.aggregate(
            s, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.greatest(F.element_at(done, -1), x["end"])))
        )

        def cut(r: Column) -> Column:
            opened = F.transform(
                s,
                lambda x, i: F.when((i == 0) | (x["start"] >= F.get(r, i)), F.concat(F.substring(body, F.get(r, i) + 1, x["start"] - F.get(r, i)), F.lit(mark))).otherwise(F.lit("")),
            )
            return F.concat(F.array_join(opened, ""), F.substring(body, F.element_at(r, -1) + 1, F.length(body)))

        return let(reach, cut)

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("text"), spans.alias("spans")), of)).otherwise(text)
