"""Mixing sources to target weights: token weights raked to marginals, then documents sampled.

Documents are counted into cells (source, language, topic). Iterative proportional fitting scales the
cells' tokens to the target share of every source, then every language, then every topic, sweep after
sweep, until every margin is within ``TOLERANCE`` of its goal; a cell table that fits into memory is swept
there, a larger one as joins with its margins. Texts are read once for the counts and once for the sample.
A document is kept with a chance in proportion to its cell's factor (weight over tokens); the largest factor
gets chance one, so no chance is cut off and the expected shares are the targets. Without given targets the
margins of the tempered cell table are aimed at (tokens to the power ``TEMPER``): they favour what is scarce, and some
weights reach them for sure, which margins tempered one by one may not, where a topic stands in one language only. The
lot is drawn from a hash of id and text: a second run keeps the same documents.

Results: null sources, languages and texts count as ``(none)`` and as empty; a text without words weighs
nothing, and a cell without tokens is kept whole; repeated rows share their lot; targets for values that
no document has are left out and the others scaled to one; values without a target keep no documents if
targets are given; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved, whole_text
from reliefgrid.runtime import bounded_rows, local_table

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets, the margins of the cells' tokens to this power are aimed at.
TEMPER = 0.9
#: Margins end within this part of their goals.
TOLERANCE = 1e-9
MAX_SWEEPS = 5_000
#: Sweeps of the SQL, which cannot stop by itself.
SQL_SWEEPS = 200
CELLS_PER_FILE = 100_000
#: Cells raked in memory; larger tables are raked as joins, with the same result.
LOCAL_CELLS = 50_000
#: Bounds of the forms that stand for topics: words of a short and of a long text, characters of a line, share of digits.
SHORT_WORDS, LONG_WORDS, LINE_CHARS, DIGIT_SHARE = 50, 500, 80, 0.03
WORD = r"[^ \t\n\r\f\x0B]+"


def topic(text: Column) -> Column:
    """What kind of text it is, by its form in any language: table, lines, figures, short, long or prose."""
    digits, lines = F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit("\n"))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when((lines >= 3) & (F.length(text) < lines * LINE_CHARS), "lines")
        .when((digits > 0) & (digits >= F.length(text) * DIGIT_SHARE), "figures")
        .when(tokens(text) < SHORT_WORDS, "short")
        .when(tokens(text) >= LONG_WORDS, "long")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def lot(id_col: str, text_col: str) -> Column:
    """A number from 0 to below 1 drawn by id and text."""
    seed = F.concat_ws("|", F.col(id_col).cast("string"), F.md5(whole_text(text_col)))
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The columns that cells and sample need, as expressions on ``docs``."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in ("source", "lang")}
    return named | {"topic": topic(whole_text(text_col)), "tokens": tokens(whole_text(text_col)), "lot": lot(id_col, text_col)}


def _swept(weight: np.ndarray, keys: list[np.ndarray], goals: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Tokens raked to all goals, and the largest gap of a margin (share of its goal)."""
    gap = np.inf
    for _ in range(MAX_SWEEPS):
        for key, goal in zip(keys, goals):
            have = np.bincount(key, weight, len(goal))
            weight = weight * np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)[key]
        before = gap
        gap = max(np.abs(np.bincount(key, weight, len(goal)) / goal - 1).max(initial=0) for key, goal in zip(keys, goals))
        if gap <= TOLERANCE or abs(before - gap) <= 1e-9 * gap:
            break
    return weight, float(gap)


def _in_memory(state: DataFrame, goals: Mapping[str, DataFrame]) -> tuple[DataFrame, float] | None:
    """Raked cells and gap, or None for a table that is too large."""
    rows = bounded_rows(state.select(*DIMENSIONS, "tokens"), LOCAL_CELLS)
    if rows is None:
        return None
    goal = {d: {r[0]: r[1] for r in goals[d].collect() if r[1] > 0} for d in DIMENSIONS}
    # cells without tokens or with a value that has no goal get no weight
    some = [i for i, r in enumerate(rows) if r["tokens"] > 0 and all(r[d] in goal[d] for d in DIMENSIONS)]
    weight, gap = np.zeros(len(rows)), 0.0
    if some:
        place = [{v: k for k, v in enumerate(sorted(goal[d]))} for d in DIMENSIONS]
        keys = [np.array([at[rows[i][d]] for i in some]) for d, at in zip(DIMENSIONS, place)]
        aims = [np.array([goal[d][v] for v in at]) for d, at in zip(DIMENSIONS, place)]
        weight[some], gap = _swept(np.array([rows[i]["tokens"] for i in some], float), keys, aims)
    table = [(*r, float(w)) for r, w in zip(rows, weight)]
    return local_table(state.sparkSession, table, "source string, lang string, topic string, tokens bigint, weight double"), gap


def _told(gap: float) -> None:
    if gap > TOLERANCE:
        warnings.warn(f"no weights reach the target shares: a margin stays {gap:.3g} of its goal away", stacklevel=3)


def rake(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``source``, ``lang``, ``topic``, ``tokens``, ``weight``: tokens scaled to the target shares (total kept).

    ``targets`` has a table (value, share) per dimension; without it shares are tempered. Every margin ends within
    ``TOLERANCE`` of its goal; targets that contradict each other are warned of.
    """
    state, goals, files = _goals(cells, targets)
    held = _in_memory(state, goals)
    if held is not None:
        _told(held[1])
        return held[0]
    gap = np.inf
    for _ in range(MAX_SWEEPS):
        state = _joined_sweep(state, goals, files)
        before, gap = gap, _gap(state, goals)
        if gap <= TOLERANCE or abs(before - gap) <= 1e-9 * gap:
            break
    _told(gap)
    return state


def _gap(state: DataFrame, goals: Mapping[str, DataFrame]) -> float:
    def off(d: str) -> DataFrame:
        margin = state.groupBy(d).agg(F.sum("weight").alias("_w")).join(goals[d].filter("_goal > 0"), d)
        return margin.select((F.abs(F.col("_w") - F.col("_goal")) / F.col("_goal")).alias("_off"))

    return off("source").unionByName(off("lang")).unionByName(off("topic")).agg(F.max("_off")).first()[0] or 0.0


def _goals(cells: DataFrame, targets: Mapping[str, DataFrame] | None) -> tuple[DataFrame, dict[str, DataFrame], int]:
    """Cells with their tokens as weights, the goal of every margin, and the files that the cells need."""
    total, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    files = 1 + n // CELLS_PER_FILE  # cells are few and counted, the sweeps' tables need no more
    goals = {}
    for d in DIMENSIONS:
        power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(TEMPER)))
        margin = cells.groupBy(d).agg(F.sum("tokens").alias("_m"), F.sum(power).alias("_s")).filter("_m > 0")
        if targets and d in targets:
            given = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias("_s"))
            margin = margin.drop("_s").join(given, d)
        margin = saved(margin.select(d, "_s").coalesce(files), "goal")
        whole = margin.agg(F.sum("_s")).first()[0] or 1.0
        goals[d] = margin.select(d, (F.col("_s") / whole * total).alias("_goal"))
    state = saved(cells.withColumn("weight", F.col("tokens").cast("double")).coalesce(files), "cells")
    return state, goals, files


def _joined_sweep(state: DataFrame, goals: Mapping[str, DataFrame], files: int) -> DataFrame:
    for d in DIMENSIONS:
        margin = state.groupBy(d).agg(F.sum("weight").alias("_w")).join(goals[d], d, "left")
        # a margin that nothing fills or aims at becomes zero
        ratio = F.when(F.col("_w") > 0, F.coalesce("_goal", F.lit(0.0)) / F.col("_w")).otherwise(F.lit(0.0))
        state = state.join(margin.select(d, ratio.alias("_ratio")), d).withColumn("weight", F.col("weight") * F.col("_ratio")).drop("_ratio")
    return saved(state.select(*DIMENSIONS, "tokens", "weight").coalesce(files), "cells")


def probabilities(cells: DataFrame) -> DataFrame:
    """Adds ``factor`` (weight per token) and ``probability`` (factor over the largest) to raked cells."""
    cells = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    largest = cells.agg(F.max("factor")).first()[0] or 1.0
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.col("factor") / F.lit(largest)), F.lit(1.0)))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the cell, ``tokens``, ``probability`` and ``kept`` of every row."""
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in described(docs, id_col, text_col).items()]), "described")
    met = rows.join(_chances(rows, targets), list(DIMENSIONS))
    return met.select("doc_id", *DIMENSIONS, "tokens", "probability", (F.col("lot") < F.col("probability")).alias("kept"))


def _chances(rows: DataFrame, targets: Mapping[str, DataFrame] | None) -> DataFrame:
    cells = saved(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "counts")
    return saved(probabilities(rake(cells, targets)).select(*DIMENSIONS, "probability"), "chances")


def sampled(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns."""
    made = described(docs, id_col, text_col)
    chances = _chances(docs.select(*[made[k].alias(k) for k in (*DIMENSIONS, "tokens")]), targets)
    chances = chances.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "probability")
    rows = docs.select(*[made[d].alias(f"_{d}") for d in DIMENSIONS], made["lot"].alias("_lot"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(chances, [f"_{d}" for d in DIMENSIONS]).filter(F.col("_lot") < F.col("probability")).select("_row.*")


def oracle() -> str:
    """The same in SQL: the sweeps as a recursive query."""
    goal = "\n".join(f", goal_{d} AS (SELECT {d}, sum(pow(tokens, {TEMPER})) / (SELECT sum(pow(tokens, {TEMPER})) FROM cells WHERE tokens > 0) * (SELECT sum(tokens) FROM cells) AS goal FROM cells WHERE tokens > 0 GROUP BY {d})" for d in DIMENSIONS)
    step = "SELECT n, source, lang, topic, tokens, weight FROM it WHERE n < %d" % SQL_SWEEPS
    for d in DIMENSIONS:
        step = f"SELECT n, source, lang, topic, tokens, CASE WHEN s > 0 THEN weight * coalesce(goal, 0) / s ELSE 0 END AS weight FROM (SELECT x.*, sum(weight) OVER (PARTITION BY {d}) AS s FROM ({step}) x) y LEFT JOIN goal_{d} USING ({d})"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS tokens,
    ('0x' || substr(md5(doc_id || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0 AS lot
  FROM documents
), described AS (
  SELECT doc_id, source, lang, tokens, lot, CASE WHEN contains(t, ' | ') THEN 'table'
    WHEN length(t) - length(replace(t, chr(10), '')) >= 3 AND length(t) < (length(t) - length(replace(t, chr(10), ''))) * {LINE_CHARS} THEN 'lines'
    WHEN regexp_matches(t, '[0-9]') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= length(t) * {DIGIT_SHARE} THEN 'figures'
    WHEN tokens < {SHORT_WORDS} THEN 'short' WHEN tokens >= {LONG_WORDS} THEN 'long' ELSE 'prose' END AS topic FROM base
), cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM described GROUP BY ALL)
{goal}
, it AS (
  SELECT 0 AS n, source, lang, topic, tokens, tokens::DOUBLE AS weight FROM cells
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, weight FROM ({step}) z
), done AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens END AS factor FROM it WHERE n = {SQL_SWEEPS}
), chances AS (SELECT source, lang, topic, coalesce(least(1.0, factor / max(factor) OVER ()), 1.0) AS probability FROM done)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(probability, 6) AS probability, lot < probability AS kept
FROM described JOIN chances USING (source, lang, topic)"""
