"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is an expression over the row itself, so nothing is shuffled. Windows of three words
are compared by sorting (hash, window, position) inside the row: n log n in the row's own words,
whatever repeats.

Defined cases: a null text has no words and no lines, and fails the base rule. Lines are what stands
between line feeds; a line without a word is never a repeated line. Repeated rows are judged alike,
whatever their id. A division by zero words gives zero. ``keep_good`` returns every column of the
input as it was, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, settled, table
from tallyloom.llm.registry import query

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\"'()"

#: Frequent words of English, French, German and Spanish; fixed values.
STOP_WORDS = (
    "the and of to in a is it that for was on are with as at by this be have from or an not "
    "le la les de des et en un une du que qui est dans pour pas sur au par avec "
    "der die das und zu den mit von für auf ist im sich dem nicht ein eine "
    "el y los del se las por para con no su al es lo como"
).split()


@dataclass(frozen=True)
class Limit:
    """``measure`` must lie within [low, high]; a missing bound does not matter."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rule of every document, and the threshold table of the method.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LIMITS = (
    Limit("words", 50),
    Limit("mean_word", 2.0, 12.0),
    Limit("symbols_per_word", None, 0.1),
    Limit("stop_share", 0.02, None),
    Limit("letter_share", 0.6, None),
    Limit("repeated_line_share", None, 0.4),
    Limit("bullet_line_share", None, 0.9),
    Limit("ellipsis_line_share", None, 0.3),
)


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _count(c: Column, chars: str) -> Column:
    return (F.char_length(c) - F.char_length(_without(c, chars))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_m`` of all counts; three projections, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "")
    one = docs.withColumns({"_t": t, "_w": words, "_l": lines})
    w = F.col("_w")
    windows = F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"),
            i.alias("i"),
        ),
    )
    two = one.withColumn("_s", F.sort_array(windows))
    s = F.col("_s")
    twice = F.filter(
        F.transform(s, lambda x, j: F.when((x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]), x["i"])), lambda x: x.isNotNull()
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))
    tt, ll = F.col("_t"), F.col("_l")
    starts = lambda *p: F.size(F.filter(ll, lambda x: F.ltrim(x).rlike(rf"^[{''.join(p)}]")))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.char_length(tt) - _count(tt, SPACES)).cast("long").alias("word_chars"),
        _count(tt, SYMBOLS).alias("n_symbols"),
        F.size(ll).cast("long").alias("n_lines"),
        (F.size(ll) - F.size(F.array_distinct(ll))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: ascii_lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.char_length(F.regexp_replace(tt, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        starts("•", "\\-", "*").cast("long").alias("n_bullets"),
        F.size(F.filter(ll, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipses"),
    )
    return two.withColumn("_m", counts).drop("_t", "_w", "_l", "_s")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(m: Column) -> dict[str, Column]:
    """What the threshold table can name."""
    return {
        "words": m["n_words"].cast("double"),
        "mean_word": _share(m["word_chars"], m["n_words"]),
        "symbols_per_word": _share(m["n_symbols"], m["n_words"]),
        "stop_share": _share(m["n_stop"], m["n_words"]),
        "letter_share": _share(m["n_letters"], m["word_chars"]),
        "repeated_line_share": _share(m["n_dup_lines"], m["n_lines"]),
        "bullet_line_share": _share(m["n_bullets"], m["n_lines"]),
        "ellipsis_line_share": _share(m["n_ellipses"], m["n_lines"]),
    }


def compile_limits(limits: tuple[Limit, ...], known: dict[str, Column]) -> Column:
    """One condition: every measure lies within its bounds."""
    out = F.lit(True)
    for x in limits:
        if x.low is not None:
            out = out & (known[x.measure] >= F.lit(float(x.low)))
        if x.high is not None:
            out = out & (known[x.measure] <= F.lit(float(x.high)))
    return out


def judge(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS, text: str = "text") -> DataFrame:
    """``docs`` with ``_m`` (counts), ``_base_failed`` and ``_kept``."""
    out = measure(docs, text)
    m = F.col("_m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return out.withColumn("_base_failed", failed).withColumn("_kept", ~F.col("_base_failed") & compile_limits(limits, measures(m)))


def keep_good(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their own columns."""
    judged = judge(docs.select(F.struct("*").alias("_row"), "text"), limits)
    return settled(judged, F.col("_kept")).select("_row.*")


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: The same in plain SQL, over unnested words.
JUDGED_SQL = rf"""
doc AS (SELECT row_number() OVER () AS rid, * FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM {{docs}})),
listed AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc),
word AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM listed),
win AS (SELECT rid, p, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY p)),
twice AS (SELECT rid, p FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
counted AS (SELECT d.*, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_LIST}))) AS n_stop,
    length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[•\-*]'))) AS n_bullets,
    len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipses
    FROM doc d JOIN listed USING (rid) LEFT JOIN covered c USING (rid)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
judged AS (SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12
    AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02 AND n_letters / word_chars >= 0.6
    AND n_dup_lines / n_lines <= 0.4 AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.3 AS kept FROM based)
"""

SQL = f"""WITH {JUDGED_SQL.replace("{docs}", "documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM judged
"""


@query("op6_quality_rules", SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("_m")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
