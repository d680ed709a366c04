"""Line dedup by a log-template tree, in DataFrame operations only.

Lines are parsed to a fixed depth: number of tokens, then the first three tokens, with every run of digits
read as one field. A leaf holds any number of templates, and a template is a line that exists: its
variants agree with it in at least four fifths of their tokens, the rest being variable fields. A variant differs in
at most a fifth of n tokens, so if the tokens behind the leading ones are cut into one segment more than that, some
segment agrees. Within a leaf, lines with one segment in common are therefore held against the earliest of
them (by first document, then by digest), never against each other. A line that finds such a partner is a variant of it, unless the
partner is a variant itself; so every dropped line agrees with a line that stays in an earlier document.
A template that recurs stays in its first document and goes, with its variants, from all later ones. Lines of fewer than five
tokens cannot vary; they go where they stand in ``SHORT_DOCUMENTS`` documents or more, since a word or two recur by chance.

Tokens are made once, where the texts lie, and written beside the lines' numbers and digests; what is shuffled is one
row of digests per line, once the lines with their leaf to find the leaves that hold several, and the texts once to meet
the numbers of their dropped lines. Every aggregate reduces a frequent line or leaf before the shuffle; nothing is
gathered but the numbers of one document's dropped lines.

Defined cases: a null text stays null. Lines without a token stay. Lines that repeat within one document only are kept.
Rows with one id count as one document; rows without an id keep all lines. A text from which nothing is dropped does not change.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import settled, table
from tallyloom.llm.registry import query
from tallyloom.session import materialise

#: Leading tokens of a leaf; one variable field for so many tokens; and where lines of fewer tokens count as templates.
DEPTH, VARIABLE, SHORT_DOCUMENTS = 3, 5, 20
SPACE = r"[\x20\x09-\x0D]"


def _plain(line: Column) -> Column:
    """Tokens of a line joined by single spaces, with each run of digits as one 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), rf"{SPACE}{{2,}}|[\x09-\x0D]", " "))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, plain, n, leaf, key) of the lines that have a token; ``row`` tells rows of one id apart by their text.

    ``plain`` is null where a line cannot vary.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    plain = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "row", "at", _plain(F.col("line")).alias("plain"))
    lead = F.substring_index("plain", " ", DEPTH)
    n = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    keyed = plain.select("doc_id", "row", "at", "plain", n.alias("n"), lead.alias("lead"), F.unhex(F.md5("plain")).alias("key"))
    text = F.when(F.col("n") >= VARIABLE, F.col("plain")).alias("plain")
    return keyed.select("doc_id", "row", "at", text, "n", F.xxhash64("n", "lead").alias("leaf"), "key")


def variants(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(key, first): variants of a template, and the first document of it. ``known`` has leaf, key, first of the lines that can vary."""
    several = known.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    texts = lines.where(F.col("n") >= VARIABLE).select("leaf", "key", "plain").join(several, "leaf").groupBy("leaf", "key").agg(F.min("plain").alias("plain"))
    texts = materialise(texts.join(known, ["leaf", "key"]).select("leaf", "key", "first", F.split("plain", " ").alias("tokens")), "several")
    rest = F.size("tokens") - DEPTH
    pieces = F.floor(F.size("tokens") / VARIABLE).cast("int") + 1
    at = texts.select("leaf", "key", "first", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k"), rest.alias("rest"), pieces.alias("pieces"))
    start, end = (F.floor(k * F.col("rest") / F.col("pieces")).cast("int") for k in (F.col("k"), F.col("k") + 1))
    segment = F.array_join(F.slice("tokens", start + DEPTH + 1, end - start), " ")
    filed = at.select("key", "first", F.xxhash64("leaf", "k", segment).alias("block"))
    earliest = filed.groupBy("block").agg(F.min(F.struct("first", "key")).alias("head"), F.count("*").alias("lines")).where("lines > 1")
    pairs = filed.join(earliest, "block").where(F.col("head.key") != F.col("key")).select("key", F.col("head.key").alias("partner")).distinct()
    own = texts.select("key", "tokens")
    heads = texts.select(F.col("key").alias("partner"), F.col("tokens").alias("shape"), F.col("first").alias("since"))
    agree = F.size(F.filter(F.zip_with("tokens", "shape", lambda a, b: a == b), lambda x: x))
    alike = pairs.join(own, "key").join(heads, "partner").where((F.size("tokens") == F.size("shape")) & (agree * VARIABLE >= F.size("tokens") * (VARIABLE - 1)))
    alike = materialise(alike.select("key", "partner", "since"), "alike")
    stays = alike.join(alike.select(F.col("key").alias("partner")).distinct(), "partner", "left_anti")
    return stays.groupBy("key").agg(F.min("since").alias("first"))


def recurring(lines: DataFrame) -> DataFrame:
    """(key, first): lines of a recurring template, and the document in which it stays."""
    known = materialise(lines.groupBy("leaf", "key").agg(F.min("n").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "known")
    long = known.where(F.col("n") >= VARIABLE)
    found = variants(lines, long.select("leaf", "key", "first")).withColumnRenamed("first", "since")
    varied = long.join(found, "key", "left").select("key", F.coalesce("since", "first").alias("first"), "last").where("first < last")
    short = lines.where(F.col("n") < VARIABLE).select("key", "doc_id").distinct().groupBy("key")
    short = short.agg(F.min("doc_id").alias("first"), F.count("*").alias("documents")).where(F.col("documents") >= SHORT_DOCUMENTS)
    return varied.select("key", "first").unionByName(short.select("key", "first"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped, and ``_n_lines``, ``_n_dropped``."""
    lines = materialise(parsed_lines(docs), "lines", "zstd")
    gone = lines.select("doc_id", "row", "at", "key").join(recurring(lines), "key").where("doc_id > first")
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row_key"), "_gone")
    out = docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_row_key")), "left")
    every = F.split("text", "\n")
    # what lies between two dropped lines is one slice
    none = F.array().cast("array<int>")
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda k: k + 1)), F.concat(F.col("_gone"), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a)))
    out = out.withColumns({"_lines": F.when(F.col("_gone").isNotNull(), every), "_n_lines": F.coalesce(F.size(every), F.lit(0)).cast("long")})
    out = out.withColumns(
        {
            "_n_dropped": F.size(F.coalesce("_gone", none)).cast("long"),
            "text": F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    )
    return out.drop("_gone", "_lines", "_id", "_row_key")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of ``docs``, ``n_chars`` with the text; a document that loses all its words is dropped."""
    out = drop_recurring(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    changed = F.col("_n_dropped") > 0
    out = settled(out, ~F.coalesce(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


#: The same in plain SQL; leaves and segments are the tokens themselves.
DEDUP_SQL = r"""
split_l AS (SELECT *, string_split(text, chr(10)) AS l FROM {docs}),
line AS (SELECT doc_id, x, string_split_regex(regexp_replace(x, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+') AS raw
    FROM (SELECT doc_id, unnest(l) AS x FROM split_l WHERE doc_id IS NOT NULL)),
tok AS (SELECT * FROM (SELECT doc_id, x, list_filter(raw, lambda t: t <> '') AS t FROM line) WHERE len(t) > 0),
keyed AS (SELECT doc_id, x, t, len(t) AS n, md5(array_to_string(t, ' ')) AS key, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM tok),
known AS (SELECT leaf, key, t, n, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT doc_id) AS documents FROM keyed GROUP BY leaf, key, t, n),
several AS (SELECT *, n // 5 + 1 AS pieces FROM known WHERE n >= 5 AND leaf IN (SELECT leaf FROM known GROUP BY leaf HAVING count(*) > 1)),
filed AS (SELECT leaf, key, t, first, k, array_to_string(t[4 + k * (n - 3) // pieces : 3 + (k + 1) * (n - 3) // pieces], ' ') AS segment
    FROM (SELECT *, unnest(range(pieces)) AS k FROM several)),
heads AS (SELECT leaf, k, segment, min(struct_pack(first := first, key := key)) AS head FROM filed GROUP BY ALL HAVING count(*) > 1),
pairs AS (SELECT DISTINCT f.key, f.t, h.head.key AS partner, h.head.first AS since FROM filed f JOIN heads h USING (leaf, k, segment) WHERE h.head.key <> f.key),
alike AS (SELECT p.key, p.partner, p.since FROM pairs p JOIN several s ON s.key = p.partner
    WHERE 5 * len(list_filter(range(1, len(p.t) + 1), lambda i: p.t[i] = s.t[i])) >= 4 * len(p.t)),
variant AS (SELECT key, min(since) AS since FROM alike WHERE partner NOT IN (SELECT key FROM alike) GROUP BY key),
firsts AS (SELECT k.key, coalesce(v.since, k.first) AS first FROM known k LEFT JOIN variant v ON v.key = k.key
    WHERE CASE WHEN n < 5 THEN documents >= 20 ELSE coalesce(v.since, k.first) < last END),
gone AS (SELECT doc_id, list(DISTINCT x) AS xs FROM keyed JOIN firsts USING (key) WHERE doc_id > first GROUP BY doc_id),
deduped AS (SELECT s.* EXCLUDE (l) REPLACE (CASE WHEN g.xs IS NULL THEN text
    ELSE array_to_string(list_filter(l, lambda x: NOT list_contains(g.xs, x)), chr(10)) END AS text), len(l) AS n_lines,
    len(l) - len(list_filter(l, lambda x: NOT coalesce(list_contains(g.xs, x), false))) AS n_dropped
    FROM split_l s LEFT JOIN gone g ON g.doc_id = s.doc_id)
"""

SQL = f"""WITH {DEDUP_SQL.replace("{docs}", "documents")}
SELECT doc_id, n_lines, n_dropped, text FROM deduped"""


@query("op3_line_templates", SQL)
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")
