"""Line-first cleaning (native): rules judge every line, failing lines go, and a document that loses too much
of its text is rejected.

All work is Column expressions over one row: no shuffle, no Python. Defined results:
null text counts as empty; an empty text has zero counts and is not kept (it has under ten words); ties and
repeated rows are judged each on their own; an empty table gives an empty table; other columns of the input are
never read, and results come as one struct, so equal names cannot clash. Very long texts are one row's arrays,
with one sort of their repeated windows (n log n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, read

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Rules of a line. A line that holds no word is neither counted nor judged.
LONG_LINE_WORDS = 12
MARK = r"[.!?;:,\x{2026}\x{3002}]"
SYMBOL_PER_100 = 8
SHOUT_PER_100 = 30
NAV_MARK = r"[|>\x{00BB}\x{2022}\x{00B7}]"
BOILERPLATE = r"(?i)(all rights reserved|alle rechte vorbehalten|tous droits r[e\x{00E9}\x{00C9}]serv|todos los derechos reservados|\x{00A9} ?[0-9]{4}|copyright ([0-9]{4}|\x{00A9})|(cookie|privacy) (policy|settings|notice)|(accept|we use|uses) (all )?cookies|terms (of (use|service)|and conditions)|subscribe to (our|the)|unsubscribe|sign (up for|in to)|log in to|click here|read more|back to top|powered by|enable javascript|skip to (main )?content|(share|follow us) on (facebook|twitter|instagram|linkedin))"
BOILERPLATE_MAX_WORDS = 40
MAX_LOSS_PER_100 = 40


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def _count(text: Column, kind: str) -> Column:
    """Characters of class kind in text."""
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def repeat_words(w: Column) -> Column:
    """Words inside windows of five words found twice or more. Windows compare by a 64-bit hash."""
    size = F.size(w)
    hashes = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k)
                    for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda a, k: a
            + F.when(k == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k))).cast("long"))

    def places(z: Column) -> Column:
        last = F.size(z) - 1
        same = lambda j: ((j > 0) & (F.get(z, j)["h"] == F.get(z, j - 1)["h"])) | ((j < last) & (F.get(z, j)["h"] == F.get(z, j + 1)["h"]))
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda j: F.get(z, j)["i"]))

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, lambda z: let(places(z), covered)))

    return let(hashes, of)


def line_passes(line: Column) -> Column:
    """The verdict of the line rules: punctuation, navigation and boilerplate."""

    def judge(x: Column) -> Column:
        n, chars = x["n"], x["c"]
        punctuation = ((n >= LONG_LINE_WORDS) & ~line.rlike(MARK)) | (_count(line, SYMBOL) * 100 > SYMBOL_PER_100 * chars) | (_count(line,
                "!") * 100 > SHOUT_PER_100 * n) & (n >= 4)
        marks = _count(line, NAV_MARK)
        navigation = (marks >= 3) & (marks * 3 >= n)
        boilerplate = (n <= BOILERPLATE_MAX_WORDS) & line.rlike(BOILERPLATE)
        return ~(punctuation | navigation | boilerplate)

    return let(F.struct(F.size(words(line)).alias("n"), _chars(line).alias("c")), judge)


def measure(text: Column) -> Column:
    """Struct of the base counts, the cleaned text and the verdicts for one text."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.filter(lines, line_passes).alias("good"),
        )

    base = F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
        _chars(text).cast("long").alias("word_chars"),
        _count(text, SYMBOL).cast("long").alias("n_symbols"),
    )

    def verdict(b: Column) -> Column:
        clean = F.array_join(b["l"]["good"], "\n")
        failed = (b["w"]["n_words"] < 10) | (100 * b["w"]["n_repeat_words"] > 20 * b["w"]["n_words"])
        lost = 100 * (b["word_chars"] - _chars(clean)) > MAX_LOSS_PER_100 * b["word_chars"]
        return F.struct(
            b["w"]["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"),
                b["l"]["n_dup_lines"].alias("n_dup_lines"), b["w"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & ~lost).alias("kept"), clean.alias("clean_text"),
        )

    return let(base, verdict)


def line_first_clean(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """df with a struct column `out` (see measure); a column of that name is replaced."""
    return df.withColumn(out, measure(F.col(text)))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; the text is what the lines that passed leave, joined by line
    ends. Measured once a row: a filter on the verdict would measure again."""
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    good = F.explode(F.filter(F.array(measure(named(text))), lambda q: q["kept"]))
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), good.alias("quality"))
    return rows.select(*[(F.col("quality.clean_text") if c == text else F.col("row")[c]).alias(c) for c in df.columns])


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return line_first_clean(docs).select("doc_id", *[q[n].alias(n) for n in names])


OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, i, w FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t))),
g AS (SELECT rid, i, CASE WHEN lead(w, 4) OVER o IS NULL THEN NULL ELSE concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 THEN 1 ELSE 0 END AS hit FROM g),
c AS (SELECT rid, max(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM f),
r AS (SELECT rid, count(*) AS n_words, sum(covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^!]', '', 'g')) AS bang, length(regexp_replace(line, '[^|>\x{00BB}\x{2022}\x{00B7}]', '', 'g')) AS nav FROM l),
v AS (SELECT rid, line, c, NOT ((n >= 12 AND NOT regexp_matches(line, '[.!?;:,\x{2026}\x{3002}]')) OR sym * 100 > 8 * c OR (bang * 100 > 30 * n AND n >= 4) OR (nav >= 3 AND nav * 3 >= n)
  OR (n <= 40 AND regexp_matches(line, '(?i)(all rights reserved|alle rechte vorbehalten|tous droits r[e\x{00E9}\x{00C9}]serv|todos los derechos reservados|\x{00A9} ?[0-9]{4}|copyright ([0-9]{4}|\x{00A9})|(cookie|privacy) (policy|settings|notice)|(accept|we use|uses) (all )?cookies|terms (of (use|service)|and conditions)|subscribe to (our|the)|unsubscribe|sign (up for|in to)|log in to|click here|read more|back to top|powered by|enable javascript|skip to (main )?content|(share|follow us) on (facebook|twitter|instagram|linkedin))'))) AS good FROM m),
d AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(c) AS c, coalesce(sum(c) FILTER (good), 0) AS good_c FROM v GROUP BY rid),
a AS (SELECT t.rid, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(d.c, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(good_c, 0) AS good_c FROM t LEFT JOIN r USING (rid) LEFT JOIN d USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * (word_chars - good_c) > 40 * word_chars) AS kept FROM a
"""
