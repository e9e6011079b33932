"""Column functions over text: all of them stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SENTENCE_END = r"(?<=[.!?])\s+"
PARAGRAPH_GAP = r"\n\s*\n"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(rows: DataFrame, keep: list[Column | str], items: Column, pos: str, item: str) -> DataFrame:
    """rows of keep, place and item of an array, none for an empty or null one. The explode is an outer one whose nulls are
    dropped, for before a plain one Spark filters by the array's size, and so makes a derived array twice."""
    return rows.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


#: Items of a block of scan: appending to a list copies it, so short lists are filled and then joined.
SCAN_BLOCK = 256


def scan(items: Column, zero: Column, state: str, step, kind: str) -> Column:
    """A value an item, in order: step(state, item) gives a struct of s, the state for the next item, and out, this item's value:
    a fold over an array that keeps what it finds. state and kind are the types; work grows with the items' number."""
    none = F.array().cast(f"array<{kind}>")

    def inside(a: Column, item: Column) -> Column:
        return let(step(a["s"], item), lambda r: F.struct(r["s"].cast(state).alias("s"), F.concat(a["out"], F.array(r["out"].cast(kind))).alias("out")))

    def block(a: Column, start: Column) -> Column:
        of = F.aggregate(F.slice(items, start + 1, F.lit(SCAN_BLOCK)), F.struct(a["s"].alias("s"), none.alias("out")), inside)
        return let(of, lambda r: F.struct(r["s"].alias("s"), F.concat(a["parts"], F.array(r["out"])).alias("parts")))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(SCAN_BLOCK))).otherwise(F.array().cast("array<int>"))
    first = F.struct(zero.cast(state).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    return F.aggregate(starts, first, block, lambda a: F.flatten(a["parts"]))


def strip(text: Column) -> Column:
    """Without white space (that of the regular expression \\s) at either end; Spark's trim alone takes blanks only."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def pieces(text: Column, pattern: str) -> Column:
    """Stripped non-empty parts between matches of pattern; null text has none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    return pieces(text, SENTENCE_END)


def paragraphs(text: Column) -> Column:
    return pieces(text, PARAGRAPH_GAP)


def token_count(text: Column) -> Column:
    """A quarter of the code points, as used when no tokenizer is at hand."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def doc_key(stem: Column) -> Column:
    """Upper-case key of letters, digits and single underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(stem), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def hash_suffix(text: Column, chars: int) -> Column:
    """Upper-case hex that stands for a random suffix but is the same on every run."""
    return F.upper(F.substring(F.sha2(text, 256), 1, chars))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def shorten(text: Column, n: int) -> Column:
    """The first n characters with three dots after them if there were more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match without regard to case and with Unicode classes, stripped; null if none."""
    found = strip(F.regexp_extract(text, "(?iU)" + pattern, group))
    return F.get(F.array_remove(F.array(found), ""), F.lit(0))  # as nullif, which would evaluate the pattern twice


def hash_embedding(text: Column) -> Column:
    """32 numbers in [-1, 1] from the SHA-256 of the text: the cosine of two of them equals that of their repetitions."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length; never above 1."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.least(F.lit(1.0), dot(a, b) / size)).otherwise(F.lit(0.0))
