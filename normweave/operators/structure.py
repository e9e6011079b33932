"""From document text to sections and token-bounded chunks."""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from normweave.functions.text import exploded, let, paragraphs, scan, sentences, strip, token_count

DEFAULT_TITLE = "Document Content"
#: Sections up to which string functions find the parents; their work grows with the square, but its unit is a byte.
SHORT_SCAN = 128


@dataclass(frozen=True)
class ChunkSizes:
    target: int = 768
    least: int = 256
    most: int = 1024
    overlap: int = 64


def parents(sections: DataFrame, doc: str = "doc_id", order: str = "section_ord", level: str = "hierarchy_level") -> DataFrame:
    """Add parent_ord: the nearest section before with a smaller level. One window serves all six levels."""
    before = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == n, F.col(order))).over(before) for n in range(1, 6)]
    return sections.withColumn("parent_ord", F.greatest(*[F.when(F.col(level) > n, x) for n, x in enumerate(last, 1)]))


def section_id(key: Column, n: Column) -> Column:
    return F.format_string("%s_S%03d", key, n)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, text) to (doc_id, section_id, section_ord, section_title, hierarchy_level, parent_section, text).

    The text is cut before each heading inside its row, and a fold over the levels finds the parents, so nothing is
    shuffled. Text before the first heading goes; without any heading the document is one section; a
    null or blank document has none.
    """
    raw = F.coalesce("text", F.lit(""))
    text = F.when(F.contains(raw, F.lit("\r")), F.regexp_replace(raw, "\r\n?", "\n")).otherwise(raw)
    # only the first part may lack a heading, for the others are cut before one
    parts = F.filter(F.split("__text", r"(?m)^(?=#{1,6}[ \t]+\S)"), lambda p, i: (i > 0) | p.rlike(r"\A#{1,6}[ \t]+\S"))
    head = lambda p: F.substring_index(p, "\n", 1)
    rest = lambda p: F.when(F.contains(p, F.lit("\n")), F.substr(p, F.locate("\n", p) + 1)).otherwise("")
    level = lambda p: F.length(F.substring_index(F.translate(head(p), "\t", " "), " ", 1))  # noqa: E731  the run of # ends at a blank

    # last[k]: the number of the last section of level k + 1 so far, 0 for none; their greatest is the number of sections
    place = lambda last: F.array_max(last) + 1
    parent = lambda last, n: F.when(n > 1, F.array_max(F.slice(last, F.lit(1), n - 1))).otherwise(0)
    step = lambda last, n: F.struct(F.transform(last, lambda x, k: F.when(k + 1 == n, place(last)).otherwise(x)).alias("s"), parent(last, n).alias("out"))
    long = scan(F.col("__levels"), F.array(*[F.lit(0)] * 6), "array<int>", step, "int")
    # of few sections, whose levels are a short string of digits: what is left of those before without the deeper or equal ones at their end
    short = F.transform("__levels", lambda n, i: F.length(F.rtrim(F.left("__digits", i), F.substring(F.lit("123456"), n, F.lit(6)))))
    above = F.when(F.size("__levels") <= SHORT_SCAN, short).otherwise(long)
    rows = docs.select("doc_id", "doc_key", text.alias("__text")).withColumn("__parts", parts)
    rows = rows.withColumn("__levels", F.transform("__parts", level)).withColumn("__digits", F.array_join(F.col("__levels").cast("array<string>"), ""))
    found = F.transform("__parts", lambda p, i: F.struct(
        F.get(F.col("__levels"), i).alias("level"), strip(F.substr(head(p), F.get(F.col("__levels"), i) + 1)).alias("title"),
            strip(rest(p)).alias("body"), F.get(F.col("__above"), i).alias("parent"),
    ))
    whole = F.array(F.struct(F.lit(1).alias("level"), F.lit(DEFAULT_TITLE).alias("title"), strip(F.col("__text")).alias("body"), F.lit(0).alias("parent")))
    of = F.when(F.size("__parts") > 0, found).when(strip(F.col("__text")) != "", whole)
    rows = exploded(rows.withColumn("__above", above), ["doc_id", "doc_key"], of, "pos", "s")
    return rows.select(
        "doc_id", section_id(F.col("doc_key"), F.col("pos") + 1).alias("section_id"), (F.col("pos") + 1).alias("section_ord"),
            F.col("s.title").alias("section_title"), F.col("s.level").alias("hierarchy_level"),
        F.when(F.col("s.parent") > 0, section_id(F.col("doc_key"), F.col("s.parent"))).alias("parent_section"), F.col("s.body").alias("text"),
    )


#: Elements whose content doesn't count, and those that never hold any.
DROPPED = ("nav", "footer", "header")
_RAW = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Characters by the names of HTML's named entities, from the standard library's rule.
_NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}


def unescape_html(text: Column) -> Column:
    """Named and numeric character references as characters; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])

    def part(p: Column) -> Column:  # what follows an ampersand
        name = F.regexp_extract(p, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w{1,31});", 1)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(
            name.startswith("#"), F.substring(name, F.lit(2), F.length(name))).cast("long")
        usable = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        numeric = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))
        char = F.coalesce(numeric, F.element_at(names, name))
        return F.coalesce(F.when(name != "", F.concat(char, rest)), F.concat(F.lit("&"), p))

    parts = F.split(text, "&")
    first = F.element_at(parts, 1)
    decoded = F.concat(first, F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def plain_html(html: Column) -> Column:
    """Text of an HTML fragment: block tags become blank lines, others go, entities turn into characters."""
    text = F.regexp_replace(html, r"(?i)</?(p|div|section|article|ul|ol|li|table|tr|br|h[1-6])\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    return strip(F.regexp_replace(unescape_html(text), r"[ \t]*\n\s*\n\s*", "\n\n"))


_TOKEN = "struct<text:string,name:string,turn:int,level:int,at:int>"
_PLACE = "struct<depth:int,number:int>"
_TAGS = f"struct<stack:array<string>,hidden:int,open:array<{_PLACE}>,live:array<{_PLACE}>,count:int>"
_MARK = "struct<hidden:boolean,opened:int,closed:array<int>,begun:int,ended:array<int>>"


def _tokens(html: Column) -> Column:
    """Tags and texts of an HTML page, in order: turn is 1 for an opening tag, -1 for a closing one, 0 for others; level is
    that of a heading, else 0."""

    def of(t: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        turn = F.when((name == "") | name.isin(*_VOID) | t.endswith("/>"), 0).when(t.startswith("</"), -1).otherwise(1)
        level = F.coalesce(F.regexp_extract(name, "^h([1-6])$", 1).try_cast("int"), F.lit(0))
        return F.struct(t.alias("text"), name.alias("name"), turn.alias("turn"), level.alias("level"), at.alias("at")).cast(_TOKEN)

    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<[^<>]*>|[^<]+|<"), F.lit(0)), of)


def _tag_scan(tokens: Column, siblings: bool) -> Column:
    """For each token, by a stack of open elements: whether it is hidden in a dropped element, the number of the heading that it
    opens (0: none), the headings that it closes, the one whose section then begins, and those whose section ends before it.

    A section lives at the depth of its heading's parent: the next heading at this depth ends it, and so does the parent's
    end. Unless siblings, any next heading ends it, and nothing else. A closing tag closes the last open element of its
    name with all inside, or nothing.
    """
    numbers = lambda places, test: F.transform(F.filter(places, test), lambda p: p["number"])

    def look(a: Column, t: Column) -> Column:
        depth = F.size(a["stack"])
        last = F.array_max(F.transform(a["stack"], lambda x, k: F.when(x == t["name"], k)))
        down = F.when(t["turn"] == -1, F.coalesce(last, F.lit(-1))).otherwise(-1)  # the depth after a closing tag
        heads = (t["turn"] == 1) & (t["level"] > 0) & (a["hidden"] == 0)
        closes = (t["turn"] == -1) & (down >= 0)
        ends = lambda p: (heads & ((p["depth"] == depth) if siblings else F.lit(True))) | (closes & (p["depth"] > down) & F.lit(siblings))
        closed = F.filter(a["open"], lambda p: closes & (p["depth"] >= down))
        begun = F.get(F.filter(closed, lambda p: p["depth"] == down), F.lit(0)) if siblings else F.try_element_at(closed, F.lit(-1))
        return F.struct(depth.alias("depth"), down.alias("down"), heads.alias("heads"), closes.alias("closes"), closed.alias("closed"),
            begun.alias("begun"), numbers(a["live"], ends).alias("ended"))

    no_numbers = F.array().cast("array<int>")

    def plain(a: Column) -> Column:  # a text or a tag that holds nothing
        mark = F.struct((a["hidden"] > 0).alias("hidden"), F.lit(0).alias("opened"), no_numbers.alias("closed"), F.lit(0).alias("begun"), no_numbers.alias("ended"))
        return F.struct(a.cast(_TAGS).alias("s"), mark.cast(_MARK).alias("out"))

    def tag(a: Column, t: Column) -> Column:
        drop = (t["turn"] == 1) & t["name"].isin(*DROPPED)

        def after(x: Column) -> Column:
            mark = F.struct(((a["hidden"] > 0) | drop).alias("hidden"), F.when(x["heads"], a["count"] + 1).otherwise(0).alias("opened"),
                F.transform(x["closed"], lambda p: p["number"]).alias("closed"), F.coalesce(x["begun"]["number"], F.lit(0)).alias("begun"), x["ended"].alias("ended"))
            own = F.struct(x["depth"].alias("depth"), (a["count"] + 1).alias("number"))
            live = F.when(F.size(x["ended"]) > 0, F.filter(a["live"], lambda p: ~F.array_contains(x["ended"], p["number"]))).otherwise(a["live"])
            state = F.struct(
                F.when(t["turn"] == 1, F.concat(a["stack"], F.array(t["name"]))).when(x["closes"], F.slice(a["stack"], F.lit(1), F.greatest(x["down"], F.lit(0)))).otherwise(a["stack"]).alias("stack"),
                F.when(drop & (a["hidden"] == 0), x["depth"] + 1).when(x["closes"] & (x["down"] < a["hidden"]), 0).otherwise(a["hidden"]).alias("hidden"),
                F.when(x["heads"], F.concat(a["open"], F.array(own))).when(F.size(x["closed"]) > 0, F.filter(a["open"], lambda p: p["depth"] < x["down"])).otherwise(a["open"]).alias("open"),
                F.when(x["begun"].isNotNull(), F.concat(live, F.array(x["begun"]))).otherwise(live).alias("live"),
                F.when(x["heads"], a["count"] + 1).otherwise(a["count"]).alias("count"))
            return F.struct(state.cast(_TAGS).alias("s"), mark.cast(_MARK).alias("out"))

        return let(look(a, t), after)

    step = lambda a, t: F.when(t["turn"] == 0, plain(a)).otherwise(tag(a, t))
    none = F.array().cast(f"array<{_PLACE}>")
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("hidden"), none.alias("open"), none.alias("live"), F.lit(0).alias("count"))
    return scan(tokens, zero, _TAGS, step, _MARK)


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), siblings: bool = True) -> DataFrame:
    """(key, *keep, section_ord, section_title, hierarchy_level, text): each heading with what follows it among its siblings, up
    to the next heading there; unless siblings, with all up to the next heading anywhere. A page without headings is one
    section of all its text, a blank or null page none. Navigation, headers, footers, scripts, styles and comments go,
    however they nest."""
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), _RAW, " ")
    rows = pages.select(key, *keep, _tokens(clean).alias("__t")).select(key, *keep, "__t", _tag_scan(F.col("__t"), siblings).alias("__m"))
    kept = F.zip_with("__t", "__m", lambda t, m: F.when(m["hidden"], " ").otherwise(t["text"]))
    at = lambda pick: F.map_from_entries(F.flatten(F.transform("__m", lambda m, k: F.transform(pick(m), lambda n: F.struct(n, k)))))
    only = lambda n: F.filter(F.array(n), lambda x: x > 0)
    rows = rows.select(key, *keep, "__t", kept.alias("__k"), at(lambda m: only(m["opened"])).alias("__opened"), at(lambda m: m["closed"]).alias("__closed"),
        at(lambda m: only(m["begun"])).alias("__begun"), at(lambda m: m["ended"]).alias("__ended"))
    size = F.size("__k")
    joined = lambda start, end: F.array_join(F.slice("__k", start + 1, F.greatest(F.lit(0), end - start)), "")

    def section(n: Column) -> Column:
        opened, begun = F.element_at("__opened", n), F.element_at("__begun", n)
        title = joined(opened + 1, F.coalesce(F.element_at("__closed", n), size))
        body = F.when(begun.isNotNull(), joined(begun + 1, F.coalesce(F.element_at("__ended", n), size))).otherwise("")
        return F.struct(F.get("__t", opened)["level"].alias("level"), title.alias("title"), body.alias("body"))

    count = F.size("__opened")
    whole = F.array(F.struct(F.lit(1).alias("level"), F.lit(DEFAULT_TITLE).alias("title"), F.array_join("__k", "").alias("body")))
    found = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), section)).when(plain_html(F.array_join("__k", "")) != "", whole)
    rows = exploded(rows, [key, *keep], found, "pos", "s")
    return rows.select(key, *keep, (F.col("pos") + 1).alias("section_ord"), plain_html(F.col("s.title")).alias("section_title"),
        F.col("s.level").alias("hierarchy_level"), plain_html(F.col("s.body")).alias("text"))


def chunk_texts(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """Array of chunk texts of one section: a scan over its paragraphs finds where chunks begin, then they are sliced.

    A paragraph over `most` flushes what is held and is cut at sentences by itself. One that would lift the held
    tokens over `target` flushes them first, but only from `least` on; the next chunk then begins with an overlap:
    the last paragraph if it is short, else its last characters.
    """
    item = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), token_count(t).alias("n"))
    wall = F.array(item("wall", F.lit(None).cast("string")))  # what is held ends here

    def of_paragraph(p: Column) -> Column:
        by_sentence = F.concat(wall, F.transform(sentences(p), lambda s: item("sentence", s)), wall)
        return F.when(token_count(p) > sizes.most, by_sentence).otherwise(F.array(item("paragraph", p)))

    def opens(a: Column, i: Column) -> Column:  # whether a chunk begins at the item, and with an overlap
        full = (a["parts"] > 0) & (a["tokens"] + i["n"] > sizes.target)
        cut = full & (i["kind"] == "paragraph") & (a["tokens"] >= sizes.least)
        begins = (i["kind"] != "wall") & ((a["parts"] == 0) | cut | (full & (i["kind"] == "sentence")))
        return F.struct(begins.alias("begins"), (cut & (i["kind"] == "paragraph")).alias("overlaps"))

    def step(a: Column, i: Column) -> Column:
        def after(o: Column) -> Column:
            kept = F.when(o["overlaps"], F.least(a["last"], F.lit(sizes.overlap))).when(o["begins"], 0).otherwise(a["tokens"])
            wall = i["kind"] == "wall"
            after = F.struct(F.when(wall, 0).otherwise(kept + i["n"]).alias("tokens"), F.when(wall, 0).otherwise(1).alias("parts"), i["n"].alias("last"))
            return F.struct(after.alias("s"), o.alias("out"))

        return let(opens(a, i), after)

    zero = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("parts"), F.lit(0).alias("last"))

    def chunked(items: Column) -> Column:
        found = scan(items, zero, "struct<tokens:int,parts:int,last:int>", step, "struct<begins:boolean,overlaps:boolean>")
        starts = F.filter(F.transform(found, lambda o, k: F.struct(o["begins"].alias("begins"), o["overlaps"].alias("overlaps"), k.alias("at"))), lambda o: o["begins"])
        texts = F.transform(items, lambda i: i["text"])
        return let(F.struct(starts.alias("starts"), texts.alias("texts")), sliced)

    def sliced(x: Column) -> Column:
        def one(o: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["starts"], k + 1)["at"], F.size(x["texts"]))
            body = F.array_join(F.slice(x["texts"], o["at"] + 1, end - o["at"]), " ")  # walls have no text
            last = F.get(x["texts"], o["at"] - 1)
            overlap = F.when(token_count(last) <= sizes.overlap, last).otherwise(F.right(last, F.lit(4 * sizes.overlap)))
            return F.when(o["overlaps"], F.concat(overlap, F.lit(" "), body)).otherwise(body)

        return F.transform(x["starts"], one)

    # a text within the target is never flushed, for its paragraphs have no more tokens than it has
    one_chunk = F.filter(F.array(F.array_join(paragraphs(text), " ")), lambda t: t != "")
    small = token_count(text) <= min(sizes.target, sizes.most)
    return F.when(small, one_chunk).otherwise(let(F.flatten(F.transform(paragraphs(text), of_paragraph)), chunked))


def chunks(sections: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """(doc_id, section_id, text) to (doc_id, section_id, chunk_id, chunk_ord, text, token_count); no shuffle."""
    rows = exploded(sections, ["doc_id", "section_id"], chunk_texts(F.col("text"), sizes), "chunk_ord", "text")
    return rows.select("doc_id", "section_id", F.format_string("%s_C%03d", "section_id", "chunk_ord").alias("chunk_id"), "chunk_ord",
        "text", token_count(F.col("text")).alias("token_count"))


def first_of_equal(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(hash, first id, copies) of each distinct text; aggregates before it shuffles."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash")).agg(F.min(order).alias("first_id"), F.count("*").alias("copies"))
