"""Rendering of mapped clauses as rule artifacts in six formats, and checks of their syntax.

Renderers are Column expressions that share one set of context columns; every text that enters a file is escaped
for its format. A format is rendered by the renderer for its clause type, else by its default one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from normweave.functions.text import let, shorten

VERSION = "1.0.0"
#: File extensions by format.
EXTENSIONS = {"yaml": ".yaml", "sql": ".sql", "python": ".py", "terraform": ".tf", "rego": ".rego", "json": ".json"}
DEFAULT_FORMATS = ("yaml", "sql", "python")
FALLBACK_TABLE = "compliance_table"
#: Which words in an actor tell a resource type; the first hit counts.
RESOURCES = (("storage_bucket", ("storage", "data")), ("network", ("network", "vpc")), ("instance", ("compute", "server")), ("database", ("database", "db")))
FALLBACK_RESOURCE = "generic_resource"
Renderer = Callable[[], Column]


def _last_path(role: str) -> Column:
    hits = F.filter("mapped_entities", lambda m: m["source_role"] == role)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["target_path"])


def _table(path: Column) -> Column:
    return F.when(path.contains(".") & ~path.startswith("."), F.substring_index(path, ".", 1))


def resource_type(actor: Column) -> Column:
    low, kind = F.lower(actor), F.when(F.lit(False), "")
    for name, words in RESOURCES:
        kind = kind.when(low.contains(words[0]) | low.contains(words[1]), name)
    return kind.otherwise(FALLBACK_RESOURCE)


def severity(kind: Column) -> Column:
    return F.when(kind == "prohibition", "critical").when(kind == "obligation", "high").otherwise("medium")


def enforcement(kind: Column) -> Column:
    return F.when(kind == "obligation", "require").when(kind == "prohibition", "block").otherwise("allow")


def context(mapped: DataFrame) -> DataFrame:
    """Mapped clauses with the columns that renderers use."""
    total = F.aggregate(F.coalesce("mapped_entities", F.array()), F.lit(0.0), lambda a, m: a + m["confidence"])
    n = F.size(F.coalesce("mapped_entities", F.array()))
    name = F.lower(F.replace(F.replace("clause_id", F.lit("-"), F.lit("_")), F.lit("."), F.lit("_")))
    status = F.concat(F.lower("verb"), F.lit("_status"))
    return mapped.withColumns({
        "actor_path": _last_path("actor"), "object_path": _last_path("object"),
        "mapping_confidence": F.round(F.when(n > 0, F.round(total / n, 9)).otherwise(0.5), 2),
        "severity": severity(F.col("type")), "resource_type": resource_type(F.col("actor")), "rule_name": name, "enforcement": enforcement(F.col("type")),
        "check_condition": F.when(F.col("type") == "prohibition", F.concat(F.lit("NOT "), status)).otherwise(F.concat(status, F.lit(" = TRUE"))),
    }).withColumn("table_name", F.coalesce(_table(F.col("actor_path")), _table(F.col("object_path")), F.lit(FALLBACK_TABLE)))


def _flat(text: Column) -> Column:
    return F.when(text.contains("\n") | text.contains("\r"), F.regexp_replace(text, r"[\r\n]+", " ")).otherwise(text)


def _quoted(text: Column) -> Column:
    """Double-quoted scalar of JSON, which YAML, Rego and HCL read alike."""
    text = F.coalesce(text, F.lit(""))
    escaped = F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', "")
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _calm(text: Column) -> Column:
    """Quotes and braces as apostrophes and brackets, characters that HCL and its heredocs would read."""
    return F.when(text.rlike(r'["{}]'), F.translate(text, '"{}', "'()")).otherwise(text)


def _literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def _lines(*parts: Column | str) -> Column:
    """Parts as lines; null parts are left out."""
    return F.concat(F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit("\n"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _head(mark: str, width: int = 70) -> tuple[Column, ...]:
    return (
        F.concat(F.lit(f"{mark} From: "), shorten(_flat(F.col("source_text")), width)),
        F.concat(F.lit(f"{mark} Clause: "), F.col("clause_id")),
        F.concat(F.lit(f"{mark} Confidence: "), F.col("mapping_confidence").cast("string")),
    )


def _phrase() -> Column:
    return F.concat_ws(" ", "verb", "object")


def yaml_rule() -> Column:
    banned = F.col("type") == "prohibition"
    return _lines(
        *_head("#", 80), "control:", _line("  id: ", _quoted(F.col("clause_id"))), _line("  type: ", F.col("type")),
        _line("  rule: ", _quoted(F.when(banned, F.concat(F.lit("MUST NOT "), _phrase())).otherwise(_phrase()))),
        "  actor:", _line("    entity: ", _quoted(F.col("actor"))),
            F.when(F.col("actor_path").isNotNull(), _line("    mapped_to: ", _quoted(F.col("actor_path")))),
        F.when(banned, "  prohibited_action:").otherwise("  action:"), _line("    operation: ", _quoted(F.col("verb"))),
            F.when(banned, '    enforcement: "block"'),
        F.when(F.col("object").isNotNull(), _line("  object:\n    entity: ", _quoted(F.col("object")))),
            F.when(F.col("object").isNotNull() & F.col("object_path").isNotNull(), _line("    mapped_to: ", _quoted(F.col("object_path")))),
        F.when(F.col("trigger").isNotNull(), F.concat(F.when(banned, "  exception:\n    condition: ").otherwise("  trigger:\n    event: "),
                    _quoted(F.col("trigger")))),
        F.when(~banned & F.coalesce("deadline", "frequency", "duration").isNotNull(), "  temporal_scope:"),
        *[F.when(~banned & F.col(c).isNotNull(), _line(f"    {c}: ", _quoted(F.col(c)))) for c in ("deadline", "frequency", "duration")],
        _line("  severity: ", F.col("severity")), "  metadata:", _line("    source_document: ", _quoted(F.col("doc_id"))),
            _line("    confidence: ", F.col("mapping_confidence").cast("string")), f'    compiler_version: "{VERSION}"',
    )


def sql_rule(as_emitted: bool = False) -> Column:
    """A CHECK constraint for obligations and prohibitions, a comment for other types. as_emitted negates a
    prohibition's condition once more, so that it demands the forbidden status."""
    name = F.concat(F.lit("chk_"), F.col("rule_name"), F.when(F.col("type") == "prohibition", "_prohibit").otherwise(""))
    condition = F.when(F.col("type") == "prohibition", F.concat(F.lit("NOT ("), F.col("check_condition"),
            F.lit(")"))).otherwise(F.col("check_condition")) if as_emitted else F.col("check_condition")
    binding = F.col("type").isin("obligation", "prohibition")
    return _lines(
        *_head("--"),
        F.when(binding, F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" ADD CONSTRAINT "), name, F.lit(" CHECK ("), condition, F.lit(");"))),
        F.when(binding, F.concat(F.lit("COMMENT ON CONSTRAINT "), name, F.lit(" ON "), F.col("table_name"), F.lit(" IS "),
                _literal(shorten(_flat(F.col("source_text")), 200)), F.lit(";")))
        .otherwise(F.concat(F.lit("COMMENT ON TABLE "), F.col("table_name"), F.lit(" IS "), _literal(shorten(_flat(F.col("source_text")), 200)), F.lit(";"))),
    )


def python_rule() -> Column:
    field, wanted = F.concat(F.lower("verb"), F.lit("_status")), F.when(F.col("type") == "prohibition", "False").otherwise("True")
    other = F.when(F.col("type") == "prohibition", "True").otherwise("False")
    binding = F.col("type").isin("obligation", "prohibition")
    case = lambda kind, status: F.concat(F.lit(f"def test_{kind}_"), F.col("rule_name"), F.lit("():\n    record = {\"id\": \""),
        F.lit(kind), F.lit('", "'), field, F.lit('": '), status, F.lit("}\n    assert (record[\""), field, F.lit('"] is '), wanted,
        F.lit(f") is {kind == 'compliant'}\n"))
    return _lines(
        *_head("#"), _line("CLAUSE_ID = ", _quoted(F.col("clause_id"))), _line("CLAUSE_TYPE = ", _quoted(F.col("type"))),
            _line("SOURCE_TEXT = ", _quoted(F.col("source_text"))),
        _line("CONFIDENCE = ", F.col("mapping_confidence").cast("string")),
            F.when(F.col("trigger").isNotNull(), _line("CONDITION = ", _quoted(F.col("trigger")))),
            F.when(F.col("deadline").isNotNull(), _line("DEADLINE = ", _quoted(F.col("deadline")))),
        F.when(binding, F.concat(F.lit("\n\n"), case("compliant", wanted), F.lit("\n\n"), case("violating", other))),
    )


def _modal() -> Column:
    return F.when(F.col("type") == "obligation", "must").when(F.col("type") == "prohibition", "must not").otherwise("may")


def terraform_rule() -> Column:
    kind, flag = F.col("type"), F.concat(F.lit("rc.change.after."), F.lower("verb"), F.lit("_enabled"))
    every = lambda body: F.concat(F.lit("      all tfplan.resource_changes as _, rc {\n        rc.type is "),
        _quoted(F.col("resource_type")), body, F.lit("\n      }"))
    return _lines(
        *_head("#"), F.concat(F.lit('resource "sentinel_policy" '), _quoted(F.col("rule_name")), F.lit(" {")),
            _line("  name        = ", _quoted(F.col("clause_id"))), _line("  description = ",
                _quoted(F.replace(_calm(shorten(_flat(F.col("source_text")), 200)), F.lit("$"), F.lit("$$")))),
        _line("  enforcement_level = ", F.when(kind == "prohibition", '"hard-mandatory"').otherwise('"soft-mandatory"')),
            "  policy = <<-POLICY", '    import "tfplan/v2" as tfplan', F.concat(F.lit("    # "), _calm(F.col("actor")),
                F.lit(" "), _modal(), F.lit(" "), F.col("verb")), "    main = rule {",
        F.when(kind == "obligation", every(F.concat(F.lit(" and "), flag, F.lit(" is true")))).when(kind == "prohibition",
                every(F.concat(F.lit(" implies "), flag, F.lit(" is not true")))).otherwise("      true"),
        "    }", "  POLICY", "  tags = {", _line("    clause_id  = ", _quoted(F.col("clause_id"))),
            _line("    type       = ", _quoted(kind)), F.concat(F.lit('    confidence = "'), F.col("mapping_confidence").cast("string"),
                F.lit('"')), "  }", "}",
    )


def rego_rule() -> Column:
    kind = F.col("type")
    actor, action = F.concat(F.lit("    input.actor == "), _quoted(F.lower("actor"))), F.concat(F.lit("    input.action == "), _quoted(F.lower("verb")))
    thing = F.when(F.col("object").isNotNull(), F.concat(F.lit("    input.object == "), _quoted(F.lower("object"))))
    met = F.when(F.col("trigger").isNotNull(), F.lit("    input.condition_met == true"))
    message = F.concat(F.lit("    msg := "), _quoted(F.concat(F.col("clause_id"), F.lit(": "), F.col("actor"), F.lit(" "), _modal(),
                F.lit(" "), F.col("verb"))))
    block = lambda head, *body: F.concat_ws("\n", F.lit(head + " if {"), *body, F.lit("}"))
    obligation = F.concat_ws("\n", block("allow", actor, action, thing, met),
        block("violation contains msg", actor, F.concat(F.lit("    not input."), F.lower("verb"), F.lit("_completed")), message))
    prohibition = F.concat_ws("\n", block("attempted", action, thing), block("allow", actor, F.lit("    not attempted")),
        block("violation contains msg", actor, F.lit("    attempted"), message))
    return _lines(
        *_head("#"), F.concat(F.lit("package policy."), F.col("rule_name")), "import rego.v1", "default allow := false",
        F.when(kind == "obligation", obligation).when(kind == "prohibition", prohibition).otherwise(block("allow", actor)),
        F.concat(F.lit("metadata := "), F.to_json(F.struct("clause_id", "type", F.col("mapping_confidence").alias("confidence"),
                        shorten(F.col("source_text"), 200).alias("source_text")))),
    )


def json_rule() -> Column:
    """Valid by construction; nulls stay in place."""
    part = lambda test, s: F.when(test.isNotNull(), s)
    return F.to_json(F.struct(
        F.col("clause_id").alias("rule_id"), F.col("type"), F.lit(VERSION).alias("version"), F.col("mapping_confidence").alias("confidence"),
        F.struct(F.col("source_text").alias("text"), F.col("doc_id").alias("document_id")).alias("source"),
        F.struct(F.col("actor").alias("entity"), F.col("actor_path").alias("mapped_to")).alias("actor"),
        F.struct("verb", "enforcement").alias("action"),
        part(F.col("object"), F.struct(F.col("object").alias("entity"), F.col("object_path").alias("mapped_to"))).alias("object"),
        part(F.col("trigger"), F.struct("trigger")).alias("condition"),
        part(F.coalesce("deadline", "frequency", "duration"), F.struct("deadline", "frequency", "duration")).alias("temporal_scope"), F.col("severity"),
    ), {"ignoreNullFields": "false"})


#: Filters of templates: functions of a text and of literal arguments.
FILTERS: dict[str, Callable[..., Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "truncate": lambda c, n: shorten(c, int(n)),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
    "default": lambda c, text: F.when(c == "", F.lit(text)).otherwise(c),
    "json": lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', ""),
}
_ARGUMENT = r"""\s*(?:"([^"]*)"|'([^']*)'|(\d+))\s*"""


def from_text(template: str) -> Renderer:
    """A renderer of a template's text over the columns of `context`.

    `{{ name | filter(arguments) }}` puts a value in, null as nothing; `{% if name %}`, `{% if not name %}`, `{% if name ==
    "text" %}` and `!=` with `{% elif … %}`, `{% else %}` and `{% endif %}` choose, where null, empty, false and 0 count as no; `{% for x in
    name %}` … `{% endfor %}` repeats for the entries of an array, whose fields are `x.field`. A template with other
    tags, an unknown filter or an open block is an error when it is read.
    """
    tokens = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.DOTALL)
    Piece = Callable[[dict[str, Column]], Column]
    at = 0

    def tag() -> str | None:
        return tokens[at][2:-2].strip() if at % 2 and tokens[at].startswith("{%") else None

    def named(name: str) -> Piece:
        if not re.fullmatch(r"\w+(\.\w+)*", name):
            raise ValueError(f"not a name in a template: {name}")
        head, *rest = name.split(".")

        def value(env: dict[str, Column]) -> Column:
            c = env[head] if head in env else F.col(head)
            for field in rest:
                c = c[field]
            return c

        return value

    def valued(source: str) -> Piece:
        name, *uses = [x.strip() for x in source.split("|")]
        value, steps = named(name), []
        for use in uses:
            found = re.fullmatch(rf"(\w+)(?:\(((?:{_ARGUMENT},)*{_ARGUMENT})\))?", use)
            if not found or found[1] not in FILTERS:
                raise ValueError(f"unknown filter in a template: {use}")
            steps.append((FILTERS[found[1]], [a or b or c for a, b, c in re.findall(_ARGUMENT + "(?:,|$)", found[2])] if found[2] else []))

        def render(env: dict[str, Column]) -> Column:
            c = F.coalesce(value(env).cast("string"), F.lit(""))
            for f, arguments in steps:
                c = f(c, *arguments)
            return c

        return render

    def condition(source: str) -> Piece:
        compared = re.fullmatch(rf"([\w.]+)\s*(==|!=){_ARGUMENT}", source)
        if compared:
            value, text = named(compared[1]), compared[3] or compared[4] or compared[5] or ""
            same = lambda env: F.coalesce(value(env).cast("string") == text, F.lit(False))
            return same if compared[2] == "==" else lambda env: ~same(env)
        plain = source.removeprefix("not ").strip()
        value = named(plain)
        there = lambda env: F.coalesce(~F.lower(value(env).cast("string")).isin("", "false", "0", "0.0", "[]"), F.lit(False))
        return there if plain == source else lambda env: ~there(env)

    def block(*ends: str) -> Piece:
        nonlocal at
        pieces: list[Piece] = []
        while at < len(tokens):
            token, inner = tokens[at], tag()
            if inner is not None and inner.split()[0] in ends:
                break
            at += 1
            if inner is None:
                pieces.append(valued(token[2:-2]) if token.startswith("{{") else lambda env, t=token: F.lit(t))
            elif inner.startswith("if "):
                pieces.append(choice(inner[3:]))
            elif found := re.fullmatch(r"for (\w+) in ([\w.]+)", inner):
                pieces.append(loop(found[1], named(found[2])))
            else:
                raise ValueError(f"unknown tag in a template: {inner}")
        else:
            if ends:
                raise ValueError(f"a template lacks {ends[-1]}")
        return lambda env: F.concat(F.lit(""), *[p(env) for p in pieces])

    def choice(source: str) -> Piece:
        nonlocal at
        test, body = condition(source), block("elif", "else", "endif")
        end, other = tag(), lambda env: F.lit("")
        at += 1
        if end.startswith("elif "):
            other = choice(end[5:])
        elif end == "else":
            other = block("endif")
            at += 1
        return lambda env: F.when(test(env), body(env)).otherwise(other(env))

    def loop(name: str, items: Piece) -> Piece:
        nonlocal at
        body = block("endfor")
        at += 1
        return lambda env: F.coalesce(F.array_join(F.transform(items(env), lambda x: body({**env, name: x})), ""), F.lit(""))

    whole = block()
    return lambda: whole({})


#: Renderers by format and clause type; `default` serves the types that have none of their own.
TEMPLATES: dict[str, dict[str, Renderer]] = {
    "yaml": {"obligation": yaml_rule, "prohibition": yaml_rule, "default": yaml_rule}, "sql": {"default": sql_rule}, "python": {"default": python_rule},
    "terraform": {"default": terraform_rule}, "rego": {"default": rego_rule}, "json": {"default": json_rule},
}


def artifact_id(format: Column) -> Column:
    return F.concat("clause_id", F.lit("_"), format)


def artifact_ids(clauses: DataFrame, formats: tuple[str, ...] = DEFAULT_FORMATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(clause_id, artifact_id, *keep) of the artifacts that compile_rules makes of clauses, which needs neither mappings nor contents."""
    rows = clauses.select("clause_id", *keep, F.explode(F.array(*[F.lit(f) for f in formats])).alias("format"))
    return rows.select("clause_id", artifact_id(F.col("format")).alias("artifact_id"), *keep)


def compile_rules(mapped: DataFrame, formats: tuple[str, ...] = DEFAULT_FORMATS, templates: dict[str, dict[str, Renderer]] | None = None,
    carry: bool = False) -> DataFrame:
    """A row for each clause and format: artifact_id, clause_id, doc_id, format, content, file_path, template_used.

    carry: also the clause and its mappings, as structs c and m, so that a validation needs no join to find them.
    """
    templates = templates or TEMPLATES
    unknown = [f for f in formats if f not in templates]
    if unknown:
        raise ValueError(f"no template for {unknown}")
    rows = context(mapped)

    def rendered(f: str) -> tuple[Column, Column]:
        own = {k: r for k, r in templates[f].items() if k != "default"}
        if "default" in templates[f]:
            content, used = templates[f]["default"](), F.lit(f"{f}/default")
        else:  # a clause of a type that no template serves ends the job
            content = F.raise_error(F.concat(F.lit(f"no template for {f}/"), F.col("type"))).cast("string")
            used = F.lit(None).cast("string")
        by_renderer: dict[Renderer, list[str]] = {}
        for kind, r in own.items():
            by_renderer.setdefault(r, []).append(kind)
            used = F.when(F.col("type") == kind, f"{f}/{kind}").otherwise(used)
        for r, kinds in by_renderer.items():
            if r is not templates[f].get("default"):
                content = F.when(F.col("type").isin(*kinds), r()).otherwise(content)
        return content, used

    # The lambda in the same select keeps Spark from fusing it with its neighbours: a renderer's code in one method is over
    # the 8,000 bytes that the JVM compiles at most, and would be interpreted.
    made = {f: rendered(f) for f in formats}
    rows = rows.withColumns({
        "clause_id": let(F.col("clause_id"), lambda x: x), **{f"__content{n}": made[f][0] for n, f in enumerate(formats)},
        **({"c": clause_struct(), "m": mapping_struct()} if carry else {}),
    })

    def of_format(value: Callable[[int, str], Column]) -> Column:
        found = F.when(F.col("format") == formats[0], value(0, formats[0]))
        for n, f in list(enumerate(formats))[1:]:
            found = found.when(F.col("format") == f, value(n, f))
        return found

    rows = rows.withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats])))
    return rows.select(
        artifact_id(F.col("format")).alias("artifact_id"), "clause_id", "doc_id", "format", of_format(lambda n, f: F.col(f"__content{n}")).alias("content"),
        F.concat("doc_id", F.lit("/"), "clause_id", of_format(lambda n, f: F.lit(EXTENSIONS.get(f, f".{f}")))).alias("file_path"),
        of_format(lambda n, f: made[f][1]).alias("template_used"), "type", "actor", "verb", "severity", "mapping_confidence", *(("c", "m") if carry else ()),
    )


def clause_struct() -> Column:
    """What a validation asks of a parsed clause."""
    return F.struct("doc_id", "section_id", "chunk_id", "source_text", "type", "actor", "verb", "confidence", "cross_references")


def mapping_struct() -> Column:
    return F.struct(F.lit(True).alias("there"), F.transform("mapped_entities", lambda x: x["confidence"]).alias("confidences"))


#: Tags, merges, complex keys and what may be a date: YAML that can fail after it is parsed.
_CONSTRUCTED = re.compile(r"!|<<|\?|[\]}]\s*:|\d{4}-\d")


_SHORT, _TEXT = 2_000, r"[\x20-\x7e\u00a1-\u1fff]"
_STRING = r'"[\x20\x21\x23-\x5b\x5d-\x7e\u00a1-\u1fff]*+(?:\\["\\bfnrt][\x20\x21\x23-\x5b\x5d-\x7e\u00a1-\u1fff]*+)*+"'
_KEY, _PLAIN = "[a-z_]{1,64}+", rf"(?:{_STRING}|[A-Za-z_]++|\d++\.\d++)"
#: Patterns of contents that are valid whatever their texts say: comments, then mappings of two or three levels whose keys are
#: words and whose values are quoted texts, words or decimals; comments, assignments of such constants and tests of a record.
_SURELY = {
    "yaml": rf"\A(?:#{_TEXT}*+\n)*+(?:{_KEY}:\n(?:  {_KEY}:(?: {_PLAIN}\n|\n(?:    {_KEY}: {_PLAIN}\n)++))++)\z",
    "python": rf"\A(?:#{_TEXT}*+\n|\n|[A-Z_]{{1,64}}+ = (?:{_STRING}|\d++\.\d++)\n|def test_[a-z0-9_]++\(\):\n    record = \{{{_STRING}: {_STRING}, {_STRING}: (?:True|False)\}}\n"
    rf"    assert \(record\[{_STRING}\] is (?:True|False)\) is (?:True|False)\n)*+\z",
}


def surely_valid(kind: Column, content: Column) -> Column:
    """Whether a short YAML or Python content is of a form that can't fail; false tells nothing, that is for the parser."""
    short = F.length(content) <= _SHORT
    return short & F.when(kind == "yaml", content.rlike(_SURELY["yaml"])).when(kind == "python", content.rlike(_SURELY["python"])).otherwise(False)


@F.pandas_udf(BooleanType())
def _parses(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """YAML and Python need their own parsers."""
    import ast

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the C parser where it is built in

    def good(kind: str, content: str) -> bool:
        try:
            if kind != "yaml":
                ast.parse(content)
            elif _CONSTRUCTED.search(content):
                yaml.load(content, loader)
            else:  # nothing that could fail once the nodes are composed
                yaml.compose(content, loader)
            return True
        except (yaml.YAMLError, SyntaxError, ValueError):
            return False

    for kind, content in rows:
        out, asked = np.ones(len(content), dtype=bool), np.flatnonzero(content.notna().to_numpy())
        for n in asked:
            out[n] = good(kind.iat[n], content.iat[n])
        yield pd.Series(out)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def check_syntax(artifacts: DataFrame, formats: tuple[str, ...] | None = None) -> DataFrame:
    """Add syntax_valid and warnings. Only YAML and Python contents that no pattern proves valid are sent to Python; where
    `formats`, those that the artifacts have, names neither, no row is."""
    c = F.coalesce("content", F.lit(""))
    first = F.regexp_extract(F.regexp_replace(c, r"(?m)^\s*--.*$", ""),
        r"(?i)^\s*(select|insert|update|delete|create|alter|drop|comment|grant|revoke|with|begin)\b", 1)
    warn = F.when(F.col("format") == "sql", F.array_compact(F.array(F.when(first == "", "statement of unknown kind")))).when(
        F.col("format") == "rego", F.array_compact(F.array(F.when(~c.contains("package "), "no package"), F.when(~c.contains("import "), "no import")))
    )
    native = (
        F.when(F.col("format") == "sql", F.trim(c) != "").when(F.col("format") == "json",
            F.try_parse_json(c).isNotNull()).when(F.col("format") == "rego", F.lit(True))
        .when(F.col("format") == "terraform", (_count(c, "{") == _count(c, "}")) & (_count(c, '"') % 2 == 0)).otherwise(F.lit(True))
    )
    by_parser = F.col("format").isin("yaml", "python")
    if formats is not None and not {"yaml", "python"} & set(formats):
        return artifacts.withColumn("warnings", F.coalesce(warn, F.array().cast("array<string>"))).withColumn("syntax_valid", native)
    # Spark keeps each row that waits for Python's answer, on disk where memory is short, and as Python is the faster side, all rows
    # of a task wait. What isn't deterministic is not moved, so what is asked of content and other wide columns next to this is
    # found before, and they don't wait.
    asked = by_parser & ~surely_valid(F.col("format"), c) & (F.spark_partition_id() >= 0)
    rows = artifacts.withColumns({"warnings": F.coalesce(warn, F.array().cast("array<string>")), "__native": native, "__asked": F.when(asked, c)})
    parsed = _parses(F.col("format"), F.col("__asked"))  # other rows send a null, which is valid
    return rows.withColumn("syntax_valid", F.when(by_parser, parsed).otherwise(F.col("__native"))).drop("__native", "__asked")
