"""DuckDB SQL that says the same as the queries, over the same tables."""

from __future__ import annotations

from normweave.operators import clauses
from normweave.operators.artifacts import FALLBACK_RESOURCE, RESOURCES
from normweave.plans.corpus import FIELDS, OVERRIDES, SECTIONS, SYNONYMS, values

_schemas = list(dict.fromkeys(f[0] for f in FIELDS))

SECTION_CTE = f"""
sec(sec, lvl, title, body) AS ({values([(i, *s) for i, s in enumerate(SECTIONS, 1)])}),
sections AS (SELECT 'DESK_' || c_custkey AS doc_id, sec, lvl, title, replace(replace(body, '{{actor}}', 'The ' || lower(c_mktsegment) || ' desk'), '{{n}}', c_custkey::VARCHAR) AS text FROM customer, sec)"""

CLAUSE_CTE = SECTION_CTE + r""",
chunk AS (SELECT doc_id, sec, doc_id || '_S' || lpad(sec::VARCHAR, 3, '0') AS section_id, doc_id || '_S' || lpad(sec::VARCHAR, 3, '0') || '_C000' AS chunk_id, text FROM sections WHERE text <> ''),
parts AS (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM chunk),
sent AS (SELECT chunk_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM parts),
flagged AS (SELECT *, regexp_matches(s, '(?i)\b(@REGULATORY)\b') AS reg FROM sent),
grouped AS (SELECT *, coalesce(sum(reg::INT) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, bool_or(reg) OVER (PARTITION BY chunk_id) AS any_reg FROM flagged),
folded AS (SELECT chunk_id, g, any_value(any_reg) AS any_reg, string_agg(s, ' ' ORDER BY i) FILTER (NOT reg) AS ctx, max(s) FILTER (reg) AS reg FROM grouped GROUP BY chunk_id, g),
texts AS (SELECT chunk_id, g, CASE WHEN reg IS NULL THEN ctx WHEN length(ctx) < 100 THEN ctx || ' ' || reg ELSE reg END AS source_text FROM folded WHERE reg IS NOT NULL OR NOT any_reg),
clause AS (SELECT doc_id, section_id, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY g)::INTEGER AS clause_ord, source_text FROM texts JOIN chunk USING (chunk_id)),
named AS (SELECT doc_id, section_id, chunk_id, clause_ord, doc_id || '_' || chunk_id || '_CL' || lpad(clause_ord::VARCHAR, 3, '0') AS clause_id, source_text, lower(source_text) AS low FROM clause)""".replace("@REGULATORY", "|".join(clauses.REGULATORY))

_x = lambda p: f"nullif(trim(regexp_extract(source_text, '(?i){p}', 1)), '')"
_any = lambda patterns: ", ".join(_x(p) for p in patterns)
_kinds = " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{kind}'" for kind, parts in clauses.TYPE_RULES)

PARSED_CTE = CLAUSE_CTE + rf""",
parsed AS (SELECT doc_id, section_id, chunk_id, clause_ord, clause_id, source_text,
  CASE WHEN starts_with(low, 'if ') OR starts_with(low, 'when ') THEN 'conditional' {_kinds} ELSE 'obligation' END AS type,
  coalesce({_x(clauses.ACTOR)}, '{clauses.NO_ACTOR}') AS actor, coalesce({_x(clauses.VERB)}, '{clauses.NO_VERB}') AS verb,
  array_to_string(string_split_regex(coalesce({_any(clauses.OBJECTS)}), '\s+')[1:5], ' ') AS object,
  coalesce({_any(clauses.TRIGGERS)}) AS trigger, {_x(clauses.DEADLINE)} AS deadline, {_x(clauses.DURATION)} AS duration, {_x(clauses.FREQUENCY)} AS frequency,
  {clauses.CONFIDENCE} AS confidence FROM named)"""

REGISTRY_CTE = f"""
field(ord, schema_id, table_name, field_name, labels, description) AS ({values([(i, f[0], f[1], f[2], f[4], f[5]) for i, f in enumerate(FIELDS)])}),
keyed AS (SELECT lower(unnest(list_concat([field_name], labels))) AS key, ord, schema_id, table_name || '.' || field_name AS path FROM field),
keys AS (SELECT key, min(ord) AS ord, arg_min(schema_id, ord) AS schema_id, arg_min(path, ord) AS path FROM keyed GROUP BY key),
syn(o, term, so, synonym) AS ({values([(i, t, j, s) for i, (t, all_) in enumerate(SYNONYMS) for j, s in enumerate(all_)])}),
edge AS (SELECT term AS entity, synonym AS related, o, so FROM syn UNION ALL SELECT synonym, term, o, -1 FROM syn UNION ALL SELECT a.synonym, b.synonym, a.o, b.so FROM syn a JOIN syn b USING (o)),
ovr(entity_lower, target) AS ({values(OVERRIDES)})"""

_vec = "list_transform(range(32), lambda i: ((instr('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + (instr('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1)) / 255.0::DOUBLE * 2 - 1)"

MAPPED_CTE = PARSED_CTE + "," + REGISTRY_CTE + f""",
mention AS (SELECT clause_id, 'actor' AS source_role, 0 AS role_ord, actor AS entity FROM parsed UNION ALL SELECT clause_id, 'object', 1, object FROM parsed WHERE object <> ''
  UNION ALL SELECT clause_id, 'condition_subject', 2, array_to_string(string_split_regex(trigger, '\\s+')[1:3], ' ') FROM parsed WHERE trigger <> ''),
ent AS (SELECT DISTINCT entity FROM mention),
by_o AS (SELECT entity, CASE WHEN contains(target, ':') THEN string_split(target, ':')[1] ELSE 'default' END AS schema_id, string_split(target, ':')[-1] AS path FROM ent JOIN ovr ON lower(entity) = entity_lower),
by_x AS (SELECT entity, schema_id, path FROM ent JOIN keys ON replace(lower(entity), ' ', '_') = key),
by_s AS (SELECT e.entity, arg_min(k.schema_id, (o, so)) AS schema_id, arg_min(k.path, (o, so)) AS path FROM ent e JOIN edge ON lower(e.entity) = edge.entity JOIN keys k ON replace(related, ' ', '_') = k.key GROUP BY e.entity),
rest AS (SELECT entity FROM ent WHERE entity NOT IN (SELECT entity FROM by_o) AND entity NOT IN (SELECT entity FROM by_x) AND entity NOT IN (SELECT entity FROM by_s)),
fvec AS (SELECT ord, schema_id, path, {_vec} AS v FROM (SELECT ord, schema_id, table_name || '.' || field_name AS path, sha256(concat_ws(' ', field_name, array_to_string(labels, ' '), nullif(description, ''))) AS h FROM field)),
evec AS (SELECT entity, {_vec} AS v FROM (SELECT entity, sha256(entity) AS h FROM rest)),
sims AS (SELECT entity, ord, schema_id, path, round(list_cosine_similarity(evec.v, fvec.v), 9) AS sim, row_number() OVER (PARTITION BY entity ORDER BY round(list_cosine_similarity(evec.v, fvec.v), 9) DESC, ord) AS rn FROM evec, fvec),
by_n AS (SELECT entity, schema_id, path, sim FROM sims WHERE rn = 1 AND sim >= 0.7),
hit AS (SELECT ent.entity, coalesce(by_o.path, by_x.path, by_s.path, by_n.path) AS target_path, coalesce(by_o.schema_id, by_x.schema_id, by_s.schema_id, by_n.schema_id) AS target_schema,
  CASE WHEN by_o.path IS NOT NULL THEN 1.0 WHEN by_x.path IS NOT NULL THEN 0.95 WHEN by_s.path IS NOT NULL THEN 0.85 WHEN by_n.path IS NOT NULL THEN least(1.0, by_n.sim) END AS confidence,
  CASE WHEN by_o.path IS NOT NULL THEN 'manual' WHEN by_x.path IS NOT NULL THEN 'exact' WHEN by_s.path IS NOT NULL THEN 'synonym' WHEN by_n.path IS NOT NULL THEN 'semantic' END AS mapping_method
  FROM ent LEFT JOIN by_o USING (entity) LEFT JOIN by_x USING (entity) LEFT JOIN by_s USING (entity) LEFT JOIN by_n USING (entity)),
per AS (SELECT clause_id, count(target_path) AS n_mapped, count(*) FILTER (target_path IS NULL AND source_role <> 'condition_subject') AS n_lost, coalesce(bool_or(confidence < 0.8), false) AS low, sum(confidence::DOUBLE) AS conf,
  max(target_path) FILTER (source_role = 'actor') AS actor_path, max(target_path) FILTER (source_role = 'object') AS object_path FROM mention JOIN hit USING (entity) GROUP BY clause_id),
mapped AS (SELECT parsed.*, n_mapped, n_lost, actor_path, object_path, conf, CASE WHEN n_lost = 0 AND low THEN 'needs_review' WHEN n_lost = 0 THEN 'complete' WHEN n_mapped > 0 THEN 'partial' ELSE 'needs_review' END AS mapping_status,
  round((0.75::DOUBLE + coalesce(conf, 0)) / (1 + n_mapped), 9) AS trace, round(CASE WHEN n_mapped > 0 THEN round(conf / n_mapped, 9) ELSE 0.5 END, 2) AS mapping_confidence FROM parsed JOIN per USING (clause_id))"""


def artifacts_cte(formats: tuple[str, ...]) -> str:
    ext = {"yaml": ".yaml", "sql": ".sql", "python": ".py", "terraform": ".tf", "rego": ".rego", "json": ".json"}
    return MAPPED_CTE + f""",
fmt(format, ext) AS ({values([(f, ext[f]) for f in formats])}),
artifact AS (SELECT mapped.*, format, clause_id || '_' || format AS artifact_id, doc_id || '/' || clause_id || ext AS file_path FROM mapped, fmt),
judged AS (SELECT *, NOT (format = 'yaml' OR type IN ('obligation', 'prohibition') OR contains(lower(source_text), type) OR contains(lower(source_text), lower(actor)) OR contains(lower(source_text), lower(verb))) AS drift FROM artifact),
valid AS (SELECT *, 'TRC_' || upper(substr(sha256(artifact_id), 1, 8)) AS trace_id, CASE WHEN trace < 0.5 THEN 'failed' WHEN trace < 0.85 OR drift THEN 'needs_review' ELSE 'passed' END AS validation_status, round(trace, 3) AS confidence_score FROM judged)"""


_q = lambda x: f"to_json(coalesce({x}, ''))::VARCHAR"
_if = lambda test, value: f"CASE WHEN {test} THEN {value} END"
_cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"
_lines = lambda *parts: f"concat_ws(chr(10), {', '.join(parts)}) || chr(10)"
_calm = lambda x: "translate(" + x + """, '"{}', '''()')"""


def _head(mark: str, width: int) -> tuple[str, ...]:
    return f"'{mark} From: ' || ({_cut('source_text', width)})", f"'{mark} Clause: ' || clause_id", f"'{mark} Confidence: ' || mapping_confidence::VARCHAR"


def _block(head: str, *body: str) -> str:
    return f"concat_ws(chr(10), '{head} if {{', {', '.join(body)}, '}}')"


def _case(kind: str) -> str:
    wanted, other = "CASE WHEN banned THEN 'False' ELSE 'True' END", "CASE WHEN banned THEN 'True' ELSE 'False' END"
    status = wanted if kind == "compliant" else other
    return f"""'def test_{kind}_' || rule || '():' || chr(10) || '    record = {{"id": "{kind}", "' || status || '": ' || {status} || '}}' || chr(10) || '    assert (record["' || status || '"] is ' || {wanted} || ') is {kind == "compliant"}' || chr(10)"""


def _every(body: str) -> str:
    return f"'      all tfplan.resource_changes as _, rc {{' || chr(10) || '        rc.type is ' || to_json(resource)::VARCHAR || {body} || chr(10) || '      }}'"


_actor, _action = f"'    input.actor == ' || {_q('lower(actor)')}", f"'    input.action == ' || {_q('lower(verb)')}"
_thing = _if("object IS NOT NULL", f"'    input.object == ' || {_q('lower(object)')}")
_message = "'    msg := ' || to_json(clause_id || ': ' || actor || ' ' || modal || ' ' || verb)::VARCHAR"
_times = ("deadline", "frequency", "duration")

#: Contents of the artifacts by format, over the columns of `rendered`.
CONTENTS = {
    "yaml": _lines(
        *_head("#", 80), "'control:'", f"'  id: ' || {_q('clause_id')}", "'  type: ' || type",
        f"""'  rule: ' || {_q("(CASE WHEN banned THEN 'MUST NOT ' ELSE '' END || concat_ws(' ', verb, object))")}""",
        "'  actor:'", f"'    entity: ' || {_q('actor')}", _if("actor_path IS NOT NULL", f"'    mapped_to: ' || {_q('actor_path')}"),
        "CASE WHEN banned THEN '  prohibited_action:' ELSE '  action:' END", f"'    operation: ' || {_q('verb')}",
            _if("banned", """'    enforcement: "block"'"""),
        _if("object IS NOT NULL", f"'  object:' || chr(10) || '    entity: ' || {_q('object')}"),
            _if("object IS NOT NULL AND object_path IS NOT NULL", f"'    mapped_to: ' || {_q('object_path')}"),
        _if("trigger IS NOT NULL",
                f"CASE WHEN banned THEN '  exception:' || chr(10) || '    condition: ' ELSE '  trigger:' || chr(10) || '    event: ' END || {_q('trigger')}"),
        _if(f"NOT banned AND coalesce({', '.join(_times)}) IS NOT NULL", "'  temporal_scope:'"),
            *[_if(f"NOT banned AND {c} IS NOT NULL", f"'    {c}: ' || {_q(c)}") for c in _times],
        "'  severity: ' || severity", "'  metadata:'", f"'    source_document: ' || {_q('doc_id')}",
            "'    confidence: ' || mapping_confidence::VARCHAR", """'    compiler_version: "1.0.0"'""",
    ),
    "python": _lines(
        *_head("#", 70), f"'CLAUSE_ID = ' || {_q('clause_id')}", f"'CLAUSE_TYPE = ' || {_q('type')}",
            f"'SOURCE_TEXT = ' || {_q('source_text')}", "'CONFIDENCE = ' || mapping_confidence::VARCHAR",
        _if("trigger IS NOT NULL", f"'CONDITION = ' || {_q('trigger')}"), _if("deadline IS NOT NULL", f"'DEADLINE = ' || {_q('deadline')}"),
        _if("type IN ('obligation', 'prohibition')", f"chr(10) || chr(10) || {_case('compliant')} || chr(10) || chr(10) || {_case('violating')}"),
    ),
    "terraform": _lines(
        *_head("#", 70), f"""'resource "sentinel_policy" ' || {_q('rule')} || ' {{'""", f"'  name        = ' || {_q('clause_id')}",
        f"""'  description = ' || {_q(f"replace({_calm('(' + _cut('source_text', 200) + ')')}, '$', '$$')")}""",
        """'  enforcement_level = ' || CASE WHEN banned THEN '"hard-mandatory"' ELSE '"soft-mandatory"' END""", "'  policy = <<-POLICY'",
            """'    import "tfplan/v2" as tfplan'""",
        f"'    # ' || {_calm('actor')} || ' ' || modal || ' ' || verb", "'    main = rule {'",
        f"""CASE type WHEN 'obligation' THEN {_every("' and rc.change.after.' || lower(verb) || '_enabled is true'")} WHEN 'prohibition' THEN {_every("' implies rc.change.after.' || lower(verb) || '_enabled is not true'")} ELSE '      true' END""",
        "'    }'", "'  POLICY'", "'  tags = {'", f"'    clause_id  = ' || {_q('clause_id')}", f"'    type       = ' || {_q('type')}",
            """'    confidence = "' || mapping_confidence::VARCHAR || '"'""", "'  }'", "'}'",
    ),
    "rego": _lines(
        *_head("#", 70), "'package policy.' || rule", "'import rego.v1'", "'default allow := false'",
        f"""CASE type WHEN 'obligation' THEN {_block('allow', _actor, _action, _thing, _if('trigger IS NOT NULL', "'    input.condition_met == true'"))} || chr(10) || {_block('violation contains msg', _actor, "'    not input.' || lower(verb) || '_completed'", _message)}"""
        f""" WHEN 'prohibition' THEN {_block('attempted', _action, _thing)} || chr(10) || {_block('allow', _actor, "'    not attempted'")} || chr(10) || {_block('violation contains msg', _actor, "'    attempted'", _message)} ELSE {_block('allow', _actor)} END""",
        f"""'metadata := {{"clause_id":' || {_q('clause_id')} || ',"type":' || {_q('type')} || ',"confidence":' || mapping_confidence::VARCHAR || ',"source_text":' || to_json({_cut('source_text', 200)})::VARCHAR || '}}'""",
    ),
}


def rendered(name: str) -> str:
    """Contents of all artifacts of one format."""
    resource = "CASE " + " ".join(f"WHEN contains(lower(actor), '{a}') OR contains(lower(actor), '{b}') THEN '{kind}'" for kind,
        (a, b) in RESOURCES) + f" ELSE '{FALLBACK_RESOURCE}' END"
    return f"""WITH {MAPPED_CTE}, shown AS (SELECT * REPLACE (nullif(object, '') AS object), type = 'prohibition' AS banned, lower(replace(replace(clause_id, '-', '_'), '.', '_')) AS rule, lower(verb) || '_status' AS status,
  CASE type WHEN 'prohibition' THEN 'critical' WHEN 'obligation' THEN 'high' ELSE 'medium' END AS severity, CASE type WHEN 'obligation' THEN 'must' WHEN 'prohibition' THEN 'must not' ELSE 'may' END AS modal, {resource} AS resource FROM mapped)
SELECT clause_id || '_{name}' AS artifact_id, {CONTENTS[name]} AS content FROM shown"""


_strip = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def chunk_cte(target: int = 768, least: int = 256, most: int = 1024, overlap: int = 64) -> str:
    """Chunks of `sections` (doc_id, section_id, text): a recursion over each section's items, which are paragraphs (p)
    and, in place of a paragraph over the limit, a flush (b), its sentences (s) and a flush (b)."""
    return rf"""
par AS (SELECT doc_id, section_id, pos, {_strip('p')} AS p FROM (SELECT doc_id, section_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, section_id, string_split_regex(text, '\n\s*\n') AS ps FROM sections))),
sen AS (SELECT doc_id, section_id, pos, i, {_strip('s')} AS s FROM (SELECT doc_id, section_id, pos, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT *, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM par WHERE length(p) // 4 > {most}))),
raw_item AS (SELECT doc_id, section_id, pos, 0 AS i, 'p' AS kind, p AS t FROM par WHERE p <> '' AND length(p) // 4 <= {most} UNION ALL SELECT doc_id, section_id, pos, i, 's', s FROM sen WHERE s <> ''
  UNION ALL SELECT doc_id, section_id, pos, unnest([0, 1000000]), 'b', '' FROM par WHERE length(p) // 4 > {most}),
item AS (SELECT *, length(t) // 4 AS n, row_number() OVER (PARTITION BY section_id ORDER BY pos, i) AS place, count(*) OVER (PARTITION BY section_id) AS total FROM raw_item),
step AS (SELECT doc_id, section_id, 0::BIGINT AS place, max(total) AS total, '' AS held, '' AS last, 0::BIGINT AS tokens, 0 AS parts, NULL::VARCHAR AS out FROM item GROUP BY doc_id, section_id
  UNION ALL SELECT doc_id, section_id, place, total,
    CASE WHEN kind = 'b' THEN '' WHEN NOT flush THEN held || CASE WHEN parts > 0 THEN ' ' ELSE '' END || t WHEN kind = 's' THEN t ELSE over || ' ' || t END,
    CASE WHEN kind = 'b' THEN '' ELSE t END, CASE WHEN kind = 'b' THEN 0 WHEN NOT flush THEN tokens + n WHEN kind = 's' THEN n ELSE length(over) // 4 + n END,
    CASE WHEN kind = 'b' THEN 0 WHEN NOT flush THEN parts + 1 WHEN kind = 's' THEN 1 ELSE 2 END, CASE WHEN flush THEN held END
  FROM (SELECT s.doc_id, s.section_id, i.place, s.total, s.held, s.tokens, s.parts, i.kind, i.t, i.n, CASE WHEN length(s.last) // 4 <= {overlap} THEN s.last ELSE right(s.last, {4 * overlap}) END AS over,
      s.parts > 0 AND CASE i.kind WHEN 'b' THEN true WHEN 's' THEN s.tokens + i.n > {target} ELSE s.tokens + i.n > {target} AND s.tokens >= {least} END AS flush
    FROM step s JOIN item i ON i.section_id = s.section_id AND i.place = s.place + 1)),
made AS (SELECT doc_id, section_id, place, out AS text FROM step WHERE out IS NOT NULL UNION ALL SELECT doc_id, section_id, total + 1, held FROM step WHERE place = total AND parts > 0),
chunked AS (SELECT doc_id, section_id, row_number() OVER (PARTITION BY section_id ORDER BY place) - 1 AS chunk_ord, text FROM made)"""
