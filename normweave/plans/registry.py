"""Registered queries of the policy engine, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from normweave.functions import text as T
from normweave.operators import artifacts, clauses, lineage, mapping, metrics, rules, structure, validation, views
from normweave.plans import corpus, history, oracle, outputs, pipeline  # noqa: F401  history and outputs register queries
from normweave.plans.catalog import oracle_sql, queries, query, read  # noqa: F401
from normweave.sources import stages
from normweave.sources.store import grows, scratch_path, spread, stored, tasks_of
from normweave.streaming import events

AS_OF = datetime.datetime(2026, 1, 1)
FORMATS = ("yaml", "sql")
#: Documents are dealt to tasks by so many clauses, where whole documents become one object.
CLAUSES_A_TASK = 50_000


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.parse_chunks(corpus.chunks(spark, sf_dir))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_clauses(_parsed(spark, sf_dir), corpus.registry(spark))


def _validated(spark: SparkSession, sf_dir: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    return pipeline.compile_clauses(_parsed(spark, sf_dir), corpus.registry(spark), formats)


def _rules(spark: SparkSession, sf_dir: str, formats: tuple[str, ...]) -> DataFrame:
    return artifacts.compile_rules(_mapped(spark, sf_dir), formats)


flagship_sql = f"WITH {oracle.artifacts_cte(FORMATS)} SELECT type, validation_status, count(*) AS n, round(avg(confidence_score), 6) AS avg_confidence FROM valid GROUP BY ALL"


@query(flagship_sql)
def flagship(spark, sf_dir):
    return pipeline.status_by_type(_validated(spark, sf_dir))


# -- documents and structure


@query("SELECT p_partkey, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', '_', 'g'), '_') AS doc_key FROM part")
def doc_key_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.doc_key(F.col("p_name")).alias("doc_key"))


@query("SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_hash_dedup(spark, sf_dir):
    return structure.first_of_equal(read(spark, sf_dir, "documents"))


@query("SELECT lang, count(*) AS docs, sum(length(text) // 4)::BIGINT AS tokens, max(length(text) // 4)::INTEGER AS longest FROM documents GROUP BY lang")
def token_count_by_lang(spark, sf_dir):
    n = T.token_count(F.col("text"))
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.max(n).alias("longest"))


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::INTEGER AS sentences FROM documents""")
def sentence_split_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(rf"""WITH RECURSIVE sections AS (SELECT doc_id::VARCHAR AS doc_id, doc_id || '_S001' AS section_id, {oracle._strip("replace(text, chr(10), chr(10) || chr(10))")} AS text FROM documents WHERE {oracle._strip('text')} <> ''),{oracle.chunk_cte()}
SELECT doc_id, section_id || '_C' || lpad(chunk_ord::VARCHAR, greatest(3, length(chunk_ord::VARCHAR))::INTEGER, '0') AS chunk_id, (length(text) // 4)::INTEGER AS token_count, sha256(text) AS text_hash FROM chunked""")
def chunk_fold(spark, sf_dir):
    """Every line of a document is a paragraph; lines over the limit are cut at sentences."""
    key = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents").select(key.alias("doc_id"), key.alias("doc_key"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return structure.chunks(structure.markdown_sections(docs)).select("doc_id", "chunk_id", "token_count", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id || '_S001_RAW' AS chunk_id, sha256(coalesce(text, '')) AS text_hash FROM documents")
def raw_text_chunks(spark, sf_dir):
    return stages.raw_text(read(spark, sf_dir, "documents")).select("doc_id", "chunk_id", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {oracle.SECTION_CTE} SELECT doc_id, count(*) AS sections, count(*) FILTER (text <> '') AS chunks FROM sections GROUP BY doc_id")
def documents_listed(spark, sf_dir):
    return views.list_documents(corpus.documents(spark, sf_dir), corpus.sections(spark, sf_dir), corpus.chunks(spark, sf_dir))


@query(r"""SELECT page_id, 1 AS section_ord, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS section_title, 1 AS hierarchy_level FROM pages""")
def html_sections(spark, sf_dir):
    return structure.html_sections(spread(read(spark, sf_dir, "pages"), "page_id")).select("page_id", "section_ord", "section_title", "hierarchy_level")


@query(f"""WITH {oracle.SECTION_CTE} SELECT s.doc_id, s.doc_id || '_S' || lpad(s.sec::VARCHAR, 3, '0') AS section_id, s.sec::INTEGER AS section_ord, s.title AS section_title, s.lvl::INTEGER AS hierarchy_level,
  s.doc_id || '_S' || lpad((SELECT max(p.sec) FROM sec p WHERE p.sec < s.sec AND p.lvl < s.lvl)::VARCHAR, 3, '0') AS parent_section, s.text FROM sections s""")
def markdown_hierarchy(spark, sf_dir):
    return corpus.sections(spark, sf_dir)


# -- clauses


@query(f"WITH {oracle.CLAUSE_CTE} SELECT doc_id, section_id, chunk_id, clause_ord, clause_id, source_text FROM named")
def clause_split_context(spark, sf_dir):
    return clauses.split_clauses(corpus.chunks(spark, sf_dir))


@query(f"WITH {oracle.PARSED_CTE} SELECT type, count(*) AS n FROM parsed GROUP BY type")
def clause_type_counts(spark, sf_dir):
    return corpus.parsed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {oracle.PARSED_CTE} SELECT clause_id, type, actor, verb, nullif(object, '') AS object, trigger FROM parsed")
def clause_components(spark, sf_dir):
    return corpus.parsed(spark, sf_dir).select("clause_id", "type", "actor", "verb", "object", "trigger")


@query(f"WITH {oracle.PARSED_CTE} SELECT clause_id, actor, verb FROM parsed WHERE type = 'prohibition' AND doc_id IN ('DESK_1', 'DESK_2')")
def clauses_filtered(spark, sf_dir):
    return views.filter_clauses(corpus.parsed(spark, sf_dir), kind="prohibition", doc_ids=("DESK_1", "DESK_2")).select("clause_id", "actor", "verb")


@query(f"WITH {oracle.PARSED_CTE} SELECT clause_id, deadline, duration, frequency FROM parsed WHERE coalesce(deadline, duration, frequency) IS NOT NULL")
def clause_temporal(spark, sf_dir):
    return clauses.nested(corpus.parsed(spark, sf_dir)).where("temporal_scope IS NOT NULL").select("clause_id", "temporal_scope.deadline",
        "temporal_scope.duration", "temporal_scope.frequency")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n FROM s WHERE regexp_matches(s, '(?i)(^|[^\p{L}\p{N}_])(must|shall|may|should|required|prohibited|permitted|means|defined|except|unless|if|when|where)($|[^\p{L}\p{N}_])') GROUP BY doc_id""")
def clause_when_documents(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.where(clauses.is_regulatory(F.col("s"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {oracle.PARSED_CTE}, refs AS (SELECT clause_id, doc_id, unnest(list_distinct(regexp_extract_all(source_text, '(?i)\\bsection\\s+(\\d+(?:\\.\\d+)*)', 1))) AS ref FROM parsed)
SELECT clause_id, ref, doc_id || '_S' || lpad(ref, 3, '0') IN (SELECT doc_id || '_S' || lpad(sec::VARCHAR, 3, '0') FROM sections) AS known FROM refs""")
def crossref_integrity(spark, sf_dir):
    parsed = corpus.parsed(spark, sf_dir).withColumn("ref", F.explode(clauses.cross_references(F.col("source_text"))))
    known = corpus.sections(spark, sf_dir).select("section_id", F.lit(True).alias("__known"))
    target = F.concat("doc_id", F.lit("_S"), F.lpad("ref", 3, "0"))
    return parsed.select("clause_id", "ref", target.alias("section_id")).join(grows(known), "section_id", "left").select("clause_id", "ref",
        F.coalesce("__known", F.lit(False)).alias("known"))


# -- mapping


def _entities(spark, sf_dir):
    return mapping.mentions(corpus.parsed(spark, sf_dir)).select("entity").distinct()


@query(f"WITH {oracle.MAPPED_CTE} SELECT entity, schema_id, path FROM by_o")
def map_override(spark, sf_dir):
    return mapping.by_override(_entities(spark, sf_dir), corpus.registry(spark))


@query(f"WITH {oracle.MAPPED_CTE} SELECT entity, schema_id, path FROM by_x")
def map_exact(spark, sf_dir):
    return mapping.by_name(_entities(spark, sf_dir), corpus.registry(spark))


@query(f"WITH {oracle.MAPPED_CTE} SELECT entity, schema_id, path FROM by_s")
def map_synonym(spark, sf_dir):
    return mapping.by_synonym(_entities(spark, sf_dir), corpus.registry(spark))


@query(f"WITH {oracle.MAPPED_CTE} SELECT entity, rn::INTEGER AS place, schema_id, path, sim AS similarity FROM sims WHERE rn <= 3")
def hash_embedding_cosine(spark, sf_dir):
    reg = corpus.registry(spark)
    rest = mapping.map_entities(_entities(spark, sf_dir), reg).where("mapping_method IS NULL OR mapping_method = 'semantic'").select("entity")
    return mapping.nearest(rest, reg).select("entity", F.posexplode("top").alias("pos", "t")).select("entity",
        (F.col("pos") + 1).alias("place"), "t.schema_id", "t.path", "t.similarity")


@query(f"WITH {oracle.MAPPED_CTE} SELECT clause_id, source_role, entity, target_path, target_schema, confidence::DOUBLE AS confidence, mapping_method FROM mention JOIN hit USING (entity)")
def map_cascade(spark, sf_dir):
    return mapping.map_mentions(mapping.mentions(corpus.parsed(spark, sf_dir)), corpus.registry(spark)).select("clause_id", "source_role",
        "entity", "target_path", "target_schema", "confidence", "mapping_method")


@query(f"WITH {oracle.MAPPED_CTE} SELECT mapping_status, count(*) AS n FROM mapped GROUP BY 1")
def mapping_status(spark, sf_dir):
    return mapping.status_counts(_mapped(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.e, i.e), 6) AS similarity FROM v q, v i WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) SELECT query_id, item_id, similarity, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def embedding_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    top = mapping.top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"),
        v.select(F.col("vec_id").alias("item_id"), "embedding"), 3, digits=6)
    return top.select("query_id", "item_id", "similarity", "rank")


_old_schemas = ", ".join(f"('{x}', {n}, {sum(f[0] == x for f in corpus.FIELDS)})" for n, x in enumerate(dict.fromkeys(f[0] for f in corpus.FIELDS)))


@query(f"""WITH old(schema_id, schema_ord, n_fields) AS (VALUES {_old_schemas}), new AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'people' ELSE 'region_' || r_regionkey END AS schema_id, count(*) AS n_fields FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
placed AS (SELECT schema_id, n_fields, (SELECT max(schema_ord) FROM old) + row_number() OVER (ORDER BY schema_id) AS schema_ord FROM new)
SELECT schema_id, schema_ord::INTEGER AS schema_ord, n_fields::BIGINT AS n_fields FROM old WHERE schema_id NOT IN (SELECT schema_id FROM new) UNION ALL SELECT schema_id, schema_ord::INTEGER, n_fields FROM placed""")
def registry_upsert(spark, sf_dir):
    """Regions as schemas whose nations are fields; those of even key replace a schema of the registry."""
    reg = corpus.registry(spark)
    r, n = read(spark, sf_dir, "region").select("r_regionkey"), read(spark, sf_dir, "nation")
    schema = F.when(F.col("r_regionkey") % 2 == 0, "people").otherwise(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")))
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(schema.alias("schema_id"), F.lit("nation").alias("table_name"),
        F.col("n_name").alias("field_name"), F.col("n_nationkey").alias("field_ord"))
    places = rows.select("schema_id").distinct().withColumn("schema_ord", (F.row_number().over(Window.orderBy("schema_id")) - 1).cast("int"))  # a row a schema
    new = rows.join(F.broadcast(places), "schema_id").select("schema_ord", F.lit(0).alias("table_ord"), F.col("field_ord").cast("int").alias("field_ord"), "schema_id",
        "table_name", "field_name", F.lit("VARCHAR").alias("field_type"), F.array().cast("array<string>").alias("labels"), F.lit("").alias("description"))
    return reg.with_schema(new).fields.groupBy("schema_id", "schema_ord").agg(F.count("*").alias("n_fields"))


# -- artifacts


@query(f"""WITH {oracle.artifacts_cte(("yaml", "sql", "json"))} SELECT artifact_id, file_path, format || '/' || CASE WHEN format = 'yaml' AND type IN ('obligation', 'prohibition') THEN type ELSE 'default' END AS template_used,
  CASE type WHEN 'prohibition' THEN 'critical' WHEN 'obligation' THEN 'high' ELSE 'medium' END AS severity, mapping_confidence FROM artifact""")
def artifact_matrix(spark, sf_dir):
    return _rules(spark, sf_dir, ("yaml", "sql", "json")).select("artifact_id", "file_path", "template_used", "severity", "mapping_confidence")


@query(f"""WITH {oracle.MAPPED_CTE} SELECT clause_id, type, actor, actor_path, nullif(object, '') AS object, CASE WHEN object <> '' THEN object_path END AS object_path, CASE type WHEN 'obligation' THEN 'require' WHEN 'prohibition' THEN 'block' ELSE 'allow' END AS enforcement, mapping_confidence AS confidence FROM mapped""")
def render_json(spark, sf_dir):
    kind = "type string, rule_id string, confidence double, actor struct<entity:string,mapped_to:string>, action struct<enforcement:string>, object struct<entity:string,mapped_to:string>"
    r = _rules(spark, sf_dir, ("json",)).select(F.from_json("content", kind).alias("r")).select("r.*")
    return r.select(F.col("rule_id").alias("clause_id"), "type", F.col("actor.entity").alias("actor"),
        F.col("actor.mapped_to").alias("actor_path"), F.col("object.entity").alias("object"),
        F.col("object.mapped_to").alias("object_path"), F.col("action.enforcement").alias("enforcement"), "confidence")


@query(f"""WITH {oracle.MAPPED_CTE}, n AS (SELECT *, coalesce(nullif(regexp_extract(actor_path, '^([^.]*)\\.', 1), ''), nullif(regexp_extract(object_path, '^([^.]*)\\.', 1), ''), 'compliance_table') AS tbl, lower(replace(replace(clause_id, '-', '_'), '.', '_')) AS rule,
  lower(verb) || '_status' AS st, CASE WHEN length(source_text) > 200 THEN left(source_text, 200) || '...' ELSE source_text END AS txt, CASE WHEN length(source_text) > 70 THEN left(source_text, 70) || '...' ELSE source_text END AS head FROM mapped)
SELECT clause_id, '-- From: ' || head || chr(10) || '-- Clause: ' || clause_id || chr(10) || '-- Confidence: ' || mapping_confidence::VARCHAR || chr(10) ||
  CASE WHEN type IN ('obligation', 'prohibition') THEN 'ALTER TABLE ' || tbl || ' ADD CONSTRAINT chk_' || rule || CASE WHEN type = 'prohibition' THEN '_prohibit' ELSE '' END || ' CHECK (' || CASE WHEN type = 'prohibition' THEN 'NOT ' || st ELSE st || ' = TRUE' END || ');' || chr(10) ||
  'COMMENT ON CONSTRAINT chk_' || rule || CASE WHEN type = 'prohibition' THEN '_prohibit' ELSE '' END || ' ON ' || tbl ELSE 'COMMENT ON TABLE ' || tbl END || ' IS ''' || replace(txt, '''', '''''') || ''';' || chr(10) AS content FROM n""")
def render_sql(spark, sf_dir):
    return _rules(spark, sf_dir, ("sql",)).select("clause_id", "content")


def _rendered(name: str):
    def run(spark, sf_dir):
        return _rules(spark, sf_dir, (name,)).select("artifact_id", "content")

    run.__name__ = f"render_{name}"
    return query(oracle.rendered(name))(run)


for _name in ("yaml", "python", "terraform", "rego"):
    _rendered(_name)


@query(f"""WITH {oracle.artifacts_cte(("yaml", "sql", "python", "terraform", "rego", "json"))}, a AS (SELECT format, ends_with(clause_id, 'CL002') AS spoilt FROM artifact)
SELECT format, count(*) AS n, count(*) FILTER (NOT spoilt OR format = 'rego') AS n_valid, count(*) FILTER (spoilt AND format IN ('sql', 'rego')) AS n_warned FROM a GROUP BY format""")
def artifact_syntax(spark, sf_dir):
    """Each second clause's artifacts are spoilt before they are checked."""
    spoilt = {"yaml": "a: [1", "python": "def f(:", "json": "{", "terraform": "a {", "sql": "  ", "rego": "x"}
    bad = F.element_at(F.create_map(*[F.lit(x) for kv in spoilt.items() for x in kv]), F.col("format"))
    rows = _rules(spark, sf_dir, tuple(artifacts.EXTENSIONS)).withColumn("content",
        F.when(F.col("clause_id").endswith("CL002"), bad).otherwise(F.col("content")))
    return artifacts.check_syntax(rows).groupBy("format").agg(F.count("*").alias("n"), F.count_if("syntax_valid").alias("n_valid"),
        F.count_if(F.size("warnings") > 0).alias("n_warned"))


# -- validation and lineage


@query(f"""WITH {oracle.artifacts_cte(FORMATS)} SELECT trace_id, artifact_id, validation_status, confidence_score, trace >= 0.85 AS confident, concat_ws(',', CASE WHEN trace < 0.7 THEN 'low_confidence' WHEN trace < 0.85 THEN 'below_threshold' END, CASE WHEN drift THEN 'semantic_drift' END) AS flags FROM valid""")
def validation_checks(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("trace_id", "artifact_id", "validation_status", "confidence_score",
        F.col("validation_checks")[2]["passed"].alias("confident"), F.array_join("review_flags", ",").alias("flags"))


@query(f"WITH {oracle.artifacts_cte(FORMATS)} SELECT count(*) AS total, count(*) FILTER (validation_status = 'passed') AS passed, count(*) FILTER (validation_status = 'failed') AS failed, count(*) FILTER (validation_status = 'needs_review') AS needs_review FROM valid")
def validation_status_summary(spark, sf_dir):
    return validation.summary(_validated(spark, sf_dir))


@query(f"WITH {oracle.artifacts_cte(FORMATS)} SELECT CASE WHEN trace < 0.7 THEN 'low_confidence' ELSE 'below_threshold' END AS flag, count(*) AS n FROM valid WHERE trace < 0.85 GROUP BY 1 UNION ALL SELECT 'semantic_drift', count(*) FROM valid WHERE drift")
def review_flag_counts(spark, sf_dir):
    return validation.flag_counts(_validated(spark, sf_dir))


_graph = f"""WITH {oracle.artifacts_cte(FORMATS)}, nodes AS (SELECT DISTINCT 'document:' || doc_id AS node_id, 'document' AS node_type FROM valid UNION SELECT 'section:' || section_id, 'section' FROM valid UNION SELECT 'chunk:' || chunk_id, 'chunk' FROM valid
  UNION SELECT 'clause:' || clause_id, 'clause' FROM valid UNION SELECT 'artifact:' || artifact_id, 'artifact' FROM valid),
pairs AS (SELECT DISTINCT 'document:' || doc_id AS source_id, 'section:' || section_id AS target_id, 'CONTAINS_SECTION' AS relationship, NULL::DOUBLE AS confidence FROM valid UNION SELECT 'section:' || section_id, 'chunk:' || chunk_id, 'CONTAINS_CHUNK', NULL FROM valid
  UNION SELECT 'chunk:' || chunk_id, 'clause:' || clause_id, 'PARSED_TO', NULL FROM valid UNION SELECT 'clause:' || clause_id, 'artifact:' || artifact_id, 'COMPILED_TO', confidence_score FROM valid)"""


def _graph_rows(spark: SparkSession, sf_dir: str, *judged: str) -> DataFrame:
    """What the graph is made of, stored, for its levels are read one by one; of the verdicts only what is named is found out."""
    none = {"confidence_score": F.lit(None).cast("double"), "validation_status": F.lit(None).cast("string")}
    rows = stored(_validated(spark, sf_dir).select("artifact_id", "lineage", "format", "type", *judged), "validated")
    return rows.withColumns({c: x for c, x in none.items() if c not in judged})


@query(_graph + " SELECT node_id, node_type FROM nodes")
def prov_nodes(spark, sf_dir):
    return lineage.nodes(_graph_rows(spark, sf_dir), once=FORMATS[0]).select("node_id", "node_type")


@query(_graph + " SELECT 'e:' || source_id || '->' || target_id AS edge_id, source_id, target_id, relationship, confidence FROM pairs")
def prov_edges(spark, sf_dir):
    return lineage.edges(_graph_rows(spark, sf_dir, "confidence_score"), once=FORMATS[0])


@query(_graph + " SELECT artifact_id, 'clause:' || clause_id AS clause, 'chunk:' || chunk_id AS chunk, 'section:' || section_id AS section, 'document:' || doc_id AS document FROM valid")
def lineage_trace(spark, sf_dir):
    return lineage.traced(_validated(spark, sf_dir))


@query(_graph + " SELECT artifact_id, 'clause:' || clause_id AS clause, 'chunk:' || chunk_id AS chunk, 'section:' || section_id AS section, 'document:' || doc_id AS document FROM valid")
def lineage_walk(spark, sf_dir):
    """The same through the graph's edges."""
    v = _graph_rows(spark, sf_dir)
    return lineage.trace(stored(lineage.edges(v, once=FORMATS[0]), "edges"), v.select("artifact_id"))


@query(_graph + """ SELECT 0 AS ord, '' AS id, 'digraph provenance {' AS line UNION ALL SELECT 3, '', '}' UNION ALL
SELECT 1, node_id, '  "' || node_id || '" [label="' || string_split(node_id, ':')[-1] || '", shape=' || CASE node_type WHEN 'document' THEN 'box' WHEN 'section' THEN 'folder' WHEN 'chunk' THEN 'note' WHEN 'clause' THEN 'ellipse' ELSE 'component' END || '];' FROM nodes UNION ALL
SELECT 2, 'e:' || source_id || '->' || target_id, '  "' || source_id || '" -> "' || target_id || '" [label="' || relationship || '"];' FROM pairs""")
def graph_dot(spark, sf_dir):
    v = _graph_rows(spark, sf_dir)
    return lineage.dot_lines(lineage.nodes(v, once=FORMATS[0]), lineage.edges(v, once=FORMATS[0]))


_json_graph = _graph + """, prop AS (SELECT DISTINCT 'clause:' || clause_id AS node_id, '{"type":' || to_json(type)::VARCHAR || '}' AS p FROM valid UNION ALL SELECT 'artifact:' || artifact_id, '{"format":' || to_json(format)::VARCHAR || ',"status":' || to_json(validation_status)::VARCHAR || '}' FROM valid),
n AS (SELECT node_id AS id, '{"node_id":' || to_json(node_id)::VARCHAR || ',"node_type":' || to_json(node_type)::VARCHAR || ',"properties":' || coalesce(p, '{}') || '}' AS line FROM nodes LEFT JOIN prop USING (node_id)),
e AS (SELECT 'e:' || source_id || '->' || target_id AS id, '{"edge_id":' || to_json('e:' || source_id || '->' || target_id)::VARCHAR || ',"source_id":' || to_json(source_id)::VARCHAR || ',"target_id":' || to_json(target_id)::VARCHAR || ',"relationship":"' || relationship || '","confidence":' || coalesce(confidence::VARCHAR, 'null') || '}' AS line FROM pairs)"""


@query(_json_graph + """ SELECT 0 AS ord, '' AS id, '{"nodes":[' AS line UNION ALL SELECT 2, '', '],"edges":[' UNION ALL SELECT 4, '', ']}' UNION ALL SELECT 1, id, CASE WHEN id = (SELECT min(id) FROM n) THEN '' ELSE ',' END || line FROM n
UNION ALL SELECT 3, id, CASE WHEN id = (SELECT min(id) FROM e) THEN '' ELSE ',' END || line FROM e""")
def graph_json(spark, sf_dir):
    v = _graph_rows(spark, sf_dir, "confidence_score", "validation_status")
    return lineage.json_lines(lineage.nodes(v, once=FORMATS[0]), lineage.edges(v, once=FORMATS[0]))


@query(f"""WITH {oracle.artifacts_cte(("json",))}, good AS (SELECT artifact_id, round((0.75::DOUBLE + coalesce(conf, 0)) / (1 + n_mapped), 9) AS trace, clause_ord = 2 AS unknown FROM artifact)
SELECT artifact_id, CASE WHEN trace < 0.5 THEN 'failed' WHEN trace < 0.85 OR unknown THEN 'needs_review' ELSE 'passed' END AS validation_status,
  concat_ws(',', CASE WHEN trace < 0.7 THEN 'low_confidence' WHEN trace < 0.85 THEN 'below_threshold' END, CASE WHEN unknown THEN 'invalid_references' END, CASE WHEN trace < 0.5 THEN 'blocked_low_confidence' END) AS flags FROM good
UNION ALL SELECT artifact_id || '_x', 'failed', 'incomplete_chain,low_confidence,semantic_drift' FROM artifact WHERE clause_ord = 1""")
def validation_faults(spark, sf_dir):
    """Unknown references in each second clause, and artifacts of clauses that nobody parsed."""
    none = F.array().cast("array<string>")
    parsed = stored(_parsed(spark, sf_dir).withColumn("cross_references",
            F.when(F.col("clause_ord") == 2, F.array(F.col("clause_id"), F.lit("nope"))).otherwise(none)), "clauses")
    mapped = mapping.map_clauses(parsed, corpus.registry(spark))
    made = artifacts.check_syntax(artifacts.compile_rules(mapped, ("json",)), ("json",))
    lost = made.where(F.col("clause_id").endswith("CL001")).withColumns(
        {"artifact_id": F.concat("artifact_id", F.lit("_x")), "clause_id": F.lit("absent"), "content": F.lit("{}")})
    v = validation.validate(made.unionByName(lost), parsed, mapped)
    return v.select("artifact_id", "validation_status", F.array_join("review_flags", ",").alias("flags"))


# -- what the stages hand on as JSON


def _through_json(rows: DataFrame, stage: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, f"json-{stage}")
    stages.write_json(rows, path)
    return stages.read_json(rows.sparkSession, path, stage)


@query(f"WITH {oracle.CLAUSE_CTE} SELECT doc_id, section_id, chunk_id, 0 AS chunk_ord, (length(text) // 4)::INTEGER AS token_count, text FROM chunk")
def json_documents(spark, sf_dir):
    sections = corpus.sections(spark, sf_dir)
    return stages.chunks_in(_through_json(stages.ingested(sections, structure.chunks(sections)), "documents"))


@query(f"WITH {oracle.PARSED_CTE} SELECT doc_id, section_id, chunk_id, clause_id, source_text, type, actor, verb, nullif(object, '') AS object, trigger, deadline, duration, frequency, 0.75::DOUBLE AS confidence FROM parsed")
def json_clauses(spark, sf_dir):
    out = stages.parsed_out(clauses.nested(corpus.parsed(spark, sf_dir)), F.lit(AS_OF.isoformat()))
    return stages.parsed_in(_through_json(out, "clauses")).drop("cross_references")


@query(f"WITH {oracle.MAPPED_CTE} SELECT clause_id, mapping_status, n_mapped::INTEGER AS n_mapped, n_lost::INTEGER AS n_lost FROM mapped")
def json_mappings(spark, sf_dir):
    m = _through_json(_mapped(spark, sf_dir).select("clause_id", "mapping_status", "mapped_entities", "unmapped_entities"), "mappings")
    return m.select("clause_id", "mapping_status", F.size("mapped_entities").alias("n_mapped"), F.size("unmapped_entities").alias("n_lost"))


@query(oracle.rendered("python"))
def json_artifacts(spark, sf_dir):
    return _through_json(_rules(spark, sf_dir, ("python",)), "artifacts").select("artifact_id", "content")


@query(f"WITH {oracle.artifacts_cte(FORMATS)} SELECT trace_id, artifact_id, validation_status, confidence_score, 'DESK_' || split_part(doc_id, '_', 2) AS document_id FROM valid")
def json_validations(spark, sf_dir):
    return _through_json(_validated(spark, sf_dir), "validations").select("trace_id", "artifact_id", "validation_status",
        "confidence_score", "lineage.document_id")


@query(f"""WITH {oracle.artifacts_cte(FORMATS)}, n AS (SELECT doc_id AS key, count(DISTINCT clause_id) AS clauses, count(*) AS artifacts, count(DISTINCT section_id) AS sections FROM valid GROUP BY 1)
SELECT 'policy.parsed' AS topic, key, clauses AS n FROM n UNION ALL SELECT 'policy.mapped', key, clauses FROM n UNION ALL SELECT 'policy.compiled', key, artifacts FROM n UNION ALL SELECT 'policy.validated', key, artifacts FROM n
UNION ALL SELECT 'policy.ingested', doc_id, count(*) FROM sections GROUP BY 2""")
def events_published(spark, sf_dir):
    """Every stage's events, written and read back, with the number of items that each holds."""
    sections, stored_clauses, reg = corpus.sections(spark, sf_dir), _parsed(spark, sf_dir), corpus.registry(spark)
    tasks, hits = tasks_of(stored_clauses, CLAUSES_A_TASK), mapping.clause_hits(stored_clauses, reg)
    parsed = stored_clauses.repartition(tasks, "doc_id")
    mapped = mapping.map_clauses(parsed, reg, hits=hits)
    made = artifacts.compile_rules(mapped, FORMATS)
    judged = pipeline.judge_rules(artifacts.compile_rules(mapping.map_clauses(stored_clauses, reg, hits=hits), FORMATS, carry=True), FORMATS, tasks)
    items = {
        "policy.ingested": ("sections", stages.ingested(sections, structure.chunks(sections))),
            "policy.parsed": ("clauses", stages.parsed_out(clauses.nested(parsed), F.lit(AS_OF.isoformat()))),
        "policy.mapped": ("clauses", events.by_document(mapped.select("doc_id", "clause_id", "mapping_status", "mapped_entities",
                        "unmapped_entities"), F.col("doc_id"), "clauses")),
        "policy.compiled": ("artifacts", events.by_document(made, F.col("doc_id"), "artifacts")),
            "policy.validated": ("results", events.by_document(judged, F.col("doc_id"), "results", apart=("doc_id",))),
    }
    path = scratch_path(spark, "events")
    for topic, (_, objects) in items.items():
        events.publish(events.events(objects, topic, F.lit(AS_OF)), path)
    name = F.element_at(F.create_map(*[F.lit(x) for t, (n, _) in items.items() for x in (t, n)]), F.col("topic"))
    size = F.json_array_length(F.when(name == "sections", F.get_json_object("value", "$.sections")).when(name == "clauses",
            F.get_json_object("value", "$.clauses")).when(name == "artifacts",
            F.get_json_object("value", "$.artifacts")).otherwise(F.get_json_object("value", "$.results")))
    return spark.read.schema(events.EVENT).parquet(path).select("topic", "key", size.cast("long").alias("n"))


# -- rules over data


@query("SELECT l_orderkey, l_linenumber, 'quantity' AS rule FROM lineitem WHERE NOT coalesce(l_quantity <= 45, true) UNION ALL SELECT l_orderkey, l_linenumber, 'late_return' FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-01-01'")
def rule_check_violations(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit(datetime.datetime(1995, 1, 1)))
    of = lambda p, name: rules.check_violations(li, p).select("l_orderkey", "l_linenumber", F.lit(name).alias("rule"))
    return of(F.col("l_quantity") <= 45, "quantity").unionByName(of(rules.prohibition_predicate(late), "late_return"))


_RULE_CTE = corpus.rule_cte()
_FACT_CTE = _RULE_CTE + """, fact AS (SELECT o_orderkey AS entity_id, lower(c_mktsegment) AS actor, CASE o_orderstatus WHEN 'F' THEN 'close' WHEN 'O' THEN 'hold' ELSE 'review' END AS action, 'order' AS object,
  CASE WHEN o_totalprice > 300000 THEN 'violation' ELSE 'ok' END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS completed, o_orderstatus = 'O' AS attempted, o_orderpriority LIKE '1%' AS condition_met, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey), hit AS (SELECT f.*, r.rule_id, r.type AS r_type, r.action AS r_action, r.object AS r_object, r.has_condition, r.severity FROM fact f JOIN rule r ON lower(f.actor) = lower(r.actor))"""


def _facts(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    s = F.col("o_orderstatus")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entity_id"), F.lower("c_mktsegment").alias("actor"),
            F.when(s == "F", "close").when(s == "O", "hold").otherwise("review").alias("action"), F.lit("order").alias("object"),
        F.when(F.col("o_totalprice") > 300000, "violation").otherwise("ok").alias("status"), F.when(s != "P", s == "F").alias("completed"),
            (s == "O").alias("attempted"), F.col("o_orderpriority").startswith("1").alias("condition_met"),
            F.col("o_orderdate").alias("ts"),
    )


@query(f"""WITH {_FACT_CTE} SELECT entity_id, rule_id, CASE r_type WHEN 'obligation' THEN 'obligation_not_met' WHEN 'prohibition' THEN 'prohibition_violated' ELSE r_type || '_triggered' END AS violation_type,
  CASE WHEN r_type = 'prohibition' THEN 'critical' ELSE severity END AS severity, r_type IN ('obligation', 'prohibition') AS blocking, ts FROM hit WHERE CASE r_type WHEN 'obligation' THEN NOT coalesce(completed, false) WHEN 'prohibition' THEN attempted ELSE true END""")
def rule_trigger_audit(spark, sf_dir):
    return rules.trigger_log(_facts(spark, sf_dir), corpus.rule_table(spark))


@query(f"""WITH {_FACT_CTE} SELECT rule_id, count(*) AS n, count(*) FILTER (CASE r_type WHEN 'obligation' THEN NOT coalesce(completed, false) WHEN 'prohibition' THEN attempted ELSE status = 'violation' END) AS violations FROM hit GROUP BY rule_id""")
def rule_validator_outcomes(spark, sf_dir):
    return rules.validator_outcomes(_facts(spark, sf_dir), corpus.rule_table(spark)).groupBy("rule_id").agg(F.count("*").alias("n"),
        F.count_if("violated").alias("violations"))


@query(f"""WITH {_FACT_CTE}, d AS (SELECT entity_id, bool_or(CASE r_type WHEN 'obligation' THEN action = r_action AND (r_object IS NULL OR object = r_object) AND (NOT has_condition OR condition_met) WHEN 'prohibition' THEN NOT (action = r_action AND (r_object IS NULL OR object = r_object)) ELSE true END) AS allow,
  count(*) FILTER (CASE r_type WHEN 'obligation' THEN NOT coalesce(completed, false) WHEN 'prohibition' THEN action = r_action AND (r_object IS NULL OR object = r_object) ELSE false END) AS violations FROM hit GROUP BY entity_id)
SELECT entity_id, coalesce(allow, false) AS allow, coalesce(violations, 0)::BIGINT AS violations FROM fact LEFT JOIN d USING (entity_id)""")
def policy_decisions(spark, sf_dir):
    return rules.decisions(_facts(spark, sf_dir), corpus.rule_table(spark))


@query("SELECT l_orderkey AS plan_id, bool_and(NOT (l_linestatus = 'O' AND l_discount > 0.08)) AS passed, 'hard-mandatory' AS level FROM lineitem GROUP BY 1")
def plan_policy_all(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    changes = li.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linestatus").alias("resource"), (F.col("l_discount") > 0.08).alias("enabled"))
    return rules.plan_verdicts(changes, "prohibition", "O")


@query("""WITH r AS (SELECT s_suppkey, lower(n_name) AS actor, CASE s_suppkey % 3 WHEN 0 THEN 'obligation' WHEN 1 THEN 'prohibition' ELSE 'permission' END AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'S' || s_suppkey || '_' || p AS entity_id, actor, CASE WHEN type = 'prohibition' THEN NULL ELSE p = 'compliant' END AS completed, type = 'prohibition' AND p = 'violating' AS attempted, 'S' || s_suppkey AS broken FROM r, (VALUES ('compliant'), ('violating')) t(p)
WHERE p = 'violating' AND type <> 'permission' UNION ALL SELECT 'S' || s_suppkey || '_' || p, actor, CASE WHEN type = 'prohibition' THEN NULL ELSE p = 'compliant' END, type = 'prohibition' AND p = 'violating', NULL FROM r, (VALUES ('compliant'), ('violating')) t(p) WHERE p = 'compliant' OR type = 'permission'""")
def rule_fixtures(spark, sf_dir):
    """A rule a supplier; each pair of facts is put to its own rule: who breaks it must be the violating one."""
    k = F.col("s_suppkey") % 3
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    table = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("rule_id"),
        F.when(k == 0, "obligation").when(k == 1, "prohibition").otherwise("permission").alias("type"), F.lower("n_name").alias("actor"),
        F.lit("close").alias("action"), F.lit("order").alias("object"), F.lit(False).alias("has_condition"), F.lit("high").alias("severity"))
    facts = rules.fixture_pairs(table)
    own = F.concat("rule_id", F.when(F.col("type") == "permission", "_none").otherwise("_violating")) == F.col("entity_id")
    broken = rules.validator_outcomes(facts, table).where("violated").join(table.select("rule_id", "type"), "rule_id").where(own).select("entity_id",
        F.col("rule_id").alias("broken"))
    return facts.select("entity_id", "actor", "completed", "attempted").join(broken, "entity_id", "left")


# -- reports


@query(f"""WITH {oracle.artifacts_cte(FORMATS)} SELECT doc_id, count(DISTINCT clause_id) AS clause_count, count(DISTINCT artifact_id) AS artifact_count, round(avg(confidence), 6)::DOUBLE AS avg_confidence, 0.75::DOUBLE AS avg_clause_confidence FROM valid GROUP BY doc_id""")
def document_summary(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    docs = corpus.documents(spark, sf_dir).select("doc_id")
    s = views.document_summary(docs, parsed, artifacts.compile_rules(mapping.map_clauses(parsed, corpus.registry(spark)), FORMATS))
    return s.select("doc_id", "clause_count", "artifact_count", F.round("avg_confidence", 6).alias("avg_confidence"),
        F.round("avg_clause_confidence", 6).alias("avg_clause_confidence"))


@query(f"WITH {oracle.artifacts_cte(FORMATS)} SELECT validation_status, count(*) AS count, round(avg(confidence_score), 6) AS avg_confidence FROM valid GROUP BY 1")
def validation_summary(spark, sf_dir):
    return views.validation_summary(_validated(spark, sf_dir))


_AUDIT_CTE = """audit AS (SELECT event_id AS id, event_type AS violation_type, CASE WHEN user_id % 2 = 0 THEN 'client' ELSE 'payment' END AS table_name, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, value > 50 AS resolved, ts AS occurred_at FROM events WHERE value IS NOT NULL)"""


def _audit(spark, sf_dir):
    k = F.col("event_id") % 4
    return read(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("violation_type"),
            F.when(F.col("user_id") % 2 == 0, "client").otherwise("payment").alias("table_name"),
        F.when(k == 0, "critical").when(k == 1, "high").when(k == 2, "medium").otherwise("low").alias("severity"),
            (F.col("value") > 50).alias("resolved"), F.col("ts").cast("timestamp").alias("occurred_at"),
    )


@query(f"WITH {_AUDIT_CTE} SELECT id, violation_type, severity, round((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(occurred_at)) / 3600000000.0, 6)::DOUBLE AS hours_open FROM audit WHERE NOT resolved")
def unresolved_violations(spark, sf_dir):
    as_of = F.timestamp_micros(F.lit(int((AS_OF - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)))
    return views.unresolved(_audit(spark, sf_dir), as_of).select("id", "violation_type", "severity", F.round("hours_open", 6).alias("hours_open"))


@query(f"WITH {_AUDIT_CTE} SELECT violation_type, table_name, severity, count(*) AS total, count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us FROM audit GROUP BY ALL")
def violation_summary(spark, sf_dir):
    s = views.violation_summary(_audit(spark, sf_dir))
    return s.withColumns({"first_us": F.unix_micros("first_at"), "last_us": F.unix_micros("last_at")}).drop("first_at", "last_at")


@query(f"WITH {oracle.artifacts_cte(FORMATS)} SELECT artifact_id FROM artifact WHERE doc_id NOT IN ('DESK_1', 'DESK_2')")
def erase_document(spark, sf_dir):
    gone = spark.createDataFrame([("DESK_1",), ("DESK_2",)], "doc_id string")
    return views.erase(_rules(spark, sf_dir, FORMATS), corpus.parsed(spark, sf_dir), gone).select("artifact_id")


@query("SELECT 'orders' AS child, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))")
def referential_integrity(spark, sf_dir):
    o, c, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    count = lambda df, name: df.agg(F.lit(name).alias("child"), F.count("*").alias("orphans"))
    lost = count(views.orphans(o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k")), "k"), "orders")
    return lost.unionByName(count(views.orphans(li.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), "k"),
            "lineitem")).unionByName(count(views.repeated_keys(o, "o_orderkey"), "repeated orders"))


@query(f"WITH {oracle.artifacts_cte(('yaml', 'sql', 'json'))} SELECT clause_id, min(artifact_id) AS artifact_id FROM artifact GROUP BY 1")
def rule_lookup_first(spark, sf_dir):
    return views.first_artifact(_rules(spark, sf_dir, ("yaml", "sql", "json")).select("clause_id", "artifact_id"))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def job_status_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return views.latest(e.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("updated_at"),
            F.col("event_type").alias("status"))).select("job_id", "status")


@query(f"""WITH {oracle.CLAUSE_CTE}, changed AS (SELECT doc_id || chr(7) || clause_id AS x, clause_id, clause_ord FROM named) SELECT clause_id, CASE WHEN clause_ord = 1 THEN 'same' WHEN clause_ord = 2 THEN 'changed' ELSE 'removed' END AS change FROM changed""")
def clause_version_diff(spark, sf_dir):
    old = clauses.split_clauses(corpus.chunks(spark, sf_dir))
    new = old.where("clause_ord < 3").withColumn("source_text",
        F.when(F.col("clause_ord") == 1, F.concat(F.lit(" "), F.upper("source_text"))).otherwise(F.concat("source_text", F.lit(" again"))))
    return views.version_diff(old, new)


# -- metrics


@query("SELECT event_type, round(sum(value), 4) AS total, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def metric_counters(spark, sf_dir):
    return metrics.counters(read(spark, sf_dir, "events").where("value IS NOT NULL"), ["event_type"]).withColumn("total", F.round("total", 4))


_ORDERED = "SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL"


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, count(*) AS count, round(sum(v), 4) AS sum, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max, max(v) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50,
  max(v) FILTER (i = CASE WHEN n >= 20 THEN floor(n * 0.95) ELSE n - 1 END) AS p95, max(v) FILTER (i = CASE WHEN n >= 100 THEN floor(n * 0.99) ELSE n - 1 END) AS p99 FROM o GROUP BY 1""")
def metric_histogram_stats(spark, sf_dir):
    s = metrics.histogram_stats(read(spark, sf_dir, "events"), ["event_type"])
    return s.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query("WITH b(le, v) AS (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('+Inf', 1e300)) SELECT event_type, le, count(*) FILTER (value <= v) AS cumulative FROM events, b GROUP BY ALL")
def metric_buckets(spark, sf_dir):
    return metrics.buckets(read(spark, sf_dir, "events"), ["event_type"])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def gauge_running(spark, sf_dir):
    return metrics.gauge_running(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", F.round("running", 4).alias("running"))


@query(f"""WITH o AS ({_ORDERED}) SELECT event_type, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev, round(median(v), 6) AS median, max(v) FILTER (i = floor(n * 0.9)) AS p90, max(v) FILTER (i = floor(n * 0.95)) AS p95, max(v) FILTER (i = floor(n * 0.99)) AS p99,
  count(*) FILTER (v > 95) AS failures, count(*) FILTER (v > 95) <= 0.1 * count(*) AS passed FROM o GROUP BY 1""")
def load_stats(spark, sf_dir):
    s = metrics.load_stats(read(spark, sf_dir, "events").where("value IS NOT NULL"), ["event_type"], failed=F.col("value") > 95)
    return s.select("event_type", "count", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"),
        F.round("median", 6).alias("median"), "p90", "p95", "p99", "failures", "passed")
