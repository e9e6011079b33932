"""Mapping of entity mentions to fields of a schema registry, by a cascade of joins.

Work is done once for each distinct entity. A registry is three small tables: fields (schema_ord, table_ord,
field_ord, schema_id, table_name, field_name, field_type, labels, description), synonyms (ord, term, syn_ord,
synonym) and overrides (entity_lower, target_path).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from normweave.functions.text import cosine, first_words, hash_embedding
from normweave.sources.store import expected_bytes, stored

OVERRIDE, EXACT, SYNONYM = 1.0, 0.95, 0.85
THRESHOLD, REVIEW_BELOW, SUGGESTIONS = 0.7, 0.8, 3
#: Rows of a block of queries and of items in top_k, and of queries that are multiplied at once.
QUERY_BLOCK, ITEM_BLOCK, QUERY_SLICE = 2048, 8192, 256
#: Distinct entities whose mappings go to all tasks at most, and the bytes that the optimizer expects of them.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


@dataclass(frozen=True)
class Registry:
    fields: DataFrame
    synonyms: DataFrame
    overrides: DataFrame

    def only(self, schema_id: str) -> Registry:
        """The registry of one schema; overrides stay."""
        return Registry(self.fields.where(F.col("schema_id") == schema_id), self.synonyms, self.overrides)

    def with_schema(self, fields: DataFrame) -> Registry:
        """Replace the schemas that `fields` names; they come last."""
        last = self.fields.agg(F.coalesce(F.max("schema_ord"), F.lit(-1)).alias("last"))
        kept = self.fields.join(fields.select("schema_id").distinct(), "schema_id", "left_anti").select(*self.fields.columns)
        moved = fields.crossJoin(last).withColumn("schema_ord", (F.col("schema_ord") + F.col("last") + 1).cast("int")).select(*self.fields.columns)
        return Registry(kept.unionByName(moved), self.synonyms, self.overrides)

    def with_synonym(self, term: str, synonym: str) -> Registry:
        row = self.synonyms.agg(F.coalesce(F.max(F.when(F.col("term") == term, F.col("ord"))), F.max("ord") + 1,
                F.lit(0)).cast("int").alias("ord"), (F.coalesce(F.max("syn_ord"), F.lit(-1)) + 1).cast("int").alias("syn_ord"))
        row = row.select("ord", F.lit(term).alias("term"), "syn_ord", F.lit(synonym).alias("synonym"))
        return Registry(self.fields, self.synonyms.unionByName(row.join(self.synonyms, ["term", "synonym"],
                    "left_anti").select(*self.synonyms.columns)), self.overrides)

    def with_override(self, entity: str, path: str) -> Registry:
        rest = self.overrides.where(F.col("entity_lower") != entity.lower())
        row = self.overrides.sparkSession.range(1).select(F.lit(entity.lower()).alias("entity_lower"), F.lit(path).alias("target_path"))
        return Registry(self.fields, self.synonyms, rest.unionByName(row))


def _place() -> Column:
    """A field's place in the registry; never rely on the order of rows."""
    return F.struct("schema_ord", "table_ord", "field_ord")


def _path() -> Column:
    return F.concat("table_name", F.lit("."), "field_name")


def field_keys(fields: DataFrame) -> DataFrame:
    """(key, schema_id, path): the first field of each name or label, in lower case."""
    names = F.explode(F.array_distinct(F.transform(F.concat(F.array("field_name"), F.col("labels")), F.lower)))
    keys = fields.select(names.alias("key"), F.struct(_place().alias("place"), F.col("schema_id"), _path().alias("path")).alias("hit"))
    return keys.groupBy("key").agg(F.min("hit").alias("hit")).select("key", "hit.place", "hit.schema_id", "hit.path")


def entity_key(entity: Column) -> Column:
    return F.replace(F.lower(entity), F.lit(" "), F.lit("_"))


def synonym_edges(synonyms: DataFrame) -> DataFrame:
    """(entity_lower, related, rel_ord): what an entity may be called, in order: a term's synonyms for the term, the
    term and all its synonyms for each synonym."""
    s = synonyms.withColumns({"term": F.lower("term"), "synonym": F.lower("synonym")})
    order = lambda first: F.struct(F.col("ord").alias("o"), first.alias("s"))
    of_term = s.select(F.col("term").alias("entity_lower"), F.col("synonym").alias("related"), order(F.col("syn_ord")).alias("rel_ord"))
    to_term = s.select(F.col("synonym").alias("entity_lower"), F.col("term").alias("related"), order(F.lit(-1)).alias("rel_ord"))
    others = s.alias("a").join(s.alias("b"), F.col("a.ord") == F.col("b.ord")).select(F.col("a.synonym").alias("entity_lower"),
        F.col("b.synonym").alias("related"), F.struct(F.col("a.ord").alias("o"), F.col("b.syn_ord").alias("s")).alias("rel_ord"))
    return of_term.unionByName(to_term).unionByName(others).groupBy("entity_lower", "related").agg(F.min("rel_ord").alias("rel_ord"))


def override_targets(registry: Registry, default_schema: str = "default") -> DataFrame:
    """(entity_lower, schema_id, path): the part of the target after the last colon, the schema before the first."""
    parts = F.split("target_path", ":")
    schema = F.when(F.col("target_path").contains(":"), F.element_at(parts, 1)).otherwise(F.lit(default_schema))
    return registry.overrides.select("entity_lower", schema.alias("schema_id"), F.element_at(parts, -1).alias("path"))


def synonym_targets(registry: Registry) -> DataFrame:
    """(entity_lower, schema_id, path): the field of the first related name that is one."""
    hits = synonym_edges(registry.synonyms).join(field_keys(registry.fields), entity_key(F.col("related")) == F.col("key"))
    return hits.groupBy("entity_lower").agg(F.min(F.struct("rel_ord", "place", "schema_id", "path")).alias("hit")).select("entity_lower",
        "hit.schema_id", "hit.path")


def by_override(entities: DataFrame, registry: Registry, default_schema: str = "default") -> DataFrame:
    return entities.join(override_targets(registry, default_schema), F.lower("entity") == F.col("entity_lower")).select("entity", "schema_id", "path")


def by_name(entities: DataFrame, registry: Registry) -> DataFrame:
    return entities.join(field_keys(registry.fields), entity_key(F.col("entity")) == F.col("key")).select("entity", "schema_id", "path")


def by_synonym(entities: DataFrame, registry: Registry) -> DataFrame:
    return entities.join(synonym_targets(registry), F.lower("entity") == F.col("entity_lower")).select("entity", "schema_id", "path")


def _field_row(registry: Registry, embed) -> DataFrame:
    """All fields with their embeddings as one array in one row, in registry order."""
    text = F.concat_ws(" ", F.col("field_name"), F.array_join("labels", " "), F.nullif(F.coalesce("description", F.lit("")), F.lit("")))
    return registry.fields.select(F.struct(_place().alias("place"), F.col("schema_id"), _path().alias("path"),
            embed(text).alias("e")).alias("f")).agg(F.array_sort(F.collect_list("f")).alias("__fields"))


def _top(entity: Column, k: int, embed) -> Column:
    own = F.transform(F.array(embed(entity)), lambda e: F.transform("__fields", lambda f: F.struct((-F.round(cosine(e, f["e"]),
                        9)).alias("far"), f["place"].alias("place"), f["schema_id"].alias("schema_id"), f["path"].alias("path"))))
    return F.transform(F.slice(F.array_sort(F.element_at(own, 1)), 1, k),
        lambda f: F.struct((-f["far"]).alias("similarity"), f["schema_id"].alias("schema_id"), f["path"].alias("path")))


def nearest(entities: DataFrame, registry: Registry, k: int = SUGGESTIONS, embed=hash_embedding) -> DataFrame:
    """(entity, top): the k fields of highest cosine, as structs (similarity, schema_id, path), ties by registry order.
    Each entity is ranked inside its own row."""
    return entities.crossJoin(_field_row(registry, embed)).select("entity", _top(F.col("entity"), k, embed).alias("top"))


def map_entities(entities: DataFrame, registry: Registry, threshold: float = THRESHOLD, default_schema: str = "default", embed=hash_embedding) -> DataFrame:
    """Distinct (entity) to (entity, target_path, target_schema, confidence, mapping_method, reason, suggestions).

    One pass over the entities: three left joins with the registry's small tables, and a ranking that is evaluated
    only for what these left over. Entities under the threshold get a null path, a reason and up to three suggestions.
    """
    low, hit = F.lower("entity"), F.struct("schema_id", "path")
    o = override_targets(registry, default_schema).select(F.col("entity_lower").alias("__ol"), hit.alias("o"))
    x = field_keys(registry.fields).select(F.col("key").alias("__xk"), hit.alias("x"))
    s = synonym_targets(registry).select(F.col("entity_lower").alias("__sl"), hit.alias("s"))
    rows = entities.join(o, low == F.col("__ol"), "left").join(x, entity_key(F.col("entity")) == F.col("__xk"), "left").join(s,
        low == F.col("__sl"), "left").crossJoin(_field_row(registry, embed))
    rows = rows.select("entity", "o", "x", "s", F.coalesce("o", "x", "s").alias("found"),
        F.when(F.coalesce("o", "x", "s").isNull(), _top(F.col("entity"), SUGGESTIONS, embed)).alias("top"))
    best = F.element_at("top", 1)
    good = F.coalesce(F.col("found").isNull() & (F.size("top") > 0) & (F.get("top", F.lit(0))["similarity"] >= threshold), F.lit(False))
    lost = F.col("found").isNull() & ~good
    near = F.transform("top", lambda f: F.struct(F.concat(f["schema_id"], F.lit(":"), f["path"]).alias("target_path"),
            F.greatest(f["similarity"], F.lit(0.0)).alias("confidence")))
    return rows.select(
        "entity", F.when(good, best["path"]).otherwise(F.col("found.path")).alias("target_path"),
            F.when(good, best["schema_id"]).otherwise(F.col("found.schema_id")).alias("target_schema"),
        F.when(good, F.least(F.lit(1.0), best["similarity"])).when(F.col("o").isNotNull(), OVERRIDE).when(F.col("x").isNotNull(),
                EXACT).when(F.col("s").isNotNull(), SYNONYM).alias("confidence"),
        F.when(good, "semantic").when(F.col("o").isNotNull(), "manual").when(F.col("x").isNotNull(), "exact").when(F.col("s").isNotNull(),
                "synonym").alias("mapping_method"),
        F.when(lost, f"no field reaches similarity {threshold}").alias("reason"), F.when(lost, near).alias("suggestions"),
    )


def mentions(parsed: DataFrame) -> DataFrame:
    """(clause_id, source_role, role_ord, entity): actor, object and the first three words of the trigger."""
    of = lambda role, n, entity: F.struct(F.lit(role).alias("source_role"), F.lit(n).alias("role_ord"), entity.alias("entity"))
    every = F.array(of("actor", 0, F.col("actor")), of("object", 1, F.col("object")), of("condition_subject", 2, first_words(F.col("trigger"), 3)))
    return parsed.select("clause_id", F.explode(F.filter(every, lambda m: F.coalesce(m["entity"], F.lit("")) != "")).alias("m")).select("clause_id", "m.*")


def _small(table: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """table, stored; marked for broadcast if it has `most` rows and its files `most_bytes` at most."""
    table = stored(table, "entities")
    return F.broadcast(table) if expected_bytes(table) <= most_bytes and table.count() <= most else table


def map_mentions(found: DataFrame, registry: Registry, threshold: float = THRESHOLD, default_schema: str = "default", embed=hash_embedding) -> DataFrame:
    """mentions with the mapping of their entities."""
    return found.join(_small(map_entities(found.select("entity").distinct(), registry, threshold, default_schema, embed)), "entity")


def _entities_of_roles() -> dict[str, Column]:
    """A clause's entity of each role, null for none."""
    of_role = {"actor": F.col("actor"), "object": F.col("object"), "condition_subject": first_words(F.col("trigger"), 3)}
    return {role: F.nullif(F.coalesce(e, F.lit("")), F.lit("")) for role, e in of_role.items()}


def clause_hits(parsed: DataFrame, registry: Registry, threshold: float = THRESHOLD, default_schema: str = "default", embed=hash_embedding) -> DataFrame:
    """The mappings of the distinct entities of parsed clauses, stored."""
    names = parsed.select(F.explode(F.array(*_entities_of_roles().values())).alias("entity")).where("entity IS NOT NULL").distinct()
    return _small(map_entities(names, registry, threshold, default_schema, embed))


def map_clauses(parsed: DataFrame, registry: Registry, threshold: float = THRESHOLD, default_schema: str = "default", embed=hash_embedding,
    hits: DataFrame | None = None) -> DataFrame:
    """Parsed clauses with mapped and unmapped entities and mapping_status; clauses without mentions are complete.

    Each distinct entity is mapped once; then a clause finds the mappings of its two or three mentions beside its own
    row. parsed is read twice, so it should be stored where it is costly. hits: what clause_hits gave for these clauses.
    """
    if hits is None:
        hits = clause_hits(parsed, registry, threshold, default_schema, embed)
    rows, entity = parsed, _entities_of_roles()
    for n, (role, e) in enumerate(entity.items()):
        own = hits.select(F.col("entity").alias(f"__e{n}"), F.struct(F.lit(n).alias("role_ord"), F.lit(role).alias("source_role"), "*").alias(f"__m{n}"))
        rows = rows.join(own, e == F.col(f"__e{n}"), "left").drop(f"__e{n}")
    found = F.array_compact(F.array(*[F.col(f"__m{n}") for n in range(len(entity))]))
    hit = lambda m: m["target_path"].isNotNull()
    lost = lambda m: m["target_path"].isNull() & (m["source_role"] != "condition_subject")
    part = lambda m, *names: F.struct(*[(m["entity"] if c == "source_entity" else m[c]).alias(c) for c in names])
    rows = rows.withColumn("__found", found).withColumns({
        "mapped_entities": F.transform(F.filter("__found", hit),
                lambda m: part(m, "role_ord", "source_role", "source_entity", "target_path", "target_schema", "confidence",
                    "mapping_method")),
        "unmapped_entities": F.transform(F.filter("__found", lost), lambda m: part(m, "role_ord", "source_role", "entity", "reason", "suggestions")),
    })
    low = F.exists("mapped_entities", lambda m: m["confidence"] < REVIEW_BELOW)
    status = F.when((F.size("unmapped_entities") == 0) & low, "needs_review").when(F.size("unmapped_entities") == 0,
        "complete").when(F.size("mapped_entities") > 0, "partial").otherwise("needs_review")
    return rows.withColumn("mapping_status", status).drop("__found", *[f"__m{n}" for n in range(len(entity))])


def status_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("mapping_status").agg(F.count("*").alias("n"))


def _vectors(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each length; a null vector or one with a null has no length."""
    column = table.column("v").combine_chunks()
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, owner = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    starts, own = np.cumsum(sizes) - sizes, sizes.copy()
    own[owner[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = 0
    found = [(size, np.flatnonzero(own == size)) for size in np.unique(own)]
    return [(rows, values[starts[rows][:, None] + np.arange(size)]) for size, rows in found]


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round does; what may be a tie is judged by its shortest decimal form."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    unit = Decimal(1).scaleb(-digits)
    for n in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[n] = float(Decimal(repr(float(x[n]))).quantize(unit, ROUND_HALF_UP))
    return out


def _best_of_block(q: pa.Table, i: pa.Table, k: int, digits: int) -> pa.Table:
    """The k best items of each query of one pair of blocks."""
    order = pc.sort_indices(i.column("item_id"), null_placement="at_start").to_numpy()
    i, found = i.take(order), []
    items = [(rows, m, np.sqrt((m * m).sum(axis=1))) for rows, m in _vectors(i)]
    for q_rows, q_m in _vectors(q):
        for low in range(0, len(q_rows), QUERY_SLICE):
            rows, m = q_rows[low : low + QUERY_SLICE], q_m[low : low + QUERY_SLICE]
            near, size = np.zeros((len(rows), i.num_rows)), np.sqrt((m * m).sum(axis=1))
            for i_rows, i_m, i_size in items:
                n, length = min(m.shape[1], i_m.shape[1]), size[:, None] * i_size[None, :]
                with np.errstate(all="ignore"):
                    cos = (m[:, :n] @ i_m[:, :n].T) / length
                near[:, i_rows] = np.where(length == 0, 0.0, np.where(cos < 1, cos, 1.0))
            last = np.partition(near, -k, axis=1)[:, -k] if k < i.num_rows else np.full(len(rows), -np.inf)
            at, item = np.nonzero(near >= (last - 2 * 10.0**-digits)[:, None])  # what rounding may make equal to the last
            rounded = _half_up(near[at, item], digits)
            sorted_ = np.lexsort((item, -rounded, at))
            at, item, rounded = at[sorted_], item[sorted_], rounded[sorted_]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((rows[at[keep]], item[keep], rounded[keep]))
    at, item, near = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, dtype=np.int64) for n in range(3))
    return pa.table({"query_id": q.column("query_id").take(pa.array(at)), "item_id": i.column("item_id").take(pa.array(item)), "similarity": pa.array(near, pa.float64())})


def top_k(queries: DataFrame, items: DataFrame, k: int, embedding: str = "embedding", query_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK, digits: int = 9) -> DataFrame:
    """(query_id, item_id, similarity, rank) of the k items nearest to each query by cosine, rounded to `digits`, ties by item_id.

    Queries and items are cut into blocks of about query_block and item_block rows by hash, and each pair of blocks is
    multiplied by itself as matrices: no side goes through the driver, and neither may be bounded. A pair of blocks hands on the k
    best of each query, so the merge gets k rows a query and item block, never all pairs. The work is that of all pairs.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_q, n_i = blocks(queries, query_block), blocks(items, item_block)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", F.col(embedding).alias("v"), block("query_id", n_q).alias("q_block"), every(n_i).alias("i_block"))
    i = items.select("item_id", F.col(embedding).alias("v"), block("item_id", n_i).alias("i_block"), every(n_q).alias("q_block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_block(left, right, k, digits)

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double"
    of_block = q.groupBy("q_block", "i_block").cogroup(i.groupBy("q_block", "i_block")).applyInArrow(run, kinds)
    order = [F.desc("similarity"), F.col("item_id")]
    best = of_block.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return best.where(F.col("rank") <= k)
