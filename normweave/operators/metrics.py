"""Aggregation of metric observations (name, labels, value, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from normweave.sources.store import stored

#: Upper bounds of the histogram's buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def label_key(labels: Column) -> Column:
    """Labels as text, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def gauge_last(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by("value", F.struct(*order)).alias("last_value"))


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, parts: int = 256) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the group up to each row in order.

    No task takes a whole group: approximate percentiles of the first order column, from a sketch of bounded size,
    cut a group into `parts` ranges of like mass; sums of ranges give each range's offset, a window inside it the rest.
    Nulls of that column come first. rows are read three times, so they should be cheap or stored.
    """
    at = F.unix_micros(F.col(order[0]).cast("timestamp")) if rows.schema[order[0]].dataType.typeName().startswith("timestamp") else F.col(order[0])
    rows = rows.withColumn("__at", at)
    cuts = rows.groupBy(*by).agg(F.percentile_approx("__at", [k / parts for k in range(1, parts)], 4 * parts).alias("__cuts"))
    same = lambda left, right: [left[c].eqNullSafe(right[f"__k_{c}"]) for c in by]
    keyed = lambda df, *more: df.select(*[F.col(c).alias(f"__k_{c}") for c in by], *more)
    cuts = keyed(cuts, F.array_distinct("__cuts").alias("__cuts"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda _, k: k % 16 == 15))
    below = lambda c: c < F.col("__at")
    whole = F.size(F.filter("__coarse", below)) * 16  # these cuts lie below; then at most 16 are compared
    part = F.when(F.col("__at").isNull(), -1).otherwise(whole + F.size(F.filter(F.slice("__cuts", whole + 1, F.lit(16)), below)))
    rows = rows.join(cuts, same(rows, cuts)).withColumn("__part", part).select(*rows.columns, "__part")
    sums = rows.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # `parts` rows a group
    offsets = keyed(sums.withColumn("__offset", F.sum("__sum").over(before)), F.col("__part").alias("__k_part"), "__offset")
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__inside", F.sum(value).over(inside))
    rows = rows.join(offsets, [*same(rows, offsets), rows["__part"] == offsets["__k_part"]])
    total = F.when(F.col("__offset").isNull(), F.col("__inside")).when(F.col("__inside").isNull(),
        F.col("__offset")).otherwise(F.col("__offset") + F.col("__inside"))
    return rows.withColumn(out, total).drop("__at", "__part", "__inside", "__offset", "__k_part", *[f"__k_{c}" for c in by])


def gauge_running(events: DataFrame, by: list[str], order: list[str], delta: str = "value") -> DataFrame:
    """Add `running`: the gauge after each increment or decrement."""
    return running_total(events, by, order, delta, "running")


def distinct_sorted(events: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, __v, __c, __upto): each group's distinct values, their counts and the counts up to them: equal values meet
    before the shuffle, and no task sorts a whole group."""
    per = events.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    per = stored(per, "distinct-values")  # running_total reads it three times
    return running_total(per, by, ["__v"], "__c", "__upto")


def histogram_stats(events: DataFrame, by: list[str], value: str = "value", guard: bool = True) -> DataFrame:
    """count, sum, avg, min, max and the values at places floor(n * p) for p50, p95, p99; with guard, p95 needs 20
    values and p99 a hundred, else they are the greatest. Ranks come from counts of equal values, not from sorting
    whole groups in memory."""
    sums = events.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.sum(value).alias("sum"),
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    ranked = distinct_sorted(events, by, value).join(sums.select(*by, "count"), by)
    pick = lambda p, least: F.min(F.when(F.col("__upto") > F.when(F.col("count") >= (least if guard else 0),
                F.least(F.floor(F.col("count") * p), F.col("count") - 1)).otherwise(F.col("count") - 1), F.col("__v")))
    places = ranked.groupBy(*by).agg(pick(0.5, 0).alias("p50"), pick(0.95, 20).alias("p95"), pick(0.99, 100).alias("p99"))
    return sums.join(places, by)


def buckets(events: DataFrame, by: list[str], value: str = "value", bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, le, cumulative): one aggregation of conditional sums, then a row for each bound and +Inf."""
    columns = [F.count_if(F.col(value) <= b).alias(f"b{n}") for n, b in enumerate(bounds)]
    wide = events.groupBy(*by).agg(*columns, F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{n}").alias("cumulative")) for n, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("cumulative")))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def load_stats(requests: DataFrame, by: list[str], value: str = "value", failed: Column | None = None) -> DataFrame:
    """Response statistics of a load run by endpoint, with the sample deviation, the median and unguarded p90, p95, p99."""
    sums = requests.groupBy(*by).agg(
        F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"),
        (F.count_if(failed) if failed is not None else F.lit(0).cast("long")).alias("failures"),
    )
    ranked = distinct_sorted(requests, by, value).join(sums.select(*by, "count"), by)
    pick = lambda p: F.min(F.when(F.col("__upto") > F.least(F.floor(F.col("count") * p), F.col("count") - 1), F.col("__v")))
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    median = (at(F.floor((F.col("count") - 1) / 2)) + at(F.floor(F.col("count") / 2))) / 2
    places = ranked.groupBy(*by).agg(median.alias("median"), pick(0.9).alias("p90"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))
    return sums.join(places, by).withColumn("passed", F.col("failures") <= 0.1 * F.col("count"))


def window_stats(requests: DataFrame, window: Column, by: list[str], value: str = "value", failed: Column | None = None) -> DataFrame:
    """(start, end, *by, count, failures, success_rate, per_second, mean, stdev, min, max) of each window of event time.

    `window` is F.window or F.session_window over a timestamp. All aggregates are sums, so the same plan runs over a table and,
    with a watermark, over a stream. per_second divides by the window's length, a session's with its closing gap; a null
    timestamp is in no window; a value that is null counts as a request without a time.
    """
    lost = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    rows = requests.groupBy(window.alias("w"), *by).agg(F.count("*").alias("count"), F.count_if(lost).alias("failures"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1_000_000
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count", "failures",
        (1 - F.col("failures") / F.col("count")).alias("success_rate"), (F.col("count") / seconds).alias("per_second"), "mean", "stdev", "min", "max")


#: Accuracy of the quantile sketches: the error of a rank falls with it, about 1.3 % at 200, 0.3 % at 1000.
SKETCH_K = 1000


def window_sketches(requests: DataFrame, window: Column, by: list[str], value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """(start, end, *by, sketch): a quantile sketch of bounded size a window and group. Sketches of any windows merge, so
    longer spans need no second look at the requests."""
    rows = requests.where(F.col(value).isNotNull()).groupBy(window.alias("w"), *by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "sketch")


def merged_quantiles(sketches: DataFrame, by: list[str], places: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """(*by, count, p50, p90, …) of the merged sketches; each quantile's rank is within the sketch's error."""
    rows = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("s"))
    names = [f"p{p * 100:g}".replace(".", "_") for p in places]
    return rows.select(*by, F.kll_sketch_get_n_double("s").alias("count"), *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(n) for p, n in zip(places, names, strict=True)])


#: Names and kinds of the metrics that the engine's jobs record, after the prefix; the help texts are our own.
DEFAULTS = (
    ("requests_total", "counter", "Calls of the interface"), ("request_duration_seconds", "histogram", "Time that a call took, in seconds"),
        ("request_errors_total", "counter", "Calls that ended in an error"),
    ("documents_processed_total", "counter", "Documents that went through the engine"),
        ("document_processing_duration_seconds", "histogram", "Time from a document to its rules, in seconds"),
        ("documents_in_progress", "gauge", "Documents under way"),
    ("clauses_extracted_total", "counter", "Clauses found in all documents"),
        ("clauses_per_document", "histogram", "Clauses that one document gave"),
        ("artifacts_generated_total", "counter", "Rule artifacts rendered"),
    ("compilation_duration_seconds", "histogram", "Time that rendering took, in seconds"),
        ("validations_total", "counter", "Artifacts that were judged"),
        ("validation_failures_total", "counter", "Artifacts that were judged and failed"),
    ("llm_requests_total", "counter", "Calls of a language model"),
        ("llm_request_duration_seconds", "histogram", "Time that a language model took to answer, in seconds"),
        ("llm_tokens_used_total", "counter", "Tokens that language models read and wrote"),
        ("active_connections", "gauge", "Connections that are open"),
)


def default_metrics(spark: SparkSession, prefix: str = "normweave_") -> DataFrame:
    """(name, kind, help)"""
    return spark.createDataFrame([(prefix + n, k, h) for n, k, h in DEFAULTS], "name string, kind string, help string")


def observed(events: DataFrame) -> DataFrame:
    """events (name, kind, labels map, value, ts) to (name, kind, label_key, labels, total, last, count, stats, buckets):
    a row for each metric and its labels; counters have a total, gauges a last value, histograms statistics."""
    e = events.withColumn("label_key", label_key("labels"))
    by = ["name", "kind", "label_key"]
    base = e.groupBy(*by).agg(F.any_value("labels").alias("labels"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last"),
        F.count("value").alias("count"))
    own = e.where("kind = 'histogram'")
    stats = histogram_stats(own, by).select(*by, F.struct("count", "sum", "avg", "min", "max", "p50", "p95", "p99").alias("stats"))
    bounds = buckets(own, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("le") == "+Inf",
                        float("inf")).otherwise(F.col("le").cast("double")).alias("bound"), "le", "cumulative"))).alias("buckets"))
    return base.join(stats, by, "left").join(bounds, by, "left")


def _label_pairs(names: Column, value) -> Column:
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit('="'), escaped(value(n)), F.lit('"'))), ",")


def prometheus(metrics: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, ord, label_key, line): the text format of all metrics (name, kind, help) with what `observed` found, to be
    written in this order: HELP and TYPE of each metric, then its samples."""
    pairs = _label_pairs(F.array_sort(F.map_keys("labels")), lambda n: F.element_at("labels", n))
    braces = lambda inner: F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise("")
    line = lambda suffix, inner, value: F.concat(F.col("name"), F.lit(suffix), braces(inner), F.lit(" "), value.cast("string"))
    with_le = lambda le: F.concat_ws(",", F.nullif(pairs, F.lit("")), F.concat(F.lit('le="'), le, F.lit('"')))
    histogram = F.concat(F.transform("buckets", lambda b: line("_bucket", with_le(b["le"]), b["cumulative"])),
        F.array(line("_sum", pairs, F.col("stats.sum")), line("_count", pairs, F.col("count"))))
    lines = F.when(F.col("kind") == "histogram", histogram).when(F.col("kind") == "gauge",
        F.array(line("", pairs, F.col("last")))).otherwise(F.array(line("", pairs, F.col("total"))))
    samples = seen.select("name", "label_key", F.posexplode(lines).alias("pos", "line")).select("name", (F.col("pos") + 2).alias("ord"), "label_key", "line")
    heads = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))
    return metrics.select("name", F.posexplode(heads).alias("ord", "line")).select("name", "ord", F.lit("").alias("label_key"), "line").unionByName(samples)


def metrics_json(metrics: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, json): each metric as an object with its type, description and values by labels; a metric has few labels."""
    value = F.when(F.col("kind") == "histogram", F.to_json("stats")).when(F.col("kind") == "gauge",
        F.col("last").cast("string")).otherwise(F.col("total").cast("string"))
    values = seen.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("label_key", value.alias("value")))).alias("v"))
    entry = F.transform("v", lambda x: F.concat(F.regexp_replace(F.to_json(F.struct(x["label_key"].alias("k"))), r'^\{"k":|\}$', ""), F.lit(":"), x["value"]))
    head = F.regexp_replace(F.to_json(F.struct(F.col("kind").alias("type"), F.col("help").alias("description"))), r"\}$", "")
    return metrics.join(values, "name", "left").select("name",
        F.concat(head, F.lit(',"values":{'), F.coalesce(F.array_join(entry, ","), F.lit("")), F.lit("}}")).alias("json"))
