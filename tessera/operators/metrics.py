"""Benchmark reports: summaries, comparisons, acceptance, retries, recall, and table digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import selection


def _six(c: Column) -> Column:
    return F.round(c, 6)


def summarise(results: DataFrame, metrics: list[str], stable: list[str]) -> DataFrame:
    """One row per ``sample, variant``: outcome counts and rates, and of each metric mean, median,
    95th percentile, maximum and sum over successful runs; of stable ones deviation and variation.  There are few samples
    and variants however many runs there are, so percentiles come from ``selection``, not from a group in one task."""
    ok = (F.col("status") == "ok") & (F.col("report_status") == "ok")
    finite = lambda m: F.when(ok & ~F.isnan(F.col(m).cast("double")) & (F.abs(F.col(m).cast("double")) != float("inf")), F.col(m).cast("double"))
    aggs = [F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("successes"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("timeout", "timeouts"), ("interrupted", "interruptions"), ("runner_error", "runner_errors"))]]
    for m in metrics:
        v = finite(m)
        aggs += [_six(F.avg(v)).alias(f"{m}_mean"), _six(F.max(v)).alias(f"{m}_max"), _six(F.sum(v)).alias(f"{m}_sum")]
    for m in stable:
        v = finite(m)
        aggs += [_six(F.when(F.count(v) >= 2, F.stddev_pop(v))).alias(f"{m}_stdev"), _six(F.when(F.count(v) >= 2, F.try_divide(F.stddev_pop(v), F.avg(v)))).alias(f"{m}_cv")]
    out = results.groupBy("sample", "variant").agg(*aggs)
    ranks = selection.percentiles(results.select("sample", "variant", *[finite(m).alias(m) for m in metrics]), ["sample", "variant"], metrics, [0.5, 0.95])
    at = lambda m, q: _six(F.max(F.when((F.col("name") == m) & (F.col("fraction") == q), F.col("value")))).alias(f"{m}_p{round(100 * q)}")
    ranks = ranks.groupBy(F.col("sample").alias("of_sample"), F.col("variant").alias("of_variant")).agg(*[at(m, q) for m in metrics for q in (0.5, 0.95)])
    out = out.join(ranks, F.col("sample").eqNullSafe(F.col("of_sample")) & F.col("variant").eqNullSafe(F.col("of_variant")), "left").drop("of_sample", "of_variant")
    return out.withColumns({
        "failures": F.col("runs") - F.col("successes") - F.col("timeouts") - F.col("interruptions") - F.col("runner_errors"), "success_rate": F.col("successes") / F.col("runs"),
        "timeout_rate": F.col("timeouts") / F.col("runs"), "failure_rate": (F.col("runs") - F.col("successes")) / F.col("runs")})


def compare(summary: DataFrame, baseline: str, prefix: str, speed: str, cost: str, deltas: list[str]) -> DataFrame:
    """``sample, variant, speedup, reduction_pct`` and deltas of means against the baseline variant
    of the same sample, for variants that start with ``prefix``."""
    base = summary.where(F.col("variant") == baseline).alias("b")
    mine = summary.where(F.col("variant").startswith(prefix) & (F.col("variant") != baseline)).alias("m")
    s, c = f"{speed}_mean", f"{cost}_mean"
    return mine.join(base, "sample").select(
        "sample", "m.variant", _six(F.when(F.col(f"m.{s}") > 0, F.col(f"b.{s}") / F.col(f"m.{s}"))).alias("speedup"),
        F.round(F.when(F.col(f"b.{c}") > 0, (F.col(f"b.{c}") - F.col(f"m.{c}")) / F.col(f"b.{c}") * 100), 4).alias("reduction_pct"),
        *[_six(F.col(f"m.{d}_mean") - F.col(f"b.{d}_mean")).alias(f"{d}_delta") for d in deltas])


def acceptance(summary: DataFrame, with_analyst: bool = False) -> DataFrame:
    """``sample, variant, passed`` and each check of a run summary."""
    have = set(summary.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    checks = {
        "success_rate_100": F.coalesce(col("success_rate"), F.lit(0.0)) >= 1.0, "no_timeouts": F.coalesce(col("timeouts"), F.lit(0)) == 0,
        "no_failed_api_calls": F.coalesce(col("failed_api_calls_max"), F.lit(0.0)) <= 0.0,
        "retry_recovery_complete": (F.coalesce(col("usage_retry_groups_sum"), F.lit(0.0)) <= 0) | ((F.coalesce(col("usage_failed_retry_groups_sum"), F.lit(0.0)) <= 0) & (F.coalesce(col("usage_recovered_retry_groups_sum"), F.lit(0.0)) >= col("usage_retry_groups_sum")))}
    if with_analyst:
        checks["llm_interaction_success_100"] = F.coalesce(col("llm_interaction_success_rate_mean"), F.lit(0.0)) >= 1.0
    rows = summary.select("sample", "variant", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return rows.withColumn("passed", passed)


def attempt_groups(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``records`` with ``grp``: a group starts at an attempt of 1 or less."""
    starts = F.when(F.coalesce("attempt", F.lit(1)) <= 1, 1).otherwise(0)
    return records.withColumn("grp", F.sum(starts).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def recovery(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per ``by``: attempts, interactions, retried, recovered and failed groups, budget expansions."""
    rows = attempt_groups(records, by, order)
    seq = F.struct(*order)
    groups = rows.groupBy(*by, "grp").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("attempt", F.lit(1))).alias("most"), F.max_by("status", seq).alias("last"),
        F.min_by("budget", F.when(F.col("budget") > 0, seq)).alias("first_budget"), F.max("budget").alias("max_budget"), F.count_if(F.col("budget") > 0).alias("budgets"))
    retried = (F.col("n") > 1) | (F.col("most") > 1)
    return groups.groupBy(*by).agg(
        F.sum("n").alias("attempts"), F.count(F.lit(1)).alias("interactions"), F.count_if(retried).alias("retried"), F.count_if(retried & (F.col("last") == "ok")).alias("recovered"),
        F.count_if(retried & ~(F.coalesce("last", F.lit("")) == "ok")).alias("failed"), F.count_if(retried & (F.col("budgets") >= 2) & (F.col("max_budget") > F.col("first_budget"))).alias("expansions"))


def run_matrix(samples: DataFrame, engines: DataFrame, budgets: DataFrame, repeats: int) -> DataFrame:
    """Every run of a campaign.  The inputs are a manifest's few rows, not data."""
    runs = samples.crossJoin(engines).crossJoin(budgets).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return runs.dropDuplicates()


def recall(found: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per ``keys``: how many expected items were found, and the share."""
    hits = found.select(*keys, item).distinct().withColumn("hit", F.lit(1))
    j = expected.select(*keys, item).distinct().join(hits, [*keys, item], "left")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"), _six(F.count("hit") / F.count(F.lit(1))).alias("recall"))


def path_recall(paths: DataFrame, expected: DataFrame) -> DataFrame:
    """Per sample the share of expected subsequences (``sample, expected``) that some path
    (``sample, path``) holds in order."""
    j = expected.join(paths, "sample", "left").withColumn("hit", F.coalesce(T.is_subsequence(F.col("expected"), F.col("path")), F.lit(False)))
    one = j.groupBy("sample", "expected").agg(F.max("hit").alias("hit"))
    return one.groupBy("sample").agg(F.count(F.lit(1)).alias("expected_paths"), _six(F.avg(F.col("hit").cast("double"))).alias("path_recall"))


def chunked_digest(rows: DataFrame, columns: list[str], chunks: int = 1024) -> DataFrame:
    """``rows, digest`` of a table as a multiset, whatever its order: SHA-256 of every row, summed
    by chunk of the digest, and one digest over the chunks' sums.  Equal tables have equal digests."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    halves = [F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)") for k in (1, 16, 31)]
    part = rows.select(F.pmod(F.conv(F.substring(h, 49, 8), 16, 10).cast("bigint"), F.lit(chunks)).alias("chunk"), *[x.alias(f"h{i}") for i, x in enumerate(halves)])
    sums = part.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(3)])
    line = F.concat_ws(":", "chunk", "n", "h0", "h1", "h2")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def profile(tables: dict[str, tuple[DataFrame, list[str]]], chunks: int = 1024) -> DataFrame:
    """``metric, rows, digest`` of each table over the columns given."""
    out = None
    for name, (df, columns) in tables.items():
        one = chunked_digest(df, columns, chunks).select(F.lit(name).alias("metric"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def diff(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Metrics whose rows or digests differ; a missing one has -1 rows and no digest."""
    c, r = current.alias("c"), rebuilt.alias("r")
    j = c.join(r, "metric", "full_outer").select("metric", F.coalesce("c.rows", F.lit(-1)).alias("rows_current"), F.coalesce("r.rows", F.lit(-1)).alias("rows_rebuilt"), F.coalesce("c.digest", F.lit("")).alias("digest_current"), F.coalesce("r.digest", F.lit("")).alias("digest_rebuilt"))
    return j.where("rows_current != rows_rebuilt or digest_current != digest_rebuilt")


def tier(functions: Column, small: int = 800, medium: int = 8000) -> Column:
    return F.when(functions < small, "small").when(functions < medium, "medium").otherwise("large")


def usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token sums per ``by``; a missing total is the sum of its parts."""
    total = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return rows.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


def numeric(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a finite number in ``column``."""
    value = F.col(column).cast("double")
    return rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def flat_usage(reports: DataFrame, by: list[str], tree: str = "usage") -> DataFrame:
    """``<by>, prompt_tokens, completion_tokens, total_tokens`` summed over a report's steps (``tree``: an array of structs
    with these numbers and an array ``attempts`` of the same): a step's own numbers stand for its attempts'."""
    step = reports.select(*by, F.explode(tree).alias("s"))
    own = F.coalesce("s.prompt_tokens", "s.completion_tokens", "s.total_tokens").isNotNull()
    records = F.when(own, F.array(F.struct("s.prompt_tokens", "s.completion_tokens", "s.total_tokens"))).otherwise(F.transform("s.attempts", lambda x: F.struct(x["prompt_tokens"], x["completion_tokens"], x["total_tokens"])))
    flat = step.select(*by, F.explode(records).alias("r")).select(*by, F.col("r.prompt_tokens").alias("p"), F.col("r.completion_tokens").alias("c"), F.col("r.total_tokens").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return flat.groupBy(*by).agg(F.sum(zero("p")).alias("prompt_tokens"), F.sum(zero("c")).alias("completion_tokens"), F.sum(F.coalesce("t", zero("p") + zero("c"))).alias("total_tokens"))


def focus(current: DataFrame, rebuilt: DataFrame, active: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric`` with the rows of three profiles, and which of the first two the active one agrees with."""
    side = lambda df, name: df.where(F.col("metric").isin(*metrics)).select("metric", F.struct("rows", "digest").alias(name))
    j = side(current, "c").join(side(rebuilt, "r"), "metric", "full_outer").join(side(active, "a"), "metric", "full_outer")
    same = F.when(F.col("a").eqNullSafe(F.col("c")) & F.col("a").eqNullSafe(F.col("r")), "both").when(F.col("a").eqNullSafe(F.col("c")), "current").when(F.col("a").eqNullSafe(F.col("r")), "rebuilt").otherwise("neither")
    return j.select("metric", F.col("c.rows").alias("rows_current"), F.col("r.rows").alias("rows_rebuilt"), F.col("a.rows").alias("rows_active"), same.alias("active_is"))
