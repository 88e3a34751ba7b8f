"""Incremental analysis, caches, reviews and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_states(now: DataFrame, before: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """now with state new, changed or cached against an earlier listing."""
    old = before.select(key, *[F.col(c).alias(f"_{c}") for c in signature], F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in signature:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    state = F.when(F.col("_known").isNull(), "new").when(same, "cached").otherwise("changed")
    return now.join(old, key, "left").withColumn("state", state).select(*now.columns, "state")


def cache_lookup(now: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """now with the cache's payload where path, configuration and signature agree, else null."""
    return now.join(cache, keys, "left")


def cacheable(results: DataFrame) -> DataFrame:
    """Results without an error and without a group in error."""
    return results.where("error is null").where(~F.exists("group_health", lambda h: h["status"] == "error")) if "group_health" in results.columns else results.where("error is null")


def config_hash(config: Column) -> Column:
    return F.substring(F.sha2(config, 256), 1, 32)


def latest_decisions(reviews: DataFrame, order: list[str]) -> DataFrame:
    """The latest decision of each file and the number of its decisions."""
    return reviews.groupBy("file").agg(F.max_by("decision", F.struct(*order)).alias("decision"), F.count("*").alias("n"))


def decision_counts(files: DataFrame, reviews: DataFrame, order: list[str], known: tuple[str, ...] = ("approved", "rejected", "undecided")) -> DataFrame:
    """Files by latest decision, `undecided` without one; known decisions are filled with zero."""
    own = files.select("file").distinct().join(latest_decisions(reviews, order), "file", "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    counts = own.groupBy("decision").agg(F.count("*").alias("n"))
    names = files.sparkSession.createDataFrame([(d,) for d in known], "decision string")
    return names.join(counts, "decision", "full_outer").na.fill(0, ["n"])


def exit_severity(codes: Column) -> Column:
    """The most severe exit code of a batch; severity order is 3, 1, 2, 0."""
    rank = F.when(codes == 3, 3).when(codes == 1, 2).when(codes == 2, 1).otherwise(0)
    return F.max_by(codes, rank)


def file_signature(size: Column, modified: Column) -> Column:
    """A file's version: its size and modification time in microseconds."""
    return F.concat_ws(":", size.cast("string"), F.unix_micros(modified).cast("string"))


def cache_key(path: Column, config: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\0"), config), 256)


def cache_update(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache after `fresh` rows that may be cached replace older ones of the same keys."""
    new = cacheable(fresh)
    return cache.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*cache.columns))


def review_history(reviews: DataFrame, order: list[str]) -> DataFrame:
    """Decisions of each file with their number from the first, and whether each is the latest."""
    w = Window.partitionBy("file").orderBy(*order)
    return reviews.withColumn("number", F.row_number().over(w)).withColumn("latest", F.lead("decision").over(w).isNull() & F.lead(order[-1]).over(w).isNull())


def files_by_decision(files: DataFrame, reviews: DataFrame, order: list[str], decision: str) -> DataFrame:
    """Files whose latest decision is `decision`; undecided: those without one."""
    own = files.select("file").distinct().join(latest_decisions(reviews, order), "file", "left")
    return own.where(F.coalesce("decision", F.lit("undecided")) == decision).select("file")


#: Exit codes: fine, gate failed, invalid input, analysis failed (fixed values).
EXIT_OK, EXIT_GATE, EXIT_INPUT, EXIT_ANALYSIS = 0, 1, 2, 3


def exit_code(results: DataFrame, load_error: Column, gate_failed: Column) -> DataFrame:
    """One row, code: 2 if rows have errors and all are load errors, 3 if others are among them, else 1 if a gate failed, else 0."""
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    code = F.when(F.count_if(bad & ~load_error) > 0, EXIT_ANALYSIS).when(F.count_if(bad) > 0, EXIT_INPUT).when(F.count_if(gate_failed) > 0, EXIT_GATE).otherwise(EXIT_OK)
    return results.agg(code.alias("code"))


def readiness(gates: DataFrame) -> DataFrame:
    """One row over gates (name, passed): ready if all passed, and the names of the failed ones, sorted."""
    ok = F.coalesce("passed", F.lit(False))
    return gates.agg(F.coalesce(F.every(ok), F.lit(False)).alias("ready"), F.sort_array(F.collect_list(F.when(~ok, F.col("name")))).alias("failed"))  # a row a gate


def asset_lock(files: DataFrame) -> DataFrame:
    """path, size and SHA-256 of binary files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_lock(lock: DataFrame, now: DataFrame) -> DataFrame:
    """path and status ok, changed, missing or unexpected of a lock against files as they are."""
    j = lock.select("path", F.col("sha256").alias("_old")).join(now.select("path", F.col("sha256").alias("_new")), "path", "full_outer")
    return j.select("path", F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "unexpected").when(F.col("_old") == F.col("_new"), "ok").otherwise("changed").alias("status"))


def compatible(version: str, current: str) -> bool:
    """Whether a plug-in's API version runs on the current one: the same major number, and a minor one that is no higher."""
    try:
        (a, b), (c, d) = (tuple(int(x) for x in v.split(".")[:2]) for v in (version, current))
    except ValueError:
        return False
    return a == c and b <= d


def issues(reports: DataFrame, order: str) -> DataFrame:
    """path and message of what is wrong with report rows, numbered from 0 in `order` within a file as `$[i].field`, metrics as `$[i].metrics[j].field`."""
    at = F.concat(F.lit("$["), F.col(order).cast("string"), F.lit("]"))
    issue = lambda path, message: F.struct(path.alias("path"), F.lit(message).alias("message"))
    field = lambda name: F.concat(at, F.lit(f".{name}"))
    own = F.array(
        F.when(F.col("file").isNull() | (F.col("file") == ""), issue(field("file"), "required field is missing")),
        F.when(F.col("duration_s").isNull() | F.isnan("duration_s") | (F.col("duration_s") < 0), issue(field("duration_s"), "must be a number of 0 or more")),
        F.when(F.col("sample_rate").isNull() | (F.col("sample_rate") < 0), issue(field("sample_rate"), "must be a number of 0 or more")),
    )
    inner = lambda j, name: F.concat(at, F.lit(".metrics["), j.cast("string"), F.lit(f"].{name}"))
    each = F.flatten(F.transform("metrics", lambda m, j: F.array(F.when(m["name"].isNull() | (m["name"] == ""), issue(inner(j, "name"), "required field is missing")), F.when(m["grp"].isNull(), issue(inner(j, "grp"), "required field is missing")), F.when(F.isnan(m["value"]), issue(inner(j, "value"), "must be a finite number or null")))))
    return reports.select(F.inline(F.array_compact(F.concat(own, F.coalesce(each, F.array().cast("array<struct<path: string, message: string>>"))))))


REQUIRED = {"file": "string", "sample_rate": "int", "channels": "int", "duration_s": "double"}


def validate(reports: DataFrame, required: dict[str, str] = REQUIRED) -> DataFrame:
    """file and message of report rows whose required fields are missing, empty or negative."""
    checks = []
    for name, kind in required.items():
        if name not in reports.columns:
            checks.append(F.lit(f"{name}: required field is missing"))
            continue
        bad = F.col(name).isNull()
        if kind != "string":
            bad = bad | (F.col(name) < 0)
        checks.append(F.when(bad, f"{name}: required field is missing or invalid"))
    key = F.col("file") if "file" in reports.columns else F.lit(None).cast("string")
    return reports.select(key.alias("file"), F.explode(F.array_compact(F.array(*checks))).alias("message"))


SCHEMA_VERSION = "3.6"
#: Version -> the next one (fixed values); rows without a version are legacy.
NEXT_VERSION = {"legacy": "3.0", "1.0": "3.0", "2.0": "3.0", "3.0": "3.4", "3.1": "3.4", "3.2": "3.4", "3.3": "3.4", "3.4": "3.5", "3.5": "3.6"}
ALIASES = {"path": "file", "sample_rate_hz": "sample_rate"}


def version_chain(version: str, steps: dict[str, str] = NEXT_VERSION) -> list[str]:
    """The versions from `version` to the current one; a ValueError for one that is unknown or whose steps go in a circle."""
    chain = [version]
    while chain[-1] != SCHEMA_VERSION:
        after = steps.get(chain[-1])
        if after is None:
            raise ValueError(f"unsupported schema version {chain[-1]!r}; known: {', '.join(sorted(steps))}")
        if after in chain:
            raise ValueError(f"the migration of schema version {chain[-1]!r} does not advance")
        chain.append(after)
    return chain


def migrate(reports: DataFrame, steps: dict[str, str] = NEXT_VERSION) -> DataFrame:
    """Older report rows in the current shape; a row of an unknown version fails the job.

    Aliased fields get their names, missing columns their defaults, null numbers 0 and a status `ok` goes.
    """
    out = reports
    for old, new in ALIASES.items():
        if old in out.columns:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in out.columns else F.col(old)).drop(old)
    if "status" in out.columns:
        out = out.withColumn("status", F.when(F.col("status") != "ok", F.col("status")))
    version = F.coalesce(F.col("schema_version").cast("string"), F.lit("legacy")) if "schema_version" in out.columns else F.lit("legacy")
    for known in steps:
        version_chain(known, steps)
    old = version.isin(*steps, SCHEMA_VERSION)
    none = F.array().cast("array<string>")
    defaults = {"file": F.lit(""), "source_file": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "content_type": F.lit(None).cast("string"), "notes": none, "confidence_notes": none, "duration_s": F.lit(0.0), "sample_rate": F.lit(0), "channels": F.lit(0), "segment_index": F.lit(None).cast("int"), "tool_version": F.lit("unknown")}
    for name, default in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    stamped = F.when(old, F.lit(SCHEMA_VERSION)).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version "), version)))
    return out.withColumn("schema_version", stamped.cast("string"))
