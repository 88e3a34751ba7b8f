"""Threshold rules over metric facts. Rules are a small table that is broadcast (one row a rule, written by hand)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import load_rule_file


def normal(name: Column) -> Column:
    """Names match without regard to case and runs of white space."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def violated(value: Column) -> Column:
    """Missing values break a rule that requires one; others break equals, or lie below low or above high."""
    outside = (F.col("low").isNotNull() & (value < F.col("low"))) | (F.col("high").isNotNull() & (value > F.col("high")))
    return F.when(value.isNull(), F.col("require_present")).otherwise((F.col("equals").isNotNull() & (value != F.col("equals"))) | outside)


def general(value: Column) -> Column:
    """A number without trailing zeros, as `%g` prints magnitudes from 1e-4 to 1e6 of six digits or fewer."""
    return F.regexp_replace(F.regexp_replace(F.round(value, 6).cast("decimal(28,6)").cast("string"), "0+$", ""), r"\.$", "")


def default_message(name: str = "name") -> Column:
    """What the metric (column `name`) should be by its rule, or that it violated a rule without bounds."""
    bounds = F.concat_ws(" and ", F.concat(F.lit(">= "), general(F.col("low"))), F.concat(F.lit("<= "), general(F.col("high"))), F.concat(F.lit("== "), F.col("equals").cast("string")))
    return F.when(bounds == "", F.concat(F.col(name), F.lit(" violated threshold rule"))).otherwise(F.concat(F.col(name), F.lit(" should be "), bounds))


def matches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts with each rule whose metric, and group if it has one, they match."""
    f = facts.withColumn("_key", normal(F.col("name")))
    r = rules.withColumnRenamed("grp", "rule_grp").withColumn("_key", normal(F.col("metric")))
    both = f.join(F.broadcast(r), "_key")
    return both.where(F.col("rule_grp").isNull() | (normal(F.col("grp")) == normal(F.col("rule_grp")))).drop("_key")


def violations(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """file, rule_id, metric, grp, actual, message of facts that break a rule."""
    hit = matches(facts, rules).where(violated(F.col("value")))
    return hit.select("file", "rule_id", F.col("name").alias("metric"), "grp", F.col("value").alias("actual"), F.coalesce("message", default_message()).alias("message"))


def required_missing(results: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Results without any fact for a rule that requires one: every result with each such rule, less those that match."""
    wanted = results.select("file").distinct().join(F.broadcast(rules.where("require_present")))
    there = matches(facts, rules.where("require_present")).select("file", "rule_id").distinct()
    left = wanted.join(there, ["file", "rule_id"], "left_anti")
    return left.select("file", "rule_id", "metric", F.coalesce("grp", F.lit("")).alias("grp"), F.coalesce("message", F.concat("metric", F.lit(" is required but missing"))).alias("message"))


def unmatched(facts: DataFrame, rules: DataFrame, behavior: str = "violation") -> DataFrame:
    """Rules that match no fact at all, as rows of the file `*` with `kind` violation or note; "ignore" gives none, "error" raises."""
    if behavior not in {"ignore", "note", "violation", "error"}:
        raise ValueError("behavior must be ignore, note, violation or error")
    left = rules.join(matches(facts, rules).select("rule_id").distinct(), "rule_id", "left_anti")
    if behavior == "error" and (names := sorted({r["metric"] for r in left.collect()})):  # a row a rule at most
        raise ValueError(f"rules name unknown metrics: {', '.join(names)}")
    rows = left.select(F.lit("*").alias("file"), "rule_id", "metric", F.coalesce("grp", F.lit("")).alias("grp"), F.concat(F.lit("Rule metric did not match any analyzed metric: "), "metric").alias("message"))
    return rows.withColumn("kind", F.lit(behavior)) if behavior != "ignore" else rows.withColumn("kind", F.lit(None).cast("string")).where(F.lit(False))


def apply_rules(results: DataFrame, facts: DataFrame, rules: DataFrame, unmatched_behavior: str = "violation") -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts with warnings, all violations (file, rule_id, metric, grp, actual, message), and per file a note and a diagnostic with their number."""
    found = violations(facts, rules)
    none = F.lit(None).cast("double").alias("actual")
    missing = required_missing(results, facts, rules).select("file", "rule_id", "metric", "grp", none, "message")
    never = unmatched(facts, rules, unmatched_behavior).where("kind = 'violation'").select("file", "rule_id", "metric", "grp", none, "message")
    every = found.union(missing).union(never)
    counts = every.where("file != '*'").groupBy("file").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("threshold rules: "), "n", F.lit(" violation(s)"))
    diagnostic = F.struct(F.lit("threshold_rule_violation").alias("code"), F.lit("warn").alias("severity"), F.lit("rules").alias("source"), text.alias("message"), F.col("n").alias("count"))
    return add_warnings(facts, found), every, counts.select("file", "n", text.alias("note"), diagnostic.alias("diagnostic"))


def unmatched_notes(results: DataFrame, facts: DataFrame, rules: DataFrame, behavior: str = "note") -> DataFrame:
    """file, note and diagnostic for every file if there are rules that match no fact at all; nothing for "ignore"."""
    names = unmatched(facts, rules, "note" if behavior != "ignore" else behavior).agg(F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("_names")).where("_names != ''")  # one row, from rules
    note = F.concat(F.lit("threshold rules: unmatched metric names: "), "_names")  # fixed text
    severity = "error" if behavior == "error" else "warn"
    diagnostic = F.struct(F.lit("threshold_rules_unmatched").alias("code"), F.lit(severity).alias("severity"), F.lit("rules").alias("source"), note.alias("message"))
    return results.select("file").distinct().crossJoin(F.broadcast(names)).select("file", note.alias("note"), diagnostic.alias("diagnostic"))


RULE_KEYS = {"metric": str, "group": str, "min": (int, float), "max": (int, float), "equals": (int, float), "require_present": bool, "message": str}


def load_threshold_rules(path: str) -> list[tuple]:
    """Rules of a .json or .toml file (a list, or an object with `rules`) as tuples for plans.presets.rules_table; a ValueError names what is wrong."""
    payload = load_rule_file(path)
    rules = payload.get("rules") if isinstance(payload, dict) else payload
    if not isinstance(rules, list):
        raise ValueError(f"{path}: expected a list of rules or an object with 'rules'")
    for k, r in enumerate(rules):
        if not isinstance(r, dict) or not isinstance(r.get("metric"), str) or not r["metric"].strip():
            raise ValueError(f"{path}: rules[{k}] needs a metric")
        for key, value in r.items():
            if key not in RULE_KEYS or value is not None and (not isinstance(value, RULE_KEYS[key]) or isinstance(value, bool) and key in ("min", "max", "equals")):
                raise ValueError(f"{path}: rules[{k}].{key} is unknown or of a wrong type")
    number = lambda x: None if x is None else float(x)
    return [(r["metric"], r.get("group"), number(r.get("min")), number(r.get("max")), number(r.get("equals")), bool(r.get("require_present", False)), r.get("message")) for r in rules]


def lint(rules: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """rule_id, severity and message of rules whose bounds cross, whose group is unknown or that repeat an earlier one."""
    from pyspark.sql import Window

    same = Window.partitionBy(normal(F.col("metric")), normal(F.coalesce("grp", F.lit(""))), "low", "high", "equals").orderBy("rule_id")
    found = rules.withColumn("_n", F.row_number().over(same)).select(
        "rule_id",
        F.array_compact(
            F.array(
                F.when(F.col("low") > F.col("high"), F.struct(F.lit("error").alias("severity"), F.lit("min is above max").alias("message"))),
                F.when(F.col("grp").isNotNull() & ~normal(F.col("grp")).isin(*groups), F.struct(F.lit("error").alias("severity"), F.lit("unknown group").alias("message"))),
                F.when(F.col("_n") > 1, F.struct(F.lit("warn").alias("severity"), F.lit("repeats an earlier rule").alias("message"))),
            )
        ).alias("found"),
    )
    return found.select("rule_id", F.inline("found"))


def add_warnings(facts: DataFrame, found: DataFrame) -> DataFrame:
    """facts whose warning gains the messages of their violations, each once, after `; `."""
    own = found.groupBy("file", "grp", F.col("metric").alias("name")).agg(F.array_sort(F.collect_set("message")).alias("_new"))
    joined = facts.join(own, ["file", "grp", "name"], "left")
    old = F.filter(F.split(F.coalesce("warning", F.lit("")), "; "), lambda x: x != "")
    full = F.array_join(F.array_union(old, F.coalesce("_new", F.array().cast("array<string>"))), "; ")
    return joined.withColumn("warning", F.when(full != "", full)).drop("_new")
