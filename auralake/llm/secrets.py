"""Secret scan: credentials in parts, linked within scopes, in DataFrame functions only.

A strong part is reported wherever it stands: an assignment to a secret's name (value of 12 characters or more), an access
key id, a long hexadecimal run. A weak part could be anything by itself: a user name, an endpoint, a mixed token, a short
password. A weak part is reported only where a complementary one, weak or strong, stands at most `NEAR` code points away in
the same scope, a paragraph between blank lines: secrets complement user names, access ids and endpoints, and these
complement secrets. Spans are gathered in each row without a shuffle; only parts of documents that hold both sides are
exploded and interval-joined, by buckets of positions within a scope, as a semi join that never emits pairs. Weak parts that
touch a strong one are no parts of their own.

Null text counts as empty; empty texts have no spans; repeated rows give repeated results, and an empty table an empty one.
Spans that begin at one place are all given, in the order of KINDS. Texts of any length are scanned whole: places are sums of
lengths, added up in blocks. A null or repeated doc_id is no matter, since rows have numbers of their own; columns but doc_id
and text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import checkpointed, discard

VALUE = r"""["']?\x20*[:=]\x20*["']?"""
STRONG = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
WEAK = {
    "user": rf"(?i:user(?:name|_?id)?|login|client_?id|access_?key_?id){VALUE}[A-Za-z0-9._@+-]{{3,}}",
    "endpoint": rf"(?:(?:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://|(?i:host|endpoint|server){VALUE})[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]{{1,5}})?",
    "blob": r"[A-Za-z0-9+/_=-]{20,}",
}
KINDS = (*STRONG, *WEAK, "short")
#: What ends a scope.
BLANK = r"\n[\x20\t\r]*\n"
SECRET = ("assign", "hex", "blob", "short")
#: Characters of a value that make an assignment strong, and weak.
LONG, SHORT = 12, 4
#: Code points between two parts of one credential, at most.
NEAR = 300
#: Sums are added up in blocks of so many, so that long lists take little more than linear time.
BLOCK = 256

_CODE = {k: i for i, k in enumerate(KINDS)}


def running_sums(values: Column) -> Column:
    """Running sums of an array of numbers."""
    grow = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
    sums = lambda v: F.aggregate(v, F.array().cast("array<int>"), grow)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: sums(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))
    before = lambda b: F.concat(F.array(F.lit(0)), sums(F.transform(b, lambda x: F.element_at(x, -1))))
    moved = lambda b: F.flatten(F.zip_with(b, F.slice(before(b), F.lit(1), F.size(b)), lambda x, o: F.transform(x, lambda v: v + o)))
    return F.element_at(F.transform(F.array(blocks), moved), 1)  # blocks are bound once


def places(text: Column, pattern: str, matches: Column) -> Column:
    """start and end (exclusive, code points) and text of all matches of a pattern; [] where there are none."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    size = F.transform(matches, F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.slice(F.concat(F.array(F.lit(0)), size), F.lit(1), F.size(matches)), lambda g, m: g + m)
    starts = F.element_at(F.transform(F.array(steps), running_sums), 1)
    spans = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    return F.coalesce(F.when(F.size(matches) > 0, spans), F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _as_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(_CODE[kind]).alias("kind")))


def _value_size(match: Column) -> Column:
    return F.length(F.regexp_extract(match, STRONG["assign"], 1))


def parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, strong and weak spans, and breaks (ends of scopes) where a weak part has a complement in its text; no text."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    patterns = STRONG | WEAK
    own = own.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()))
    own = own.select("row", "doc_id", "text", *(places(F.col("text"), p, F.col(k)).alias(k) for k, p in patterns.items()))
    mixed = lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[a-z]") & s["match"].rlike("[A-Z]")
    short = F.filter("assign", lambda s: _value_size(s["match"]).between(SHORT, LONG - 1))
    strong = [_as_kind(F.filter("assign", lambda s: _value_size(s["match"]) >= LONG), "assign"), _as_kind(F.col("access"), "access"), _as_kind(F.col("hex"), "hex")]
    weak = [_as_kind(F.col("user"), "user"), _as_kind(F.col("endpoint"), "endpoint"), _as_kind(F.filter("blob", mixed), "blob"), _as_kind(short, "short")]
    own = own.select("row", "doc_id", "text", F.concat(*strong).alias("strong"), F.concat(*weak).alias("weak"))
    secret = lambda s: s["kind"].isin([_CODE[k] for k in SECRET])
    every = F.concat("strong", "weak")
    both = (F.size("weak") > 0) & F.exists(every, secret) & F.exists(every, lambda s: ~secret(s))
    breaks = F.transform(places(F.col("text"), BLANK, F.regexp_extract_all("text", F.lit(BLANK), F.lit(0))), lambda s: s["start"])
    return own.select("row", "doc_id", "strong", "weak", F.when(both, breaks).alias("breaks"))


def linked(found: DataFrame, near: int = NEAR) -> DataFrame:
    """row and the weak spans that have a complement in their scope, as an array; rows without any don't come."""
    apart = found.where("breaks is not null")
    secret = F.col("kind").isin([_CODE[k] for k in SECRET])
    spans = apart.select("row", F.inline(F.concat("strong", "weak")))
    ends = apart.select("row", F.explode("breaks").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("int").alias("kind"))
    order = Window.partitionBy("row").orderBy("start", F.col("kind").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    scoped = spans.unionByName(ends).withColumn("scope", F.count_if(F.col("kind").isNull()).over(order)).where("kind is not null").withColumn("secret", secret)

    def dealt(rows: DataFrame, margin: int) -> DataFrame:
        width = F.lit(max(1, near))
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - margin) / width), F.floor((F.col("end") + margin) / width))))

    other = scoped.select("row", "scope", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("kind").alias("o_kind"), F.col("secret").alias("o_secret"))
    strong = other.where(F.col("o_kind") < len(STRONG)).select("row", "o_start", "o_end")
    width = F.lit(max(1, near))
    by = lambda rows: rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("o_start") / width), F.floor(F.col("o_end") / width))))
    touch = (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
    key = ["row", "scope", "start", "end", "kind", "secret"]
    weak = scoped.where(F.col("kind") >= len(STRONG))
    s, w = by(strong).alias("s"), dealt(weak, 0).alias("w")
    covered = w.join(s, (F.col("w.row") == F.col("s.row")) & (F.col("w.bucket") == F.col("s.bucket")) & touch, "left_semi").select(*key).distinct()
    free = weak.join(covered, ["row", "start", "end", "kind"], "left_anti")
    complement = other.where(F.col("o_kind") < len(STRONG)).unionByName(free.select("row", "scope", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("kind").alias("o_kind"), F.col("secret").alias("o_secret")))
    f, o = dealt(free, near).alias("f"), by(complement).alias("o")
    close = (F.col("o_start") - F.col("end") <= near) & (F.col("start") - F.col("o_end") <= near)
    same = (F.col("f.row") == F.col("o.row")) & (F.col("f.scope") == F.col("o.scope")) & (F.col("f.bucket") == F.col("o.bucket"))
    kept = f.join(o, same & close & (F.col("f.secret") != F.col("o.o_secret")), "left_semi").select(*key).distinct()
    return kept.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))


def secret_spans(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (`kind:start:end`, comma-joined), n_linked."""
    found = checkpointed(parts(docs))
    every = found.join(linked(found, near), "row", "left")
    names = F.array(*(F.lit(k) for k in KINDS))
    sort = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    text = lambda spans: F.concat_ws(",", F.transform(sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == _CODE[kind])).cast("long").alias(f"n_{kind}")
    extra = F.coalesce("linked", F.array().cast("array<struct<start:int,end:int,kind:int>>"))
    out = every.select("doc_id", *map(count, STRONG), F.sha2(text(F.col("strong")), 256).alias("base_sha256"), text(F.concat(F.col("strong"), extra)).alias("spans"), F.size(extra).cast("long").alias("n_linked"))
    out = checkpointed(out)
    discard(found)
    return out
