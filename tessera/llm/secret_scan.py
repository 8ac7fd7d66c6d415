"""Secret scans over a ledger of content-addressed blobs, all in DataFrame operations.

Every version of every path is a blob, named by the SHA-256 of its bytes. The ledger says which blob was scanned
with which version of which rule, and what was found. A scan takes unseen pairs only, and its findings go back
to all paths that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_with, materialise

#: Paths of one blob that a task joins findings to, about: the paths of commoner blobs are dealt to several tasks.
PATHS = 1 << 18


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    #: A Java pattern of which all leftmost matches that do not overlap are looked at.
    pattern: str
    #: Lower-case strings of which a text must hold one, lower-cased; none: any text is looked at.
    needs: tuple[str, ...] = ()
    #: Least length of group ``group``; shorter matches are dropped.
    least: int = 1
    group: int = 0
    #: A group at the pattern's start that is no part of the span; 0: none.
    lead: int = 0


BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api_key", "apikey"), 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", (), 24),
)
#: What the method adds to the base rules.
MORE = (
    # starts where a run starts: a search that starts at every eyJ of a long run takes time with the square of its length
    Rule("jwt", 2, r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (".eyj",), 20, lead=1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 40),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",), 20),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:int,stop:int>>"
_SCANNED = "array<struct<rule:string,rule_version:int>>"
_FOUND = "array<struct<rule:string,rule_version:int,start:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Code point spans, ends exclusive, of a rule's matches: lengths of the matches and of what lies between add up."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    grouped = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    leads = F.regexp_extract_all(text, p, F.lit(rule.lead)) if rule.lead else F.transform(found, lambda m: F.lit(""))
    between = F.split(text, rule.pattern, -1)
    every = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    every = F.zip_with(every, grouped, lambda x, g: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.length(g).alias("g")))
    every = F.zip_with(every, leads, lambda x, lead: F.struct(x["b"].alias("b"), x["m"].alias("m"), x["g"].alias("g"), F.length(lead).alias("lead")))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc, x):
        stop = acc["at"] + x["b"] + x["m"]
        grown = F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"] + x["lead"]).alias("start"), stop.alias("stop"))))
        return F.struct(stop.alias("at"), F.when(x["g"] >= rule.least, grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(every, zero, step, lambda acc: acc["out"])


def _hints(rule: Rule) -> Column:
    if not rule.needs:
        return F.col("text").rlike(rule.pattern)
    some = F.lit(False)
    for x in rule.needs:
        some = some | F.contains("lowered", F.lit(x))
    return some


def _entry(rule: Rule):
    return lambda x: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("rule_version"), x["start"].alias("start"), x["stop"].alias("stop"))


def ledger_schema() -> str:
    """A row for each blob and scan: the pairs of rule and version that the blob was scanned with, and what they found."""
    return f"blob string, scanned {_SCANNED}, found {_FOUND}"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings and the ledger after the scan.

    ``versions`` has one row per version of a path. Findings: doc_id, blob, found (start, place among the rules, stop, rule,
    rule_version, sorted; null if none) of every row of ``versions``, from this scan and, for blobs and rule versions already
    in ``ledger``, from it. Null texts are empty blobs. Equal texts under different ids are scanned once, repeated rows
    entered once; rows that share an id, or have none, keep one row each; other columns are ignored, whatever their names. No
    rows, no findings, and the ledger stays as it is.
    """
    rows = versions.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    named = materialise(rows.select("doc_id", "blob"), "paths")
    blobs = named.groupBy("blob").agg(F.min("doc_id").alias("path"), F.count("*").alias("paths"))
    everything = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        todo = blobs.select(F.col("blob").alias("of"), "path", everything.alias("todo"))
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))  # a row for each scan of the blob
        left = F.array_except(everything, F.coalesce("seen", F.expr(f"cast(array() as {_SCANNED})")))
        todo = blobs.join(seen, "blob", "left").select(F.col("blob").alias("of"), "path", left.alias("todo")).where(F.size("todo") > 0)
    # the first path that holds a blob lends its text
    texts = joined_with(rows, todo, F.col("doc_id").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("of")), "inner")
    ready = texts.withColumn("lowered", F.lower("text"))
    none = F.expr(f"cast(array() as {_SPANS})")
    wanted = [F.array_contains(F.col("todo.rule"), r.kind) for r in rules]
    looked = ready.select("blob", "todo", *[F.when(w & _hints(r), spans(F.col("text"), r)).otherwise(none).alias(f"s{i}") for i, (w, r) in enumerate(zip(wanted, rules, strict=True))])
    each = [F.transform(f"s{i}", _entry(r)) for i, r in enumerate(rules)]
    fresh = looked.select("blob", F.col("todo").alias("scanned"), F.concat(*each).alias("found"))
    fresh = materialise(fresh.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.first("found").alias("found")), "ledger")
    after = fresh if ledger is None else ledger.select("blob", "scanned", "found").unionByName(fresh)

    place = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        place = F.when((F.col("x.rule") == r.kind) & (F.col("x.rule_version") == r.version), i).otherwise(place)
    one = after.where(F.size("found") > 0).select("blob", F.explode("found").alias("x")).select("blob", F.col("x.start"), place.alias("place"), F.col("x.stop"), F.col("x.rule"), F.col("x.rule_version")).where("place is not null").distinct()
    found = one.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "stop", "rule", "rule_version"))).alias("found"))  # of one text

    total = named.count()
    if total <= PATHS:
        return named.join(found, "blob", "left").select("doc_id", "blob", "found"), after
    # blobs of more than a thousandth of all paths, so at most a thousand
    hot = F.broadcast(blobs.where(F.col("paths") > max(PATHS, total // 1000)).select("blob", F.ceil(F.col("paths") / F.lit(PATHS)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    paths = named.join(hot, "blob", "left").select("doc_id", "blob", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"))
    salted = found.join(hot, "blob", "left").select("blob", "found", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return paths.join(salted, ["blob", "salt"], "left").select("doc_id", "blob", "found"), after


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["stop"].cast("string"))))


def _is(kind: str):
    return lambda x: x["rule"] == kind


def digest(findings: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, a count for each base rule, base_sha256, spans."""
    found = F.coalesce("found", F.expr("cast(array() as array<struct<start:int,place:int,stop:int,rule:string,rule_version:int>>)"))
    rows = findings.select("doc_id", found.alias("found"))
    kinds = [r.kind for r in base]
    return rows.select(
        "doc_id",
        *[F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(F.filter("found", lambda x: x["rule"].isin(*kinds))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redact(text: Column, found: Column, marker: str = "[SECRET]") -> Column:
    """The text with every stretch that a span covers replaced by ``marker``; spans are sorted by start."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        start, stop = x["start"], x["stop"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(start - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], stop).alias("at"), F.when(start >= acc["at"], F.concat(acc["out"], gap, F.lit(marker))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)
