"""Secret scanning with an incremental ledger of blobs, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.sql import let, running, unused
from strataflow.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` is matched leftmost without overlap; a match counts if its group has ``least`` characters.

    ``hint`` is a cheap pattern that every text with a match also matches.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def name(self) -> str:
        """The rule in its version, as ledgers know it."""
        return f"{self.kind}@{self.version}"


# The three base kinds' patterns, in the order of their listing.
RULES = [
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:passw|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10}"),
]
BASE = ("assign", "access", "hex")

#: Parts into which a blob's paths are dealt where findings meet them; adaptive execution splits parts that are still large.
SALTS = 32

FOUND = "struct<start:int,rule:string,end:int>"
SPAN = "struct<start:int,ord:int,kind:string,end:int>"
LEDGER = f"blob string, rules array<string>, spans array<{FOUND}>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in ``text`` by start: code points, end exclusive.

    The pieces between matches and the matches alternate, so that running lengths give the places.
    """

    def of(gaps: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: let(groups(m), lambda g: walk(gaps, m, g)))

    def groups(m: Column) -> Column:
        return m if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))

    def walk(gaps: Column, m: Column, g: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))

        def places(before: Column) -> Column:
            spans = F.transform(m, lambda x, i: F.struct((F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(rule.name).alias("rule"), (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(x)).alias("end")))
            return F.filter(spans, lambda s, i: F.length(F.get(g, i)) >= rule.least)

        return let(running(steps, lambda a, b: a + b, F.lit(0)), places)

    found = let(F.split(text, rule.pattern, -1), of)
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(f"array<{FOUND}>"))


def in_order(spans: Column, rules: list[Rule]) -> Column:
    """The spans of ``rules`` by start, then by the rules' order, with their kinds."""
    order, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    named = F.filter(spans, lambda s: s.rule.isin(*[r.name for r in rules]))

    def of(s: Column) -> Column:
        o, k = order, kind
        for n, r in enumerate(rules):
            o, k = F.when(s.rule == r.name, F.lit(n)).otherwise(o), F.when(s.rule == r.name, F.lit(r.kind)).otherwise(k)
        return F.struct(s.start.alias("start"), o.alias("ord"), k.alias("kind"), s.end.alias("end"))

    return F.sort_array(F.transform(named, of)).cast(f"array<{SPAN}>")


def address(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text, blob): the blob is the text's SHA-256, null texts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """New ledger rows (blob, rules, spans): one for each blob in ``versions`` that has rules which ``ledger`` hasn't seen on it.

    The unit of work is the pair of a blob and a rule's version: a row names the rules that it
    ran and their spans. Texts without any rule's hint are settled where they are read, and
    only their address travels; of the others one text of each blob is scanned, however many
    paths hold it.
    """
    rules = rules or RULES
    hints = "|".join(f"(?:{r.hint})" for r in rules)
    blobs = versions.groupBy("blob").agg(F.max(F.when(F.col("text").rlike(hints), F.col("text"))).alias("text"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    none = F.array().cast(f"array<{FOUND}>")
    spans = F.concat(*[F.when(F.array_contains("todo", r.name), spans_of(F.col("text"), r)).otherwise(none) for r in rules])
    return blobs.where(F.size("todo") > 0).select("blob", F.col("todo").alias("rules"), F.when(F.col("text").isNull(), none).otherwise(spans).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(docs: DataFrame, path: str, rules: list[Rule] | None = None, first: bool = False) -> DataFrame:
    """The ledger at ``path`` after the unseen pairs of blobs and rules in ``docs`` have been scanned and appended to it.

    ``first`` begins a ledger. Spark commits the appended files as a whole, so that a run that
    fails leaves the ledger as it was and is simply repeated.
    """
    spark = docs.sparkSession
    new = scan_unseen(address(docs), None if first else read_ledger(spark, path), rules)
    new.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def blob_findings(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, spans) of the blobs on which ``rules`` found something, each ``SALTS`` times with its ``salt``."""
    names = [r.name for r in rules]
    own = ledger.where(F.size("spans") > 0).withColumn("spans", F.filter("spans", lambda s: s.rule.isin(*names)))
    # a blob has a row for each scan; a pair that two concurrent runs scanned counts once
    known = own.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0)
    return known.select("blob", in_order(F.col("spans"), rules).alias("spans"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def salt() -> Column:
    """A row's part, by its place in its partition: null and repeated ids are dealt like others."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, blob and spans of every row of ``docs``: the ledger's findings, old and new, on all paths.

    Without a ledger the texts are scanned as part of the plan. A null text is the empty blob;
    a null doc_id and repeated rows are reported as they are; an empty table gives no rows.
    Only blobs with findings meet the paths; each is sent to ``SALTS`` parts among which its
    paths are dealt, so that no task holds all paths of a blob.
    """
    rules = rules or RULES
    new = scan_unseen(address(docs), ledger, rules)
    return on_paths(docs, new if ledger is None else new.unionByName(ledger), rules)


def on_paths(docs: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """What ``ledger`` holds of ``rules`` on every row of ``docs``, without any scan."""
    paths = address(docs).select("doc_id", "blob", salt().alias("salt"))
    joined = paths.join(blob_findings(ledger, rules), ["blob", "salt"], "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def ledger_findings(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``findings`` by way of a ledger at ``path`` (by default a fresh one), scanned in two passes.

    The first pass runs the base rules over all blobs. The second comes with all rules and
    finds the base pairs in the ledger, so that it scans the added rules only; findings of
    both passes meet all paths.
    """
    path = path or scratch_path(docs.sparkSession, "secrets-ledger")
    update_ledger(docs, path, [r for r in RULES if r.kind in BASE], first=True)
    return on_paths(docs, update_ledger(docs, path, RULES), RULES)


def secrets(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row of ``findings``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""

    def step(acc: Column, s: Column) -> Column:
        overlap = s.start < acc.at
        piece = F.concat(F.substring(text, acc.at + 1, s.start - acc.at), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.when(overlap, F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, piece).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars`` counted anew where both are there; no row is dropped.

    Findings meet the rows by the text's address, so that null or repeated ids don't matter.
    Rows without any rule's hint stay where they are read.
    """
    hints = "|".join(f"(?:{r.hint})" for r in RULES)
    hinted = F.coalesce(F.col("text").cast("string").rlike(hints), F.lit(False))
    some, rest = docs.where(hinted), docs.where(~hinted)
    versions = address(some.select(F.lit(0).alias("doc_id"), "text"))
    new = scan_unseen(versions, ledger)
    if ledger is not None:
        new = new.unionByName(ledger)
    blob, found, part, own, own_part = unused(docs, "__blob", "__spans", "__part", "__key", "__salt")
    hits = blob_findings(new, RULES).select(F.col("blob").alias(blob), F.col("spans").alias(found), F.col("salt").alias(part))
    keyed = some.withColumn(own, F.sha2(F.col("text").cast("string"), 256)).withColumn(own_part, salt())
    joined = keyed.join(hits, (keyed[own] == hits[blob]) & (keyed[own_part] == hits[part]), "left")
    has = F.col(found).isNotNull()
    out = joined.withColumn("text", F.when(has, redact(F.col("text"), F.col(found))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).unionByName(rest)
