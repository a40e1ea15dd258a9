"""Quality rules in a short-circuit cascade, as column expressions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import INK, let, windows, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Rows on which costs and selectivities are estimated, at most, and timings of each rule, of which the shortest counts.
SAMPLE_ROWS, REPEATS = 2000, 3


def count_of(text: Column, signs: str) -> Column:
    """Occurrences of the single characters ``signs``."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def repeat_words(all_words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text, each counted once.

    Windows are told apart by a 64-bit hash. Texts without a repeated window, which are
    most, end at the comparison of counts; for the others the windows are sorted by hash and
    the places of equal neighbours are covered. Linear and n log n; no window meets another
    text's.
    """

    def of(w: Column) -> Column:
        return let(F.transform(windows(F.size(w), 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), places)

    def places(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), equal))

    def equal(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1).h == e.h, F.lit(False)) | F.coalesce(F.get(s, i + 1).h == e.h, F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda e: e.i)), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(all_words, of).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the base counts of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(INK))
    return rows.select(
        "doc_id",
        "text",
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words(F.col("text"))).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a text."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The method's own rules, over the columns of ``base``."""
    text, n = F.col("text"), F.col("n_words")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("long_words", F.col("word_chars") > 12 * n),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.size(F.split(text, "\n"))),
        Rule("capitals", upper * 2 > letters),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("exclamations", count_of(text, "!") * 2 > n),
    ]


@dataclass(frozen=True)
class Estimate:
    """A rule's seconds on the sample, and the share of the sample that it rejects of what the rules before it leave."""

    name: str
    seconds: float
    rejected: float


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` to twice ``rows`` documents (all of a smaller table), chosen by a hash, so that any file or source has its share."""
    share = min(1.0, 2.0 * rows / max(docs.count(), 1))
    place = F.pmod(F.xxhash64("doc_id", F.octet_length(F.col("text").cast("string"))), F.lit(1 << 30))
    return docs.where(place < int(share * (1 << 30)))


def order_rules(names: list[str], seconds: list[float], hits: dict[tuple[bool, ...], int]) -> list[Estimate]:
    """The rules by falling rejection per second, each judged on the rows that those before it leave.

    ``hits`` counts sample rows by the rules that reject them. Ties go to the first by name.
    """
    left, total, out = dict(hits), max(sum(hits.values()), 1), []
    todo = set(range(len(names)))
    while todo:
        gain = {k: sum(n for h, n in left.items() if h[k]) / total for k in todo}
        best = min(todo, key=lambda k: (-gain[k] / max(seconds[k], 1e-6), names[k]))
        out.append(Estimate(names[best], seconds[best], gain[best]))
        left = {h: n for h, n in left.items() if not h[best]}
        todo.remove(best)
    return out


def estimate(frame: DataFrame, chosen: list[Rule]) -> list[Estimate]:
    """The rules in the order that ``frame``, a sample with the columns of ``base``, calls for.

    One aggregation counts which rules reject which rows. A rule's cost is the shortest of
    REPEATS timings over the cached sample, less the shortest of a job without a rule. The
    sample only orders the cascade; verdicts don't depend on it.
    """
    sample = frame.cache()
    try:
        flags = [F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in chosen]
        hits = {tuple(r[:-1]): r[-1] for r in sample.groupBy(*flags).agg(F.count("*").alias("rows")).collect()}

        def timed(condition: Column) -> float:
            took = []
            for _ in range(REPEATS):
                began = time.perf_counter()
                sample.where(condition).count()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = timed(F.col("n_words") < 0)
        seconds = [max(timed(f) - idle, 1e-4) for f in flags]
        return order_rules([r.name for r in chosen], seconds, hits)
    finally:
        sample.unpersist()


def cascade(chosen: list[Rule], estimates: list[Estimate]) -> Column:
    """The name of the first rule that rejects, or null: rules run in the order of ``estimates`` and stop at a hit."""
    by_name = {r.name: r for r in chosen}
    out = F.lit(None).cast("string")
    for e in reversed(estimates):
        out = F.when(F.coalesce(by_name[e.name].rejects, F.lit(False)), F.lit(e.name)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row.

    The cascade's order comes from at most ``sample_rows`` documents that the base rules
    keep. A null text is empty: its counts are 0 and it fails. Null ids and repeated rows are
    kept as they are; an empty table gives no rows. Only the sample leaves its partitions.
    """
    frame, chosen = base(docs), rules()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sample = base(sample_of(docs, sample_rows)).where(~failed).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines").limit(sample_rows)
    verdict = cascade(chosen, estimate(sample, chosen))
    return (
        frame.withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict.isNull()))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
