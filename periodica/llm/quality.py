"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and selectivity (share of a sample that it rejects) are measured first; the rules then run in
falling order of rejection per cost, as one nested CASE, so that a document that fails an early rule doesn't pay
for later ones. The order changes the work, never the verdict.

A rule is timed over many repetitions of the sample in one job, best of several, less the best time of the same job
with a rule that does nothing; what the empty jobs differ by among themselves is the least cost that can be told.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import SPACE, drop_stage, write_stage

#: Rows that costs and selectivities are estimated on, about; how often a timed job goes through them, and timed jobs of a rule.
SAMPLE_ROWS, REPEATS, TIMED = 1000, 3, 2


@dataclass(frozen=True)
class Rule:
    """rejects: from the columns of base_metrics, by name, to a boolean that is never null for a text."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: What a rule may read: counts that are there for every document anyway, and the text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The words of a text; an empty array without any."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a class (given without brackets) a text has."""
    return F.char_length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Thresholds leave room: running prose stays far below each of them.
RULES = (
    Rule("symbols", lambda m: m["n_symbols"] > 0.25 * m["n_words"]),
    Rule("shouting", lambda m: share(count_of(m["text"], "\\p{Lu}"), m["word_chars"]) > 0.4),
    Rule("exclamations", lambda m: count_of(m["text"], "!") > 0.5 * m["n_words"]),
    Rule("word_length", lambda m: ~share(m["word_chars"], m["n_words"]).between(1.5, 25.0)),
    Rule("copied_lines", lambda m: share(m["n_dup_lines"], m["n_lines"]) > 0.5),
    Rule("letters", lambda m: share(count_of(m["text"], "\\p{L}"), m["word_chars"]) < 0.4),
)


def measured_order(docs: DataFrame, rules=RULES, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds for a document, selectivity) by falling rejection per cost, on a sample by the key's hash.

    Rules with equal rates, as those that reject nothing, keep the order given; with an empty table, or one of null
    texts, all do. Null texts take no part.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    step = max(1, n // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(F.col(key).alias("doc_id"), "text").where("text is not null").limit(2 * sample_rows)
    local = write_stage(base_metrics(sample), "rule-sample")
    rows = local.count()
    if not rows:
        drop_stage(local)
        return [(r, 0.0, 0.0) for r in rules]
    often = local.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    jobs = [often.agg(F.avg(r.rejects(_columns()).cast("double")).alias("s")) for r in (Rule("nothing", lambda m: m["text"].isNull()), *rules)]
    share = [float(j.first().s or 0.0) for j in jobs]  # compiled once before it is timed
    times: list[list[float]] = [[] for _ in jobs]
    for _ in range(TIMED):
        for t, j in zip(times, jobs, strict=True):
            began = time.perf_counter()
            j.first()
            t.append(time.perf_counter() - began)
    drop_stage(local)
    least = max(max(times[0]) - min(times[0]), 1e-4)
    found = [(r, max(min(t) - min(times[0]), least) / (rows * REPEATS), s) for r, t, s in zip(rules, times[1:], share[1:], strict=True)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("text", *BASE)}


def cascade(rules, columns: dict[str, Column]) -> Column:
    """Name of the first rule, in the given order, that rejects the document; null if none does. Later rules aren't evaluated then."""
    out = F.lit(None).cast("string")
    for r in reversed(list(rules)):
        out = F.when(r.rejects(columns), F.lit(r.name)).otherwise(out)
    return out


def base_metrics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `carry`, text, and n_words, word_chars, n_symbols, n_dup_lines, n_lines (those with a word), n_repeat_words (long)."""
    d = docs.select(*carry, "text", words(F.col("text")).alias("w"))
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("h", windows).withColumn("ls", lines(F.coalesce("text", F.lit(""))))
    # only texts with a repeated window are sorted; equal windows then stand together
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    text = F.coalesce("text", F.lit(""))
    # A filter on these columns must stay above this projection: pushed below, it would copy whole arrays into the
    # functions that run for each of their elements. Spark pushes no filter past an id that depends on the row's place.
    mark = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    return d.select(
        *carry, "text",
        mark(F.size("w").cast("long")).alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_of(text, "#*$%&|<>").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").cast("long").alias("n_lines"),
        mark(F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long")).alias("n_repeat_words"),
    )


def _judged(m: DataFrame, order: list[Rule]) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", base)
    m = m.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order, _columns())))
    return m.withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows, with all their columns, that quality_rules keeps; nothing is shuffled.

    Null and empty texts go, as they have no words; repeated rows, and rows without a key, are judged like others; columns
    may have any names. A very long text is judged whole; an empty table gives an empty result.
    """
    order = [r for r, _, _ in measured_order(docs, rules)]
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return _judged(base_metrics(whole, ("row",)), order).where("kept").select("row.*")


def quality_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the base values, base_failed, failed_rule (null if none), kept.

    docs needs doc_id and text; other columns are ignored. A null text counts as one without words and fails the
    base rule (n_words < 50, or over half of its words in repeated three-word windows). failed_rule is `base` or
    the rule of the cascade that rejected the document first; which of several it names depends on the measured
    order, kept doesn't. An empty table gives an empty result; repeated rows are judged alike.
    """
    order = [r for r, _, _ in measured_order(docs, rules, sample_rows=sample_rows)]
    return _judged(base_metrics(docs), order).drop("text", "n_lines")


#: The same values and verdict in SQL for DuckDB, written from the contract; {docs} is the input.
ORACLE = """
with d as (select doc_id, text, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from {docs}),
win as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from rep) group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) line from d),
ln as (select doc_id, count(*) n_lines, count(*) - count(distinct line) n_dup from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
m as (select d.doc_id, d.t, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(n_dup, 0)::bigint n_dup_lines, coalesce(n_lines, 0) n_lines,
  coalesce(cov.n, 0)::bigint n_repeat_words, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) ups, length(regexp_replace(t, '[^!]+', '', 'g')) ex,
  length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) letters from d left join cov using (doc_id) left join ln using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_symbols > 0.25 * n_words or ups > 0.4 * word_chars or ex > 0.5 * n_words or not (word_chars / n_words between 1.5 and 25)
  or n_dup_lines > 0.5 * n_lines or letters < 0.4 * word_chars) kept
from b
"""
