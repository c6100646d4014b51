"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column over a document's measures, true where it rejects. A sample of unmeasured documents tells
each rule's selectivity and its cost, its own measures included; the cascade evaluates the rules in the order of rejections
per cost, and a CASE expression stops at the first that rejects. The order changes what is computed, never the verdict.
`keep_good` computes a measure only where the cascade gets to a rule that needs it; `judged` returns the measures of every
document, so there only what isn't returned is saved.

Null texts count as empty: no words, so they are rejected. Texts of any length are measured whole; a text costs its length,
or that times its logarithm where it repeats windows. Repeated rows get the same verdict each; an empty table gives none, in
any order. Columns of the measures' names are replaced by `judged`, others of any name kept; `keep_good` keeps all.
Five-word windows are compared by their 64-bit hashes inside one document."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What separates words, and the characters that count as symbols.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeats(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(lines equal to an earlier one, lines), both of lines with a word."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return _let(lines, lambda found: body((F.size(found) - F.size(F.array_distinct(found))).cast("long"), F.size(found).cast("long")))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words that the text has at least twice. Texts without such a window, which
    are most, cost one pass over the hashes; only others sort them with their places."""

    def hashes(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))
        return _let(each, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))

    def places(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.sort_array(F.transform(_let(ordered, again), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    count = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(_let(places(found), covered))
    # Bound here, so that the optimizer can't move the splitting of the text into the lambdas.
    return _let(words, lambda w: F.when(F.size(w) < WINDOW, 0).otherwise(_let(hashes(w), count))).cast("long")


class Measures:
    """The measures as expressions over a text and its words, each computed where it is used."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words
        self.n_words = F.size(words).cast("long")
        self.word_chars = F.length(F.concat_ws("", words)).cast("long")
        self.n_symbols = self.count(SYMBOLS)
        self.n_repeat_words = n_repeat_words(words)

    def count(self, pattern: str) -> Column:
        return F.regexp_count(self.text, F.lit(pattern)).cast("long")

    def lines(self, body: Callable[[Column, Column], Column]) -> Column:
        """body(repeated lines, lines)."""
        return _repeats(self.text, body)


class Stored(Measures):
    """The measures as columns."""

    def __init__(self, text: Column):
        self.text = text
        self.n_words, self.word_chars, self.n_symbols, self.n_repeat_words = map(F.col, ("n_words", "word_chars", "n_symbols", "n_repeat_words"))

    def lines(self, body: Callable[[Column, Column], Column]) -> Column:
        return body(F.col("n_dup_lines"), F.col("n_lines"))


@dataclass(frozen=True)
class Rule:
    """rejects: a column over the measures, never null."""

    name: str
    rejects: Callable[[Measures], Column]


#: Documents that fail these are rejected whatever other rules there are.
BASE = (
    Rule("few words", lambda m: m.n_words < 10),
    Rule("repeated windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)


def rules(least_repeats: int = 3) -> list[Rule]:
    """Fixed thresholds: at most a symbol in five words, words of 2 to 20 characters on average, at most 30 % of lines
    repeated, at most 40 % capital letters, at most an exclamation mark in three words. Lines count as repeated only from
    least_repeats of them on, as short prose may end as it began; with 1 any repeated line counts."""
    return [
        Rule("capitals", lambda m: 100 * m.count("\\p{Lu}") > 40 * m.word_chars),
        Rule("symbols", lambda m: 5 * m.n_symbols > m.n_words),
        Rule("exclamations", lambda m: 3 * m.count("!") > m.n_words),
        Rule("repeated lines", lambda m: m.lines(lambda again, lines: (again >= least_repeats) & (100 * again > 30 * lines))),
        Rule("word length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
    ]


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed. Columns of those names
    are replaced."""
    pair = lambda again, lines: F.struct(again.alias("again"), lines.alias("lines"))

    def found(words: Column) -> Column:
        m = Measures(_whole(text), words)
        return F.struct(m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), m.lines(pair).alias("lines"), m.n_repeat_words.alias("n_repeat_words"))

    measures = "__measures"  # a column of this name would be the caller's only by intent
    while measures in docs.columns:
        measures += "_"
    out = docs.withColumn(measures, _let(words_of(_whole(text)), found))
    out = out.withColumns({c: F.col(f"{measures}.{p}") for c, p in (("n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "lines.again"), ("n_lines", "lines.lines"), ("n_repeat_words", "n_repeat_words"))}).drop(measures)
    return out.withColumn("base_failed", BASE[0].rejects(m := Stored(_whole(text))) | BASE[1].rejects(m))


def _costs(sample: DataFrame, found: list[Rule], runs: int) -> dict[str, float]:
    """Seconds of each rule over the sample, that of a rule that does nothing taken off: the least of several runs, to a
    power of two, as nearer than that times aren't told apart. What takes less than a job's own noise counts as that."""

    def least(rejects: Callable[[Measures], Column]) -> float:
        once = sample.agg(F.count_if(rejects(Measures(F.col("text"), words_of(F.col("text"))))))

        def run() -> float:
            began = time.perf_counter()
            once.collect()
            return time.perf_counter() - began

        return min(run() for _ in range(runs))

    idle = least(lambda m: F.length(m.text) < 0)
    return {r.name: 2.0 ** round(math.log2(max(least(r.rejects) - idle, 0.03))) for r in found}


def ordered(docs: DataFrame, found: list[Rule], sample_rows: int = 500, copies: int = 16, runs: int = 3, text: str = "text") -> list[Rule]:
    """The rules by rejections per cost, as estimated on a sample of the documents; equal ones stay as they are. For the
    costs every sampled row is read copies times, so that a run outlasts the noise of a job."""
    count = docs.count()
    sample = common.keep(docs.select(_whole(text).alias("text")).sample(min(1.0, 2 * sample_rows / max(count, 1)), seed=7).limit(sample_rows).coalesce(1), "sample")
    parts = sample.agg(*[F.avg(r.rejects(Measures(F.col("text"), words_of(F.col("text")))).cast("double")).alias(str(k)) for k, r in enumerate(found)]).first()
    lots = common.keep(sample.select(F.explode(F.array_repeat("text", copies)).alias("text")).repartition(max(1, min(copies, sample.sparkSession.sparkContext.defaultParallelism))), "sample")
    costs = _costs(lots, found, runs)
    common.drop(sample, lots)
    return sorted(found, key=lambda r: -(parts[str(found.index(r))] or 0.0) / costs[r.name])


def verdict(found: list[Rule], measures: Measures) -> Column:
    """True if no rule rejects; a rule is evaluated only for documents that all rules before it let pass."""
    case = F.when(F.lit(False), False)
    for rule in found:
        case = case.when(rule.rejects(measures), False)
    return case.otherwise(True)


def judged(docs: DataFrame) -> DataFrame:
    """The documents (..., text) with their measures, base_failed and kept: not base_failed, and no rule rejects."""
    found = ordered(docs, rules())
    return measured(docs).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(found, Stored(_whole("text")))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names. The base rules stand in the cascade like
    the others, and only the text is split into words for every document."""
    found = ordered(docs, [*BASE, *rules()])
    kept = _let(words_of(_whole("text")), lambda words: verdict(found, Measures(_whole("text"), words)))
    return common.wrapped(docs, "text").withColumn("kept", kept).where("kept").select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS five FROM w, unnest(range(1, len(words) - 3)) AS r(i)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM d, unnest(range(i, i + 5)) AS r(p) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * len(regexp_extract_all(text, '\p{Lu}')) > 40 * word_chars OR 5 * n_symbols > n_words
    OR 3 * len(regexp_extract_all(text, '!')) > n_words OR n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
