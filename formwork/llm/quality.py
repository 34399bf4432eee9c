"""Quality rules: countable properties of a text, and how much its n-grams resemble trusted text.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwork.llm.common import SPACE, beside, written

#: Java pattern of what the resemblance counts: runs of letters and digits, runs of other marks.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
_ONE = 1 << 20  # log ratios are whole multiples of 1 / _ONE, so that sums don't depend on order


def words_of(text: Column) -> Column:
    """The words of a text (runs without ASCII white space); null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE, -1)).otherwise(F.array().cast("array<string>"))


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words stand in windows of ``width`` words that the text has twice or more.

    Only texts with equal window hashes pay for the sort that finds the places."""
    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, width))))
    windows = F.slice(hashes, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))

    def places(found: Column) -> Column:
        """Places of windows that equal a neighbour in the order of hashes."""
        row = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hit = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.array_compact(hit))

        return _let(row, neighbours)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(found: Column) -> Column:
        twice = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(twice, _let(places(found), covered)).otherwise(F.lit(0).cast("long"))

    return _let(windows, counted)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_rules(docs: DataFrame, text_column: str = "text", least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``,
    which replace columns of these names.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeats`` per cent of them in
    windows of five words that occur twice or more.  A null text has no words."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    counts = lambda words: F.struct(F.size(words).cast("long").alias("n"), repeat_words(words).alias("repeated"))
    rows = docs.withColumn("n_words", _let(words_of(F.col(text_column)), counts))
    rows = rows.withColumns(
        {
            "n_words": F.col("n_words.n"),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": duplicate_lines(F.col(text_column)),
            "n_repeat_words": F.col("n_words.repeated"),
        }
    )
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(most_repeats) * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def ngram_cells(text: Column, cells: int) -> Column:
    """The cells of a text's hashed n-grams: each token, and each two neighbours."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    cell = lambda *of: F.pmod(F.xxhash64(*of), F.lit(cells)).cast("int")

    def both(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda x, i: cell(F.get(t, i), x))
        return F.concat(F.transform(t, lambda x: cell(x)), pairs)

    return _let(tokens, both)


def trusted_rows(labels: DataFrame, id_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """(all trusted ids that are counted, column ``of``; the ids that choose the threshold, ``of, good``).

    A fifth of the labelled ids, by hash, chooses the threshold, whole, and isn't counted (``good``:
    1 trusted, 0 not).  Of labels that disagree the least counts."""
    known = labels.select(F.col(id_column).alias("of"), F.col(label_column).cast("int").alias("good")).filter("of is not null and good in (0, 1)")
    known = known.groupBy("of").agg(F.min("good").alias("good"))
    held = F.pmod(F.xxhash64("of", F.lit("held out")), F.lit(5)) == 0
    return known.filter(~held & (F.col("good") == 1)).select("of"), known.filter(held)


def cell_weights(counts: DataFrame, cells: int) -> Column:
    """An array with each cell's log p(target) - log p(raw), in whole multiples of 1 / 2**20.

    ``counts`` has at most ``cells`` rows (cell, raw, target), so the driver gets a fixed size."""
    raw, target = ([0] * cells for _ in range(2))
    for r in counts.collect():
        raw[r.cell], target[r.cell] = r.raw, r.target
    all_raw, all_target = sum(raw), sum(target)
    share = lambda c, n: math.log((c + 0.5) / (n + cells / 2))
    weights = [round((share(t, all_target) - share(r, all_raw)) * _ONE) if all_target else 0 for r, t in zip(raw, target)]
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")


def resemblance(docs: DataFrame, labels: DataFrame, cells: int = 1 << 16, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """``docs`` as ``doc_id``, the base rules, ``score`` and ``kept``.

    The score of a text is the mean over its hashed n-grams of log p(target) - log p(raw).  Both are
    multinomials over ``cells`` cells with add-one-half smoothing: raw counts all documents, target
    all trusted ones but those held out.  The trusted ids are broadcast only if they are counted to
    be few (``beside``); the cells are a fixed number, and each row is scored where it stands.

    The threshold is the score that divides all held-out labelled rows best, by the mean of the two
    rates of right verdicts (the middle of the best range), the same in each run; a fixed number of
    bins of scores is ordered, whatever the number of rows.  A text without n-grams has score 0; without held-out labels of both kinds,
    or without trusted rows, nothing but the base rules rejects.

    ``kept`` is false where the base rules fail, else whether the score reaches the threshold.
    Rows that share an id are judged apart; null ids stay; ids keep their type; other columns are
    ignored; an empty table gives no rows.
    """
    counted, chooses = trusted_rows(labels, id_column, label_column)
    counted, chooses = written(counted), written(chooses)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    marked = beside(rows, counted.select(F.col("of").alias("doc_id"), F.lit(1).alias("good")), "doc_id", how="left", most=1_000_000)
    grams = marked.select("good", F.explode(ngram_cells(F.col("text"), cells)).alias("cell"))
    weights = cell_weights(grams.groupBy("cell").agg(F.count("*").alias("raw"), F.count("good").alias("target")), cells)

    def score(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda a, c: a + F.get(weights, c))
        return F.when(F.size(found) > 0, total / F.size(found) / F.lit(float(_ONE))).otherwise(F.lit(0.0))

    judged = base_rules(rows).withColumn("score", _let(ngram_cells(F.col("text"), cells), score)).drop("text")
    found = written(judged)
    threshold = best_threshold(beside(found.filter("not base_failed").select("doc_id", "score"), chooses.withColumnRenamed("of", "doc_id"), "doc_id", most=1_000_000).select("score", "good"))
    verdict = F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold)
    return found.withColumn("kept", ~F.col("base_failed") & verdict)


def best_threshold(scored: DataFrame) -> float | None:
    """The threshold that divides ``score`` by ``good`` best; None without both labels.

    Scores fall into steps of 1/256 within [-32, 32], so at most 16,385 rows are ordered."""
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(32.0)), F.lit(-32.0)) * 256).cast("int")
    bins = scored.groupBy(step.alias("at")).agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = bins.select("at", F.sum("good").over(after).alias("passed"), F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("stopped"), F.sum("good").over(Window.partitionBy()).alias("all_good"), F.sum("bad").over(Window.partitionBy()).alias("all_bad"), F.coalesce(F.lag("at").over(Window.orderBy("at")), F.col("at") - 1).alias("below"))
    rows = rows.filter("all_good > 0 and all_bad > 0").withColumn("rate", F.col("passed") / F.col("all_good") + F.col("stopped") / F.col("all_bad"))
    best = rows.orderBy(F.desc("rate"), "at").first()
    return None if best is None else (best.at + best.below + 1) / 512
