"""Operator 8, line dedup: suffix ranks of line sequences by distributed prefix doubling.

Every document is its sequence of lines that hold a word. Suffixes are ranked by their first line,
then by their first two, four, ...: the rank of a doubled prefix is the pair of ranks of its halves.
A rank is named by the first suffix that has it (smallest id, then place), so names are exact
and need no global sort. Suffixes whose rank nobody shares drop out before the next round.

A maximal repeated run, a longest common prefix of a suffix with one that starts earlier, counts if it has
``min_words`` words or more, in however many lines; one long line is enough. Its later copies are deleted. Every line of such a run
lies in a *window* of the run, the shortest stretch of ``min_words`` words that starts at a line of it or ends at one; and a window that
repeats is such a run. So the intervals of equal windows mark exactly the lines of the runs. A window of n lines is looked up by the
ranks of its first and of its last ``2 ** k <= n`` lines; doubling goes on to the longest window.

Skew: ranks come from aggregates with map-side combining, and join back from written tables, so that the rows of
a very common line are split over tasks.

Defined results: lines are split at ``\\n``; lines without a word (``[^\\x20\\x09-\\x0D]``) are neither compared nor
deleted. Null texts have no lines and stay null; a text whose lines all go becomes empty. Rows
with a null id are left as they are. Rows that repeat an id are one document: what is marked in one goes from each.
Two lines are equal if two independent 64-bit hashes of them are. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rows import drop_written, once
from tallyspark.llm.common import written

MIN_WORDS = 8


def line_table(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, pos, line number, two hashes, lines of the window that starts here, of the one that ends here)."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(
        i.alias("line"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"),
        F.least(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(min_words)).alias("n")))
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.filter(numbered, lambda x: x["n"] > 0).alias("lines"))
    rows = once(rows, "lines")  # the windows look around in the array, which must not be made anew for each
    rows = once(rows.withColumn("sizes", F.col("lines.n")), "sizes")

    def shortest(fits) -> Column:
        return F.get(F.filter(F.sequence(F.lit(2), F.lit(max(2, min_words))), fits), 0)

    def words(start: Column, n: Column) -> Column:
        return F.aggregate(F.slice("sizes", start, n), F.lit(0), lambda a, x: a + x)

    sizes = F.size("sizes")
    ahead = F.transform("sizes", lambda n, i: F.when(n >= min_words, F.lit(1)).otherwise(
        shortest(lambda k: (i + k <= sizes) & (words(i + 1, k) >= min_words))))
    behind = F.transform("sizes", lambda n, i: F.when(n < min_words, shortest(
        lambda k: (k <= i + 1) & (words(F.greatest(i + 2 - k, F.lit(1)), k) >= min_words))))
    rows = rows.select("doc", "lines", ahead.alias("ahead"), behind.alias("behind")).select(
        "doc", F.posexplode(F.arrays_zip("lines", "ahead", "behind")).alias("pos", "x"))
    # rows that repeat an id and text give the same lines again
    return rows.select("doc", "pos", "x.lines.line", "x.lines.h1", "x.lines.h2", "x.ahead", "x.behind")


def ranked(rows: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Rows whose ``by`` is shared, with the name of their rank: the first (doc, pos) that has it."""
    first = written(rows.groupBy(*by).agg(F.min(F.struct("doc", "pos")).alias("rank"),
                                          F.max(F.struct("doc", "pos")).alias("last"))
                    .where("rank <> last").drop("last"), "ranks")
    out = written(rows.join(first, by).select("doc", "pos", *carry, "rank").distinct(), "suffixes")
    drop_written(first)
    return out


def later_windows(windows: DataFrame, suffixes: DataFrame, depth: int) -> DataFrame:
    """(doc, pos, size) of the windows of ``depth`` to twice as many lines that start earlier as well."""
    ranks = suffixes.select("doc", "pos", "rank")
    last = ranks.select("doc", F.col("pos").alias("tail"), F.col("rank").alias("right"))
    found = windows.where(F.col("size").between(depth, 2 * depth - 1)).withColumn("tail", F.col("pos") + F.col("size") - depth)
    found = found.join(ranks.withColumnRenamed("rank", "left"), ["doc", "pos"]).join(last, ["doc", "tail"])
    return ranked(found, ["left", "right", "size"], ["size"]).where(F.struct("doc", "pos") != F.col("rank")).select("doc", "pos", "size")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, lines): the line numbers of later copies of repeated runs of at least ``min_words`` words."""
    lines = written(line_table(docs, key, text, min_words), "lines")
    suffixes, depth = ranked(lines, ["h1", "h2"], ["ahead", "behind"]), 1
    gone = [suffixes.where((F.col("ahead") == 1) & (F.struct("doc", "pos") != F.col("rank"))).select("doc", "pos")]
    windows = suffixes.where("ahead > 1").select("doc", "pos", F.col("ahead").alias("size")).unionByName(
        suffixes.where("behind > 1").select("doc", (F.col("pos") - F.col("behind") + 1).alias("pos"), F.col("behind").alias("size")))
    windows = written(windows.distinct(), "windows")
    longest = windows.agg(F.max("size")).head()[0] or 1
    while 2 * depth <= longest:
        right = suffixes.select("doc", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("right"))
        pairs = written(suffixes.select("doc", "pos", F.col("rank").alias("left")).join(right, ["doc", "pos"]), "pairs")
        if depth > 1:
            drop_written(suffixes)
        suffixes, depth = ranked(pairs, ["left", "right"], []), 2 * depth
        drop_written(pairs)
        gone.append(later_windows(windows, suffixes, depth).select(
            "doc", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")))
    marked = reduce(DataFrame.unionByName, gone).distinct()
    return written(marked.join(lines.select("doc", "pos", "line"), ["doc", "pos"]).groupBy("doc").agg(
        F.collect_set("line").alias("lines")), "gone")


WITHOUT = "text string, n_lines long, n_removed long"


def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, gone in parts:
        rows = []
        for text, marks in zip(texts, gone, strict=True):
            if text is None:
                rows.append((None, 0, 0))
                continue
            lines = text.split("\n")
            out = set() if marks is None else set(marks.tolist())
            kept = [line for i, line in enumerate(lines) if i not in out]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                          min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row: texts without the later copies."""
    gone = repeated_lines(docs, key, text, min_words)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("whole"))
    # one plan at every size: the marks grow with the data, so they are never sent to all tasks
    out = rows.join(gone.hint("merge"), "doc", "left").select("doc", F.pandas_udf(without, WITHOUT)("whole", "lines").alias("x"))
    return out.select(F.col("doc").alias("doc_id"), "x.text", "x.n_lines", "x.n_removed")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, with the later copies of repeated runs cut out of ``text``."""
    gone = repeated_lines(docs, key, text, min_words).select(
        F.col("doc").alias("__llm_doc"), F.col("lines").alias("__llm_lines"))
    joined = docs.join(gone.hint("merge"), F.col(key) == F.col("__llm_doc"), "left")
    return joined.withColumn(text, F.pandas_udf(without, WITHOUT)(text, "__llm_lines")["text"]).select(*docs.columns)
