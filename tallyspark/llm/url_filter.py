"""Operator 1, URL filters: a trie over reversed host labels, then path segments.

Each node of the host trie holds the rules of one host and a trie of path segments; the part of a
rule's path behind its last slash is kept at the node as a string prefix. The walk goes down the
labels of a url's host from the right, so every rule that fits lies on one branch.

Precedence: the rule that names most of the host wins, then the longest path; between an allow and
a block entry of the same host and path, allow wins. No rule fits: ``default`` (allow).

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits
(a rule needs a host). Ports and user parts belong to the host, as written. Repeated rows are judged
one by one. Columns of other names, also clashing ones, are not read.

Size: rules are walked in blocks of at most ``RULES_PER_BLOCK``, so what one broadcast holds is bounded
however many rules there are; the best rule of all blocks wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_PER_BLOCK = 50_000
BLOCK, ALLOW = "block", "allow"
FOUND = "depth int, length int, allow boolean, rule string"

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[Rule]) -> dict:
    """Nested dictionaries: ``labels``, ``paths`` (by segment) and ``tails`` (longest first)."""
    root: dict = {"labels": {}}
    for verdict, host, path in rules:
        node, labels = root, host.lower().split(".")[::-1] if host else []
        for label in labels:
            node = node["labels"].setdefault(label, {"labels": {}})
        node = node.setdefault("paths", {"next": {}, "tails": []})
        *segments, tail = path.split("/")
        for segment in segments:
            node = node["next"].setdefault(segment, {"next": {}, "tails": []})
        node["tails"].append((tail, len(labels), len(path), verdict == ALLOW, host + path))
        node["tails"].sort(key=lambda t: (-len(t[0]), not t[3]))
    return root


def look_up(trie: dict, host: str, path: str) -> tuple | None:
    """(labels of the host, length of the path, allow, rule) of the best rule, or null."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")) if host else ():
        node = node["labels"].get(label)
        if node is None:
            break
        here, found = node.get("paths"), None
        for k, segment in enumerate(segments):
            if here is None:
                break
            # a tail is a prefix of one segment: what it matches may go on
            found = next((t[1:] for t in here["tails"] if segment.startswith(t[0])), found)
            here = here["next"].get(segment) if k + 1 < len(segments) else None
        best = found or best
    return best


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id",
               default: str = ALLOW) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row."""
    out = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = []
    for at in range(0, len(rules), RULES_PER_BLOCK):
        trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules[at:at + RULES_PER_BLOCK]))

        @F.pandas_udf(FOUND)
        def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            tree = trie.value  # noqa: B023 - bound when the function is made into a UDF below
            for hosts, paths in parts:
                rows = [look_up(tree, h, p) or (-1, -1, False, None) for h, p in zip(hosts, paths, strict=True)]
                yield pd.DataFrame(rows, columns=["depth", "length", "allow", "rule"])

        found.append(walk("host", "path"))
    if not found:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = F.greatest(*found) if len(found) > 1 else found[0]
    out = out.withColumn("best", best)
    return out.select(
        key, "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.rule").isNull(), default).when(F.col("best.allow"), ALLOW).otherwise(BLOCK)
        .alias("verdict"))
