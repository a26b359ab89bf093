"""Plug-in points for user code: an advisory model and a word-box provider.

Both run as Arrow-batched ``mapInPandas`` over an already filtered request table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ask(requests: DataFrame, fn: Callable[[str], str], key: str = "invoice_id") -> DataFrame:
    """requests(key, request JSON) → answers(key, json, error_class)."""
    # nested on purpose: the helper travels with the task, executors need no package install
    def answer(request: str) -> tuple[str | None, str | None]:
        try:
            return fn(request), None
        except ValueError:  # unusable output: the heuristic stands
            return None, None
        except ConnectionError:
            return None, "ConnectionError"
        except TimeoutError:
            return None, "TimeoutError"
        except Exception as exc:  # reported as data, never as a failed job
            return None, type(exc).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [answer(r) for r in batch["request"]]
            yield pd.DataFrame({key: batch[key], "json": [o[0] for o in out],
                                "error_class": [o[1] for o in out]})
    return requests.select(key, "request").mapInPandas(
        run, f"{key} {dict(requests.dtypes)[key]}, json string, error_class string")


def provide_words(files: DataFrame, fn: Callable[[str, bytes], pd.DataFrame]) -> DataFrame:
    """files(doc_id, path, content) → word rows by user code; a failing file yields no words."""
    columns = ["doc_id", "page_number", "index", "text", "x", "y", "width", "height"]
    schema = ("doc_id string, page_number int, index int, text string, x double, y double,"
              " width double, height double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, path, content in zip(batch["doc_id"], batch["path"], batch["content"]):
                try:
                    words = fn(path, content)
                except (OSError, ValueError, RuntimeError):
                    continue
                yield words.assign(doc_id=doc_id)[columns]
    return files.select("doc_id", "path", "content").mapInPandas(run, schema)
