"""Calls of outside models, a batch at a time, from the executors: analysis of prompts, transcription, detection."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.session import ship_package


def within(seconds: float, call: Callable[[list], list[str]], values: list) -> list[str]:
    """call(values), or a TimeoutError after so many seconds; what hangs is left to a thread that ends with its worker."""
    done: list[tuple] = []

    def run() -> None:
        try:
            done.append((call(values), None))
        except Exception as e:
            done.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise TimeoutError(f"no reply in {seconds} s")
    replies, error = done[0]
    if error:
        raise error
    return replies


def with_provider(rows: DataFrame, column: str, provider: Callable[[list], list[str]], out: str = "reply", retries: int = 2, wait: float = 0.5, partitions: int | None = None, seconds: float = 120.0) -> DataFrame:
    """rows with the provider's reply to each value of column, and null where it fails, or takes more than `seconds` for a
    batch, `retries` times again. provider takes a list and returns as many strings; it is pickled to the workers.
    partitions bounds how many calls run at once."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            for turn in range(retries + 1):
                try:
                    yield pd.Series(within(seconds, provider, values), dtype=object)
                    break
                except Exception:
                    if turn == retries:
                        yield pd.Series([None] * len(values), dtype=object)
                    else:
                        time.sleep(wait * 2**turn)

    rows = rows.repartition(partitions) if partitions else rows
    return rows.withColumn(out, ask(F.col(column)))


def analysis_of(reply: str = "reply") -> list:
    """The eight fields of a reply's JSON object, read as text, then cast. A missing field has its default; a reply without
    a JSON object is to be reviewed, at 50. A flag is true by the value's own kind: any text but the empty one is, "false"
    too; null, 0 and empty lists and objects are false."""
    from noteforge.functions import arrow

    json = arrow.json_object_span(F.col(reply))
    get = lambda k: F.get_json_object(json, f"$.{k}")

    def truthy(k: str, other: bool) -> Column:
        at = F.try_variant_get(F.try_parse_json(json), f"$.{k}", "variant")
        value = F.when(F.schema_of_variant(at) == "STRING", get(k) != "").otherwise(~get(k).isin("0", "0.0", "-0", "-0.0", "[]", "{}", "false"))
        return F.when(at.isNull(), other).when(F.is_variant_null(at), False).otherwise(F.coalesce(value, F.lit(other))).alias(k)

    strings = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")).alias(k)
    return [
        F.coalesce(get("quality_score").try_cast("double"), F.lit(50.0)).alias("quality_score"),
        F.when(json.isNull(), "review").otherwise(F.coalesce(get("suggested_action"), F.lit("keep"))).alias("suggested_action"),
        F.when(json.isNull(), "Error parsing LLM response").otherwise(F.coalesce(get("reasoning"), F.lit(""))).alias("reasoning"),
        truthy("has_framework", False),
        truthy("is_valuable", True),
        strings("primary_topics"),
        get("framework_description").alias("framework_description"),
        strings("key_questions"),
    ]
