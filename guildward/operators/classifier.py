"""A pluggable classifier over messages that no signal decides at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guildward.operators.identity import common_key
from guildward.operators.signals import immediate

SCORES = "{key} {kind}, status string, label string, confidence double, violation_probability double, probabilities map<string,double>"


def classify(messages: DataFrame, signals: DataFrame, evaluate: Callable[[str, bool], dict | None]) -> DataFrame:
    """SCORES of messages (message_id, or ROW_KEY if signals have it too, and plain_text). evaluate(text, sensitive_matched) gives a row's values.

    A result that fails to come, for whatever reason, is as good as none: the
    message has no row, and its signals go on without the classifier.
    """
    key = common_key(messages, signals)
    kind = messages.schema[key].dataType.simpleString()
    sensitive = signals.where("needs_ai").select(key).distinct().withColumn("sensitive", F.lit(True))
    asked = messages.join(immediate(signals, key), key, "left_anti").join(sensitive, key, "left")
    asked = asked.select(key, "plain_text", F.coalesce("sensitive", F.lit(False)).alias("sensitive"))
    names = ["status", "label", "confidence", "violation_probability", "probabilities"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for message, body, matched in zip(f[key], f["plain_text"], f["sensitive"], strict=True):
                try:
                    got = evaluate(body, bool(matched))
                except Exception:  # noqa: BLE001  any failure of a foreign classifier counts as no result
                    got = None
                if got and got.get("status") != "skipped":
                    rows.append((message, *(got.get(n) for n in names)))
            yield pd.DataFrame(rows, columns=[key, *names])

    return asked.mapInPandas(run, SCORES.format(key=key, kind=kind))
