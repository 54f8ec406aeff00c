"""What the physical plan of a DataFrame does: shuffles, joins, pushed filters and read columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def summary(df: DataFrame) -> dict[str, object]:
    text = physical(df)
    head = text.split("\n\n")[0]
    return {
        "exchanges": len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange \(", head)),
        "broadcasts": len(re.findall(r"BroadcastExchange \(", head)),
        "joins": sorted(re.findall(r"(\w+Join|CartesianProduct)", head)),
        "python": bool(re.search(r"Python|Pandas|Arrow", head)),
        "pushed": re.findall(r"PushedFilters: \[(.*?)\]", text),
        "read": re.findall(r"ReadSchema: struct<(.*?)>\n", text),
    }
