"""Writers of text: tables for bulk loads, review queues, and small frozen artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_pipe_text(df: DataFrame, path: str) -> None:
    """Pipe-separated lines without a header, null as nothing: what bulk loaders take."""
    df.write.mode("overwrite").csv(path, sep="|", nullValue="", emptyValue="", quote="")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_artifact(df: DataFrame, key: str, path: str, most: int = 100_000) -> None:
    """A JSON object of one record per key, in the order of keys, as one text file in the folder ``path``.

    For tables with a row per screen: the object is put together by the driver, so that more than ``most`` rows are refused.
    """
    rows = df.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no artifact")
    records = {str(r[key]): {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in rows}
    text = json.dumps(records, indent=1, sort_keys=True, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
