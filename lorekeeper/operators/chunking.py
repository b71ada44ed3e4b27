"""Texts as overlapping windows of words or of an injected encoder's tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64


def chunk_texts(
    rows: DataFrame,
    keys: list[str],
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    encode: Callable[[str], list[int]] | None = None,
    decode: Callable[[list[int]], str] | None = None,
) -> DataFrame:
    """``keys``, chunk_index and text: windows of ``size`` tokens that start every ``size - overlap``.

    Windows go on until one would start past the last token, so the last may lie within
    the one before it.  A text without tokens has none.  Tokens are words, or with
    ``encode`` and ``decode`` what a tokenizer makes of the text; windows are made one by one in the task.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    if (encode is None) != (decode is None):
        raise ValueError("an encoder needs its decoder")
    step = size - overlap
    if encode is None:
        words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
        held = rows.select(*keys, words.alias("words")).where(F.size("words") > 0)
        starts = F.posexplode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step)))
        held = held.select(*keys, "words", starts.alias("chunk_index", "start"))
        return held.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.slice("words", F.col("start") + 1, size), " ").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                tokens = encode(batch["__text"].iloc[i])
                starts = range(0, len(tokens), step)
                if len(starts):
                    made = pd.DataFrame({"chunk_index": range(len(starts)), "text": [decode(tokens[s : s + size]) for s in starts]})
                    yield pd.concat([pd.DataFrame({k: [batch[k].iloc[i]] * len(starts) for k in keys}), made], axis=1)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "chunk_index long, text string"])
    return rows.select(*keys, F.coalesce(text, F.lit("")).alias("__text")).mapInPandas(run, schema)
