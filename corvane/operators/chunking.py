"""Sections and overlapping token windows, as spans of the source text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X

#: A tokenizer gives the pieces of each text of an array: each token with the white space before it, so that joined
#: pieces are the text up to its trailing white space.
Tokenizer = Callable[[Column], Column]


def words(texts: Column) -> Column:
    """Pieces of word and punctuation tokens, the default tokenizer."""
    return F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("\\s*(?:\\w+|[^\\w\\s])"), F.lit(0)))


def from_file(path: str) -> Tokenizer:
    """Pieces by a tokenizer file that every executor can read; special tokens' strings are ordinary text."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer as Tokens

        tokens = Tokens.from_file(path)
        tokens.encode_special_tokens = True

        def cut(text: str) -> list[str]:
            # where the bytes of one character are several tokens, its text stands with the first
            at, out = 0, []
            for _, end in tokens.encode(text, add_special_tokens=False).offsets:
                out.append(text[at : max(at, end)])
                at = max(at, end)
            return out

        for part in parts:
            yield part.map(lambda texts: [cut(t or "") for t in texts])

    return lambda texts: pieces(texts)


def count_tokens(text: Column, tokenizer: Tokenizer = words) -> Column:
    """How many tokens a text has; null has none."""
    return F.size(F.get(tokenizer(F.array(F.coalesce(text, F.lit("")))), F.lit(0)))


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 512
    overlap: float = 0.15
    least: int = 64

    def __post_init__(self):
        if self.target <= 0 or not 0 <= self.overlap < 1 or not 0 <= self.least <= self.target:
            raise ValueError("target > 0, 0 <= overlap < 1, 0 <= least <= target")

    @property
    def step(self) -> int:
        return self.target - int(self.target * self.overlap)


def windows(text: Column, pieces: Column, config: ChunkConfig) -> Column:
    """Array of (start, stop, n): the token windows of a text as spans of it; the last one ends with the text."""
    n = F.size(pieces)
    last = F.greatest(F.lit(0), F.ceil((n - config.target) / F.lit(float(config.step)))).cast("int")
    length = lambda i, count: F.char_length(F.array_join(F.slice(pieces, i * config.step + 1, F.lit(count)), ""))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,n:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        stop = F.when(i == last, F.char_length(text)).otherwise(s["at"] + length(i, config.target))
        window = F.struct(s["at"].alias("start"), stop.alias("stop"), F.least(n - i * config.step, F.lit(config.target)).alias("n"))
        return F.struct((s["at"] + length(i, config.step)).alias("at"), F.concat(s["out"], F.array(window)).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), last), begin, step, lambda s: s["out"])).otherwise(begin["out"])


def chunk_text(docs: DataFrame, config: ChunkConfig = ChunkConfig(), tokenizer: Tokenizer = words, key: str = "doc_id", fixed: bool = False) -> DataFrame:
    """(key, ordinal, section, text, token_count, char_start, char_end) of ``docs`` (key, text), without a shuffle.

    Sections are cut by themselves; a window of fewer than ``least`` tokens gives no chunk and takes no ordinal.  The
    text is the span of the source; offsets are code points.  Null and empty texts give none.  ``fixed``: see
    :func:`corvane.functions.text.sections`.
    """
    part = docs.where("text <> ''").select(key, "text", X.sections(F.col("text"), fixed).alias("spans"))
    bodies = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"]))
    part = part.withColumn("bodies", bodies)
    part = part.withColumn("pieces", tokenizer(F.col("bodies")))

    def cut(z: Column) -> Column:
        span = z["spans"]
        return F.transform(windows(z["bodies"], z["pieces"], config), lambda w: F.struct(span["section"].alias("section"), w["n"].alias("token_count"), (span["start"] + w["start"]).alias("char_start"), (span["start"] + w["stop"]).alias("char_end")))

    found = F.filter(F.flatten(F.transform(F.arrays_zip("spans", "bodies", "pieces"), cut)), lambda c: c["token_count"] >= config.least)
    part = part.select(key, "text", found.alias("found")).select(key, "text", F.posexplode("found").alias("ordinal", "c"))
    return part.select(key, "ordinal", "c.section", F.substring("text", F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start")).alias("text"), "c.token_count", "c.char_start", "c.char_end")


def chunk_html(pages: DataFrame, config: ChunkConfig = ChunkConfig(), tokenizer: Tokenizer = words, key: str = "page_id", fixed: bool = False) -> DataFrame:
    """:func:`chunk_text` of the plain text of ``pages`` (key, html)."""
    return chunk_text(pages.select(key, X.html_to_text(F.col("html")).alias("text")), config, tokenizer, key, fixed)
