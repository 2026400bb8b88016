"""Token counts by a map-side two-tier lookup.

A subword BPE of this kind has no piece that holds a non-space followed by a space mark, so no merge crosses the start of a
run of spaces: a text's token count is the sum over its pre-tokens (a run of spaces with the word after it). Tier one is a
broadcast table of the lengths of the corpus's frequent pre-tokens; tier two encodes a miss with the library and keeps its
length in a bounded cache that lives as long as the Python worker. Pre-tokens are never shuffled: each partition gives one
row, its bounded summary of frequent ones, and these rows are merged.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import column, kept, map_batches, map_rows, texts

PRETOKEN = re.compile(" +[^ ]*")
#: Entries of the broadcast table, and of each partition's summary: a table of 32,768 words is about 1 MB.
TABLE_ROWS, SUMMARY_ROWS = 32_768, 8_192
#: Distinct pre-tokens that a partition counts at once before it forgets the rarest, cached lengths in a worker, and the
#: longest pre-token kept in either.
COUNTED, CACHED, LONGEST = 200_000, 200_000, 48
#: Summaries that are merged at once.
MERGED = 32


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; the library puts one space before any text but the empty one, and reads U+2581 as a space."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Pre-token to number of tokens: filled with tier one, asks the library on a miss."""

    def __init__(self, model: bytes, known: dict[str, int] | None = None):
        import sentencepiece

        super().__init__(known or {})
        self.encoder, self.tier_one, self.older, self.misses = sentencepiece.SentencePieceProcessor(model_proto=model), known or {}, {}, 0

    def __missing__(self, pretoken: str) -> int:
        n = self.older.get(pretoken)
        if n is None:
            # The library adds the first space itself; a lone space is the one piece that this can't ask for.
            n = 1 if pretoken == " " else len(self.encoder.encode(pretoken[1:], num_threads=1))
        if len(pretoken) <= LONGEST:
            if self.misses >= CACHED:  # what was not asked for since the last time is let go
                self.older = dict(self)
                self.clear()
                self.update(self.tier_one)
                self.misses = 0
            self.misses += 1
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))


def frequent_pretokens(docs: DataFrame, text: str = "text", rows: int = TABLE_ROWS) -> list[str]:
    """The corpus's most frequent pre-tokens, from one bounded summary for each partition (counts are lower bounds).

    Summaries are merged ``MERGED`` at a time, each a single row: no pre-token is a key of any shuffle.
    """
    most = lambda found, n: heapq.nlargest(n, ((k, w) for w, k in found.items()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for x in texts(batch, text):
                found.update(pretokens(x))
                if len(found) > COUNTED:
                    found = Counter(dict(heapq.nlargest(COUNTED // 4, found.items(), key=lambda kv: kv[1])))
        top = most({w: n for w, n in found.items() if len(w) <= LONGEST}, SUMMARY_ROWS)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "pretokens": pa.array([[w for _, w in top]], pa.list_(pa.string())), "counts": pa.array([[n for n, _ in top]], pa.list_(pa.int64()))})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: Counter[str] = Counter()
        for words, counts in zip(pdf["pretokens"], pdf["counts"], strict=True):
            for w, n in zip(words, counts, strict=True):
                found[w] += int(n)
        top = most(found, rows)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // MERGED], "pretokens": [[w for _, w in top]], "counts": [[n for n, _ in top]]})

    schema = "part long, pretokens array<string>, counts array<long>"
    found, parts = map_batches(docs.select(text), summary, schema), max(docs.rdd.getNumPartitions(), 2)
    while parts > 1:
        found, parts = found.groupBy(F.floor(F.col("part") / MERGED)).applyInPandas(merge, schema), -(-parts // MERGED)
    return [w for r in found.collect() for w in r["pretokens"]][:rows]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, n_tokens``.

    Counts equal the library's for the whole text, without added tokens. Null and empty texts count 0 bytes and 0 tokens; repeated
    rows give repeated rows; an empty table gives none; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    lengths, key = Lengths(model), uuid.uuid4().hex
    tier_one = spark.sparkContext.broadcast((model, {w: lengths[w] for w in frequent_pretokens(docs, text, table_rows)}))

    def per_batch(batch: pa.RecordBatch) -> dict:
        count = kept(key, lambda: Lengths(*tier_one.value)).count
        return {
            id_col: column(batch, id_col),
            "n_bytes": pc.fill_null(pc.binary_length(pc.cast(column(batch, text), pa.binary())), 0).cast(pa.int64()),
            "n_tokens": [count(x) for x in texts(batch, text)],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text), per_batch, f"`{id_col}` {kind}, n_bytes long, n_tokens long", key)
