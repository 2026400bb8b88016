"""Language identification by compression.

For every language a raw-content dictionary is gathered from labelled text; a text is encoded piece by piece with each
dictionary, and the language whose dictionary makes it smallest is chosen. A choice whose margin over the next language is
narrow is rejected.
"""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import column, kept, map_rows

UNKNOWN = "und"
#: Labelled texts sampled for each language (as expected from a hash of the text), and the characters taken from each of
#: them at a place that the hash picks: dictionaries have about 128 KB.
TEXTS_PER_LANG, CHARS_PER_TEXT = 384, 384
#: Languages that are learned at most: each costs an encoder in every worker.
LANGUAGES = 256
#: Bytes of a text that are encoded at once, so that the dictionary and not the text's own start explains each piece.
PIECE = 4096
LEVEL = 3
#: A text of up to SHORT bytes is encoded behind each PART of CONTEXT bytes of the language that its dictionary lacks, and
#: counts as the bytes that it adds: alone it has too few letters for codes of its own.
SHORT, CONTEXT, PART = 512, 8192, 1024
#: Smallest margin (bytes saved over the next language, as a share) that is not rejected, and the score's bytes per nat.
MARGIN, SOFTNESS = 0.004, 2.0


def fit_dictionaries(labelled: DataFrame, *, text: str = "text", lang: str = "lang", texts_per_lang: int = TEXTS_PER_LANG, chars: int = CHARS_PER_TEXT, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each of the ``languages`` that have most different texts in ``labelled`` (ties by name); the others aren't learned.

    Rows with null text or language count for nothing. Equal texts of a language count once, however often they stand there.
    A language whose texts are few or none by the draw has the text of the least hash in any case.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null and t <> ''")
    rows = rows.withColumn("k", F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13))
    most = rows.groupBy("l").agg(F.approx_count_distinct("k", 0.02).alias("n"), F.min("k").alias("low")).orderBy(F.desc("n"), "l").limit(languages)
    counts = {r[0]: (r[1], r[2]) for r in most.collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, (n, _) in sorted(counts.items()) for x in (k, min(1.0, texts_per_lang / n))])
    least = F.create_map(*[F.lit(x) for k, (_, low) in sorted(counts.items()) for x in (k, low)])
    place = (F.col("k") * 1e6 % 1 * (F.greatest(F.length("t") - chars, F.lit(0)) + 1)).cast("int") + 1
    drawn = (F.col("k") < share[F.col("l")]) | (F.col("k") == least[F.col("l")])
    sample = rows.where(drawn).select("l", "k", F.substring("t", place, F.lit(chars)).alias("s")).distinct()
    found: dict[str, list[tuple]] = {}
    for r in sample.collect():
        found.setdefault(r["l"], []).append((r["k"], r["s"]))
    return {k: letters(" ".join(s for _, s in sorted(found[k]))) for k in sorted(found)}


#: All but letters separates words.
GAP = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The whole text's words, lower-case, one space between them: punctuation and digits say nothing of a language."""
    return GAP.sub(" ", text.lower()).encode()


class Classifier:
    """Encoders with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.encoders = []
        for lang, content in dictionaries.items():
            content = content.ljust(16)
            context, content = content[-min(CONTEXT, len(content) // 2) :], content[: -min(CONTEXT, len(content) // 2)]
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            encode = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            parts = [context[i : i + PART] for i in range(0, len(context), PART)]
            self.encoders.append((lang, encode, parts, sum(len(encode(p)) for p in parts)))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(bytes, language) of the whole text, smallest first, ties by language."""
        data = letters(text)
        if len(data) <= SHORT:
            return sorted((max(sum(len(encode(p + data)) for p in parts) - alone, 0), lang) for lang, encode, parts, alone in self.encoders)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return sorted((sum(len(encode(p)) for p in pieces), lang) for lang, encode, _, _ in self.encoders)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if not text or not self.encoders or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best, lang = sizes[0]
        score = 1 / sum(math.exp(-min((n - best) / SOFTNESS, 700)) for n, _ in sizes)
        margin = (sizes[1][0] - best) / max(sizes[1][0], 1) if len(sizes) > 1 else 1.0
        return lang, score, margin, margin < MARGIN


def identify(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", keep: list[str] | None = None, model: dict[str, bytes] | None = None) -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred, score, margin, rejected``.

    ``train`` picks the rows whose ``lang`` may be learned from. The score is the softmax share of the chosen language over
    the encoded sizes. Null and empty texts, and texts with no letter, get ``und``, score 0 and are rejected; so does every
    text if there is nothing to learn from. With one language its margin is 1. Repeated rows give repeated, equal rows; an
    empty table gives none. Result names that ``keep`` already has are refused.
    """
    keep = keep if keep is not None else [c for c in docs.columns]
    clash = {"lang_pred", "score", "margin", "rejected"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    dictionaries = model if model is not None else fit_dictionaries(docs.where(train), text=text, lang=lang)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(dictionaries)

    def per_batch(batch: pa.RecordBatch) -> dict:
        classify = kept(key, lambda: Classifier(sent.value))
        found = [classify(x) for x in column(batch, text).to_pylist()]
        named = dict(zip(("lang_pred", "score", "margin", "rejected"), zip(*found), strict=True)) if found else dict.fromkeys(("lang_pred", "score", "margin", "rejected"), [])
        return {c: column(batch, c) for c in keep} | {k: list(v) for k, v in named.items()}

    source = docs.select(*dict.fromkeys([*keep, text]))

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_rows(source, per_batch, schema, key)
