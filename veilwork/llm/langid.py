"""Language identification by prediction by partial matching.

Each language gets a tree of byte contexts up to three bytes long, counted on labelled texts. A byte is predicted in
the longest context the language knows; a byte never seen there costs an escape (method C: distinct / (total +
distinct)) and is predicted in the context shorter by one, down to the even chance of 1 / 256. The statistics are
frozen after training, so the code length of a byte depends on its context alone: all code lengths are put into one
table, and the exact code length of a text under every language is a sum of table entries. The language with the
shortest code wins; the score is its share of 2^-length over all languages.

Training takes at most ``train_docs`` labelled documents per language (those of the smallest keyed hash), whole texts;
contexts of three bytes seen once are left out, which bounds the table. Everything else runs over all texts.

Texts are lower-cased. Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing
was learned. Ties go to the language first in order. Repeated rows are predicted each by itself. Other columns are not
looked at, and neither are language, source or id when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from veilwork.llm.common import cell

TRAIN_DOCS = 500
ORDER = 3
#: Bytes of a text scored at a time.
PIECE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the lower-cased texts end to end, and where each text begins (with the end at last)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _before(codes: np.ndarray, begins: np.ndarray, at: int, end: int) -> list[np.ndarray]:
    """The codes one, two and three places before each place of [at, end); 0 before a text's beginning."""
    out = []
    lo, hi = np.searchsorted(begins, [at - ORDER, end])
    near = begins[lo:hi]
    for back in range(1, ORDER + 1):
        prev = np.zeros(end - at, codes.dtype)
        skip = max(0, back - at)
        prev[skip:] = codes[at + skip - back : end - back]
        for k in range(back):
            place = near + k - at
            prev[place[(place >= 0) & (place < end - at)]] = 0
        out.append(prev)
    return out


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of four bytes occurs, with zeros before a text's beginning."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, begins = _lowered(batch.column(1).filter(pa.array(langs == lang)))
                grams: dict[int, int] = {}
                for at in range(0, len(data), PIECE):
                    end = min(len(data), at + PIECE)
                    b1, b2, b3 = (x.astype(np.uint32) for x in _before(data, begins, at, end))
                    codes, n = np.unique(b3 << 24 | b2 << 16 | b1 << 8 | data[at:end], return_counts=True)
                    for c, k in zip(codes.tolist(), n.tolist()):
                        grams[c] = grams.get(c, 0) + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"]
                )

    return labelled.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits for every context and next byte, a column per language."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        used = sorted({int(b) for codes, _ in grams.values() for b in np.unique(codes & 255)} - {0})
        self.symbol = np.full(256, len(used) + 1, np.int64)  # the last symbol stands for any byte never seen
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.symbol[0] = 0
        s = self.size = len(used) + 2
        keys = []  # per language and order: contexts, next symbols, counts
        for lang in self.langs:
            codes, n = grams[lang]
            c = [self.symbol[codes >> shift & 255] for shift in (24, 16, 8, 0)]
            keys.append([(sum(c[4 - 1 - j] * s ** (j - 1) for j in range(1, k + 1)) if k else np.zeros(len(n), np.int64), c[3], n) for k in range(ORDER + 1)])
        rows = np.zeros((1, s, len(self.langs)))
        spot = np.zeros(1, np.int64)  # row of each context of the order below
        tables = []
        count = 0
        for k in range(ORDER + 1):
            seen = []
            for lang in range(len(self.langs)):
                ctx, _, n = keys[lang][k]
                known, at = np.unique(ctx, return_inverse=True)
                seen.append(known[np.bincount(at, n) > (1 if k == ORDER else 0)])
            contexts = np.unique(np.concatenate(seen))
            lower = np.full((len(contexts), s, len(self.langs)), 1 / 256) if k == 0 else rows[spot[contexts % s ** (k - 1)]]
            now = lower.copy()
            for lang in range(len(self.langs)):
                ctx, nxt, n = keys[lang][k]
                counts = np.zeros((len(contexts), s))
                at = np.searchsorted(contexts, ctx)
                fits = (at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == ctx)
                np.add.at(counts, (at[fits], nxt[fits]), n[fits])
                total = counts.sum(axis=1, keepdims=True)
                kinds = (counts > 0).sum(axis=1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    p = np.where(counts > 0, counts, kinds * lower[:, :, lang]) / (total + kinds)
                now[:, :, lang] = np.where(total > 0, p, lower[:, :, lang])
            wider = np.tile(spot, s) if k else np.zeros(1, np.int64)
            wider[contexts] = count + np.arange(len(contexts))
            tables.append(now)
            count += len(contexts)
            spot, rows = wider, np.concatenate(tables)
        self.spot = spot.astype(np.int32)
        self.bits = (-np.log2(rows)).astype(np.float32).reshape(-1, len(self.langs))

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        data, offsets = _lowered(texts)
        out = np.zeros((len(texts), len(self.langs)))
        begins = offsets[:-1]
        for at in range(0, len(data), PIECE):
            end = min(len(data), at + PIECE)
            lead = max(0, at - ORDER)
            codes = self.symbol[data[lead:end]].astype(np.int32)
            b1, b2, b3 = _before(codes, begins - lead, at - lead, end - lead)
            row = self.spot[(b3 * self.size + b2) * self.size + b1]
            bits = self.bits[row * self.size + codes[at - lead :]]
            first = int(np.searchsorted(offsets, at, side="right")) - 1
            last = int(np.searchsorted(offsets, end, side="left"))
            owners = np.arange(first, last)
            cuts = np.clip(offsets[first:last], at, end) - at
            full = offsets[first + 1 : last + 1] > offsets[first:last]  # empty texts have no sum
            out[owners[full]] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.float64)
        return out

    def predict(self, texts: pa.Array) -> pa.StructArray:
        bits = self.lengths(texts)
        best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
        share = 1 / np.exp2(np.minimum(0, bits[np.arange(len(bits)), best][:, None] - bits)).sum(axis=1)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names = np.array([*self.langs, "und"], object)[np.where(letters, best, len(self.langs))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))], names=["lang", "score"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model from a bounded sample of (doc_id, text, lang); None without labelled text."""
    known = docs.where("lang IS NOT NULL")
    # one row per language; the share of it whose hashes hold about twice the sample, so that few texts are moved
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, 2 * train_docs / n))])[F.col("lang")]
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    some = known.where((mark < share) & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_docs).select("lang", "text")
    rows = count_grams(sample).toArrow()
    if not rows.num_rows:
        return None
    langs = np.array(rows["lang"].to_pylist(), object)
    codes, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    return Model({lang: (codes[langs == lang], n[langs == lang]) for lang in set(langs)})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score; learned from the documents not held out."""
    slim = docs.select(cell(id_col).alias("doc_id"), cell(text_col).alias("text"), cell(lang_col).cast("string").alias("lang"))
    model = train(slim.where(~held_out(F.col("doc_id"))), train_docs)
    if model is None:
        return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        return model.predict(texts)  # the model travels with the function, which Spark broadcasts

    found = slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
