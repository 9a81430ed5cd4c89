"""Language identification by multilingual mixture inference.

Training sums hashed byte 3-grams of at most PER_LANGUAGE labelled documents of each language (a
bounded, documented sample, picked by a hash of the id); the model is one table of BINS
probabilities per language. For a document, expectation-maximisation estimates the proportions of
the languages that best explain its n-grams; then language sets are grown from the largest
proportion on, keeping a further language only while the penalised likelihood rises. Prediction
is a map over whole texts without a shuffle; the model broadcast has a fixed size per language.
More than MAX_LANGUAGES labelled languages raise ValueError, none is thinned or left out.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every
text when there is no labelled row; held_out is false and nothing is learned where the id is
null; rows may repeat, each is predicted by itself; of languages with equal proportions the first by
name is predicted; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import columns_as_row, discard, materialise, row_as_columns

BINS = 1 << 13
PER_LANGUAGE, MAX_LANGUAGES = 400, 200
SALTS = 32
SMOOTHING = 0.2
ROUNDS = 8
#: Weight of log(n) that each further language must gain in log-likelihood.
PENALTY = 6.0
ENTRIES = 1_000_000
UNDETERMINED = "und"
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def bins_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the 3-grams of a text's lower-cased letters; runs of blanks are left out."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0)
    x = raw.astype(np.uint32)
    code = ((x[:-2] * np.uint32(0x01000193) ^ x[1:-1]) * np.uint32(0x01000193) ^ x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(19)
    count = np.bincount(code, minlength=BINS)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def mixtures(p: np.ndarray, count: np.ndarray, ends: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document by expectation-maximisation.

    p: probabilities of each entry (document's n-gram) by language; ends: entry bounds of the
    documents; allowed: the languages each document may hold.
    """
    starts, sizes = ends[:-1], np.diff(ends)
    total = np.add.reduceat(count, starts)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        joint = p * np.repeat(share, sizes, axis=0)
        joint *= (count / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    likely = np.add.reduceat(count * np.log((p * np.repeat(share, sizes, axis=0)).sum(1)), starts)
    return share, likely


def infer(docs: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, proportion) of the main language of each document's selected set."""
    n, languages = len(docs), table.shape[1]
    ends = np.cumsum([0, *(len(d[0]) for d in docs)])
    p, count = table[np.concatenate([d[0] for d in docs])], np.concatenate([d[1] for d in docs])
    starts, sizes = ends[:-1], np.diff(ends)
    share, _ = mixtures(p, count, ends, np.ones((n, languages)))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros((n, languages))
    best[np.arange(n), order[:, 0]] = 1
    main = np.repeat(order[:, 0], sizes)
    value = np.add.reduceat(count * np.log(p[np.arange(len(p)), main]), starts)
    price = PENALTY * np.log(np.add.reduceat(count, starts) + 1)
    active = np.flatnonzero(share[np.arange(n), order[:, 0]] < 0.999)
    for size in range(2, languages + 1):
        if not len(active):
            break
        allowed = np.zeros((len(active), languages))
        np.put_along_axis(allowed, order[active, :size], 1, axis=1)
        entries = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in active])
        found, likely = mixtures(p[entries], count[entries], np.cumsum([0, *sizes[active]]), allowed)
        gain = likely - price[active] * (size - 1)
        better = gain > value[active]
        value[active] = np.where(better, gain, value[active])
        best[active[better]] = found[better]
        active = active[better]
    top = best.argmax(1)
    return top, best[np.arange(n), top]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their BINS x languages table of probabilities, from a bounded labelled sample."""
    first = [F.xxhash64("id"), F.col("id")]
    within, over = Window.partitionBy("lang", "salt").orderBy(*first), Window.partitionBy("lang").orderBy(*first)
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where((F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # in two steps, as one language may hold most rows
    ids = usable.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).alias("salt"))
    for w in (within, over):
        ids = ids.withColumn("k", F.row_number().over(w)).where(F.col("k") <= PER_LANGUAGE).drop("k")
    picked = materialise(ids.select("lang", "id"), "sample")
    if picked.select("lang").distinct().count() > MAX_LANGUAGES:
        discard(picked)
        raise ValueError(f"the labels have more than {MAX_LANGUAGES} languages")
    ids = picked.select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, n = bins_of(text.as_py())
                counts.setdefault(lang, np.zeros(BINS))[at] += n
        if counts:
            yield pa.RecordBatch.from_pydict({"lang": list(counts), "counts": [c.tobytes() for c in counts.values()]})

    sample = usable.join(F.broadcast(ids), "id", "left_semi").select("lang", "text")  # at most PER_LANGUAGE * MAX_LANGUAGES ids
    counts: dict[str, np.ndarray] = {}
    for r in sample.repartition(8).mapInArrow(run, "lang string, counts binary").toLocalIterator():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"])
    discard(picked)
    names = sorted(counts)
    if not names:
        return [], np.empty((BINS, 0))
    table = np.stack([counts[x] for x in names], axis=1) + SMOOTHING
    return names, table / table.sum(0)


def _judged(docs: DataFrame, lead: F.Column, id_col: str, text_col: str, lang_col: str, text: bool) -> DataFrame:
    """(row, lang_pred, score) of every row, and its text if asked for; lead: the struct `row`."""
    names, table = train(docs, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast((names, table))
    taken = docs.select(lead.alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = taken if text else taken.select("row")
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in batches:
            lang, score = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows
            held, where, entries = [], [], 0

            def settle():
                if held:
                    for i, k, s in zip(where, *(x.tolist() for x in infer(held, table)), strict=True):
                        lang[i], score[i] = names[k], min(max(s, 0.0), 1.0)
                held.clear()
                where.clear()

            for i, found in enumerate(b.column(1)):
                t = found.as_py()
                if names and has_letter(t) and len((grams := bins_of(t))[0]):
                    held.append(grams)
                    where.append(i)
                    entries += len(grams[0])
                    if entries * len(names) > ENTRIES:
                        settle()
                        entries = 0
            settle()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - 2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return taken.mapInArrow(run, schema)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    lead = F.struct(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"))
    return _judged(docs, lead, id_col, text_col, lang_col, False).select("row.doc_id", "row.held_out", "lang_pred", "score")


def determined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a determined language."""
    judged = _judged(docs, columns_as_row(docs, without=text_col), id_col, text_col, lang_col, True)
    kept = judged.where(F.col("lang_pred") != UNDETERMINED).select("row", F.col("text").alias(text_col))
    return kept.select(*row_as_columns(docs.columns, "row", without=text_col))
