"""Language identification in two steps: the language family first, then one-versus-one linear support vector
machines between the languages of that family.

Features are hashed byte trigrams and single bytes of the lower-cased text, with everything in ASCII that is not
a letter read as a space; counts over the whole text, as square roots of shares, so every text has length one.
Models are linear with squared hinge loss, fitted on a bounded sample: at most ``per_language`` labelled rows of
each language, those with the smallest hash of their id. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.store import cut, free

# ISO 639-1 codes by family; a code that is not listed is in the family "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sd", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "austronesian": ("id", "jv", "mg", "ms", "su", "tl"),
    "tai": ("lo", "th"),
    "austroasiatic": ("km", "vi"),
    "hellenic": ("el",),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNDETERMINED = "und"
TRIGRAMS = 1 << 12
SIZE = TRIGRAMS + 256
#: ASCII letters in lower case, other ASCII as a space, the rest as it is
READ = np.array([(b | 32) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256)], np.uint8)


def lettered(text: str) -> bool:
    """Whether a character is a letter (Unicode's categories L); raised, circled and broken numbers are none."""
    return any(map(str.isalpha, text))


def features(text: bytes) -> np.ndarray:
    """The feature vector of a lower-cased text; its length is one."""
    b = READ[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = b.astype(np.uint32)
    g = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    blank = (x[:-2] == 32) & (x[1:-1] == 32)  # runs of spaces say nothing
    counts = np.bincount((g >> np.uint32(20))[~blank], minlength=TRIGRAMS).astype(np.float32)
    single = np.bincount(b[b != 32], minlength=256).astype(np.float32)
    out = np.concatenate([counts / (2 * max(1.0, counts.sum())), single / (2 * max(1.0, single.sum()))])
    return np.sqrt(out)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights with a bias at the end: squared hinge loss, y in -1 and 1, classes weighted alike; accelerated
    gradient descent from zero, so the outcome is the same each time."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (2 * float((weight * (x * x).sum(1)).sum()) + penalty)
    w = last = np.zeros(x.shape[1], np.float32)
    for k in range(1, steps + 1):
        at = w + (k - 1) / (k + 2) * (w - last)
        loss = np.maximum(0, 1 - y * (x @ at))
        last, w = w, at - step * (penalty * at - 2 * ((weight * loss * y) @ x))
    return w


class Model:
    """A family decision and, within families, one machine per pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs, object)
        family = np.array([FAMILY_OF.get(code, "other") for code in langs], object)
        self.stages = {"": self.pairs(x, family)}
        for f in sorted(set(family)):
            self.stages[f] = self.pairs(x[family == f], lang[family == f])
        #: the lowest score of a text that was learned from
        self.lowest = min(self.predict(row)[1] for row in x)

    @staticmethod
    def pairs(x: np.ndarray, label: np.ndarray):
        """(names, pairs, weights by column): names in order, so the first of equals is the smallest."""
        names = sorted(set(label))
        pairs = list(combinations(range(len(names)), 2))
        w = [fit(x[(p := label == names[a]) | (label == names[b])], np.where(p, 1.0, -1.0)[p | (label == names[b])].astype(np.float32)) for a, b in pairs]
        return names, pairs, np.array(w, np.float32).T if w else None

    def decide(self, stage: str, x: np.ndarray) -> tuple[str, float]:
        names, pairs, w = self.stages[stage]
        if w is None:
            return names[0], 1.0
        margin = x @ w[:-1] + w[-1]
        won, total, worst = [0] * len(names), [0.0] * len(names), [np.inf] * len(names)
        for (a, b), m in zip(pairs, margin.tolist(), strict=True):
            won[a if m >= 0 else b] += 1
            for k, s in ((a, m), (b, -m)):
                total[k] += s
                worst[k] = min(worst[k], s)
        best = max(range(len(names)), key=lambda k: (won[k], total[k], -k))
        return names[best], float(1 / (1 + np.exp(-4 * np.clip(worst[best], -20, 20))))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = self.decide("", x)
        lang, surer = self.decide(family, x)
        return lang, sure * surer


PARTS = 32  # in which a language's sample is drawn first


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.encode()).astype(np.float16).tobytes() for t in pc.utf8_lower(b.column(1)).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Model | None:
    """Fits on labelled rows whose crc32 of the id as text is not 2 modulo 4; None without any. ``per_language``
    bounds the sample, so what reaches the driver is 8.5 kB times that for each language."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    open_rows = d.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    open_rows = open_rows.withColumn("version", F.xxhash64("text"))
    draw = ["doc_id", "version", "lang"]
    ids = open_rows.select(draw).withColumn("draw", F.xxhash64("doc_id"))
    for part in ([F.col("lang"), F.pmod(F.col("version"), F.lit(PARTS))], [F.col("lang")]):  # so that no task sees more than PARTS samples of a language
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("draw", "doc_id", "version"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    ids = cut(ids.select(draw).distinct())  # ``per_language`` rows a language
    chosen = open_rows.join(F.broadcast(ids), draw, "left_semi").dropDuplicates(draw)
    rows = chosen.select("doc_id", "text", "lang").mapInArrow(sample_features, "doc_id long, lang string, x binary").collect()
    free(ids)
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.x))
    return Model(np.array([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32), [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns named in ``keep``, for each row of ``docs``.

    Only the text is looked at, and all of it. A null or empty text, or one without any letter, is ``und`` with
    score 0; so is every text if nothing was learned. score is the weaker side's probability, from 0 to 1. Equal
    votes and margins go to the smaller name. Null ids stay null; repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs[c].alias(f"keep_{k}") for k, c in enumerate(keep)]
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select([f"keep_{k}" for k in range(len(keep))]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for t in pc.utf8_lower(b.column(1)).to_pylist():
                known = m is not None and t is not None and lettered(t)
                out.append(m.predict(features(t.encode())) if known else (UNDETERMINED, 0.0))
            cols = [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["doc_id", "lang_pred", "score", *b.schema.names[2:]])

    out = d.mapInArrow(run, "doc_id long, lang_pred string, score double" + (", " + fields if keep else ""))
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
