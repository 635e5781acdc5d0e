"""Language identification by nearest centroid.

A text becomes a TF-IDF vector over hashed byte trigrams (1 + log tf, times idf, scaled to length 1). Each
language has several centroids, found by spherical k-means among its training vectors. A text gets the
language of the centroid with the largest cosine; it is rejected when that cosine distance is beyond what
the language's own training texts show, or when the text has no letter.

Only the fit sees a sample: at most `max_train` labelled texts, drawn evenly over the languages by a hash of
the id. Prediction reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, pick, position, slices, texts

BUCKETS = 1 << 13
MAX_TRAIN = 1600
CENTROIDS = 4
#: A text is rejected below SLACK times the similarity that all but the share QUANTILE of its language's training texts
#: reach: one odd labelled text doesn't set the floor for all.
SLACK, QUANTILE = 0.35, 0.01
UND = "und"
#: ASCII other than letters becomes a space, A-Z lower case; bytes of other scripts stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NO_LETTERS = bytes(b for b in range(128) if b not in _LETTERS)


def has_letter(text: bytes) -> bool:
    rest = text.translate(None, _NO_LETTERS)  # ASCII letters and bytes of other scripts
    if not rest:
        return False
    return not rest.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))) or any(b < 128 for b in rest)


def counts(text: bytes) -> np.ndarray:
    """How often each hashed trigram occurs; long texts are counted piece by piece."""
    out = np.zeros(BUCKETS, np.int64)
    folded = b" " + text.translate(FOLD) + b" "
    step = 1 << 20
    for i in range(0, len(folded) - 2, step):
        a = np.frombuffer(folded, np.uint8, min(step + 2, len(folded) - i), i).astype(np.uint32)
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        code = code[code != 0x202020] * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """langs[i] and floors[i] belong to centroids[i]; idf has one weight a bucket."""

    langs: tuple[str, ...]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32)
        return _unit(w * self.idf)

    def predict(self, many: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and rejection of each text."""
        n = len(many)
        lettered = [t is not None and has_letter(t) for t in many]
        if not self.langs:
            return [UND] * n, np.zeros(n), np.ones(n, bool)
        v = self.vectors(np.array([counts(t) if ok else np.zeros(BUCKETS, np.int64) for t, ok in zip(many, lettered)]).reshape(n, BUCKETS))
        cosine = v @ self.centroids.T
        best = cosine.argmax(axis=1) if n else np.zeros(0, int)
        score = np.clip(cosine[np.arange(n), best], 0, 1).astype(float)
        rejected = ~np.array(lettered, bool) | (score < self.floors[best])
        return [self.langs[i] if ok else UND for i, ok in zip(best, lettered)], np.where(lettered, score, 0.0), rejected


def held_out():
    """Whether the row of a doc_id is kept out of training: crc32 of it as text, mod 4, is 2; a null id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from spread-out rows; deterministic."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[own == i].sum(axis=0)) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, clusters: int = CENTROIDS) -> Model:
    """Learn from the rows of df with text and language that `held_out` doesn't keep back.

    At most `max_train` texts, as many of each language; their trigram counts (sparse, at most BUCKETS
    numbers each) are what reaches the driver. No such rows: a model that rejects everything.
    """
    labelled = pick(df, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null").withColumn("held", held_out()).where("not held")
    rows = labelled.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").where("text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_train).collect()}
    each = max(1, max_train // max(1, len(sizes)))
    if not sizes:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros(0), np.ones(BUCKETS, np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.25 * each / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            tf = [counts(t) for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(x) for x in tf]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([x.tolist() for x in at], pa.list_(pa.int32())), pa.array([x[i].tolist() for x, i in zip(tf, at)], pa.list_(pa.int64()))], schema=schema)

    got = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).mapInArrow(run, "doc_id long, lang string, at array<int>, tf array<long>").toArrow().to_pylist()
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["lang"], r["doc_id"], r["at"], r["tf"]))
    by: dict[str, list[np.ndarray]] = {}
    for r in got:
        if len(own := by.setdefault(r["lang"], [])) < each:
            x = np.zeros(BUCKETS, np.int64)
            x[r["at"]] = r["tf"]
            own.append(x)
    n = sum(map(len, by.values()))
    found = sum(((np.array(own) > 0).sum(axis=0) for own in by.values()), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    shell = Model((), np.zeros((0, BUCKETS), np.float32), np.zeros(0), idf)
    langs, centroids, floors = [], [], []
    for lang in sorted(by):
        x = shell.vectors(np.array(by[lang]))
        c = _kmeans(x, clusters)
        langs += [lang] * len(c)
        centroids.append(c)
        floors += [SLACK * float(np.quantile((x @ c.T).max(axis=1), QUANTILE))] * len(c)
    if not langs:
        return shell
    return Model(tuple(langs), np.concatenate(centroids).astype(np.float32), np.array(floors), idf)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per input row.

    `und` with score 0, rejected, for a null text or one without a letter. Otherwise lang_pred is the
    nearest learned language even where the distance rule rejects. Equal texts, equal results; ties of
    cosine go to the language that sorts first. The model (a few hundred kB, whatever the input) travels
    with the task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for b in slices(batches, most_rows=256):
            lang, score, rejected = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], schema=schema)

    out = texts(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's rows, all columns, that the model doesn't reject; what it rejects goes."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("boolean")
    def kept(text):
        import pandas as pd

        out = []
        for i in range(0, len(text), 256):
            out.append(~model.predict([None if t is None else bytes(t) for t in text.iloc[i : i + 256]])[2])
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    plain = numbered(df)
    return plain.where(kept(F.col(f"c{position(df, text_col)}").cast("binary"))).toDF(*df.columns)
