"""Language identification with string kernels: blended-spectrum presence kernels of character n-grams, Nystroem
landmarks, one-versus-rest kernel ridge regression, scored by batched matrix products."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, restored, shielded, small_enough, spread, staged, tidy
from .samples import remainder

#: Places for the n-grams of each length, by a hash; a place is 1 if one of its n-grams is in the text.
SPECTRUM = {1: 1 << 9, 2: 1 << 12, 3: 1 << 13}
WIDTH = sum(SPECTRUM.values())
#: Rows of each language that the model is fitted on, and landmarks of each, at most about.
EACH, LANDMARKS = 600, 32
#: Rows and landmarks in all, at most about: where languages are many, each has fewer.
ROWS, MARKS = 12_000, 1024
#: Texts in a matrix product.
BATCH = 64

_letter = np.zeros(sys.maxunicode + 1, np.uint32)
for _c in range(sys.maxunicode + 1):
    if chr(_c).isalpha():
        _letter[_c] = ord(chr(_c).lower()[0])


def _places(gram: np.ndarray, size: int) -> np.ndarray:
    mixed = gram * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(size - 1)


def _grams(text: str) -> Iterator[np.ndarray]:
    """Places of the text's n-grams for each n, with repeats."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([[0], _letter[code], [0]])
    code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])].astype(np.uint32)
    if not code.any():
        return
    gram = code[code != 0]
    for n, size in SPECTRUM.items():
        if n > 1:
            gram = (code[:-1] if n == 2 else gram[:-1]) * np.uint32(0x01000193) + code[n - 1 :]
        yield _places(gram, size)


def _unit(row: np.ndarray) -> None:
    base = 0
    for size in SPECTRUM.values():
        part = row[base : base + size]
        part /= np.sqrt(max(part.sum(), 1))
        base += size


def presence(texts: list[str]) -> np.ndarray:
    """Texts by places, float32: each n's part has unit length, so a product of two rows is the sum over n of the
    normalised presence kernels. Letters are folded to lower case; other characters, however many, part words. No
    letters: zeros."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts):
        base = 0
        for places, size in zip(_grams(text), SPECTRUM.values()):
            row[base : base + size][places] = 1
            base += size
        _unit(row)
    return out


def packed(text: str) -> bytes:
    """A text's row of presence() as bits: all that is sent of a text to be learned from."""
    row, base = np.zeros(WIDTH, np.uint8), 0
    for places, size in zip(_grams(text), SPECTRUM.values()):
        row[base : base + size][places] = 1
        base += size
    return np.packbits(row).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """presence() of what packed() gave."""
    out = np.stack([np.unpackbits(np.frombuffer(r, np.uint8)) for r in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    for row in out:
        _unit(row)
    return out


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) @ self.weights


def fit(rows: list[bytes], langs: list[str], ridge: float = 1e-2, per: int = LANDMARKS, most: int = MARKS) -> Model:
    """Ridge regression of each language against the rest in the Nystroem space of landmarks, which are the first `per`
    texts of each language, or as many first ones of each as make `most`. rows are packed() texts. Scores of the whole
    space come out as one matrix: kernels to the landmarks times weights."""
    names = sorted(set(langs))
    of = np.searchsorted(np.array(names, object), np.array(langs, object)) if names else np.zeros(0, int)
    order = np.argsort(of, kind="stable")
    nth = np.empty(len(of), int)  # a text's place among those of its language
    nth[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    first = sorted(np.lexsort((of, nth))[: min(most, (nth < per).sum())].tolist(), key=lambda i: (of[i], i))
    marks = unpacked([rows[i] for i in first])
    kernel = lambda part: (unpacked(part) @ marks.T).astype(np.float64)
    x = np.concatenate([kernel(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)]) if rows else np.zeros((0, len(marks)))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(initial=0), 1e-9)
    root = vectors[:, keep] / np.sqrt(values[keep])
    space = x @ root
    balance = np.sqrt(len(of) / (len(names) * np.maximum(np.bincount(of, minlength=len(names)), 1)))[of] if names else np.zeros(0)
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    a, b = space * balance[:, None], target * balance[:, None]
    solved = np.linalg.solve(a.T @ a + ridge * len(of) * np.eye(a.shape[1]), a.T @ b) if len(of) else np.zeros((0, 0))
    return Model(names, marks, (root @ solved).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held: int = 1, each: int = EACH) -> Model:
    """The model of the rows with a language outside the held-out fold: `each` texts of a language on average, by the
    hash of the id, or as many of each as make ROWS. Languages that the sample meets are learned; only with more of them
    than ROWS may it miss some."""
    usable = docs.filter((remainder(id_col, fold) != held) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = staged(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = min(each, ROWS / max(1, counts.count()))
    share = counts.select("lang", F.least(F.lit(1.0), each / F.col("n")).alias("share"))
    spot = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1_000_003)) / 1_000_003.0
    usable = usable.withColumn("spot", spot).withColumn("run", spread("id"))
    picked = usable.join(F.broadcast(share), "lang") if small_enough(counts) else attach(usable, share, ["lang"], "inner")
    picked = picked.filter("spot < share").select("id", "text", "lang")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"at": [hash_order(None if none else i) for i, none in zip(b["id"], b["no_id"])], "row": [packed(t) for t in b["text"]], "lang": b["lang"]})

    got = shielded(picked).mapInPandas(tidy(rows), "at long, row binary, lang string").collect()
    got.sort(key=lambda r: (r["at"], r["row"], r["lang"]))
    return fit([bytes(r["row"]) for r in got], [r["lang"] for r in got])


def hash_order(value: object) -> int:
    import zlib

    return zlib.crc32(f"order {value}".encode())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every row: the language of the highest score, and a softmax of the scores, 0 to 1.

    `und` with score 0 where the text is null, empty or has no letters, or where nothing could be learned. Ties go to the
    first name. Repeated rows get a row each; null ids stay null. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = shielded(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            texts, names, scores = b["text"].tolist(), [], []
            for i in range(0, len(texts), BATCH):
                x = presence(texts[i : i + BATCH])
                if not m.names:
                    names += ["und"] * len(x)
                    scores += [0.0] * len(x)
                    continue
                s = m.scores(x).astype(np.float64)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                some = x.any(axis=1)
                names += [m.names[k] if ok else "und" for k, ok in zip(s.argmax(axis=1), some)]
                scores += np.where(some, e.max(axis=1) / e.sum(axis=1), 0.0).tolist()
            yield pd.DataFrame({"id": b["id"], "no_id": b["no_id"], "lang_pred": names, "score": scores})

    kind = rows.schema["id"].dataType.simpleString()
    return restored(rows.mapInPandas(tidy(each), f"id {kind}, no_id boolean, lang_pred string, score double"), id_col)
