"""Quality by attention-based multiple-instance learning (Ilse et al., 2018): every passage is encoded, gated attention
weighs the passages of a document, and the weighted representation is scored. Fitted on document labels alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded, tidy
from .samples import by_label, texts_of
from .shingles import chunks, word_hashes

#: Bytes of a passage; a document's last one may be shorter.
PASSAGE = 512
#: Labelled documents of each class that the model is fitted on, at most.
EACH = 2000
HIDDEN, ATTENTION = 16, 8

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), [32, 9], [10, 13], b".,;:", b"!?", b"|", b"%$&*#@^~", b"\"'()[]{}<>/\\=+-_`"]
_class_of = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES):
    _class_of[list(_members)] = _k
FEATURES = len(_CLASSES) + 1 + 6


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, offsets by text); an empty text is one passage of zeros."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_bytes = np.array([len(r) for r in raw], np.int64)
    n = np.maximum(1, -(-n_bytes // PASSAGE))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((at[-1], FEATURES))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    which = np.repeat(np.arange(len(texts)), n)
    start = begin[which] + (np.arange(at[-1]) - at[:-1][which]) * PASSAGE
    stop = np.minimum(start + PASSAGE, (begin + n_bytes)[which])
    kinds = _class_of[data]
    kinds[begin[1:] - 1] = FEATURES  # blanks between texts are no one's
    kinds[-1] = FEATURES
    span = np.diff(np.append(start, len(data)))
    spot = np.repeat(np.arange(at[-1], dtype=np.int32) * (FEATURES + 1), span)
    counts = np.bincount(spot + kinds, minlength=at[-1] * (FEATURES + 1)).reshape(at[-1], -1)
    out[:, : len(_CLASSES) + 1] = counts[:, : len(_CLASSES) + 1] / np.maximum(stop - start, 1)[:, None]
    words, word_at = word_hashes(texts)
    if len(words):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        place = spot[first] // (FEATURES + 1)
        whose = np.repeat(np.arange(len(texts)), np.diff(word_at))
        same = [np.concatenate([np.zeros(d, bool), (words[d:] == words[:-d]) & (whose[d:] == whose[:-d])])[: len(words)] for d in (1, 2)]
        m = np.bincount(place, minlength=at[-1])
        long = np.minimum(np.append(first[1:], len(data)), (begin + n_bytes + 1)[whose]) - first  # to the next word or the text's end
        pairs = np.unique(place.astype(np.uint64) * np.uint64(1 << 32) ^ (words >> np.uint64(32)))
        fresh = np.bincount(np.minimum((pairs >> np.uint64(32)).astype(np.int64), at[-1] - 1), minlength=at[-1])
        m1 = np.maximum(m, 1)
        out[:, -6:] = np.stack([np.bincount(place, same[0], at[-1]) / m1, np.bincount(place, same[1], at[-1]) / m1, np.minimum(fresh / m1, 1), np.bincount(place, long, at[-1]) / m1 / 10, np.log1p(m) / 5, np.log1p(np.maximum(stop - start, 0)) / 7], axis=1)
    return out, at


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _forward(self.p, np.clip((x - self.mean) / self.scale, -6, 6), at)["y"]


def _forward(p: dict, x: np.ndarray, at: np.ndarray) -> dict:
    with np.errstate(over="ignore"):
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        n = np.diff(at)
        top = np.repeat(np.maximum.reduceat(e, at[:-1]), n)
        q = np.exp(e - top)
        share = q / np.repeat(np.add.reduceat(q, at[:-1]), n)
        z = np.add.reduceat(h * share[:, None], at[:-1])
        return {"h": h, "t": t, "g": g, "share": share, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}


def _gradients(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = _forward(p, x, at)
    n = np.diff(at)
    dy = (f["y"] - y) * weight / weight.sum()
    dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
    dshare = (dz * f["h"]).sum(axis=1)
    inner = np.repeat(np.add.reduceat(dshare * f["share"], at[:-1]), n)
    de = f["share"] * (dshare - inner)
    tg = f["t"] * f["g"]
    dtg = de[:, None] * p["a"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * tg * (1 - f["g"])
    dh = (dz * f["share"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
    return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": tg.T @ de, "c": f["z"].T @ dy, "d": dy.sum()}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, seed: int = 3, prior: float | None = None) -> Model:
    """Adam on the weighted log loss over all documents at once. Document weights make classes count alike at first half;
    the intercept is then moved to the labels' own share (prior, or else that of y), so scores are probabilities. One class
    only: its constant."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    p = {"w": rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b": np.zeros(HIDDEN), "v": rng.normal(size=(HIDDEN, ATTENTION)) / 4, "u": rng.normal(size=(HIDDEN, ATTENTION)) / 4, "a": rng.normal(size=ATTENTION) / 3, "c": rng.normal(size=HIDDEN) / 4, "d": np.zeros(())}
    share = float(y.mean())
    if share in (0.0, 1.0):
        return Model(mean, scale, {k: np.zeros_like(v) for k, v in p.items()} | {"d": np.array(6.0 if share else -6.0)})
    x = np.clip((x - mean) / scale, -6, 6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in _gradients(p, x, at, y, weight).items():
            g = g + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    prior = share if prior is None or not 0 < prior < 1 else prior
    p["d"] = p["d"] + np.log(prior / (1 - prior))
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = EACH) -> Model | None:
    """The model of at most `each` labelled documents of each class; None where there is no label to learn from."""
    usable = F.lit(True) if usable is None else usable
    known = labels.filter(F.col(label_col).isNotNull())
    prior = known.filter(usable).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    chosen = by_label(known, label_col, usable, [0, 1], each, id_col)
    got = texts_of(docs, chosen, id_col, text_col)
    if not got:
        return None
    texts = [t for t, _ in got]
    parts = [passages(texts[i:j]) for i, j in chunks(texts)]
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    return fit(np.concatenate([x for x, _ in parts]), at, np.array([float(y) for _, y in got]), prior=prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: better) and top_passage (byte where the passage of most attention begins) of every
    row. A score depends on the text alone; it is rounded to nine places, beyond which sums depend on a batch. Null texts count as empty; an empty text is scored as one empty passage. Without a model all scores are 0.5.
    Repeated rows get a row each; null ids stay null. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = shielded(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            texts = b["text"].tolist()
            for i, j in chunks(texts):
                if m is None:
                    y, top = np.full(j - i, 0.5), np.zeros(j - i, np.int64)
                else:
                    x, at = passages(texts[i:j])
                    f = _forward(m.p, np.clip((x - m.mean) / m.scale, -6, 6), at)
                    y, top = f["y"], np.array([int(np.argmax(f["share"][p:q])) * PASSAGE for p, q in zip(at[:-1], at[1:])], np.int64)
                yield pd.DataFrame({"id": b["id"].iloc[i:j].to_numpy(), "no_id": b["no_id"].iloc[i:j].to_numpy(), "score": np.round(y, 9), "top_passage": top})

    kind = rows.schema["id"].dataType.simpleString()
    return restored(rows.mapInPandas(tidy(each), f"id {kind}, no_id boolean, score double, top_passage long"), id_col)
