"""Toxicity by a weighted finite-state pattern grammar. Transducers for negation, reported speech, targets, threats and
insults are composed to one machine that reads a clause's word classes and adds up a clause's weight.

A threat weighs something only with a target: an object pronoun near it, or, for verbs that hardly mean anything else, a
subject; negated and reported ones weigh less. An insult that is aimed at someone, or introduced as one, has its full weight
and more; a lone one half of it, on a transition of its own.

The lexicon of insults is learned from labels: words and word beginnings that toxic documents have and others lack, with
their log odds. Function words and threats are fixed lists.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded, tidy
from .samples import by_label, texts_of

#: Labelled documents of each class that the lexicon and the calibration are fitted on, at most.
EACH = 4000

# Words of the grammar in the four languages of the tables. Verbs of threats are beginnings, with the endings
# that each kind of verb has; AIMED forms end in their object. PLAIN ones are said of much else, too.
ENGLISH = ["", "s", "ed", "ing", "en"]
FRENCH_ER = "e es ons ez ent er era erai eras erez erons eront é ée és ant".split()
FRENCH_RE = "s t re rai ras ra rons rez ront sons sez sent".split()
GERMAN = "e est st et t en ete eten te ten".split()
SPANISH_AR = "o as a amos áis an ar aré arás ará aremos arán ando ado é".split()
SPANISH_IR = "ir iré irá irán irás iremos yo yes ye yen yendo ido".split()
SPANISH_AIMED = "arte aros arlo arla arlos arlas arle".split()
THREATS = [
    ("kill murder destroy shoot", ENGLISH),
    ("hurt", ["", "s", "ing"]),
    ("stab", ["", "s", "bed", "bing"]),
    ("tu massacr", FRENCH_ER),
    ("détrui", FRENCH_RE),
    ("töt erschieß ermord zerstör", GERMAN),
    ("mat asesin", SPANISH_AR),
    ("destru", SPANISH_IR),
]
PLAIN = [("beat burn hang", ENGLISH), ("frapp brûl", FRENCH_ER), ("schlag schläg verbrenn häng", GERMAN), ("golpe quem", SPANISH_AR)]
AIMED = [("mat asesin golpe quem", SPANISH_AIMED)]
OBJECTS = "him them te toi lui leur dich dir euch ihn ihm ihnen ti os".split()
BOTH = "you your her vous sie ihr ihre usted ustedes".split()
SUBJECTS = "he she they tu il elle ils elles er tú él ella ellos ellas".split()
INTRODUCED = "what such espèce quel quelle welch qué vaya".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't won't neither nor pas jamais ni nicht kein keine nie nunca tampoco".split()
REPORTS = "said says say quoted quote quotes wrote writes reported according called dit écrit selon sagte sagt schrieb laut dijo dice escribió según".split()

#: Terms of the lexicon: their false discovery rate, and the least log odds.
RATE, ODDS = 1e-4, 1.5

CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _forms(kinds: list[tuple[str, list[str]]]) -> list[str]:
    return [stem + end for stems, ends in kinds for stem in stems.split() for end in ends]


#: Word classes: T threat, U threat by a plain verb, V one that ends in its object, O, B and S targets (objects, both,
#: subjects), P what introduces an insult, N negation, R reported speech, I insult, - any other.
CLASSES = {
    word: kind
    for kind, words in (
        ("T", _forms(THREATS)),
        ("U", _forms(PLAIN)),
        ("V", _forms(AIMED)),
        ("O", OBJECTS),
        ("B", BOTH),
        ("S", SUBJECTS),
        ("P", INTRODUCED),
        ("N", NEGATIONS),
        ("R", REPORTS),
    )
    for word in words
}
MENACES = sorted(w for w, kind in CLASSES.items() if kind in "TUV")

#: Weights: what negation and report leave of threats and of insults; an aimed threat, one with a subject only; an insult
#: that is aimed or introduced, a lone one.
LEFT = {"T": {"n": 0.4, "r": 0.6}, "I": {"n": 0.6, "r": 0.8}}
AT_OBJECT, BY_SUBJECT, AT_SOMEONE, LONE = 1.5, 0.75, 1.25, 0.5
#: Words that negation, report, a target before and an introduction reach; that threats and insults wait for a target.
REACH_N, REACH_R, REACH_G, REACH_P, WAIT_T, WAIT_I = 3, 12, 5, 3, 4, 3

#: Points of a step: of a threat; of the word itself as an insult, and of the last insult once more (both times its weight).
Points = tuple[float, float, float]
NONE: Points = (0.0, 0.0, 0.0)


class Transducer:
    """Deterministic, letter to letter, weighted: step(state, symbol) -> (written, points, next). A symbol is a word class
    and the marks that transducers before gave it."""

    def __init__(self, start, step: Callable) -> None:
        self.start, self._step, self._arcs = start, step, {}

    def step(self, state, symbol: str) -> tuple[str, Points, object]:
        """Arcs are made when they are first taken: of a composition few states are ever reached."""
        arc = self._arcs.get((state, symbol))
        if arc is None:
            arc = self._arcs[state, symbol] = self._step(state, symbol)
        return arc

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes the other reads; points add up."""

        def step(state, symbol: str):
            mid, p, a = self.step(state[0], symbol)
            out, q, b = other.step(state[1], mid)
            return out, tuple(x + y for x, y in zip(p, q)), (a, b)

        return Transducer((self.start, other.start), step)


def _marker(trigger: str, reach: int, mark: str) -> Transducer:
    """Threats and insults get the mark within `reach` words after the trigger."""

    def step(left: int, symbol: str):
        marked = symbol + mark if left and symbol[0] in "TUVI" else symbol
        return marked, NONE, reach if symbol[0] == trigger else max(0, left - 1)

    return Transducer(0, step)


def _targets() -> Transducer:
    """Threats and insults get the last target or introduction that reaches them: its class in lower case."""

    def step(state: tuple[str, int], symbol: str):
        kind, left = state
        marked = symbol + kind.lower() if left and symbol[0] in "TUVI" else symbol
        if symbol[0] in "OBSP":
            return marked, NONE, (symbol[0], REACH_P if symbol[0] == "P" else REACH_G)
        return marked, NONE, (kind, left - 1) if left > 1 else ("", 0)

    return Transducer(("", 0), step)


def _left(symbol: str) -> float:
    out = LEFT["I" if symbol[0] == "I" else "T"]
    return math.prod(x for mark, x in out.items() if mark in symbol[1:])


def _threats() -> Transducer:
    """A threat has points with an object before it, or the first object after it that it waits for; some with a subject
    before it, unless its verb is a plain one. Another threat ends the waiting."""

    def step(state: tuple[float, int], symbol: str):
        due, left = state
        kind, marks = symbol[0], symbol[1:]
        if kind in "TUV":
            weak = _left(symbol)
            if kind == "V" or "o" in marks:
                return symbol, (AT_OBJECT * weak, 0.0, 0.0), (0.0, 0)
            some = BY_SUBJECT * weak if kind == "T" and ("b" in marks or "s" in marks) else 0.0
            return symbol, (some, 0.0, 0.0), (AT_OBJECT * weak - some, WAIT_T)
        if kind in "OB" and left:
            return symbol, (due, 0.0, 0.0), (0.0, 0)
        return symbol, NONE, (due, left - 1) if left > 1 else (0.0, 0)

    return Transducer((0.0, 0), step)


def _insults() -> Transducer:
    """An insult with a target or an introduction before it is aimed; a lone one has less, and the rest if a target comes
    soon. Another insult ends the waiting."""

    def step(state: tuple[float, int], symbol: str):
        due, left = state
        kind, marks = symbol[0], symbol[1:]
        if kind == "I":
            weak = _left(symbol)
            if any(m in marks for m in "obsp"):
                return symbol, (0.0, AT_SOMEONE * weak, 0.0), (0.0, 0)
            return symbol, (0.0, LONE * weak, 0.0), ((AT_SOMEONE - LONE) * weak, WAIT_I)
        if kind in "OBS" and left:
            return symbol, (0.0, 0.0, due), (0.0, 0)
        return symbol, NONE, (due, left - 1) if left > 1 else (0.0, 0)

    return Transducer((0.0, 0), step)


def machine() -> Transducer:
    """The grammar that a Scorer reads clauses with."""
    return _marker("N", REACH_N, "n").then(_marker("R", REACH_R, "r")).then(_targets()).then(_threats()).then(_insults())


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings ("stem*")."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.stems[word[:k]] for k in range(4, min(8, len(word))) if word[:k] in self.stems), default=0.0)


def _features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(4, min(8, len(w)))}


def discoveries(ratios: dict[str, float], tested: int, rate: float = RATE) -> set[str]:
    """The features whose likelihood ratios stand out of `tested` ones at a false discovery rate (Benjamini and Hochberg);
    a ratio's p is that of chi-square with one degree of freedom."""
    order = sorted(ratios, key=lambda f: -ratios[f])
    p = [math.erfc(math.sqrt(max(0.0, ratios[f]) / 2)) for f in order]
    last = max((k + 1 for k, x in enumerate(p) if x <= rate * (k + 1) / tested), default=0)
    return set(order[:last])


def learn(texts: list[str], toxic: list[int]) -> Lexicon:
    """Terms by the likelihood ratio of document counts (at a false discovery rate) and log odds, which must stand between words
    as varied as half their documents (copies of one document repeat its neighbours). Of a word and its beginnings the
    most specific that loses under a twentieth of the toxic documents is taken, then no term that extends it. Features of
    one text at a time are held."""
    yes = [t for t, y in zip(texts, toxic) if y]
    no = [t for t, y in zip(texts, toxic) if not y]
    if not yes or not no:
        return Lexicon()
    pos: Counter[str] = Counter()
    for t in yes:
        pos.update(_features(t))
    tested, pos = len(pos), Counter({f: n for f, n in pos.items() if n >= 4})
    neg: Counter[str] = Counter()
    for t in no:
        neg.update(_features(t) & pos.keys())
    odds, ratios = {}, {}
    for f, a in pos.items():
        b = neg[f]
        share = (a + b) / (len(yes) + len(no))
        if share >= 1:
            continue
        ratio = 2 * sum(x * math.log(x / e) for x, e in ((a, share * len(yes)), (b, share * len(no)), (len(yes) - a, (1 - share) * len(yes)), (len(no) - b, (1 - share) * len(no))) if x > 0)
        odds[f] = math.log((a + 0.5) / (len(yes) + 1)) - math.log((b + 0.5) / (len(no) + 1))
        if odds[f] >= ODDS:
            ratios[f] = ratio
    good = discoveries(ratios, tested)
    between: dict[str, set[tuple[str, str]]] = {f: set() for f in good}
    for t in yes:
        words = WORD.findall(t.lower())
        for k, w in enumerate(words):
            for f in (w, *(w[:n] + "*" for n in range(4, min(8, len(w))))):
                if f in between:
                    between[f].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    good = {f for f in good if len(between[f]) >= max(4, 0.5 * pos[f])}
    longer: dict[str, list[str]] = {}
    for f in good:
        base = f.rstrip("*")
        for k in range(4, len(base) + (0 if f.endswith("*") else 1)):
            if base[:k] + "*" in good and base[:k] + "*" != f:
                longer.setdefault(base[:k] + "*", []).append(f)
    chosen: list[str] = []
    for f in sorted(good, key=lambda f: (-pos[f], len(f), f)):
        if any(f.rstrip("*").startswith(c[:-1]) for c in chosen if c.endswith("*")):
            continue
        while heirs := [x for x in longer.get(f, ()) if pos[x] >= 0.95 * pos[f]]:
            f = max(heirs, key=lambda x: (len(x.rstrip("*")), not x.endswith("*")))
        chosen.append(f)
    return Lexicon({f: odds[f] for f in chosen if not f.endswith("*")}, {f[:-1]: odds[f] for f in chosen if f.endswith("*")})


class Scorer:
    """Clause weights of texts. Only clauses with a lexicon word or a threat in them are read, found by one automaton."""

    def __init__(self, lexicon: Lexicon, coefficients: list[float]) -> None:
        import ahocorasick

        self.lexicon, self.coefficients = lexicon, np.array(coefficients)
        self.finder = ahocorasick.Automaton()
        for term in {*lexicon.words, *lexicon.stems, *MENACES}:
            self.finder.add_word(term, len(term))
        self.finder.make_automaton()
        self.machine = machine()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of the clauses with a weight, in the lower-cased text."""
        low = text.lower()
        hits = sorted(end + 1 - n for end, n in self.finder.iter(low) if end + 1 == n or not low[end - n].isalpha())
        if not hits:
            return []
        ends = [(m.start(), m.end()) for m in CLAUSE.finditer(low)]
        stops = [a for a, _ in ends]
        out, done = [], -1
        for at in hits:
            if at < done:
                continue
            k = bisect_right(stops, at)
            begin, done = ends[k - 1][1] if k else 0, stops[k] if k < len(ends) else len(low)
            weight = self.clause(WORD.findall(low, begin, done))
            if weight:
                out.append((begin, done, weight))
        return out

    def clause(self, words: list[str]) -> float:
        state, total, last = self.machine.start, 0.0, 0.0
        for w in words:
            value = self.lexicon.weight(w)
            _, (threat, now, once_more), state = self.machine.step(state, "I" if value else CLASSES.get(w, "-"))
            total += threat + value * now + last * once_more
            if value:
                last = value
        return total

    @staticmethod
    def numbers(found: list[tuple[int, int, float]], length: int) -> list[float]:
        """What the calibration sees of a text of some length with these clauses."""
        total = sum(w for _, _, w in found)
        return [1.0, math.log1p(total), max((w for _, _, w in found), default=0.0) / 5, math.log1p(len(found)), 100 * total / (length + 400)]

    def features(self, text: str) -> list[float]:
        return self.numbers(self.clauses(text), len(text))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """The lexicon is learned on every other text and the logistic calibration on the rest (on all, where that leaves no
    lexicon), so that chance terms of the lexicon don't count. share: of toxic rows among all labelled ones."""
    half = [k % 2 == 0 for k in range(len(texts))]
    lexicon = learn(*([x for x, h in zip(xs, half) if h] for xs in (texts, toxic)))
    full = learn(texts, toxic)
    rest = [not h for h in half]
    if not lexicon.words and not lexicon.stems:
        lexicon, rest = full, [True] * len(texts)
    y = np.array([float(v) for v, r in zip(toxic, rest) if r])
    if not len(y) or y.min() == y.max():
        return Model(full, [-3.0 if not len(y) or not y.max() else 3.0, 0, 0, 0, 0])
    scorer = Scorer(lexicon, [0] * 5)
    x = np.array([scorer.features(t) for t, r in zip(texts, rest) if r])
    prior = y.mean() if share is None else share
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    c = np.zeros(5)
    for _ in range(50):  # Newton, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 0.05, 0.05, 0.05, 0.05])
        c = c - np.linalg.solve(h, x.T @ (weight * (p - y)) + np.array([0.01, 0.05, 0.05, 0.05, 0.05]) * c)
    return Model(full, c.tolist())


def train(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = EACH) -> Model:
    """The model of at most `each` labelled documents of each class, where usable holds."""
    usable = F.lit(True) if usable is None else usable
    known = labels.filter(F.col(label_col).isNotNull())
    share = known.filter(usable).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    got = texts_of(docs, by_label(known, label_col, usable, [0, 1], each, id_col), id_col, text_col)
    return fit([t for t, _ in got], [int(y) for _, y in got], share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: more toxic) and clauses (array of begin, end, weight) of every row. Null and empty
    texts have the score of a text without matched clauses. Repeated rows get a row each; null ids stay null."""
    rows = shielded(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(sent.value.lexicon, sent.value.coefficients)
        for b in batches:
            found = [s.clauses(t) for t in b["text"]]
            x = np.array([s.numbers(f, len(t)) for f, t in zip(found, b["text"])]).reshape(-1, 5)
            shown = [[{"begin": p, "end": q, "weight": float(w)} for p, q, w in f] for f in found]
            yield pd.DataFrame({"id": b["id"], "no_id": b["no_id"], "score": s.score(x), "clauses": shown})

    kind = rows.schema["id"].dataType.simpleString()
    return restored(rows.mapInPandas(tidy(each), f"id {kind}, no_id boolean, score double, clauses array<struct<begin:int,end:int,weight:double>>"), id_col)


def scores(model: Model, text: F.Column, spark) -> F.Column:
    """The same score as a column, for filters that keep all columns of a table."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(sent.value.lexicon, sent.value.coefficients)
        for p in parts:
            yield pd.Series(s.score(np.array([s.features(t) for t in p]).reshape(-1, 5)), dtype=float)

    return run(F.coalesce(text, F.lit("")))
