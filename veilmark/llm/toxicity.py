"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five letter transducers read the tags of a clause's words and are composed:

* *insult* and *threat* tag words by a prefix lexicon (an automaton over
  characters, run over the whole text);
* *target* marks who is meant: an insult or threat within ``NEAR`` words of a
  pronoun is directed;
* *negation* and *reported speech* mark insults in the scope of a negator or a verb
  of saying.

The composed machine's state is the tuple of its parts' states; transitions are
built on demand and kept.  A clause's score is the sum of the weights on its path:
the lexicon entry's weight plus the weights of the marks (directed, negated,
reported, threat), and a text's score is the logistic of the sum over its matched
clauses plus a constant.  A threat counts only when it is directed.

The weights are learned: over a bounded sample of labelled rows, stems that toxic
texts use and clean texts do not enter the lexicon at the point where their words
branch (so other endings match too), and a penalised logistic regression sets all
weights, with the fixed values below as their prior means.

Cases: a null or empty text has the score of a text without a match; equal texts
score equally; without labels the prior weights hold; an empty table gives no
rows; extra columns are carried or ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import SAMPLE_CHARS, hash_sample, remainder

#: Bound of the training sample for each label value (texts of up to SAMPLE_CHARS characters).
TRAIN_TEXTS = 2000
#: Rows with crc32(doc_id) mod 5 = 0 are held out.
HELD_OUT = (5, 0)
#: A stem enters the lexicon with this many toxic sample texts and this ratio of rates.
STEM_TEXTS, STEM_RATIO = 3, 20.0
STEM_LETTERS = (3, 12)
#: Lexicon entries that are learned at most; the strongest are kept.
STEMS = 600
#: Words between a mark and the insult it reaches.
NEAR, NEGATION_SCOPE = 3, 3

# FIXED VALUES: word lists of the grammar (whole words, lower case)
TARGETS = (
    "you your yours yourself he she they him her them "
    "du dich dir dein ihr euch er sie tu toi te vous il elle ils elles tú usted ustedes él ella"
).split()
NEGATORS = "not no never isn't aren't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTERS = (
    "said says called calls wrote quoted told reported sagte nannte schrieb berichtete "
    "dit appelle écrit raconte dijo llamó escribió contó"
).split()
THREATS = (
    "kill hurt destroy murder strangle töten umbringen vernichten verprügeln "
    "tuer frapper détruire matar golpear destruir"
).split()
INSULTS = (
    "idiot moron stupid loser scum jerk imbecile dummkopf trottel arschloch blödmann "
    "connard crétin imbécile abruti idiota imbécil estúpido gilipollas"
).split()
#: Prior means: constant, insult of the list above, learned stem, directed, negated, reported, threat.
PRIOR = {"constant": -3.0, "insult": 2.0, "stem": 1.0, "directed": 0.5, "negated": -1.0, "reported": -0.7, "threat": 3.0}
#: Precision of the priors.
PENALTY = 0.5
# end of fixed values

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
MARKS = ("directed", "negated", "reported", "threat")


# ----------------------------------------------------------------- transducers
def target_step(state: int, tag: str) -> tuple[int, str]:
    """State: words for which a target still reaches.  Insult I -> J when directed, threat T -> U."""
    if tag == "Y":
        return NEAR, tag
    left = max(0, state - 1)
    return left, {"I": "J", "T": "U"}.get(tag, tag) if state else tag


def negation_step(state: int, tag: str) -> tuple[int, str]:
    """State: words for which a negator still reaches.  Negated insults and threats become lower case."""
    if tag == "N":
        return NEGATION_SCOPE, tag
    if state and tag in "IJTU":
        return 0, tag.lower()
    return max(0, state - 1), tag


def reported_step(state: int, tag: str) -> tuple[int, str]:
    """After a verb of saying, the rest of the clause is reported: tags get a prime."""
    if tag == "R":
        return 1, tag
    return state, tag + "'" if state and tag in "IJTUijtu" else tag


PARTS = (target_step, negation_step, reported_step)


@dataclass
class Composed:
    """The composition of letter transducers; its transitions are kept once they are built."""

    parts: tuple = PARTS
    arcs: dict = field(default_factory=dict)

    def run(self, tags: list[str]) -> list[str]:
        state, out, arcs = (0,) * len(self.parts), [], self.arcs
        for tag in tags:
            arc = arcs.get((state, tag))
            if arc is None:
                new, t = [], tag
                for part, s in zip(self.parts, state, strict=True):
                    s, t = part(s, t)
                    new.append(s)
                arc = arcs[state, tag] = (tuple(new), t)
            state, tag = arc
            out.append(tag)
        return out

    def clause(self, tags: list[str]) -> list[str]:
        """Marks of both directions: a target may stand before or after the insult."""
        ahead = self.run(tags)
        back, state = [], 0
        for tag in reversed(tags):
            state, tag = target_step(state, tag)
            back.append(tag)
        return [a.replace("I", "J").replace("i", "j").replace("T", "U").replace("t", "u") if b in "JU" else a
                for a, b in zip(ahead, reversed(back), strict=True)]


class Grammar:
    """Lexicon of prefixes (``stem`` or, for whole words, ``word$``) with learned weights."""

    def __init__(self, entries: list[str], weights: dict[str, float]):
        self.entries, self.weights = entries, weights
        self.machine = Composed()
        self.words = {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATORS} | {w: "R" for w in REPORTERS}
        self.automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def _build(self):
        auto = ahocorasick.Automaton()
        spelled: dict[str, list[str]] = {}  # a spelling may be a stem and a whole word
        for e in self.entries:
            spelled.setdefault(e.rstrip("$"), []).append(e)
        for w in THREATS:
            spelled.setdefault(w, [w + "$"])
        for w, found in spelled.items():
            auto.add_word(w, (len(w), found))
        if len(auto):
            auto.make_automaton()
        self.automaton = auto
        self.threats = set(THREATS)

    def matches(self, text: str) -> tuple[Counter, Counter]:
        """(lexicon entries with their number of insults, marks with theirs) of one text."""
        if self.automaton is None:
            self._build()
        entries, marks = Counter(), Counter()
        text = text.lower()
        starts: dict[int, str] = {}
        if len(self.automaton):
            for end, (n, found) in self.automaton.iter(text):
                a = end - n + 1
                if a and (text[a - 1].isalnum()):
                    continue
                for entry in found:
                    if entry[-1] == "$" and end + 1 < len(text) and text[end + 1].isalnum():
                        continue
                    if a not in starts or len(starts[a]) < len(entry):
                        starts[a] = entry
        if not starts:
            return entries, marks
        order = sorted(starts)
        i = 0
        for clause in _CLAUSE.finditer(text):
            if i == len(order):
                break
            if order[i] >= clause.end():
                continue
            tags, at = [], []
            for w in _WORD.finditer(text, clause.start(), clause.end()):
                entry = starts.get(w.start())
                tags.append(self.words.get(w[0], "O") if entry is None else "T" if entry.rstrip("$") in self.threats else "I")
                at.append(entry)
            for tag, entry in zip(self.machine.clause(tags), at, strict=True):
                if entry is None or tag[0] not in "IJTUijtu":
                    continue
                if tag[0] in "Tt":
                    continue  # nobody is threatened
                if tag[0] in "Uu":
                    marks["threat"] += 1
                else:
                    entries[entry] += 1
                    marks["directed"] += tag[0] in "Jj"
                marks["negated"] += tag[0].islower()
                marks["reported"] += tag[-1] == "'"
            while i < len(order) and order[i] < clause.end():
                i += 1
        return entries, marks

    def logit(self, text: str) -> float:
        entries, marks = self.matches(text)
        w = self.weights
        return (
            w["constant"]
            + sum(w[e] * n for e, n in entries.items())
            + sum(w[m] * n for m, n in marks.items())
        )

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text or ""), -50, 50))))


# -------------------------------------------------------------------- learning
def _prefixes(words: set[str]) -> set[str]:
    a, b = STEM_LETTERS
    return {w[:n] for w in words for n in range(a, min(b, len(w)) + 1)} | {w + "$" for w in words if len(w) >= a}


def learned_stems(toxic: list[str], clean: list[str]) -> list[str]:
    """Prefixes that toxic texts use far more often, each at the point where its words branch."""
    def words(t: str) -> set[str]:
        return set(_WORD.findall(t.lower()))

    in_toxic, in_clean = Counter(), Counter()
    for t in toxic:
        in_toxic.update(_prefixes(words(t)))
    wanted = {p for p, n in in_toxic.items() if n >= STEM_TEXTS}
    for t in clean:
        in_clean.update(_prefixes(words(t)) & wanted)

    def ratio(p: str) -> float:
        return ((in_toxic[p] + 0.5) / (len(toxic) + 1)) / ((in_clean[p] + 0.5) / (len(clean) + 1))

    good = {p for p in wanted if ratio(p) >= STEM_RATIO}
    below: dict[str, list[str]] = {}
    for p in good:
        below.setdefault(p[:-1], []).append(p)
    stems = []
    for p in sorted(good, key=lambda p: (len(p), p)):
        if any(p[:n] in good for n in range(STEM_LETTERS[0], len(p))):
            continue  # a shorter prefix is good already; it is followed down below
        while True:  # go down while all its words go the same way
            same = [c for c in below.get(p, []) if in_toxic[c] >= 0.98 * in_toxic[p]]
            if not same or p.endswith("$"):
                break
            p = max(same, key=lambda c: (in_toxic[c], c))
        stems.append(p)
    return sorted(sorted(set(stems), key=lambda p: (-ratio(p) * np.sqrt(in_toxic[p]), p))[:STEMS])


def _fit(x: np.ndarray, y: np.ndarray, mean: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * (w - mean)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_TEXTS) -> Grammar:
    """A grammar with weights learned from a bounded sample of the labelled rows that are not held out."""
    m, r = HELD_OUT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("l_doc"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(remainder(F.col("l_doc"), m) != r).distinct()
    sample = hash_sample(marked, "toxic", per_label, ["l_doc"])
    found: list = []
    if sample:
        chosen = docs.sparkSession.createDataFrame([(x["l_doc"], x["toxic"]) for x in sample], "l_doc long, toxic int")
        # two rows of the sample's size for each label at most, so the list of ids is small enough to send to every task
        found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["l_doc"]).where(F.length("text") <= SAMPLE_CHARS).select("text", "toxic").limit(4 * per_label).collect()
    kind: dict[str, list[int]] = {}
    for x in found:
        kind.setdefault(x["text"], []).append(x["toxic"])
    toxic = sorted(t for t, k in kind.items() if sum(k) * 2 > len(k))
    clean = sorted(t for t, k in kind.items() if sum(k) * 2 <= len(k))
    listed = {w + "$" for w in INSULTS}
    entries = sorted(listed | set(learned_stems(toxic, clean)))
    prior = {"constant": PRIOR["constant"]} | {e: PRIOR["insult" if e in listed else "stem"] for e in entries} | {k: PRIOR[k] for k in MARKS}
    grammar = Grammar(entries, prior)
    if not toxic or not clean:
        return grammar
    names = list(prior)
    place = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(toxic) + len(clean), len(names)))
    x[:, 0] = 1
    for i, t in enumerate(toxic + clean):
        for counts in grammar.matches(t):
            for k, n in counts.items():
                x[i, place[k]] = n
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    penalty = np.full(len(names), PENALTY)
    penalty[0] = 1e-3
    w = _fit(x, y, np.array([prior[k] for k in names]), penalty)
    return Grammar(entries, dict(zip(names, w.tolist(), strict=True)))


def scores(text: Column, grammar: Grammar) -> Column:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([grammar.score(t) for t in texts.to_pylist()], pa.float64())

    return of(F.coalesce(text.cast("string"), F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    m, r = HELD_OUT
    grammar = grammar or fit(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), (remainder(doc_id, m) == r).alias("held_out"), scores(F.col("text"), grammar).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that are predicted toxic."""
    return docs.where(scores(F.col("text"), fit(docs, labels)) < 0.5)
