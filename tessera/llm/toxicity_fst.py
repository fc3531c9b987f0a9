"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps a clause's words to symbols: insult, threat verb, target,
negation, reporting verb, quotation mark, future, other. Four transducers are composed and run
over the symbols:

* negation rewrites an insult or threat that a negation governs ("you are not an idiot");
* reported speech rewrites what stands after a reporting verb and a quotation mark, or
  after "said that" ("she called him a fool");
* threat accepts a threat verb that an intent ("will", "going to") governs;
* target knows roles. A person named in the clause before an insult is its target ("you are an
  idiot"), so is one addressed within two words after it ("stupid idiot, you"). The victim of a
  threat is a person within three words after its verb ("I will kill you", "beat up his
  brother") or an object pronoun before it ("ich werde dich töten"); the subject never is.
  A person after the word gives an event of its own, besides the word's.

What comes out are matched clause events, and a clause is worth the events it holds:
isolated words outside the grammar's lexicon count nothing. The events of a document
feed a logistic model that starts from hand-set weights and is fitted, with those
weights as its prior, to a bounded sample of labelled rows; each class weighs as much as
among all of them. A single insult without a target is no matched clause: it counts only as
``lone``, whose weight stays below the threshold; targets or a second insult make insults
count. An event that would pass the threshold by its hand-set weight and that no sampled row holds keeps its
distance from the bias.

The insult lexicon has a fixed part and a part induced from labelled rows: word stems
and words that occur in many different contexts of toxic rows and (almost) never in
others. Different contexts (the word with the one before it) are counted, not rows, so that
a copied document counts once; a log-likelihood ratio rules chance out. Induced entries pass
the same transducers as fixed ones, with events of their own, as they are less sure.

Null, empty and blank texts have no event; their score is the model's at zero events.
Repeated rows: one result each. Null id: kept, in no fold. Rows without a label, or with a
null one, are not learned from; with no label of one of the classes the hand-set weights
stand alone. Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, crc_fold, cut, sampled_texts, slices, sql_type, table, whole_row, worker_memo

SAMPLE = (6000, 2000)  # labelled rows of class 0 and class 1 that are learned from, at most
MIN_EVIDENCE = 14.0  # log-likelihood ratio of an induced entry: chance among some 100,000 stems is ruled out
MAX_RATE = 0.05  # how often an entry may occur in other rows, relative to toxic rows
STEM = (3, 8)  # lengths of induced stems; a word must go on after its stem
THRESHOLD = 0.5

# The grammar's word lists.
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool fools loser losers clown clowns "
    "trash garbage scum scumbag vermin worthless pathetic disgusting filthy bastard bastards bitch asshole assholes jerk "
    "retard retarded cretin pig pigs freak freaks ugly subhuman dickhead douchebag lowlife "
    "dummkopf trottel arschloch abschaum drecksau vollidiot schwachkopf "
    "imbécile connard connasse abruti salaud salope ordure crétin "
    "imbécil estúpido estúpida gilipollas pendejo cabrón basura escoria asqueroso"
).split()
THREATS = "kill murder hurt destroy beat strangle stab shoot burn hang crush slaughter töten umbringen tuer matar".split()
INTENTS = "will gonna ll going want should must werde vais voy".split()
ADDRESSED = "you your yours u ur youre vous usted ustedes dir ihr euch".split()
OBJECTS = "him them her his their everyone everybody people sie ihn elle eles".split()
SUBJECTS = "he she they er il tu du eres these those él ella ellos".split()
CLITICS = "dich te toi".split()  # objects that stand before the verb as well
NEGATIONS = "not never no nobody isn aren wasn weren don doesn didn won wouldn cannot nicht kein keine niemand jamais nunca nadie".split()
REPORTS = "said says say saying called calls calling wrote writes claimed claims reported reports quoted sagte dit dijo".split()

O, I, H, T, N, R, Q, F_ = range(8)  # other, insult, threat verb, target, negation, report, quote, intent
NI, NH, RI, RH, DH, TI, TH, J = range(8, 16)  # negated, reported, intended, targeted events; induced insult
NJ, RJ, TJ = range(16, 19)  # the same of an induced insult
Y, S, C = range(19, 22)  # persons: addressed, subject only, object pronoun; T is any other
PERSONS = (T, Y, S, C)
EVENTS = (I, TI, J, TJ, H, DH, TH, NI, NH, NJ, RI, RH, RJ)
EVENT_NAMES = ("insult", "targeted_insult", "induced_insult", "targeted_induced", "threat_verb", "threat", "targeted_threat",
               "negated_insult", "negated_threat", "negated_induced", "reported_insult", "reported_threat", "reported_induced")
INSULT_EVENTS = 4  # so many events at the front of EVENTS are insults that stand
#: Hand-set weights: the bias, then for each event its presence, and for each the log of its count;
#: last the log of the insults among 1000 words, and a lone insult.
PRIOR = np.array([-3.0] + [3.5, 4.0, 2.0, 2.5, 0.1, 0.5, 5.0, -0.5, -0.5, -0.5, 0.3, 0.3, 0.3]
                 + [1.0, 1.0, 1.0, 1.0, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] + [0.0, 1.0])
LONE_MOST = -0.5  # bias and lone insult together are no more than this
PRIOR_STRENGTH = 2.0

WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
CLAUSE = re.compile(r"[^.!?;\n]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``steps[state, symbol] = (next state, output)``; a missing entry copies the symbol and keeps the state."""

    steps: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.steps.get((state, symbol), (state, symbol))


class Composition:
    """The composition of transducers: one machine whose states are tuples, made as they are reached."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = (0,) * len(parts)
        self.known: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        found = self.known.get((state, symbol))
        if found is None:
            states, out = [], symbol
            for part, s in zip(self.parts, state):
                s, out = part.step(s, out)
                states.append(s)
            found = self.known[state, symbol] = (tuple(states), out)
        return found

    def run(self, symbols: list[int]) -> list[int]:
        state, out = self.start, []
        for symbol in symbols:
            state, event = self.step(state, symbol)
            if event in _EVENT_AT:
                out.append(event)
        return out


def negation(reach: int = 2) -> Transducer:
    """A negation governs the first insult or threat within the next ``reach + 1`` words."""
    steps = {(s, N): (1, N) for s in range(reach + 2)}
    for s in range(1, reach + 2):
        after = s + 1 if s <= reach else 0
        steps |= {(s, I): (0, NI), (s, J): (0, NJ), (s, H): (0, NH)} | {(s, x): (after, x) for x in (O, R, Q, F_, *PERSONS)}
    return Transducer(steps)


def reported_speech() -> Transducer:
    """0 plain, 1 after a reporting verb, 2 inside the reported quotation."""
    steps = {(0, R): (1, R), (1, Q): (2, Q), (2, Q): (0, Q)}
    for s in (1, 2):
        steps |= {(s, I): (s, RI), (s, J): (s, RJ), (s, H): (s, RH)}
        steps |= {(s, NI): (s, RI), (s, NJ): (s, RJ), (s, NH): (s, RH)}
    return Transducer(steps)


def threat(reach: int = 2) -> Transducer:
    """An intent within ``reach`` words before a threat verb makes it a threat."""
    steps = {(s, F_): (1, F_) for s in range(reach + 2)}
    for s in range(1, reach + 2):
        after = s + 1 if s <= reach else 0
        steps |= {(s, H): (0, DH)} | {(s, x): (after, x) for x in (O, R, Q, N, *PERSONS)}
    return Transducer(steps)


def target(after_threat: int = 3, after_insult: int = 2) -> Transducer:
    """Roles of persons. A state is what was named before (0 nobody, 1 a person, 2 an object pronoun) and what is open:
    a threat or an insult whose target may follow, and within how many words.
    """
    nothing = (O, 0)
    open_ = [nothing, *((kind, n) for kind, most in ((DH, after_threat), (I, after_insult), (J, after_insult)) for n in range(1, most + 1))]
    number = {(named, x): named * len(open_) + k for named in range(3) for k, x in enumerate(open_)}
    steps = {}
    for (named, (kind, left)), state in number.items():
        for insult, targeted in ((I, TI), (J, TJ)):
            steps[state, insult] = (number[named, nothing], targeted) if named else (number[0, (insult, after_insult)], insult)
        steps[state, DH] = (number[named, nothing], TH) if named == 2 else (number[named, (DH, after_threat)], DH)
        for person in PERSONS:
            event = person
            if kind == DH and person != S:
                event = TH
            elif kind in (I, J) and person == Y:
                event = TI if kind == I else TJ
            steps[state, person] = (number[2 if person == C or named == 2 else 1, nothing], event)
        then = number[named, (kind, left - 1) if left > 1 else nothing]
        steps |= {(state, x): (then, x) for x in (O, H, N, R, Q, F_, NI, NH, NJ, RI, RH, RJ)}
    return Transducer(steps)


@cache
def grammar() -> Composition:
    return Composition(negation(), reported_speech(), threat(), target())


class Lexicon:
    """The lexical transducer: whole words, and stems that words begin with."""

    def __init__(self, words: tuple[str, ...] = (), stems: tuple[str, ...] = ()):
        self.words = dict.fromkeys(words, J) | dict.fromkeys(INSULTS, I)
        for kind, group in ((H, THREATS), (Y, ADDRESSED), (T, OBJECTS), (S, SUBJECTS), (C, CLITICS), (N, NEGATIONS), (R, REPORTS), (F_, INTENTS)):
            self.words |= dict.fromkeys(group, kind)
        self.words |= dict.fromkeys("\"“”«»„", Q)
        self.stems = frozenset(stems)
        self.lengths = sorted({len(s) for s in stems})
        whole = [w for w, kind in self.words.items() if kind in (I, H, J)]
        parts = [rf"(?:{'|'.join(map(re.escape, sorted(whole)))})(?![^\W\d_])"]
        parts += [re.escape(s) + r"(?=[^\W\d_])" for s in sorted(stems)]
        self.trigger = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})")

    def symbol(self, word: str) -> int:
        kind = self.words.get(word, O)
        if kind == O and any(word[:k] in self.stems for k in self.lengths if k < len(word)):
            return J
        return kind

    def events(self, text: str) -> np.ndarray:
        """How often each event occurs in the text's clauses; last, the number of words, roughly (blanks and line ends)."""
        counts = np.zeros(len(EVENTS) + 1, np.int64)
        counts[-1] = 1 + text.count(" ") + text.count("\n")
        low, at = text.lower(), 0
        machine = grammar()
        while hit := self.trigger.search(low, at):
            # the whole clause around the trigger; clauses without one cannot hold an event
            begin = max(low.rfind(c, at, hit.start()) for c in ".!?;\n") + 1
            clause = CLAUSE.match(low, max(begin, at))
            for event in machine.run([self.symbol(w) for w in WORD.findall(clause.group())]):
                counts[_EVENT_AT[event]] += 1
            at = max(clause.end(), hit.end())
        return counts


_EVENT_AT = {e: k for k, e in enumerate(EVENTS)}


def design(counts: np.ndarray) -> np.ndarray:
    """Model inputs of event counts: one, presence, log count, log density, lone; a lone insult is none of the others."""
    n, words = counts[:, :-1].copy(), np.maximum(counts[:, -1:], 1)
    lone = (n[:, [k for k, e in enumerate(EVENTS) if e in (I, J)]].sum(axis=1) == 1) & (n[:, :INSULT_EVENTS].sum(axis=1) == 1)
    n[lone, :INSULT_EVENTS] = 0
    density = np.log1p(1000 * n[:, :INSULT_EVENTS].sum(axis=1, keepdims=True) / words)
    return np.concatenate([np.ones((len(n), 1)), n > 0, np.log1p(n), density, lone[:, None]], axis=1)


def fit(counts: np.ndarray, labels: np.ndarray, steps: int = 50, weights: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Logistic weights by Newton's method, pulled to the hand-set ones; ``weights`` are what a row of each class counts."""
    w = PRIOR.copy()
    each = np.where(labels == 1, weights[1], weights[0])
    if not (labels == 1).any() or not (labels == 0).any():
        return w
    x = design(counts)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - labels)) + PRIOR_STRENGTH * (w - PRIOR)
        curvature = (x * (each * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        move = np.linalg.solve(curvature, gradient)
        w = w - move * min(1.0, 3.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    for k in range(len(EVENTS)):
        if PRIOR[0] + PRIOR[1 + k] >= 0 and not x[:, 1 + k].any():
            w[1 + k] += PRIOR[0] - w[0]
    w[-1] = min(w[-1], LONE_MOST - w[0])
    return w


def usable_labels(labels: DataFrame, label: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """The labelled rows outside the held-out fold, each once."""
    return labels.where((crc_fold(F.col(id_col)) != 0) & F.col(label).isin(0, 1)).select(id_col, label).distinct()


def class_weights(labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                  sample: tuple[int, int] = SAMPLE) -> tuple[float, float]:
    """What a sampled row of each class counts, so that classes weigh as among all usable rows; 1 on average."""
    rows = usable_labels(labels, label, id_col).groupBy(F.col(label).cast("int").alias("c")).count().collect()
    total = {r["c"]: r["count"] for r in rows}
    taken = {c: min(n, sample[c]) for c, n in total.items()}
    scale = sum(taken.values()) / max(1, sum(total.values()))
    return tuple(scale * total[c] / taken[c] if taken.get(c) else 1.0 for c in (0, 1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                  text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``text, label`` of a bounded, reproducible sample of the labelled rows outside the held-out fold."""
    picked = cut(bounded_sample(usable_labels(labels, label, id_col), id_col, label, sample))
    return sampled_texts(docs, picked, id_col, F.col(text_col), label)


def induce(rows: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, stems) that mark toxic rows, from ``text, label``; all of them: the rows are a bounded sample."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                pairs = list(set(zip(["", *words], words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for _, w in pairs], pa.string()), pa.array([v for v, _ in pairs], pa.string()),
                     pa.array([label] * len(pairs), pa.int32())], ["word", "before", "label"])

    found = rows.mapInArrow(contexts, "word string, before string, label int").distinct()
    words = cut(found.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")))
    sums = words.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return (), ()
    base = sums[0] / (sums[0] + sums[1])
    q = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    likelihood = F.col("toxic") * F.log(q / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - base))
    ).otherwise(0.0)
    marks = (F.col("toxic") > 0) & (likelihood >= MIN_EVIDENCE) & (
        F.col("clean") / sums[1] <= MAX_RATE * F.col("toxic") / sums[0]
    )
    lo, hi = STEM
    lengths = F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: k < F.length("word"))
    prefixes = words.select(
        F.explode(F.transform(lengths, lambda k: F.col("word").substr(F.lit(1), k))).alias("stem"), "toxic", "clean"
    )
    stems = (
        prefixes.groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("forms"))
        .where(marks & (F.col("forms") >= 3))
    )
    whole = words.where(marks)
    stems = {r["stem"]: r["toxic"] for r in stems.collect()}
    # of a stem and its extensions that occur as often, the longest says the same more exactly
    longest = [s for s in stems if not any(o != s and o.startswith(s) and stems[o] >= 0.95 * stems[s] for o in stems)]
    least = [s for s in longest if not any(o != s and s.startswith(o) for o in longest)]
    return tuple(sorted(r["word"] for r in whole.collect())), tuple(sorted(least))


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]


def _events(docs: DataFrame, keep: str, text: str, words: tuple[str, ...], stems: tuple[str, ...],
            inside: bool = False) -> DataFrame:
    """``events`` of a text, and the column ``keep``; the text is the column ``text``, or ``inside`` the struct ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo(None, lambda: None)
        lexicon = Lexicon(words, stems)
        for b in slices(batches):
            texts = b.column(0).field(text) if inside else b.column(1)
            found = [lexicon.events(t).tolist() if t else [0] * (len(EVENTS) + 1) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), b.column(0)], ["events", keep])

    columns = [keep] if inside else [keep, text]
    return docs.select(*columns).mapInArrow(run, f"events array<long>, {keep} {sql_type(docs, keep)}")


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    rows = cut(training_rows(docs, labels, **how))
    how_labels = {k: v for k, v in how.items() if k != "text_col"}
    words, stems = induce(rows)
    found = _events(rows, "label", "text", words, stems).toPandas()  # as many rows as the sample may have
    counts = np.array(found["events"].tolist(), np.int64).reshape(-1, len(EVENTS) + 1)
    return Model(words, stems, tuple(fit(counts, found["label"].to_numpy(float), weights=class_weights(labels, **how_labels)).tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, events``: the probability that each whole text is toxic, with its clause events."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scored(_events(narrow, "id", "text", model.words, model.stems), model)


def _scored(found: DataFrame, model: Model) -> DataFrame:
    e = F.col("events")
    insults = sum(e[k] for k in range(INSULT_EVENTS))
    lone = (sum(e[_EVENT_AT[x]] for x in (I, J)) == 1) & (insults == 1)
    density = F.log1p(1000 * insults / F.greatest(e[len(EVENTS)], F.lit(1)))
    logit = F.lit(model.weights[0]) + F.when(lone, F.lit(model.weights[-1])).otherwise(F.lit(model.weights[-2]) * density)
    for k in range(len(EVENTS)):
        counts = (e[k] > 0) & ~lone if k < INSULT_EVENTS else e[k] > 0
        weight = F.lit(model.weights[1 + k]) + F.lit(model.weights[1 + len(EVENTS) + k]) * F.log1p(e[k])
        logit = logit + F.when(counts, weight).otherwise(0.0)
    events = F.struct(*[F.col("events")[k].alias(name) for k, name in enumerate(EVENT_NAMES)])
    return found.select("id", (1 / (1 + F.exp(-logit))).alias("score"), events.alias("events"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``."""
    model = train(docs, labels)
    rows = docs.select(whole_row(docs).alias("id"))  # a row goes through with its text once
    kept = _scored(_events(rows, "id", text_col, model.words, model.stems, inside=True), model)
    return kept.where(F.col("score") < threshold).select("id.*")


def op2_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (crc_fold(F.col("id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "events",
    )
