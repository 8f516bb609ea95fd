"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a text become class symbols: insult, threat, target, negation, report, quote,
end of a clause, other. Six weighted transducers read them. Their arcs write a symbol and a
factor, and composition multiplies the factors:

* negation marks triggers (insults and threats) up to three words after a negation, factor 0.01,
* reported speech marks triggers after a verb of saying up to the end of the clause, and
  between quotes, which outlive clauses but not lines, factor 0.25,
* target marks triggers up to four words after a target word, factor 2; who says something is no target of it,
* target from the right marks those up to three words before one, factor 2 unless marked already,
* insult lets insults through as a match, marked or not,
* threat lets threats through only with a target: `I will kill you`, not `the frost will kill the plants`.

The first three are composed into one table that reads a text from the left, the others into one
that reads the clauses with triggers from the right. A clause matches if a trigger passes all; its
score is the sum of word weights times factors. A text is judged by its clauses alone: score of the
best one, sum of the scores, sum per clause. A logistic regression turns these three into a
probability; none of its weights is negative, so equal words never weigh more in denied or reported clauses.

Insult words are the fixed English ones and words or word beginnings learned from the
labelled rows: of at most ``fit_rows`` labelled rows (by a hash of the id), those that
are far more frequent in toxic texts; groups of near copies count once.

Defined results: null and empty texts have no clause and get the score of a text
without matches; very long texts are read whole; repeated rows are scored each, and learned from
once; equal scores are left as they are. Rows with null ids are scored. Null labels, and labels of
ids without a document, are not used; without both labels in the sample the fixed
weights hold. Further columns are ignored or, by ``drop_toxic``, kept, whatever their names. An
empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import add_columns, free_name, text_bytes
from jobweave.llm.quality import held_out, labelled_sample
from jobweave.llm.trees import lasso_logistic, squash
from jobweave.llm.words import shingle_sets
from jobweave.session import stage

FIT_ROWS = 20_000
#: Lengths of the word beginnings that can be learned.
STEMS = (4, 5)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP = range(8)
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile",
    THREAT: "kill hurt destroy beat shoot stab murder smash",
    TARGET: "you your yours u him her them he she they du dich dir ihr euch sie tu toi te vous ils elles tú te ustedes ellos",
    NEGATION: "not no never neither nor none without isn't aren't don't nicht kein keine nie ne pas jamais sans nunca sin",
    REPORT: "said says saying called calls wrote writes told quoted claimed alleged sagte sagt schrieb dit disait écrit dijo dice escribió",
}
CLASS = {w: c for c, ws in WORDS.items() for w in ws.split()}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”«»]")
END = frozenset(".!?;\n")
QUOTES = frozenset("\"“”«»")
#: Marks of a trigger, in the order of the features: negated, reported, targeted are bits 1, 2, 4.
MARKS = 8


SYMBOLS = MARKS << 3
NEGATED, REPORTED, TARGETED = 1, 2, 4
#: Factors of the arcs that mark a trigger.
FACTOR = {NEGATED: 0.01, REPORTED: 0.25, TARGETED: 2.0}
Arc = tuple[int, int, float]


def is_trigger(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT)


def mark(symbol: int, bit: int) -> tuple[int, float]:
    """A trigger with this mark, and the factor of the arc; 1 if it has the mark already."""
    return symbol | bit << 3, 1.0 if symbol >> 3 & bit else FACTOR[bit]


@dataclass
class Transducer:
    """Deterministic and weighted: (state, symbol) -> (state, output symbol, factor)."""

    states: int
    arcs: dict[tuple[int, int], Arc] = field(default_factory=dict)

    def compose(self, other: Transducer) -> Transducer:
        """Reads with this one and gives its output to ``other``; factors are multiplied."""
        out = Transducer(self.states * other.states)
        for a in range(self.states):
            for b in range(other.states):
                for s in range(SYMBOLS):
                    na, mid, x = self.arcs[a, s]
                    nb, end, y = other.arcs[b, mid]
                    out.arcs[a * other.states + b, s] = (na * other.states + nb, end, x * y)
        return out

    def table(self, symbols: int) -> list[list[Arc]]:
        return [[self.arcs[state, s] for s in range(symbols)] for state in range(self.states)]


def within(opens: int, reach: int, bit: int, closes: tuple[int, ...] = (STOP,)) -> Transducer:
    """Marks triggers up to ``reach`` words after a word of the class ``opens``, unless a symbol of ``closes`` is between."""
    t = Transducer(reach + 1)
    for state in range(reach + 1):
        for symbol in range(SYMBOLS):
            kind = symbol & 7
            after = reach if kind == opens else 0 if kind in closes else state if kind == QUOTE else max(state - 1, 0)
            t.arcs[state, symbol] = (after, *(mark(symbol, bit) if state and is_trigger(symbol) else (symbol, 1.0)))
    return t


def reported() -> Transducer:
    """Marks triggers after a verb of saying (bit 1, to the end of the clause) and between quotes (bit 2, over clauses)."""
    t = Transducer(4)
    for state in range(4):
        for symbol in range(SYMBOLS):
            kind = symbol & 7
            after = {REPORT: state | 1, QUOTE: state ^ 2, STOP: state & 2}.get(kind, state)
            t.arcs[state, symbol] = (after, *(mark(symbol, REPORTED) if state and is_trigger(symbol) else (symbol, 1.0)))
    return t


def passing(kind: int, needs: int) -> Transducer:
    """Lets triggers of this kind through if they have the marks ``needs``; otherwise they become OTHER."""
    t = Transducer(1)
    for symbol in range(SYMBOLS):
        fails = symbol & 7 == kind and symbol >> 3 & needs != needs
        t.arcs[0, symbol] = (0, OTHER if fails else symbol, 1.0)
    return t


#: (next state, output, factor) by state and symbol: from the left over classes, from the right over its output.
LEFT = within(NEGATION, 3, NEGATED).compose(reported()).compose(within(TARGET, 4, TARGETED, (STOP, REPORT))).table(8)
RIGHT = within(TARGET, 3, TARGETED).compose(passing(INSULT, 0)).compose(passing(THREAT, TARGETED)).table(SYMBOLS)
#: Of a text: weights by kind and mark, which explain a score, then what its clauses are judged by.
FEATURES = 2 * MARKS + 3
JUDGED = slice(2 * MARKS, FEATURES)


class Lexicon:
    """Classes of words and weights of triggers; learned beginnings of words are triggers as well."""

    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        self.kind = dict(CLASS)
        self.weight = {w: 4.0 for w, c in CLASS.items() if c == INSULT} | {w: 1.0 for w, c in CLASS.items() if c == THREAT}
        for w, x in (words or {}).items():
            if self.kind.get(w, INSULT) == INSULT:
                self.kind[w], self.weight[w] = INSULT, x
        self.stems = stems or {}
        self.triggers = frozenset(self.weight)
        self.lengths = tuple(sorted({len(s) for s in self.stems}))

    def trigger(self, word: str) -> bool:
        return word in self.triggers or any(word[:n] in self.stems for n in self.lengths)

    def look_up(self, word: str) -> tuple[int, float]:
        kind = self.kind.get(word, OTHER)
        if kind != OTHER:
            return kind, self.weight.get(word, 0.0)
        for n in self.lengths[::-1]:
            if word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return OTHER, 0.0

    def clauses(self, text: str) -> list[list[tuple[int, float]]]:
        """The matches of every clause that has words: (output symbol, weight times factors), last one first."""
        out: list[list[tuple[int, float]]] = []
        state, read, hit = 0, [], False
        for t in [*TOKEN.findall(text.lower()), "\n"]:
            if t in QUOTES:
                state = LEFT[state][QUOTE][0]
            elif t in END:
                if read:
                    out.append(from_the_right(read) if hit else [])
                state, read, hit = 0 if t == "\n" else LEFT[state][STOP][0], [], False
            else:
                kind, weight = self.look_up(t)
                state, symbol, factor = LEFT[state][kind]
                read.append((symbol, weight * factor))
                hit = hit or is_trigger(symbol)
        return out

    def features(self, text: str) -> list[float]:
        """Weights of matches by kind and mark; best clause, sum of clauses, sum per clause (all damped)."""
        out = np.zeros(FEATURES)
        if not any(self.trigger(t) for t in set(TOKEN.findall(text.lower()))):
            return out.tolist()
        clauses = self.clauses(text)
        for symbol, weight in (match for clause in clauses for match in clause):
            out[(symbol >> 3) + MARKS * (symbol & 7 == THREAT)] += weight
        scores = [sum(weight for _, weight in clause) for clause in clauses if clause]
        if scores:
            out[JUDGED] = max(scores), sum(scores), sum(scores) / len(clauses)
        return np.log1p(out).tolist()


def from_the_right(read: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The triggers of a clause that pass the transducers that read it from the right."""
    out, state = [], 0
    for symbol, weight in reversed(read):
        state, symbol, factor = RIGHT[state][symbol]
        if is_trigger(symbol):
            out.append((symbol, weight * factor))
    return out


def word_groups(column: pa.Array) -> list:
    """Distinct words and beginnings of each text, and a name that near copies share (its smallest shingles)."""
    sets = shingle_sets(*text_bytes(column))
    words, names = [], []
    for t, s in zip(column.to_pylist(), sets):
        found = {w for w in TOKEN.findall((t or "").lower()) if w[0].isalpha()}
        words.append(sorted(found | {f"^{w[:n]}" for n in STEMS for w in found if len(w) > n}))
        names.append(int(s[:1].view(np.int64)[0]) if len(s) else 0)
    return [words, names]


def learn_lexicon(sample: DataFrame, least_texts: int = 4, least_odds: float = 25.0) -> Lexicon:
    """Words and beginnings far more frequent in toxic texts than in others, with the logarithm of the odds as weight."""
    found = add_columns(sample, "text", [("found", "array<string>"), ("name", "bigint")], word_groups)
    found = stage(found.withColumn("key", F.struct("id", F.xxhash64("text").alias("own"))).drop("text"), "toxicity-words")
    first = found.groupBy("name", "label").agg(F.min("key").alias("key"))
    once = found.join(first, ["name", "label", "key"], "left_semi")
    sizes = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    counts = once.select("label", F.explode("found").alias("w")).groupBy("w").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")
    )
    odds = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    kept = counts.where(F.col("bad") >= least_texts).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    # A kept word is in several of the sampled toxic texts, whose number is bounded.
    rows = kept.orderBy(F.desc("odds"), "w").collect()
    words = {r.w: float(np.log(r.odds)) for r in rows if r.w[0] != "^"}
    return Lexicon(words, {r.w[1:]: float(np.log(r.odds)) for r in rows if r.w[0] == "^"})


@dataclass
class Scorer:
    lexicon: Lexicon
    base: float
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t or "") for t in texts]).reshape(-1, FEATURES)
        return squash(self.base + x[:, JUDGED] @ self.weights)


def fixed_scorer(lexicon: Lexicon) -> Scorer:
    return Scorer(lexicon, -4.0, np.array([3.0, 0.0, 0.0]))


def learn(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Scorer:
    sample = stage(labelled_sample(docs, labels, label, train, fit_rows), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    names = [f"f{k}" for k in range(FEATURES)][JUDGED]
    judged = lambda c: list(np.array([lexicon.features(t or "") for t in c.to_pylist()]).reshape(-1, FEATURES).T[JUDGED])
    got = add_columns(sample, "text", [(n, "double") for n in names], judged)
    rows = got.drop("text").toPandas().sort_values(["id", *names], ignore_index=True)
    x, y = rows[names].to_numpy(float), rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return fixed_scorer(lexicon)
    base, weights = lasso_logistic(x, y, 1e-4, 2000, positive=True)
    return Scorer(lexicon, base, weights)


def with_scores(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    return add_columns(docs, text, [(name, "double")], lambda c: [scorer.score(c.to_pylist()).tolist()])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row; held-out rows (remainder 2 of 4) teach nothing."""
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    scorer = learn(plain, labels, ~held_out("doc_id", 4, 2), fit_rows=fit_rows)
    return with_scores(plain, scorer).select(
        F.col("doc_id").alias(id_column), held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", limit: float = 0.3) -> DataFrame:
    """``docs`` without rows of a score of ``limit`` or more."""
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    scorer = learn(plain, labels, ~held_out("doc_id", 4, 2))
    name = free_name(docs, "score")
    return with_scores(docs, scorer, text, name).where(F.col(name) < limit).select(*docs.columns)
