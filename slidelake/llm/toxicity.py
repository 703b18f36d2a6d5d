"""Operator 2: toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes: learned words of abuse by grade, bare insults, threats, targets, negations, reports, clause ends,
other. Three transducers are composed over the classes of a clause: the target machine raises an insult or threat near a
target to an aimed one, the negation machine marks those within reach of a negation, the report machine those in reported
speech. Their arcs carry weights, which are learned from labels, and so are the words of abuse and their grades; a clause
scores as its best path through the composed machine does, so what a word adds depends on the clause that it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, table
from .labelled import FOLDS, fold_of, logistic, sample_of, shares_of, sigmoid
from .transducers import Tables, Transducer, compose, window

#: Labelled documents of each label that are learned from.
MOST_EACH = 4000
STEMS = (4, 5, 6, 7, 8)

# Seed words of the grammar's closed classes.
TARGETS = "you your yours yourself he him his she her they them their this that these those du dich dein sie ihr er tu te toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nor isn't aren't don't doesn't nicht kein keine nie ne pas jamais non nunca jamás tampoco".split()
REPORTS = "said says say wrote writes claimed claims called calls quoted according sagte schrieb dit écrit dijo escribió".split()
THREATS = "kill killed hurt destroy beat shoot stab burn töten tuer matar".split()
INSULTS = "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash".split()

#: Classes of words. L: learned as abuse from labels; S: begins like learned words; I, T: seeds of insult and threat; Y: target;
#: N: negation; R: report; O: other. A clause's end is not a class: it parts clauses.
CLASSES = ["L", "S", "I", "T", "Y", "N", "R", "O"]
KINDS = CLASSES[:4]
#: Parameters, numbers into the learned values: what a mark of each kind weighs, and what aim, negation and report add.
PARAMS = [f"{k}{how}" for how in ("", " aimed", " negated", " reported") for k in KINDS]
#: Values before learning: a learned word counts, a seed does by its aim, negation and report take off what a word adds.
PRIOR = dict(zip(PARAMS, (2.0, 1.0, 0.2, 0.2, 0.5, 0.5, 1.5, 1.5, -2.0, -1.0, -0.2, -0.2, -2.0, -1.0, -0.2, -0.2), strict=True))
#: The share of a kind's and its aim's weight that negation and report take off at least, whatever is learned.
CANCEL = 0.9
#: Words without any kind that are kept in a row; more of them change no state of the grammar.
IDLE = 6
_EDGES = "\"'()[]{}<>*_~`#%&$|.,;:!?…«»“”‘’¡¿-–—"
_ENDS = tuple(".,;:!?…")
MOST_IN_CACHE = 200_000


def number(*names: str) -> tuple[int, ...]:
    return tuple(PARAMS.index(n) for n in names)


def spoken() -> Transducer:
    """Gives each kind its own weight; the other classes pass."""
    t = Transducer(0)
    for k in KINDS:
        t.arc(0, k, 0, k, number(k))
    return t


def aimed(reach: int = 4) -> Transducer:
    """Raises kinds within reach after a target, or, guessing ahead, within reach before one. A wrong guess has no path."""
    t = window("Y", reach, {k: (k + "a", number(f"{k} aimed")) for k in KINDS})
    for left in range(reach + 1):  # the guess: a kind is aimed at a target that is still to come
        for k in KINDS:
            if left == 0:
                t.arc(0, k, 0, k)
                t.arc(0, k, ("owes", reach), k + "a", number(f"{k} aimed"))
    for owed in range(1, reach + 1):
        state = ("owes", owed)
        t.rest[state] = ("owes", owed - 1)
        t.arc(state, "Y", reach)
        for k in KINDS:
            t.arc(state, k, ("owes", owed - 1), k + "a", number(f"{k} aimed"))
    t.rest[("owes", 0)] = ("owes", 0)
    return t


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """spoken, target, negation and report composed, over word classes. Runs that end owing a target are no runs."""
    heard = [k + a for k in KINDS for a in ("", "a")]
    negation = window("N", 3, {k: (k + "n", number(f"{k[0]} negated")) for k in heard})
    report = window("R", 1, {k: (k + "r", number(f"{k[0]} reported")) for k in heard}, keep=True)  # what is negated already stays so
    return reduce(lambda a, b: compose(a, b, CLASSES), (spoken(), aimed(), negation, report))


@lru_cache(maxsize=1)
def machine() -> tuple[Tables, np.ndarray]:
    """The grammar as arrays, and which of its states may end a clause."""
    t = grammar()
    tables = Tables.of(t, CLASSES, len(PARAMS))
    order, todo = {t.start: 0}, [t.start]  # the numbering of Tables.of
    while todo:
        s = todo.pop(0)
        for c in CLASSES:
            for to, _, _ in t.steps(s, c):
                if to not in order:
                    order[to] = len(order)
                    todo.append(to)
    owes = lambda s: isinstance(s, tuple) and (s[:1] == ("owes",) or any(owes(x) for x in s))
    return tables, np.array([not owes(s) for s in order])


@dataclass
class ToxicityModel:
    """lexicon and stems: learned words of abuse and beginnings of them. values: of PARAMS. a, b: from clauses to a score."""

    lexicon: frozenset[str]
    stems: frozenset[str]
    values: list[float] = field(default_factory=lambda: [PRIOR[p] for p in PARAMS])
    weights: list[float] = field(default_factory=lambda: [1.0, 0.0, 0.0, -2.0])

    def __post_init__(self) -> None:
        self.closed = {w: c for c, ws in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("I", INSULTS)) for w in ws}
        self.cache: dict[str, int] = {}

    def class_of(self, raw: str) -> int:
        """Number of the class of a lower-case word as it stands in a text, plus len(CLASSES) if it ends a clause."""
        w = raw.strip(_EDGES)
        c = self.closed.get(w, "O")
        if c not in "YNR":
            c = "L" if w in self.lexicon else c if c != "O" else "S" if any(w[:k] in self.stems for k in STEMS if len(w) >= k) else "O"
        out = CLASSES.index(c) + (len(CLASSES) if raw.endswith(_ENDS) else 0)
        if len(self.cache) > MOST_IN_CACHE:  # bounded memory; the cache only saves time
            self.cache.clear()
        self.cache[raw] = out
        return out

    def clauses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, clause, class) of the words of the texts that stand in clauses with a kind. Words fold in Arrow first."""
        lines = pc.split_pattern(pc.fill_null(pc.utf8_lower(texts), ""), "\n")
        doc_of_line = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
        words = pc.utf8_split_whitespace(lines.flatten())  # may hold empty words, which are idle
        flat = words.flatten().dictionary_encode()
        get, learn = self.cache.get, self.class_of
        known = np.fromiter((c if (c := get(w)) is not None else learn(w) for w in flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        line = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        code = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        ends, cls = code >= len(CLASSES), code % len(CLASSES)
        new = np.ones(len(code), bool)
        new[1:] = ends[:-1] | (line[1:] != line[:-1])
        clause = np.cumsum(new) - 1
        live = np.zeros(int(clause[-1]) + 1 if len(clause) else 0, bool)
        live[clause[cls < len(KINDS)]] = True
        keep = live[clause] if len(clause) else np.zeros(0, bool)
        line, clause, cls = line[keep], clause[keep], cls[keep]
        if len(clause):
            other = cls == CLASSES.index("O")
            breaks = np.nonzero(~other | (np.diff(clause, prepend=-1) != 0))[0]
            at = np.arange(len(clause))
            since = at - breaks[np.searchsorted(breaks, at, side="right") - 1]  # words since one that is not idle
            keep = ~other | (since < IDLE)
            line, clause, cls = line[keep], (np.cumsum(live) - 1)[clause[keep]], cls[keep]
        return doc_of_line[line], clause, cls

    def paths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, score, uses of parameters) of the best path of every clause that holds a kind."""
        doc, clause, cls = self.clauses(texts)
        tables, may_end = machine()
        score, used = best_paths(tables, may_end, cls, clause, np.array(self.values))
        first = np.nonzero(np.diff(clause, prepend=-1))[0]
        return doc[first], score, used

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per document: sum, largest and number (damped) of its clauses' scores, those above zero."""
        doc, score, _ = self.paths(texts)
        return gathered(doc, score, len(texts))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.features(texts) @ np.array(self.weights[:-1]) + self.weights[-1])


def best_paths(tables: Tables, may_end: np.ndarray, cls: np.ndarray, clause: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables.best over the runs that may end. Equal clauses are solved once.

    A clause that owes a target at its end has no such run; the run without the guess always exists.
    """
    if not len(clause):
        return np.zeros(0), np.zeros((0, len(values)), np.int64)
    first = np.nonzero(np.diff(clause, prepend=-1))[0]
    keys = [c.tobytes() for c in np.split(cls.astype(np.uint8), first[1:])]
    number_of = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    own = [np.frombuffer(k, np.uint8) for k in number_of]
    flat = np.concatenate(own).astype(np.int64)
    runs = np.repeat(np.arange(len(own)), [len(o) for o in own])
    score, used = tables.best(flat, runs, values, may_end)
    at = np.fromiter((number_of[k] for k in keys), np.int64, len(keys))
    return score[at], used[at]


def gathered(doc: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    up = np.maximum(score, 0)
    total, top = np.zeros(n), np.zeros(n)
    np.add.at(total, doc, up)
    np.maximum.at(top, doc, up)
    count = np.bincount(doc[up > 0.5], minlength=n)
    return np.stack([np.log1p(total), np.minimum(top, 4.0), np.minimum(count, 4.0)], axis=1)


def learn_lexicon(sample: DataFrame, shares: dict[int, int], least: int = 3, share: float = 0.004, precision: float = 0.9) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings that stand in toxic documents of the sample and hardly in others.

    Counts are made in Spark over the bounded sample. A key counts if toxic documents hold it, at least least of them and a
    share of all, at as many different places (by the words around it, so that copies of one text count once), and if the
    share of toxic ones, with the sample weighted back to the labels' own shares, is precision or more. That bounds the keys
    by what the sample can support. A stem stands for words not seen in learning; it must have several.
    """
    ws = F.split(F.lower("text"), r"\s+")
    near = F.arrays_zip(ws.alias("w"), F.concat(F.array(F.lit("")), ws).alias("before"), F.slice(ws, 2, 1_000_000_000).alias("after"))
    words = sample.select("doc_id", "y", F.explode(near).alias("x")).select("doc_id", "y", F.trim(F.col("x.w"), F.lit(_EDGES)).alias("w"), F.xxhash64("x.before", "x.after").alias("place"))
    words = words.where(F.length("w") >= 3)
    n = {r.y: r.c for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not n.get(0) or not n.get(1):
        return frozenset(), frozenset()
    least = max(least, int(np.ceil(share * n[1])))
    ratio = (shares[0] / n[0]) / (shares[1] / n[1])

    def support(rows: DataFrame, key: str, *more) -> DataFrame:
        one, none = F.col("y") == 1, F.col("y") == 0
        out = rows.groupBy(key).agg(F.countDistinct(F.when(one, F.col("doc_id"))).alias("docs"), F.countDistinct(F.when(one, F.col("place"))).alias("places"), F.countDistinct(F.when(none, F.col("doc_id"))).alias("neg"), *more)
        return out.withColumn("pos", F.least("docs", "places"))

    seeds = F.col("w").isin(INSULTS + THREATS)  # known beforehand, so fewer finds make them sure
    few = F.when(seeds, F.lit(2)).otherwise(F.lit(2 * least))
    good = (F.col("pos") >= few) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg") * F.lit(ratio) + F.when(seeds, 0.2).otherwise(0.5)))
    lexicon = [r.w for r in support(words, "w").where(good).select("w").collect()]
    keys = words.select("doc_id", "y", "w", "place", F.explode(F.array(*[F.lit(k) for k in STEMS])).alias("k")).where(F.length("w") >= F.col("k"))
    keys = keys.withColumn("stem", F.substring("w", F.lit(1), F.col("k")))
    sure = (F.col("n_w") >= 3) & (F.col("pos") >= 2 * least) & (F.col("pos") >= 0.97 * (F.col("pos") + F.col("neg") * F.lit(ratio) + 0.2))
    found = [r.stem for r in support(keys, "stem", F.countDistinct("w").alias("n_w")).where(sure).select("stem").collect()]
    return frozenset(lexicon), frozenset(found)


def learn_values(used: list[np.ndarray], y: np.ndarray, weight: np.ndarray, values: np.ndarray, pull: float = 2.0, rounds: int = 200) -> np.ndarray:
    """Values of the parameters by gradient steps on the logistic loss of documents' summed clause scores.

    used: per document the parameters its best paths use. Values are pulled towards their prior, so what the sample says
    little about (a negated threat, say) stays as the grammar has it; negation and report never add.
    """
    counts = np.stack(used).astype(float)
    n = counts[:, : len(KINDS)].sum(axis=1, keepdims=True)
    damp = counts / np.maximum(1.0, n) * np.log1p(n)
    prior, bias, v = values.copy(), -2.0, values.copy()
    for step in range(rounds):
        p = sigmoid(damp @ v + bias)
        g = damp.T @ (weight * (y - p)) - pull * (v - prior)
        rate = 2.0 / max(1.0, len(y)) / (1 + step / 100)
        v, bias = v + rate * g, bias + rate * float((weight * (y - p)).sum())
        k = len(KINDS)
        v[: 2 * k] = np.maximum(v[: 2 * k], 0.0)
        for lead in (2 * k, 3 * k):
            v[lead : lead + k] = np.minimum(v[lead : lead + k], -CANCEL * (v[:k] + v[k : 2 * k]))
    return v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_each: int = MOST_EACH) -> ToxicityModel:
    """Lexicon, arc weights and the map to a score, from at most most_each documents of each label.

    Labels are cut to the learning fold first: nothing here sees a held-out one. Without documents of both labels every
    score is the one label's smoothed share. Only counts come to the driver, as many rows as the sample has.
    """
    labels = fold_of(labels)
    sample = cut(sample_of(docs, labels, label, most_each))
    shares = shares_of(labels, label)
    lexicon, stems = learn_lexicon(sample, shares)
    model = ToxicityModel(lexicon, stems)
    rows = paths_of(sample, model).collect()  # a row per document of the sample, ten numbers each
    y = np.array([r.y for r in rows], float)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        model.weights = [0.0, 0.0, 0.0, float(np.log(p / (1 - p)))]
        return model
    weight = np.where(y == 1, shares.get(1, 1) / (y == 1).sum(), shares.get(0, 1) / (y == 0).sum())
    weight *= len(y) / weight.sum()
    values = learn_values([np.array(r.used) for r in rows], y, weight, np.array(model.values))
    model = ToxicityModel(lexicon, stems, values.tolist())
    rows = paths_of(sample, model).collect()
    y = np.array([r.y for r in rows], float)
    weight = np.where(y == 1, shares.get(1, 1) / (y == 1).sum(), shares.get(0, 1) / (y == 0).sum())
    weight *= len(y) / weight.sum()
    model.weights = np.maximum(logistic(np.array([r.features for r in rows]), y, 1.0, weight), [0.0, 0.0, 0.0, -np.inf]).tolist()
    return model


def paths_of(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    """(y, used, features): per document of a labelled sample."""
    given = (model.lexicon, model.stems, model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*given)
        for b in batches:
            for k, n in bounded(b.column(1)):
                part = b.slice(k, n)
                doc, score, used = own.paths(part.column(1))
                total = np.zeros((part.num_rows, len(PARAMS)), np.int64)
                np.add.at(total, doc, used)
                x = gathered(doc, score, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total.tolist(), pa.list_(pa.int64())), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "used", "features"])

    return sample.select("y", "text").mapInArrow(run, "y int, used array<long>, features array<double>")


def bounded(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of about most bytes of texts, or of one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        done = size[first - 1] if first else 0
        n = max(1, int(np.searchsorted(size, done + most, side="right")) - first)
        yield first, n
        first += n


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row, whole texts.

    Null and empty texts have no clause and the score of none. Ids pass through, null or repeated; equal texts have equal
    scores. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    given = (model.lexicon, model.stems, model.values, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*given)
        for b in batches:
            score = [own.scores(b.column(1).slice(k, n)) for k, n in bounded(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
