"""Toxicity by a weighted finite-state grammar over the clauses of a text.

A text is cut into clauses; the words of a clause become symbols: insult, threat, target (whom it is said to), negation,
report (said by somebody else) or anything else. Each of these transducers is a table of states by symbols, with the state
that follows and the mark that a word read in that state gets:

* negation: after a negation word the next ``REACH`` words are denied;
* report: after a reporting word the rest of the clause is somebody's words;
* target: the next ``REACH`` words after an addressed person are targeted;
* insult and threat: such a word is a match.

``compose`` makes the product of such tables, one state for each combination of theirs, whose marks are all of theirs. The
product of the four reads a clause from left to right, the target table alone reads it from right to left, and a last table
turns the marks of a match into its kind: plain, targeted, negated or reported.

A clause scores the weighted sum of its matches, a text the sum over its clauses and a bias, as a logistic probability. What
counts is where and how a word is used, not that it occurs.

The insult lexicon and the weights are learned from labelled rows. Candidates are words and word beginnings that are met in
toxic texts more often than chance explains: by the Chernoff bound, fewer than ``FALSE_TERMS`` of all terms are expected to
pass without reason. They are picked greedily until toxic texts are covered several times over. The weights of the kinds
of matches come from regularised logistic regression, each half of the rows read with the lexicon of the other half.
Learning takes at most ``SAMPLE`` labelled rows, the first by hash of the id; this bounds what the driver holds. Near copies
with one label count as one text, as they say little about which of their words matter; only if the different texts show no
insult at all do repeats count. Scoring reads every text where it lies; nothing but the lexicon travels. Labels, language,
source and id are no inputs of a score.

Defined cases: a null or empty text has no clauses and scores by the bias; a null id has no label; rows with one id in
the labels more than once count as toxic if any says so; without toxic labelled rows the lexicon is empty and scores are
the smoothed share of toxic rows; an empty table gives an empty result; repeated rows score alike; other columns are kept
only if asked for.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import slices, whole, written

SLICE_BYTES = 4 << 20
SAMPLE = 20_000
REACH = 3
BEGINNINGS = (4, 5, 6)
FALSE_TERMS = 0.05
LEAST_ODDS = 8.0
LEAST_GAIN = 2
COVERED = 3
KEPT_WORDS = 300_000

# symbols of the words that need no learning, in four languages
TARGETS = "you your yours yourself he she they him her them du dich dir dein ihr euch er sie tu toi te vous votre il elle ils tú usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never none nor neither without cannot dont isnt nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says say called calls wrote writes quoted quote told claimed sagte sagt nannte schrieb zitat dit disait appelé écrit citation dijo dice llamó escribió cita".split()
THREATS = "kill hurt destroy beat stab shoot burn töten umbringen schlagen erschießen tuer frapper détruire brûler matar golpear destruir quemar".split()

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
_OTHER, _BREAK, _TARGET, _NEGATION, _REPORT, _THREAT = "", ".", "t", "n", "r", "x"
SYMBOLS = (_OTHER, _TARGET, _NEGATION, _REPORT, "i", _THREAT)
KINDS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_negated", "threat_reported")
#: The weight of a plain insult of weight 1 before any label is seen, and the other kinds as shares of it.
SURE = 8.0
PRIOR = np.array([1.0, 1.2, 0.3, 0.4, 0.0, 0.6, 0.0, 0.1])


# marks of a word
_DENIED, _REPORTED, _TARGETED, _INSULT, _THREATENED = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Transducer:
    """``follow[state, symbol]`` and ``mark[state, symbol]``, the mark given for a word read in that state; state 0 starts."""

    follow: np.ndarray
    mark: np.ndarray


def _counting(symbol: str, reach: int, mark: int) -> Transducer:
    """Marks the next ``reach`` words after ``symbol``."""
    follow = np.repeat(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], len(SYMBOLS), axis=1)
    follow[:, SYMBOLS.index(symbol)] = reach
    marks = np.zeros_like(follow)
    marks[1:] = mark
    return Transducer(follow, marks)


def _lasting(symbol: str, mark: int) -> Transducer:
    """Marks all words after ``symbol``."""
    follow = np.repeat(np.arange(2)[:, None], len(SYMBOLS), axis=1)
    follow[:, SYMBOLS.index(symbol)] = 1
    return Transducer(follow, np.where(np.arange(2)[:, None] > 0, mark, 0) + np.zeros_like(follow))


def _marking(marks: dict[str, int]) -> Transducer:
    """Marks words by their own symbol."""
    return Transducer(np.zeros((1, len(SYMBOLS)), dtype=int), np.array([[marks.get(s, 0) for s in SYMBOLS]]))


def compose(*parts: Transducer) -> Transducer:
    """The product: state numbers are mixed from those of the parts, marks are put together."""
    whole = parts[0]
    for part in parts[1:]:
        n = len(part.follow)
        follow = (whole.follow[:, None, :] * n + part.follow[None, :, :]).reshape(-1, len(SYMBOLS))
        whole = Transducer(follow, (whole.mark[:, None, :] | part.mark[None, :, :]).reshape(-1, len(SYMBOLS)))
    return whole


_TARGETING = _counting(_TARGET, REACH, _TARGETED)
_FORWARD = compose(_counting(_NEGATION, REACH, _DENIED), _lasting(_REPORT, _REPORTED), _TARGETING, _marking({"i": _INSULT, _THREAT: _THREATENED}))


def _kind(marks: int) -> int:
    """The kind of a match by its marks: what is denied is so whoever is meant, then what is reported; -1 is no match."""
    how = 2 if marks & _DENIED else 3 if marks & _REPORTED else 1 if marks & _TARGETED else 0
    return how if marks & _INSULT else how + 4 if marks & _THREATENED else -1


_KIND_OF = [_kind(m) for m in range(32)]
_NUMBER = {s: k for k, s in enumerate(SYMBOLS)}
_FOLLOW, _MARK = _FORWARD.follow.tolist(), _FORWARD.mark.tolist()
_BACK, _BACK_MARK = _TARGETING.follow.tolist(), _TARGETING.mark.tolist()


@dataclass
class Grammar:
    """Learned insults (words, and word beginnings), weights of kinds of matches, and the bias."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR * SURE)
    bias: float = -4.0

    def __post_init__(self) -> None:
        self._symbols: dict[str, tuple[str, float]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_symbols"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._symbols = {}

    def symbol(self, token: str) -> tuple[str, float]:
        """The symbol of a lower-case token, and the weight of an insult."""
        known = self._symbols.get(token)
        if known is None:
            if len(self._symbols) >= KEPT_WORDS:
                self._symbols.clear()
            known = self._symbols[token] = self._classify(token)
        return known

    def _classify(self, token: str) -> tuple[str, float]:
        weight = max(self.words.get(token, 0.0), *(self.beginnings.get(token[:n], 0.0) if len(token) >= n else 0.0 for n in BEGINNINGS))
        if weight:
            return "i", weight
        if token in _FIXED:
            return _FIXED[token], 0.0
        return (_BREAK, 0.0) if token in ".!?;:,\n" else (_OTHER, 0.0)

    def matches(self, text: str) -> np.ndarray:
        """Summed weights of the matches of each kind."""
        sums = np.zeros(len(KINDS))
        symbol = self.symbol
        symbols = [symbol(t) for t in _TOKEN.findall(text.lower())]
        start = 0
        hits = [i for i, (s, _) in enumerate(symbols) if s == "i" or s == _THREAT]
        for i in hits:
            if i < start:
                continue
            a = i
            while a > 0 and symbols[a - 1][0] != _BREAK:
                a -= 1
            b = i
            while b < len(symbols) and symbols[b][0] != _BREAK:
                b += 1
            self._read(symbols[a:b], sums)
            start = b
        return sums

    def _read(self, clause: list[tuple[str, float]], sums: np.ndarray) -> None:
        """Run the composed tables over one clause, forth and back."""
        read = [_NUMBER[s] for s, _ in clause]
        state, marks = 0, []
        for s in read:
            marks.append(_MARK[state][s])
            state = _FOLLOW[state][s]
        state = 0
        for i in range(len(read) - 1, -1, -1):
            kind = _KIND_OF[marks[i] | _BACK_MARK[state][read[i]]]
            if kind >= 0:
                sums[kind] += clause[i][1] or 1.0
            state = _BACK[state][read[i]]

    def probability(self, sums: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sums @ self.weights, -40, 40))))


_FIXED = {w: s for s, ws in ((_TARGET, TARGETS), (_NEGATION, NEGATIONS), (_REPORT, REPORTS), (_THREAT, THREATS)) for w in ws}


def terms_of(text: str) -> set[str]:
    """The words of a text, and their beginnings marked by a star."""
    words = {t for t in _TOKEN.findall(text.lower()) if len(t) > 2}
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


def _signature(text: str) -> int:
    """The smallest hash of three words in a row: texts that share most of their words mostly share it."""
    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return min((digest(b" ".join(t)) for t in zip(words, words[1:], words[2:])), default=digest(b" ".join(words))) >> 1


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE_BYTES):
        marks = [_signature(t) for t in part.column("text").to_pylist()]
        yield pa.record_batch([part.column("text"), part.column("toxic"), pa.array(marks, pa.int64())], names=["text", "toxic", "mark"])


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int, repeats: bool = False) -> DataFrame:
    """At most ``most`` labelled rows of docs: text, toxic, half. Of near copies with one label mostly one stays, but with ``repeats`` all."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy(F.col(id_column).cast("long").alias("__id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    # bounded by `most` rows of two numbers
    known = docs.join(F.broadcast(known), F.col(id_column).cast("long") == F.col("__id")).select(whole(text_column).alias("text"), "toxic")
    rows = known.mapInArrow(_signed, "text string, toxic int, mark long")
    if not repeats:
        rows = rows.groupBy("mark", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", "toxic", F.pmod(F.xxhash64("mark"), F.lit(2)).alias("half"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for part in slices(batches, "text", SLICE_BYTES):
        for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            (toxic if label else clean).update(terms_of(text))
        terms = list(toxic.keys() | clean.keys())
        yield pa.record_batch(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
            names=["term", "toxic", "clean"],
        )
        toxic.clear()
        clean.clear()


def _pick(candidates: dict[str, float], holds: list[list[str]]) -> list[str]:
    """Terms that between them cover each list ``COVERED`` times as far as it goes, the most useful first.

    Of terms that begin alike, a word and its beginnings, only one is picked.
    """
    lists = defaultdict(list)
    for i, terms in enumerate(holds):
        for t in terms:
            lists[t].append(i)
    left, picked = [COVERED] * len(holds), []
    while lists:
        gains = {t: sum(left[i] > 0 for i in own) for t, own in lists.items()}
        # equal gains: a whole word before a beginning, a longer beginning before a shorter
        best = max(gains, key=lambda t: (gains[t] * candidates[t], not t.endswith("*"), len(t), t))
        if gains[best] < LEAST_GAIN:
            break
        picked.append(best)
        for i in lists[best]:
            left[i] -= 1
        stem = best.rstrip("*")
        lists = {t: own for t, own in lists.items() if not (t.startswith(stem) or stem.startswith(t.rstrip("*")))}
    return picked


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.1, steps: int = 100) -> np.ndarray:
    """Logistic weights (the bias first), held to ``prior``, by Newton steps that are halved until they help."""
    x = np.column_stack([np.ones(len(x)), x])
    hold = np.full(x.shape[1], strength)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (hold * (w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + hold * (w - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        if size <= 1e-6 or now - (after := loss(w - size * move)) < 1e-9:
            break
        w, now = w - size * move, after
    return w


def _lexicon(sample: DataFrame) -> Grammar:
    """A grammar with the insults that the labelled rows show, and no learned weights."""
    counted = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Grammar()
    rate = (n_toxic + 1) / (n_toxic + n_clean + 2)
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    # n times the relative entropy of the share to the rate: minus the log of the chance of such a share, at most
    surprise = n * (share * F.log(share / rate) + F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    shown = counted.where("toxic > 0").select("term", surprise.alias("surprise"), odds.alias("odds"))
    tried = shown.where(F.col("surprise") >= -np.log(rate) * 3)  # rarer terms can't pass
    limit = np.log(max(tried.count(), 1) / FALSE_TERMS)
    pure = tried.where((F.col("surprise") >= float(limit)) & (F.col("odds") >= LEAST_ODDS)).select("term", (F.log("odds") / 10).alias("weight"))
    candidates = {r["term"]: r["weight"] for r in pure.collect()}  # no more than the terms of a bounded sample
    if not candidates:
        return Grammar()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            found = [sorted(terms_of(t) & candidates.keys()) for t in part.column("text").to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    holds = [r["terms"] for r in sample.where("toxic = 1").select("text").mapInArrow(held, "terms array<string>").collect()]
    picked = _pick(candidates, holds)
    return Grammar({t: candidates[t] for t in picked if not t.endswith("*")}, {t[:-1]: candidates[t] for t in picked if t.endswith("*")})


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most: int = SAMPLE) -> Grammar:
    """A grammar from labelled rows: ``labels`` holds only those that may be learned from."""
    sample = written(_sample(docs, labels, id_column, text_column, label_column, most), "toxicity-sample")
    full = _lexicon(sample)
    if not full.words and not full.beginnings:
        sample = written(_sample(docs, labels, id_column, text_column, label_column, most, repeats=True), "toxicity-sample")
        full = _lexicon(sample)
    halves = [_lexicon(sample.where(F.col("half") == h)) for h in (0, 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            sums = [halves[1 - h].matches(t).tolist() for t, h in zip(part.column("text").to_pylist(), part.column("half").to_pylist())]
            yield pa.record_batch([part.column("toxic"), pa.array(sums, pa.list_(pa.float64()))], names=["toxic", "sums"])

    rows = sample.mapInArrow(features, "toxic int, sums array<double>").collect()  # at most `most` rows of a few numbers
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    x = np.array([r["sums"] for r in rows], dtype=np.float64).reshape(len(rows), len(KINDS))
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
    prior = np.concatenate([[np.log(rate / (1 - rate))], PRIOR * SURE])
    fitted = _fit(x, y, prior)
    full.bias, full.weights = float(fitted[0]), fitted[1:]
    return full


def score(docs: DataFrame, grammar: Grammar, keep: list[str], text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """Columns ``keep`` of every row with score and predicted."""

    # a text that is kept travels once
    apart = text_column not in keep or docs.schema[text_column].dataType.simpleString() != "string"
    read = "__text" if apart else text_column

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, read, SLICE_BYTES):
            scores = [grammar.probability(grammar.matches(t or "")) for t in part.column(read).to_pylist()]
            yield pa.record_batch(
                [*(part.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*keep, "score", "predicted"],
            )

    kept = docs.select(*keep, *([whole(text_column).alias("__text")] if apart else []))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]]
    return kept.mapInArrow(work, ", ".join([*kinds, "score double", "predicted int"]))


def held_out(id_column: str = "doc_id"):
    """Whether labels of this row may not be learned from."""
    rest = F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3))
    return F.coalesce(rest == 1, F.lit(False))
