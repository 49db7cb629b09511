"""Toxicity: a Levenshtein automaton run along a lexicon trie, scored in context.

The lexicon is learned: words and word beginnings that labelled toxic documents
hold far more often than others, in contexts that are no copies of each other. Its terms form a trie. A word is matched by
running an automaton of edit distance 2 along the trie: one set of states, as
bits, for each number of edits, so all terms are tried at once and a branch ends
when no state is left. Words of ``FUZZY[0]`` letters may be misspelled by one edit,
of ``FUZZY[1]`` by two; beginnings of ``FUZZY[2]`` by one edit. As an edit spares one half
of a term, and two spare a third, only words that hold such a part in its place are
run; a task remembers words that it has seen. Each match
is weighed by its context of ``CONTEXT`` words: inside quotation marks or beside
a word of reporting it counts as quoted, beside a word of address as aimed at
the reader. A logistic regression on these sums, and on how far the matches
exceed what chance gives in a text of that length, yields the score.

Training reads at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of
their id, at every size of the corpus; lexicon counts are made in Spark and only
the best ``MAX_TERMS`` terms and the sample's feature rows reach the driver.
``MIN_DOCS`` and ``MAX_TERMS`` are parameters of this fit. Scoring reads all texts whole. Labels, language, source and id are never inputs.

Defined results: a null text is an empty one; texts without a match get the score
of such texts of their length. Without labelled rows of both kinds every score is
the share of toxic rows (0 if there are none). Repeated rows are scored alike.
A score of exactly 0.5 is predicted as 1. Only the named columns of both tables are read, so
others may have any names, those of the result included. Words have no greatest length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, recall, text_of

TRAIN_ROWS, MAX_TERMS, MIN_DOCS, MIN_ODDS = 12_000, 400, 6, 1.6
#: Least and greatest letters of a word beginning; letters of words that allow one edit and two, and of beginnings that allow one.
STEM, FUZZY = (4, 9), (5, 9, 6)
#: Shares of the documents of a beginning that a word, and a longer beginning, must have to stand for it.
MOSTLY = (0.6, 0.95)
#: Deviations by which the log odds must lie above MIN_ODDS: fewer would let in beginnings by chance.
SURE = 2.0
CONTEXT = 8
# Fixed word lists for the context, and characters that open or close a quotation.
REPORTING = frozenset("said says say wrote writes called quote quoted quoting cited citing term word reported phrase".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dein tu ton te vous votre usted tus".split())
QUOTES = "\"“”„«»‘’"
_STRIP = ".,;:!?()[]{}<>|*#$%&/\\+=~_-'`" + QUOTES


class Lexicon(NamedTuple):
    """terms: (text, is a beginning, log odds, rate per word in other texts)."""

    terms: list[tuple[str, bool, float, float]]


def edits_allowed(term: str, stem: bool) -> int:
    return int(len(term) >= FUZZY[2]) if stem else (len(term) >= FUZZY[0]) + (len(term) >= FUZZY[1])


class Automaton:
    """Levenshtein automata for all terms of a trie at once."""

    def __init__(self, lexicon: Lexicon):
        self.chance = sum(t[3] for t in lexicon.terms)
        self.stems = {t: k for k, (t, stem, _, _) in enumerate(lexicon.terms) if stem}
        self.stem_lengths = sorted({len(t) for t in self.stems})
        self.whole = {t: k for k, (t, stem, _, _) in enumerate(lexicon.terms) if not stem}
        # No term reaches further than this into a word: longer words are tried by their beginning.
        self.reach = max((len(t) + edits_allowed(t, stem) for t, stem, _, _ in lexicon.terms), default=0) + 1
        # The trie: children by character; "" holds (term, edits allowed) of words, "*" of beginnings, "^" the most edits below.
        self.root: dict = {"^": 0}
        # Parts of terms: at the start of words of certain lengths, at their end, or near a place in them.
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        self.middles: dict[str, set[int]] = {}
        for k, (t, stem, _, _) in enumerate(lexicon.terms):
            most, n = edits_allowed(t, stem), len(t)
            if not most:
                continue
            node = self.root
            node["^"] = max(node["^"], most)
            for c in t:
                node = node.setdefault(c, {"^": 0})
                node["^"] = max(node["^"], most)
            node["*" if stem else ""] = (k, most)
            cuts = [n * j // (most + 1) for j in range(most + 2)]
            # A beginning may have any number of letters after it.
            lengths = range(n - most, self.reach + 1 if stem else n + most + 1)
            self.heads.setdefault(t[: cuts[1]], set()).update(lengths)
            if not stem:
                self.tails.setdefault(t[cuts[-2] :], set()).update(lengths)
            for a, z in list(zip(cuts[1:], cuts[2:], strict=False))[: None if stem else -1]:
                self.middles.setdefault(t[a:z], set()).update((a - 1, a, a + 1))
        self.head_lengths, self.tail_lengths, self.middle_lengths = (sorted({len(x) for x in d}) for d in (self.heads, self.tails, self.middles))

        self.middle = re.compile("|".join(map(re.escape, sorted(self.middles)))) if self.middles else None

    def fuzzy(self, word: str) -> int | None:
        """The term with the fewest edits to the word that it allows; None if there is none.

        Bit i of a state set says: i characters of the word can stand for the trie
        path so far, without an edit in the first set, with one in the second, two in the third.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        final, full = 1 << n, (1 << n + 1) - 1
        best: tuple[int, int] | None = None
        stack = [(self.root, 1, 3, 7 & full)]
        while stack:
            node, e0, e1, e2 = stack.pop()
            for c, child in node.items():
                if c == "^":
                    continue
                if c in ("", "*"):
                    k, most = child
                    at = final if c == "" else full
                    edits = 0 if e0 & at else 1 if e1 & at else 2 if e2 & at else 3
                    if edits <= most and (best is None or (edits, k) < best):
                        best = (edits, k)
                    continue
                hit = masks.get(c, 0)
                f0 = (e0 & hit) << 1
                # With an edit used: a match, a character of the term left out, swapped, or one too many in the word.
                f1 = ((e1 & hit) << 1 | e0 | e0 << 1 | f0 << 1) & full
                f2 = ((e2 & hit) << 1 | e1 | e1 << 1 | f1 << 1) & full if child["^"] > 1 else 0
                if f1 | f2:
                    stack.append((child, f0, f1, f2))
        return best[1] if best else None

    def _may_match(self, word: str) -> bool:
        n = len(word)
        if any(n in self.heads.get(word[:m], ()) for m in self.head_lengths) or any(n in self.tails.get(word[-m:], ()) for m in self.tail_lengths):
            return True
        if not self.middle or not self.middle.search(word):
            return False
        return any(i in self.middles.get(word[i : i + m], ()) for m in self.middle_lengths for i in range(n - m + 1))

    def match(self, word: str) -> tuple[int, bool] | None:
        """(term, whether it is misspelled) of a bare lower-case word."""
        k = self.whole.get(word)
        if k is not None:
            return k, False
        for m in self.stem_lengths:
            if m > len(word):
                break
            k = self.stems.get(word[:m])
            if k is not None:
                return k, False
        word = word[: self.reach]
        if self._may_match(word):
            k = self.fuzzy(word)
            if k is not None:
                return k, True
        return None


def _words(text: str) -> list[str]:
    return [raw.strip(_STRIP) for raw in text.lower().split()]


def _terms_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a final "*"."""
    return [word, *(word[:m] + "*" for m in range(STEM[0], min(STEM[1], len(word)) + 1))] if len(word) >= 3 else []


def _evidence(toxic: DataFrame) -> DataFrame:
    """(term, c1, d1) of the terms of texts: occurrences, and documents whose contexts are independent.

    A document's context of a term is the word before and the word after its first place. Copies of one text, even
    with some words changed, share one of the two with each other, so contexts count that share neither with the
    commonest ones of the term.
    """

    def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                ws = ["", *_words(text), ""]
                found: dict[str, list] = {}
                for before, w, after in zip(ws, ws[1:], ws[2:], strict=False):
                    for t in _terms_of(w):
                        found.setdefault(t, [before, after, 0])[2] += 1
                yield pd.DataFrame([(t, *v) for t, v in found.items()], columns=["term", "before", "after", "n"])

    places = toxic.select("text").mapInPandas(around, "term string, before string, after string, n long")
    places = cut(places.groupBy("term", F.xxhash64("before").alias("before"), F.xxhash64("after").alias("after")).agg(F.count("*").alias("d"), F.sum("n").alias("n")))
    commonest = lambda c: places.groupBy("term", c).agg(F.sum("d").alias("d")).groupBy("term").agg(F.max_by(c, F.struct("d", c)).alias("most_" + c))
    apart = (F.col("before") != F.col("most_before")) & (F.col("after") != F.col("most_after"))
    found = places.join(commonest("before"), "term").join(commonest("after"), "term").groupBy("term").agg(F.sum("n").alias("c1"), (F.count_if(apart) + 1).alias("d1"))
    return found.filter(F.col("d1") >= MIN_DOCS)


def learn_lexicon(train: DataFrame) -> Lexicon:
    """From (text, label): terms by log odds of their rates, at most MAX_TERMS."""
    words = F.size(F.split("text", r"\s+"))
    n1, n0 = train.agg(F.sum(F.when(F.col("label") == 1, words)), F.sum(F.when(F.col("label") == 0, words))).first()
    if not n1 or not n0:
        return Lexicon([])
    evidence = cut(_evidence(train.filter("label = 1")))
    # Terms in several contexts of a bounded sample.
    wanted = train.sparkSession.sparkContext.broadcast(frozenset(r.term for r in evidence.select("term").collect()))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, terms, known = Counter(), wanted.value, {}
        for frame in frames:
            for text in frame["text"]:
                seen = Counter(_words(text))
                for n, found in zip(seen.values(), recall(list(seen), known, lambda w: [t for t in _terms_of(w) if t in terms]), strict=True):
                    for t in found:
                        sums[t] += n
        yield pd.DataFrame(list(sums.items()), columns=["term", "n"])

    others = train.filter("label = 0").select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = evidence.join(others, "term", "left").withColumn("c0", F.coalesce("n", F.lit(0)))
    odds = F.log((F.col("c1") + 0.5) / n1) - F.log((F.col("c0") + 0.5) / n0)
    # Weight of evidence: contexts count, so that one text, long or copied, does not make a term.
    best = sums.withColumn("odds", odds).filter(F.col("odds") - SURE * F.sqrt(1 / F.col("d1") + 1 / (F.col("c0") + 0.5)) >= MIN_ODDS).orderBy((F.col("odds") * F.sqrt("d1")).desc(), "term").limit(4 * MAX_TERMS).collect()
    chosen: dict[str, tuple[str, bool, float, float]] = {}
    by_start: dict[str, list] = {}
    for r in best:
        by_start.setdefault(r.term[: STEM[0]], []).append(r)
    for r in best:
        # A beginning that mostly stands in one word, or in a longer beginning, gives way to it: these may be misspelled.
        if r.term.endswith("*"):
            longer = [x for x in by_start[r.term[: STEM[0]]] if x.term.startswith(r.term[:-1]) and x.d1 >= MOSTLY[x.term.endswith("*")] * r.d1]
            r = max(longer, key=lambda x: (len(x.term.rstrip("*")), not x.term.endswith("*"), x.d1))
        if r.term in chosen:
            continue
        stem = r.term.endswith("*")
        t = r.term.rstrip("*")
        # A stem or word inside a chosen stem adds nothing.
        if any((t[:m] + "*") in chosen for m in range(STEM[0], len(t) + (0 if stem else 1))):
            continue
        # A stem that is one chosen word only.
        if stem and any(not x[1] and x[0].startswith(t) for x in chosen.values()):
            continue
        chosen[r.term] = (t, stem, float(r.odds), float((r.c0 + 0.5) / n0))
        if len(chosen) >= MAX_TERMS:
            break
    return Lexicon(list(chosen.values()))


FEATURES = 10


_MACHINE: list = []


def machine_of(lexicon: Lexicon) -> Automaton:
    """The automaton of a lexicon; a worker process keeps the last one."""
    key = tuple(lexicon.terms)
    if not _MACHINE or _MACHINE[0] != key:
        _MACHINE[:] = [key, Automaton(lexicon)]
    return _MACHINE[1]


def _look_up(raw: str, machine: Automaton) -> tuple:
    """(term or -1, misspelled, reporting, address) of a word as it stands; empty if it is nothing."""
    w = raw.strip(_STRIP)
    hit = machine.match(w) if w else None
    said, to = w in REPORTING, w in ADDRESS
    return (*(hit or (-1, False)), said, to) if hit or said or to else ()


def features(text: str, machine: Automaton, terms: list[tuple[str, bool, float, float]], known: dict[str, tuple]) -> np.ndarray:
    """The numbers that the regression sees. ``known`` remembers words."""
    words = text.lower().split()
    n = len(words)
    found = recall(words, known, lambda w: _look_up(w, machine))
    spots = [i for i, hit in enumerate(found) if hit]
    hits = [i for i in spots if found[i][0] >= 0]
    chance = n * machine.chance
    whole = stems = misspelled = quoted = aimed = 0.0
    distinct: set[int] = set()
    marks = None
    if hits and any(q in text for q in QUOTES[:6]):  # running number of quotation marks
        marks = np.cumsum([sum(map(w.count, QUOTES[:6])) for w in words])
    for i in hits:
        k, off = found[i][:2]
        a, z = bisect_left(spots, i - CONTEXT), bisect_right(spots, i + CONTEXT)
        near = [found[j] for j in spots[a:z]]
        in_quotes = marks is not None and (marks[i] % 2 == 1 or (words[i][:1] in QUOTES and words[i][-1:] in QUOTES))
        reported = in_quotes or any(x[2] for x in near)
        weight = terms[k][2] * (0.3 if reported else 1.0)
        distinct.add(k)
        if terms[k][1]:
            stems += weight
        else:
            whole += weight
        misspelled += off
        quoted += reported
        aimed += any(x[3] for x in near)
    count = len(hits)
    over = (count - chance) / np.sqrt(chance + 1)
    return np.array([np.log1p(whole), np.log1p(stems), np.log1p(max(0.0, over)), np.log1p(len(distinct)), np.log1p(misspelled), np.log1p(quoted), np.log1p(aimed), np.log1p(n), count / (n + 20), float(count > 0)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant first, means, scales) by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (z.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    base: float


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and regression from a bounded sample of the labels that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.filter(~is_held_out(F.col("lid")))
    n = known.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    chosen = cut(known.filter(F.pmod(F.xxhash64(F.col("lid").cast("string"), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)))
    # The sample's size is known and bounded, so ids are sent to the texts and not texts to the ids.
    ids = F.broadcast(chosen) if chosen.count() <= 2 * TRAIN_ROWS else chosen
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(ids, F.col("id") == F.col("lid"))
    sample = cut(texts.select("text", "label").repartition(12))
    lexicon = learn_lexicon(sample)

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, known = machine_of(lexicon), {}
        for frame in frames:
            yield pd.DataFrame({"x": [features(t, machine, lexicon.terms, known) for t in frame["text"]], "label": frame["label"]})

    rows = sample.mapInPandas(describe, "x array<double>, label int").toPandas()
    y = rows["label"].to_numpy(float)
    base = float(y.mean()) if len(y) else 0.0
    if not lexicon.terms or base in (0.0, 1.0):
        return Model(lexicon, np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), base)
    return Model(lexicon, *fit_logistic(np.stack(rows["x"].tolist()), y), base)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, score) of each row."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms and a few numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        machine, known = machine_of(m.lexicon), {}
        for frame in frames:
            x = np.array([features(t, machine, m.lexicon.terms, known) for t in frame["_text"]]).reshape(len(frame), FEATURES)
            if m.weights.any():
                score = 1 / (1 + np.exp(-np.clip(m.weights[0] + (x - m.mean) / m.scale @ m.weights[1:], -30, 30)))
            else:
                score = np.full(len(frame), m.base)
            yield pd.DataFrame({"id": frame["id"], "text_hash": frame["text_hash"], "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, text_hash long, score double")


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of each row, the model trained on rows that are not held out."""
    model = train_model(docs, labels, id_col, text_col, label_col)
    out = score_texts(docs, model, id_col, text_col)
    return out.select("id", is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
