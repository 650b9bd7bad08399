"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on posterior labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, text_of

#: Words that vote from the start.
SEED_LEXICON = ("idiot", "moron", "loser", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown", "scum")
#: At most so many labelled rows (those with the smallest hashes of doc_id) choose the voters and are fitted.
FIT_ROWS = 8000
STEMS = (4, 5)
#: How often a term has to occur for a vote: what is plain once may be telling when repeated.
TIMES = (1, 2, 3)
#: A term votes if its likelihood ratio statistic is so large: chance gives that to one in a million terms.
LEAST_GAIN = 26.0
#: And if at least so many of the labelled texts on which it fires are toxic.
LEAST_PRECISION = 0.8
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
#: Words that address someone.
ADDRESSES = {"you", "your", "youre", "du", "dich", "ihr", "tu", "toi", "vous", "usted"}


def terms_of(text: str) -> Counter:
    """Words in lower case, and their first letters as stems (marked *), with how often they occur."""
    words = Counter(WORD.findall(text.lower()))
    terms = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) >= size:
                terms[word[:size] + "*"] += n
    return terms


def votes_of(text: str) -> list[str]:
    """The lexicon votes that a text can give: a term and how often it occurs at least ("term 2")."""
    return [f"{term} {least}" for term, n in terms_of(text).items() for least in TIMES if n >= least]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic of a bounded sample of labelled rows outside the held-out fold; the broadcast side has `rows` rows at most."""
    fold = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    fold = fold.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(some), "doc_id").select("text", "toxic")


def vote_counts(sample: DataFrame) -> DataFrame:
    """vote, pos, neg: labelled texts that give a lexicon vote, summed per Arrow batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(toxic > 0)].update(votes_of(text))
            votes = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({"vote": pa.array(votes, pa.string()), "pos": pa.array([counts[1][t] for t in votes], pa.int64()), "neg": pa.array([counts[0][t] for t in votes], pa.int64())})

    return sample.mapInArrow(run, "vote string, pos long, neg long").groupBy("vote").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def candidate_voters(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """The seed lexicon and every vote of enough contrast between the labelled classes: as many as the sample's words allow."""
    rate = min(max(n_pos / max(1, n_pos + n_neg), 1e-9), 1 - 1e-9)
    pos, neg = F.col("pos"), F.col("neg")
    told = vote_counts(sample).where((pos > (pos + neg) * F.lit(0.5)) & (gain(pos, neg, rate, F.log) >= LEAST_GAIN))
    return sorted({*(f"{word} 1" for word in SEED_LEXICON), *(r.vote for r in told.select("vote").collect())})


class Voters:
    """Lexicon voters (a term occurs so often), and pattern voters over words, letter case, marks and all lexicon hits."""

    patterns = ("any vote", "dense hits", "several votes", "vote and marks", "addressed", "shouting")

    def __init__(self, lexicon: list[str]) -> None:
        self.lexicon = [(term, int(least)) for term, least in (x.split(" ") for x in lexicon)]
        self.terms = sorted({term for term, _ in self.lexicon})
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.at = np.array([self.index[t] for t, _ in self.lexicon], np.int64)
        self.least = np.array([n for _, n in self.lexicon])
        self.size = len(self.terms) + 4

    def counts(self, texts: list[str]) -> np.ndarray:
        """How often each term occurs; then words, exclamation marks, hits within three words of an address, words in capitals."""
        out = np.zeros((len(texts), self.size))
        k = len(self.terms)
        for row, text in enumerate(texts):
            plain = WORD.findall(text)
            hits, near, addressed = out[row], -9, 0
            for at, word in enumerate(w.lower() for w in plain):
                if word in ADDRESSES:
                    near = at
                hit = False
                for term in (word, *(word[:s] + "*" for s in STEMS)):
                    if (i := self.index.get(term)) is not None:
                        hits[i] += 1
                        hit = True
                addressed += hit and at - near <= 3
            hits[k:] = len(plain), text.count("!"), addressed, sum(w.isupper() and len(w) > 2 for w in plain)
        return out

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """1 where a voter says toxic."""
        k = len(self.terms)
        lexicon = counts[:, self.at] >= self.least
        cast = lexicon.sum(axis=1)
        words, marks, addressed, capitals = counts[:, k:].T
        dense = counts[:, :k].sum(axis=1) >= 0.01 * words
        patterns = [cast > 0, (cast > 0) & dense, cast > 1, (cast > 0) & (marks >= 3), (cast > 0) & (addressed > 0), capitals >= 0.3 * np.maximum(words, 1)]
        return np.column_stack([lexicon, *patterns]).astype(float)

    def speaks(self) -> np.ndarray:
        """1 for the voters that speak on every text; the others abstain when they do not fire."""
        return np.array([0.0] * len(self.lexicon) + [1.0] + [0.0] * (len(self.patterns) - 1))

    def features(self, counts: np.ndarray) -> np.ndarray:
        """What the classifier sees: the voters' votes, and counts and shares on a log scale."""
        k = len(self.terms)
        words = np.maximum(counts[:, [k]], 1)
        return np.concatenate([self.votes(counts), np.log1p(counts[:, :k]), np.log1p(100 * counts[:, k + 1 :] / words)], axis=1)


def gain(pos, neg, rate: float, log):
    """The likelihood ratio statistic of a term's labels against the share `rate` of toxic ones."""
    return 2 * (pos * log((pos + 1e-9) / ((pos + neg + 1e-9) * rate)) + neg * log((neg + 1e-9) / ((pos + neg + 1e-9) * (1 - rate))))


def covering(hits: np.ndarray, toxic: np.ndarray, rate: float) -> list[int]:
    """Columns of hits (rows x terms) that each tell of rows on which no earlier one fires: best first, until the rows that
    are left give none a gain of LEAST_GAIN. So stems of a chosen word, and words that only copies share, get no voice."""
    chosen, left = [], np.ones(len(hits), bool)
    while left.any():
        pos, neg = (hits[left & on].sum(axis=0, dtype=np.int64) for on in (toxic, ~toxic))
        score = np.where(pos >= LEAST_PRECISION * (pos + neg), gain(pos, neg, rate, np.log), 0.0)
        best = int(score.argmax())
        if score[best] < LEAST_GAIN:
            break
        chosen.append(best)
        left &= ~hits[:, best]
    return chosen


class LabelModel:
    """A generative model of the votes without any label: the hidden class, how often each voter fires given it (the
    accuracy), and a forest of correlations.

    Voters that agree beyond what the class explains are correlated; the strongest of these residual correlations make a
    forest, in which a voter's table depends on the class and on its parent's vote. Accuracies and tables come by
    expectation and maximisation, which starts at the votes of the first `lead` voters; the class balance is given. A voter that
    does not speak on every text abstains where it is silent: a word of one language says nothing on a text of another.
    """

    least_correlation = 0.15

    def __init__(self, votes: np.ndarray, speaks: np.ndarray, prior: float, lead: int, rounds: int = 30) -> None:
        n, k = votes.shape
        self.speaks, self.prior, self.parent = speaks, prior, np.full(k, -1)
        self.correlations = np.zeros((k, k))
        first = votes[:, :lead]
        alike = np.abs(np.nan_to_num(np.corrcoef(first.T + 1e-12 * np.arange(n)))).reshape(lead, lead) if n > 1 else np.zeros((lead, lead))
        post = np.clip(2 * first @ (1 / np.maximum(alike.sum(axis=0), 1)), 0.01, 0.99)  # voters that always agree count as one
        for step in range(rounds):
            self.estimate(votes, post)
            if step in (0, 8, 16):
                self.relate(votes, post)
                self.estimate(votes, post)
            post = self.posterior(votes)

    def relate(self, votes: np.ndarray, post: np.ndarray) -> None:
        """Residual correlations, and a maximum spanning forest of those that are strong enough."""
        rest = votes - (post[:, None] * self.rate[1] + (1 - post)[:, None] * self.rate[0])
        norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        self.correlations = (rest.T @ rest) / np.outer(norm, norm)
        strength = np.abs(self.correlations)
        np.fill_diagonal(strength, 0)
        best, by, self.parent = np.zeros(len(strength)), np.full(len(strength), -1), np.full(len(strength), -1)
        left = np.ones(len(strength), bool)
        while left.any():
            at = int(np.where(left, best, -1).argmax())
            left[at] = False
            self.parent[at] = by[at] if best[at] >= self.least_correlation else -1
            nearer = left & (strength[at] > best)
            best[nearer], by[nearer] = strength[at][nearer], at

    def estimate(self, votes: np.ndarray, post: np.ndarray) -> None:
        """rate[y, j] of firing, and table[y, u, j] of firing where the parent's vote is u; rates are what few rows fall back to."""
        both = np.stack([1 - post, post])
        total = both.sum(axis=1)
        self.rate = (both @ votes + np.array([[0.02], [0.1]])) / (total + 1)[:, None]
        on = votes[:, self.parent]
        self.table = np.empty((2, 2, votes.shape[1]))
        for u in (0, 1):
            held = on if u else 1 - on
            self.table[:, u] = (both @ (held * votes) + 2 * self.rate) / (both @ held + 2)
        self.table = np.where(self.parent >= 0, self.table, self.rate[:, None])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = (votes[:, self.parent] > 0) & (self.parent >= 0)
        fires, holds = np.log(self.table[1] / self.table[0]), np.log1p(-np.clip(self.table[1], 0, 0.999)) - np.log1p(-np.clip(self.table[0], 0, 0.999))
        each = votes * np.where(on, fires[1], fires[0]) + (1 - votes) * np.where(on, holds[1], holds[0]) * self.speaks
        z = math.log(self.prior / (1 - self.prior)) + each.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) by Newton's method, on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, LabelModel]:
    """Lexicon voters, the classifier's weights, and the label model.

    Labels choose the voters and give the class balance; accuracies, correlations and the labels that the classifier is
    trained on come from the votes alone. Three scans of docs for the labelled sample; the driver gets the term counts of
    `rows` texts at most (a byte a term), whatever the table holds or repeats.
    """
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, rows)
    n_pos, n_neg = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    voters = Voters(candidate_voters(sample, n_pos, n_neg))
    toxic = np.array([0.0] * 60 + [1.0] * len(SEED_LEXICON))
    counts = voters.counts(["", "a plain text of a few words"] * 30 + [f"they call it {word} and again {word}" for word in SEED_LEXICON])  # so that no labels are needed
    if n_pos + n_neg:
        lexicon = [f"{term} {least}" for term, least in voters.lexicon]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Voters(lexicon)
            for batch in batches:
                c = own.counts(batch.column(0).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"c": [x.tobytes() for x in c], "toxic": batch.column(1)})

        counted = sample.mapInArrow(run, "c binary, toxic int")
        got = counted.orderBy(F.xxhash64("c", "toxic"), "c", "toxic").limit(rows).collect()
        counts, toxic = np.stack([np.frombuffer(r.c, np.float32) for r in got]).astype(float), np.array([float(r.toxic > 0) for r in got])
    rate = min(max(toxic.mean(), 0.02), 0.5)
    hits = voters.votes(counts)[:, : len(voters.lexicon)] > 0
    seeds = [f"{word} 1" for word in SEED_LEXICON]
    chosen = sorted({*seeds, *(f"{voters.lexicon[i][0]} {voters.lexicon[i][1]}" for i in covering(hits, toxic > 0, rate))})
    own = Voters(chosen)
    counts = counts[:, [*(voters.index[t] for t in own.terms), *range(len(voters.terms), voters.size)]]
    votes = own.votes(counts)
    model = LabelModel(votes, own.speaks(), rate, len(chosen))
    return chosen, logistic(own.features(counts), model.posterior(votes)), model


def score(voters: Voters, weights: np.ndarray, texts: list[str]) -> np.ndarray:
    z = voters.features(voters.counts(texts)) @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Voters are the seed lexicon, terms, stems and repeated terms chosen on the labelled sample, and patterns; the label
    model weighs them without labels, and a logistic regression on its posteriors scores whole texts. Rows of the held-out
    fold (crc32(doc_id as text) mod 4 = 2; a null id is not held out) are never fitted. Null and empty texts get the score
    of no votes; repeated rows are scored alike, and of repeated labelled rows FIT_ROWS at most are fitted; without labels
    only the seed lexicon counts; a doc_id with several labels counts as toxic if one says so; further columns are ignored.
    """
    chosen, weights, _ = fit(docs, labels)

    def make():
        voters = Voters(chosen)

        def each(cols: dict) -> dict:
            s = score(voters, weights, cols["text"])
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": s.tolist(), "predicted": (s >= threshold).astype(np.int32).tolist()}

        return each

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_of().alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay as they are. See scored()."""
    chosen, weights, _ = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(chosen)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(score(voters, weights, texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
