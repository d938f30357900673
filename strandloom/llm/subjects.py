"""Subject areas of documents: complement naive Bayes over sentences, refined by expectation-maximization.

Labels are given to documents, but subjects live in sentences. Two sets of complement weights are learned in turns: one from
sentences, by the subject each is given with, and one from whole documents, by the subjects they are mostly about; the latter
lets words be learned that occur in the company of a subject only. A sentence may be about nothing (the class beside the
subjects). Sums run over all documents in every round; only hashed word counts of a fixed number of features are gathered.
A tenth of the labelled documents is kept from the weights; on it each subject's posterior is calibrated.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.leakage import fold_text
from strandloom.session import stored

#: Hashed features (words and pairs of words), rounds of expectation-maximization, labelled documents used at most.
FEATURES, ROUNDS, MAX_LABELLED = 1 << 17, 6, 20_000
#: Share of a document's sentences from which on a subject counts where no label says otherwise: just under a sixth.
SHARE = 0.165
#: One in so many labelled documents is held out for the calibration.
HELD_OUT = 10
#: Slope and zero of the calibration before any label, the spread of log slope and zero, and that of a subject around all subjects.
SLOPE, ZERO, SPREAD, OWN_SPREAD = 6.0, 0.0, (0.7, 0.25), (0.3, 0.1)
#: Score of 'about nothing' in nats; weights below the least evidence say nothing; smoothing of sentence and document counts.
NOTHING, LEAST, ALPHA_SENTENCE, ALPHA_DOCUMENT = 3.0, 0.5, 0.5, 1.0
#: Share of a document from which on its subjects teach the document weights; odds of an unlabelled subject in a labelled one.
MAINLY, UNLABELLED = 0.2, 0.15
#: A sentence is mostly about what it names first: weight of its first and last words.
FIRST, LAST = 1.3, 0.7
_TAG = re.compile(r"<[^>\n]{1,200}>")
_LEAD = re.compile(r"\s*(?:\[[^\]\n]{1,40}\]\s*|<[^>\n]{1,20}>\s*)*(?:(?://+|#+|\*+|[-+>•]+|\d{1,3}[.)])\s+)?(?:[a-z]{2,12}:\s+)?")
_STOP = re.compile(r"(?<=[.!?])\s+")
_CLOSING = "\"')]»”"
_TERMINAL = re.compile(rf"[.!?][{re.escape(_CLOSING)}]*$")
_WORD, _DIGIT = re.compile(r"[^\W_]+"), re.compile(r"[0-9]")
_APART = {i: " " for i in range(128) if not chr(i).isalnum()}
#: What a line's lead (see _LEAD) can start with, besides a short name and a colon.
_LEADS = frozenset("[</#*-+>•0123456789")
_WORDS = "doc_id long, sizes array<int>, full array<boolean>, words array<int>"
_PORTION = 1 << 20


def sentences(text: str) -> list[tuple[list[str], bool]]:
    """Words (without digits, case and accents) of each sentence or line, and whether it ends like a sentence."""
    out = []
    text = fold_text(text)
    for line in (_TAG.sub("\n", text) if "<" in text else text).split("\n"):
        line = line.strip()
        if not line:
            continue
        if line[0] in _LEADS or ":" in line[:14]:
            line = line[_LEAD.match(line).end() :]
        for part in _STOP.split(line):
            words = part.translate(_APART).split() if part.isascii() else _WORD.findall(part)
            if not (part.isascii() and _DIGIT.search(part) is None):
                words = [w for w in words if w.isalpha()]
            if words:
                ends = len(words) > 1 and (last := part.rstrip()[-1:]) != "" and (last in ".!?" or last in _CLOSING and bool(_TERMINAL.search(part.rstrip())))
                out.append((words, ends))
    return out


class _Hashes(dict):
    """32-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        self[word] = h = h - (1 << 32) if h >> 31 else h
        return h


def sentence_words(documents: DataFrame) -> DataFrame:
    """_WORDS rows of the whole texts: words in each sentence, whether each is a full one, and the words' hashes in a row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            sizes, full, flat = [], [], []
            lines, words = [0], [0]
            for text in batch.column(1).to_pylist():
                for found, ends in sentences(text) if text else ():
                    sizes.append(len(found))
                    full.append(ends)
                    flat += map(known.__getitem__, found)
                lines.append(len(sizes))
                words.append(len(flat))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for at, x, t in ((lines, sizes, pa.int32()), (lines, full, pa.bool_()), (words, flat, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "sizes", "full", "words"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(rows, _WORDS)


def complement_weights(counts: np.ndarray, alpha: float, subjects: int) -> np.ndarray:
    """(features, subjects): how much rarer a feature is outside a subject than outside the average subject, in nats."""
    total = counts.sum(0)
    outside = counts.sum(1, keepdims=True) - counts[:, :subjects]
    w = -np.log((outside + alpha) / (total.sum() - total[:subjects] + alpha * len(counts)))
    w -= w.mean(1, keepdims=True)
    w[w.max(1) < LEAST] = 0
    return w


class _Batch:
    """Sentences of a batch of documents. Features are the words and the pairs of neighbouring words of a sentence, hashed."""

    def __init__(self, batch: pa.RecordBatch):
        sizes, words = batch.column("sizes"), batch.column("words")
        self.n = batch.num_rows
        self.per_doc = np.asarray(sizes.value_lengths())
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), self.per_doc)
        size = np.asarray(sizes.flatten())
        w = np.asarray(words.flatten()).view(np.uint32)
        s = np.repeat(np.arange(len(size), dtype=np.int32), size)
        ends = np.cumsum(size, dtype=np.int64)
        place = np.arange(len(w), dtype=np.int32) - (ends - size).astype(np.int32)[s]
        heed = np.float32(FIRST) - np.float32(FIRST - LAST) * place / size.astype(np.float32)[s]
        inner = np.ones(len(w), bool)
        inner[ends - 1] = False  # a sentence has a word at least
        at = np.flatnonzero(inner)
        pair = (w[at] * np.uint32(0x85EBCA6B)) ^ (w[at + 1] * np.uint32(0xC2B2AE35))
        pair ^= pair >> np.uint32(15)
        mask = np.uint32(FEATURES - 1)
        #: (feature, sentence, heed) of the words, then of the pairs
        self.features = [((w & mask).astype(np.int32), s, heed), ((pair & mask).astype(np.int32), s[at], heed[at])]

    def posteriors(self, weights: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        """(sentences, subjects + 1), the last for 'about nothing'; classes without a majority are set to 0."""
        k, live = weights.shape[1], weights.any(1)
        z = np.zeros((len(self.doc), k + 1), np.float32)
        for x, s, heed in self.features:
            at = np.flatnonzero(live[x])
            for i in range(0, len(at), _PORTION):  # the gathered weights are eight times the features
                part = at[i : i + _PORTION]
                own = s[part]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                z[own[first], :k] += np.add.reduceat(weights[x[part]] * heed[part, None], first, axis=0)
        z[:, k] = NOTHING
        if prior is not None:
            z += prior[self.doc]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z * (z > 0.5)

    def by_doc(self, p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.doc, p[:, c], self.n) for c in range(p.shape[1])], 1) if self.n else np.zeros((0, p.shape[1]))

    def feature_sums(self, p: np.ndarray, whole: bool = False) -> np.ndarray:
        """(features, classes) sums of p, one row for each sentence (or, ``whole``, for each document), over their features."""
        width = p.shape[1]
        total = np.zeros(FEATURES * width)
        order = np.argsort(-p, axis=1)
        for r in range(width):  # few classes of a row are more than 0
            c = order[:, r].astype(np.int32)
            v = p[np.arange(len(p)), c]
            if not v.any():
                break
            for x, s, _ in self.features:
                row = self.doc[s] if whole else s
                keep = np.flatnonzero(v[row] > 0)
                row = row[keep]
                total += np.bincount(x[keep] * np.int32(width) + c[row], v[row], FEATURES * width)
        return total.reshape(FEATURES, width)


def _gather(words: DataFrame, votes, weights, width: int, step, labelled: bool = False) -> np.ndarray:
    """(FEATURES, width) sums of step(batch, votes of its documents, weights) over all documents (or only the labelled)."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, width))
        held, w = votes.value, weights.value if weights is not None else None
        k = next(iter(held.values())).shape if held else (0,)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            if labelled:
                at = [i for i, d in enumerate(ids) if d in held]
                batch, ids = batch.take(pa.array(at, pa.int64())), [ids[i] for i in at]
            v = np.zeros((batch.num_rows, *k))
            for i, d in enumerate(ids):
                if d in held:
                    v[i] = held[d]
            total += step(_Batch(batch), v, w)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, c]) for c in range(width))], names=["at", *(f"c{c}" for c in range(width))])

    schema = "at int, " + ", ".join(f"c{c} double" for c in range(width))
    sums = words.mapInArrow(part, schema).groupBy("at").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(width))).toArrow()
    out = np.zeros((FEATURES, width))
    out[np.asarray(sums.column("at"))] = np.stack([np.asarray(sums.column(f"c{c}")) for c in range(width)], 1)
    return out


def label_votes(labels: DataFrame, names: list[str], limit: int = MAX_LABELLED) -> dict[int, np.ndarray]:
    """Share of each subject among a document's labels, for at most ``limit`` documents (those least by a hash of their id)."""
    subject = F.regexp_replace(F.lower(F.trim("subject")), r"[\s-]+", "_")
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), subject.alias("subject")).filter(F.col("subject").isin(names) & F.col("doc_id").isNotNull())
    chosen = rows.groupBy("doc_id").agg(F.collect_list("subject").alias("subjects")).orderBy(F.xxhash64("doc_id")).limit(limit).collect()
    at = {n: i for i, n in enumerate(names)}
    votes: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    for doc, subjects in chosen:
        for s in subjects:
            votes[doc][at[s]] += 1 / len(subjects)
    return dict(votes)


def fit_weights(words: DataFrame, votes: dict[int, np.ndarray], k: int, rounds: int = ROUNDS) -> np.ndarray:
    """(FEATURES, k) weights after ``rounds`` of expectation-maximization over all documents."""
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(votes)

    def first(b: _Batch, v: np.ndarray, _) -> np.ndarray:
        return b.feature_sums(v, whole=True)

    def refine(b: _Batch, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        labelled = v.any(1)
        prior = np.zeros((b.n, k + 1))
        prior[labelled, :k] = np.log(UNLABELLED + v[labelled])
        prior[labelled, k] = math.log(0.5)
        p = b.posteriors(w, prior)
        mainly = np.maximum(b.by_doc(p[:, :k]) / np.maximum(b.per_doc, 1)[:, None] - MAINLY, 0)
        unseen = labelled & ~mainly.any(1)  # a label holds where nothing was found yet
        mainly[unseen] = v[unseen]
        mainly /= np.maximum(mainly.sum(1, keepdims=True), 1e-9)
        return np.concatenate([b.feature_sums(mainly, whole=True), b.feature_sums(p)], 1)

    weights = complement_weights(_gather(words, held, None, k, first, labelled=True), ALPHA_DOCUMENT, k)
    for r in range(rounds):
        w = spark.sparkContext.broadcast(weights.astype(np.float32))
        sums = _gather(words, held, w, 2 * k + 1, refine)
        weights = complement_weights(sums[:, :k], ALPHA_DOCUMENT, k)
        if r:
            weights = weights + complement_weights(sums[:, k:], ALPHA_SENTENCE, k)
    return weights


def document_shares(words: DataFrame, weights: np.ndarray, names: list[str]) -> DataFrame:
    """(doc_id, subject, share) with share > 0: the subject's part of the document's full sentences (of all, if none is full)."""
    held = words.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            full = np.asarray(batch.column("full").flatten()).astype(bool)
            some = np.bincount(b.doc, full, b.n) > 0
            counted = full | ~some[b.doc]
            p = (b.posteriors(held.value)[:, : len(names)] > 0) & counted[:, None]
            share = b.by_doc(p) / np.maximum(np.bincount(b.doc, counted, b.n), 1)[:, None]
            d, s = np.nonzero(share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([names[i] for i in s], pa.string()), pa.array(share[d, s])], names=["doc_id", "subject", "share"])

    return words.mapInArrow(rows, "doc_id long, subject string, share double")


def label_noise(shares: np.ndarray, labelled: np.ndarray) -> tuple[float, float]:
    """(wrong, missing): how often documents without a sign of a subject bear its label, and those full of it don't."""
    none, full = shares < 0.05, shares > 0.3
    return (labelled[none].sum() + 0.1) / (none.sum() + 100.0), ((1 - labelled[full]).sum() + 1.0) / (full.sum() + 10.0)


def fit_curve(shares: np.ndarray, labelled: np.ndarray, noise: tuple[float, float], around: tuple[float, float] = (SLOPE, ZERO), spread: tuple[float, float] = SPREAD) -> tuple[float, float]:
    """Slope a and zero c of the logistic posterior 1 / (1 + exp(-a (share_odds - c))), by the labels of held-out documents.

    A label is there with the chance wrong + (1 - wrong - missing) * posterior (``noise``), so that missing labels don't pull the
    posterior down. Both are the best on a grid, with normal priors on the log slope and the zero.
    """
    points, counts = np.unique(np.stack([np.round(shares, 4), labelled], 1), axis=0, return_counts=True)
    wrong, missing = noise
    a, c = (g.ravel() for g in np.meshgrid(np.exp(np.linspace(0, math.log(30), 60)), np.linspace(-1.5, 1.5, 151), indexing="ij"))
    fit = -0.5 * (np.log(a / around[0]) / spread[0]) ** 2 - 0.5 * ((c - around[1]) / spread[1]) ** 2
    for x, y, n in zip(share_odds(points[:, 0]), points[:, 1], counts):
        p = wrong + (1 - wrong - missing) / (1 + np.exp(-np.clip(a * (x - c), -50, 50)))
        fit += n * np.log(p if y else 1 - p)
    best = int(np.argmax(fit))
    return float(a[best]), float(c[best])


def share_odds(share):
    odds = lambda f: np.log((f + 0.01) / (1.01 - f))
    return odds(share) - odds(SHARE)


def subject_posteriors(documents: DataFrame, subjects: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, share, posterior) for each subject with a sentence in a document.

    posterior: independent for each subject, a logistic curve over the share whose slope and zero are fitted per subject to the
    held-out labelled documents (one in HELD_OUT of at most ``max_labelled``). Null and empty texts have no subjects; a doc_id
    given repeatedly gives its rows repeatedly; labels of unknown subjects or documents are ignored; without subjects or usable
    labels there are no rows.
    """
    names = sorted(r["subject"] for r in subjects.select("subject").filter("subject IS NOT NULL").distinct().collect())
    votes = label_votes(labels, names, max_labelled) if names else {}
    apart = {d for d in votes if zlib.crc32(str(d).encode()) % HELD_OUT == 0}
    words = stored(sentence_words(documents))
    taught = {d: v for d, v in votes.items() if d not in apart}
    weights = fit_weights(words, taught, len(names), rounds) if taught else np.zeros((FEATURES, max(1, len(names))))
    shares = document_shares(words, weights, names or [""])
    curves = calibrated(shares, {d: votes[d] > 0 for d in apart}, names, words.sparkSession)
    both = [F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, curves[n][i])]), F.col("subject")) if names else F.lit(1.0) for i in (0, 1)]
    odds = lambda c: F.log((c + 0.01) / (F.lit(1.01) - c))
    return shares.withColumn("posterior", 1 / (1 + F.exp(-both[0] * (odds(F.col("share")) - odds(F.lit(SHARE)) - both[1]))))


def calibrated(shares: DataFrame, labelled: dict[int, np.ndarray], names: list[str], spark) -> dict[str, tuple[float, float]]:
    """fit_curve of each subject, around that of all subjects, over the documents of ``labelled`` (at most the labelled limit);
    those without a share have 0."""
    told = {d: np.zeros(len(names)) for d in labelled}
    known = spark.createDataFrame([(d,) for d in labelled], "doc_id long")
    for d, s, f in shares.join(F.broadcast(known), "doc_id", "left_semi").collect() if labelled else ():
        told[d][names.index(s)] = f
    f, y = (np.array([x[d] for d in labelled], float).reshape(len(labelled), len(names)) for x in (told, labelled))
    noise = label_noise(f, y)
    common = fit_curve(f.ravel(), y.ravel(), noise)
    return {n: fit_curve(f[:, i], y[:, i], noise, common, OWN_SPREAD) for i, n in enumerate(names)}


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject), distinct, of the subjects with a posterior of at least one half. Cases as in subject_posteriors."""
    return subject_posteriors(documents, subjects, labels).filter("posterior >= 0.5").select("doc_id", "subject").distinct()
