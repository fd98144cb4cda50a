"""Subject areas of documents: complement naive Bayes refined by EM, sentence by sentence.

A document has a subject if a fourth or more of the sentences of its own content
deal with it.  So the unit of the model is the sentence: labelled documents give
first word counts for each subject and, by documents labelled as having none, for
page furniture (menus, notices, footers, errors).  A word's weight for a class
compares its rate there with its rate in the complement, all other classes.  EM
over all documents then assigns sentences to subjects, furniture or neither and
counts again.  Posteriors are independent of each other, one logistic function a
subject, calibrated on labelled documents that the counts didn't use.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Hashed vocabulary: bounds the model, whatever the corpus.
VOCABULARY = 1 << 18
#: Labelled documents the model is fitted on, at most.
LABELLED = 200_000
#: Score of a sentence without a subject, in nats.
NEITHER = 3.0
#: The same for furniture, whose lines are short.
FURNITURE = 1.0
#: A document counts as so many sentences at most, so that no single one rules the model.
DOCUMENT_WEIGHT = 50
#: Weight of documents labelled with several subjects in the first counts.
SEVERAL = 0.1
#: Share of a subject in a document before any of its sentences is read, and the most that context adds or takes, in nats.
BASE_SHARE, CONTEXT = 0.1, 3.0
#: Added to the scores of a labelled document's subjects, and taken from what its labels rule out.
LABEL_NATS = 4.0
#: A word in fewer documents says nothing about subjects.
MIN_DOCUMENTS = 4
SMOOTHING = 2.0
#: A word must weigh so much for some class, in nats; others (a language's everyday words) weigh nothing.
TELLING = 1.5
SHARE = 0.25
#: Bins of sentence scores for calibration.
BINS, BIN_LOW, BIN_HIGH = 80, -20.0, 60.0
#: One document in CALIBRATION labelled ones is kept from the counts.
CALIBRATION = 5
#: Weight features of one worker's words that are kept in its cache.
CACHE = 200_000

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{So}\p{Sk}\p{Co}]+")
_JOINED = regex.compile(r"(?<=\p{L})[-‐-―](?=\p{L})")
_SENTENCES = regex.compile(r"[.!?…]+[”\"»)]*\s+|[。！？]+|\n+")
_WORDS = regex.compile(r"\p{L}+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: Without spaces, a change of script parts words.
_WIDE_WORDS = regex.compile(r"\p{Han}+|[\p{Katakana}ー]+|\p{Hiragana}+|[^\W\d_\p{Han}\p{Katakana}\p{Hiragana}ー]+")

TOKENS = "doc_id long, label long, fold int, ends array<int>, features array<int>"
#: Most subject areas, as each takes a bit of a label.
MOST_AREAS = 61


class Featurizer:
    """Sentences of a text as hashed features.

    Words of five letters or more are known by the set of their letters, which
    swapped or doubled letters and a plural's s leave unchanged; shorter ones by
    themselves.  Where there are no spaces a change of script parts words.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    @staticmethod
    def _hash(word: str) -> int:
        return xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) & (VOCABULARY - 1)

    def _feature(self, word: str) -> int:
        if _WIDE.match(word):
            return self._hash(word)
        if len(word) > 4 and word[-1] == "s":
            word = word[:-1]
        return self._hash("".join(sorted(set(word))) if len(word) > 4 else word)

    def sentences(self, text: str) -> Iterator[list[int]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
        text = _JOINED.sub("", text).lower()
        words = _WIDE_WORDS.findall if not text.isascii() and _WIDE.search(text) else _WORDS.findall
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for sentence in _SENTENCES.split(text):
            out: list[int] = []
            for word in words(sentence):
                f = known.get(word)
                if f is None:
                    f = known[word] = self._feature(word)
                out.append(f)
            if out:
                yield out


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Featurizer()
    for b in batches:
        ends, features, end_offsets, feature_offsets = [], [], [0], [0]
        for text in b.column(3):
            n = 0
            for s in make.sentences(text.as_py() or ""):
                features += s
                n += len(s)
                ends.append(n)
            end_offsets.append(len(ends))
            feature_offsets.append(len(features))
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((end_offsets, ends), (feature_offsets, features))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], names=["doc_id", "label", "fold", "ends", "features"])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, each sentence's first feature, and each sentence's row."""
    ends, features = b.column(3), b.column(4)
    n_sentences = np.diff(ends.offsets.to_numpy())
    base = features.offsets.to_numpy().astype(np.int64)
    base = base - base[0]
    flat = features.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b.num_rows), n_sentences)
    stop = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base[:-1][row]
    start = np.append(0, stop[:-1]) if len(stop) else stop
    return flat, start, row


def _label_matrix(label: np.ndarray, subjects: int) -> np.ndarray:
    """One column a subject and one for furniture; rows add up to 1, or 0 for unlabelled."""
    bits = (np.maximum(label, 0)[:, None] >> np.arange(subjects + 1)) & 1
    return bits / np.maximum(bits.sum(1, keepdims=True), 1)


class Model:
    """Word weights, one column a subject and the last for furniture."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray, on_bare_pages: np.ndarray):
        """``counts``: words by classes, the last class being neither.

        Only words ``on_bare_pages``, those labelled as having no subject, speak for
        furniture; else EM would gather there whatever has no subject.
        """
        classes = counts.shape[1] - 1
        total = counts.sum(1)
        weights = np.empty((len(counts), classes), np.float32)
        for c in range(classes):
            own, rest = counts[:, c], total - counts[:, c]
            # SMOOTHING more occurrences of every word, split as the classes' sizes: a word spread evenly weighs 0.
            size, others = max(own.sum(), 1e-9), max(rest.sum(), 1e-9)
            part = size / (size + others)
            weights[:, c] = np.log((own + SMOOTHING * part) / size) - np.log((rest + SMOOTHING * (1 - part)) / others)
        weights[(documents < MIN_DOCUMENTS) | (weights.max(1) < TELLING)] = 0
        weights[~on_bare_pages, -1] = np.minimum(weights[~on_bare_pages, -1], 0)
        self.weights = weights

    def scores(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros((0, self.weights.shape[1]), np.float32)
        return np.add.reduceat(self.weights[flat], start, axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _with_neither(scores: np.ndarray, subjects: int) -> np.ndarray:
    full = np.concatenate([scores, np.full((len(scores), 1), NEITHER, np.float32)], 1)
    full[:, subjects] += NEITHER - FURNITURE
    return full


def _in_context(scores: np.ndarray, row: np.ndarray, subjects: int) -> np.ndarray:
    """Scores with what the other sentences of the document say about its subjects.

    A single word of a subject that the rest of the document doesn't have is more
    likely a figure of speech.
    """
    if not len(scores):
        return scores
    shares = _softmax(_with_neither(scores, subjects))
    own, content = shares[:, :subjects], 1 - shares[:, subjects]
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(edge, len(row)))
    others = np.repeat(np.add.reduceat(own, edge, axis=0), size, axis=0) - own
    rest = np.repeat(np.add.reduceat(content, edge), size) - content
    prior = (others + BASE_SHARE) / (rest[:, None] + 1)
    out = scores.copy()
    out[:, :subjects] += np.clip(np.log(prior / BASE_SHARE), -CONTEXT, CONTEXT)
    return out


def _soft(scores: np.ndarray, label: np.ndarray, fold: np.ndarray, row: np.ndarray, subjects: int) -> np.ndarray:
    """Shares of each sentence in subjects, furniture and neither."""
    full = _with_neither(_in_context(scores, row, subjects), subjects)
    trained = (label >= 0) & (fold != 0)
    y = _label_matrix(label, subjects) > 0
    shift = np.zeros((len(label), subjects + 2), np.float32)
    shift[:, : subjects + 1] = np.where(trained[:, None], np.where(y, LABEL_NATS, -LABEL_NATS), 0)
    # Furniture stands on any page; a page labelled as having no subject has nothing else.
    bare = trained & y[:, subjects]
    shift[:, subjects] = np.where(bare, LABEL_NATS, 0)
    shift[bare, subjects + 1] = -LABEL_NATS
    return _softmax(full + shift[row])


def _count(subjects: int, model):
    """Add up words by class: by label where there is no model yet, else by the model's shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = subjects + 2
        counts = np.zeros((classes, VOCABULARY), np.float64)
        documents = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            flat, start, row = _flat(b)
            if not len(start):
                continue
            label, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            length = np.diff(np.append(start, len(flat)))
            if model is None:
                y = np.where(((label >= 0) & (fold != 0))[:, None], _label_matrix(label, subjects), 0)
                # Which sentences of a document of several subjects deal with which isn't known yet.
                y[(y > 0).sum(1) > 1] *= SEVERAL
                shares = np.concatenate([y[row], np.zeros((len(row), 1))], 1)
                pairs = np.unique(np.repeat(row, length).astype(np.int64) * VOCABULARY + flat)
                documents += np.bincount(pairs % VOCABULARY, minlength=VOCABULARY)
            else:
                shares = _soft(model.value.scores(flat, start), label, fold, row, subjects)
            sentences = np.bincount(row, minlength=b.num_rows)
            shares = shares * np.minimum(1, DOCUMENT_WEIGHT / np.maximum(sentences, 1))[row][:, None]
            for c in range(classes):
                w = shares[:, c]
                if w.any():
                    counts[c] += np.bincount(flat, weights=np.repeat(w, length), minlength=VOCABULARY)
        some = np.flatnonzero((documents > 0) | (counts.sum(0) > 1e-3))
        width = classes + 1
        values = np.concatenate([counts[:, some].T, documents[some, None]], 1).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["word", "counts"])

    return run


def _gather(tokens: DataFrame, subjects: int, model) -> tuple[np.ndarray, np.ndarray]:
    """Counts by word and class over all documents, and documents by word: at most VOCABULARY rows."""
    width = subjects + 3
    parts = tokens.mapInArrow(_count(subjects, model), "word int, counts array<float>")
    sums = parts.groupBy("word").agg(*[F.sum(F.col("counts")[i].cast("double")).alias(f"c{i}") for i in range(width)])
    got = sums.toPandas()
    counts, documents = np.zeros((VOCABULARY, subjects + 2)), np.zeros(VOCABULARY)
    word = got["word"].to_numpy()
    counts[word] = got[[f"c{i}" for i in range(subjects + 2)]].to_numpy()
    documents[word] = got[f"c{width - 1}"].to_numpy()
    return counts, documents


def _score_bins(subjects: int, model):
    """How often sentences of each score stand in calibration documents with and without the subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((subjects, 2, BINS), np.int64)
        for b in batches:
            label, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            flat, start, row = _flat(b)
            pick = ((label >= 0) & (fold == 0))[row]
            if not pick.any():
                continue
            s = _in_context(model.value.scores(flat, start), row, subjects)[pick]
            y = _label_matrix(label, subjects)[row[pick]] > 0
            for c in range(subjects):
                at = np.clip((s[:, c] - BIN_LOW) / (BIN_HIGH - BIN_LOW) * BINS, 0, BINS - 1).astype(np.int64)
                total[c] += np.bincount(y[:, c] * BINS + at, minlength=2 * BINS).reshape(2, BINS)
        c, y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (c, y, at)] + [pa.array(total[c, y, at])], names=["c", "y", "bin", "n"])

    return run


def _logistic(no: np.ndarray, yes: np.ndarray) -> tuple[float, float]:
    """Slope and midpoint of the logistic function that fits binned outcomes best.

    Labels are those of documents, so a sentence without the subject may stand in
    a document that has it, and one with it in a document labelled otherwise.  The
    curve therefore runs between a floor and a ceiling, which are fitted along with
    it; what lies between them is the sentence's own posterior.
    """
    x = BIN_LOW + (np.arange(BINS) + 0.5) * (BIN_HIGH - BIN_LOW) / BINS
    n = no + yes
    if not yes.sum() or not no.sum():
        return 1.0, NEITHER
    rate, best = yes / np.maximum(n, 1), (np.inf, 1.0, NEITHER)
    # Bins count by the root of their sentences, or those with no evidence at all would outweigh the rest.
    w = np.sqrt(n)
    for slope in (0.4, 0.6, 0.8, 1.0, 1.5, 2.0):
        for middle in np.arange(1.5, 6.01, 0.25):
            p = 1 / (1 + np.exp(-np.clip(slope * (x - middle), -30, 30)))
            design = np.stack([1 - p, p], 1)
            fit = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-6 * np.eye(2), design.T @ (rate * w))
            # A weak pull towards slope 1 and the midpoint of "neither" steadies small samples.
            loss = (w * (rate - design @ fit) ** 2).sum() + 0.01 * ((slope - 1) ** 2 + (middle - NEITHER) ** 2)
            if fit[1] > fit[0] and loss < best[0]:
                best = (loss, slope, float(middle))
    return best[1], best[2]


def _decide(subjects: list[str], model, slopes: np.ndarray, middles: np.ndarray, share: float):
    n = len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, start, row = _flat(b)
            scores = _in_context(model.value.scores(flat, start), row, n)
            posterior = 1 / (1 + np.exp(-np.clip(slopes * (scores[:, :n] - middles), -30, 30)))
            best = scores[:, :n].max(1) if len(scores) else np.zeros(0)
            furniture = (scores[:, n] > FURNITURE) & (scores[:, n] + NEITHER - FURNITURE > best)
            own = ~furniture
            content = np.bincount(row[own], minlength=b.num_rows)
            about = np.zeros((b.num_rows, n))
            mass = np.zeros((b.num_rows, n))
            for c in range(n):
                hit = own & (posterior[:, c] >= 0.5)
                about[:, c] = np.bincount(row[hit], minlength=b.num_rows)
                mass[:, c] = np.bincount(row[own], weights=posterior[own, c], minlength=b.num_rows)
            doc, c = np.nonzero((about > 0) & (about >= share * content[:, None]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array([subjects[i] for i in c], pa.string()), pa.array(content[doc].astype(np.int32)), pa.array(about[doc, c].astype(np.int32)), pa.array(mass[doc, c] / np.maximum(content[doc], 1))],
                names=["doc_id", "subject", "n_content", "n_about", "posterior"],
            )

    return run


def labels_by_document(labels: DataFrame, areas: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``doc_id, label``: a bit for each subject (in alphabetical order), the next bit for no subject.

    A subject counts by its key or title, whatever case and spaces.  Rows of a null
    subject count only where a document has no subject; unknown spellings and null
    ids are dropped.  At most ``bound`` documents, chosen by hash, are used.
    """
    names = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    keys = areas.where("subject is not null").select(clean(F.col("subject")).alias("k"), "subject").unionByName(areas.where("subject is not null and title is not null").select(clean(F.col("title")).alias("k"), "subject")).distinct()
    position = F.element_at(F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i).cast("long"))]), F.col("subject")) if names else F.lit(0).cast("long")
    given = labels.where("doc_id is not null").select("doc_id", clean(F.col("subject")).alias("k"))
    # The areas are a fixed list of a few rows.
    matched = given.join(F.broadcast(keys), "k", "left").select("doc_id", F.when(F.col("k").isNull(), F.lit(0).cast("long")).otherwise(position).alias("bit")).where("bit is not null")
    bits = matched.groupBy("doc_id").agg(F.bit_or("bit").alias("bits"))
    per = bits.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("bits") == 0, F.lit(1 << len(names)).cast("long")).otherwise(F.col("bits")).alias("label"))
    return per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = 3, share: float = SHARE, bound: int = LABELLED, calibration: int = CALIBRATION, settled: float = 0.002) -> DataFrame:
    """Subject areas of each document: ``doc_id, subject, n_content, n_about, posterior``.

    One row for each subject that ``share`` or more of the document's content
    sentences deal with (posterior of a sentence at least one half);
    ``posterior`` is the mean over these sentences.  Null and empty texts and
    documents of nothing but furniture have no row; repeated ids are documents of
    their own.  Without labels, or without areas, there are no rows.

    EM ends when a round moves less than ``settled`` of all words to another class,
    after ``rounds`` rounds at the latest.  There may be MOST_AREAS areas at most.

    Only the labels are sampled (``bound``); word counts and EM cover all
    sentences of all documents.  The driver holds the model: VOCABULARY words by
    the number of subjects.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    n = len(names)
    nothing = "doc_id long, subject string, n_content int, n_about int, posterior double"
    if not n:
        return spark.createDataFrame([], nothing)
    if n > MOST_AREAS:
        raise ValueError(f"at most {MOST_AREAS} subject areas")
    known = labels_by_document(labels, areas, bound)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    # At most ``bound`` rows of 12 bytes.
    joined = texts.join(F.broadcast(known), "doc_id", "left")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(calibration)).cast("int")
    tokens = materialize(joined.select("doc_id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"), fold.alias("fold"), "text").mapInArrow(_tokenize, TOKENS))
    sc = spark.sparkContext
    counts, seen_in = _gather(tokens, n, None)
    if not counts.any():
        return spark.createDataFrame([], nothing)
    bare = counts[:, n] > 0
    model = sc.broadcast(Model(counts, seen_in, bare))
    for _ in range(rounds):
        before, (counts, _unused) = counts, _gather(tokens, n, model)
        model = sc.broadcast(Model(counts, seen_in, bare))
        if np.abs(counts / max(counts.sum(), 1e-9) - before / max(before.sum(), 1e-9)).sum() / 2 < settled:
            break
    bins = np.zeros((n, 2, BINS))
    for c, y, at, k in tokens.where("label >= 0 and fold = 0").mapInArrow(_score_bins(n, model), "c int, y int, bin int, n long").groupBy("c", "y", "bin").agg(F.sum("n")).collect():
        bins[c, y, at] = k
    fitted = [_logistic(bins[c, 0], bins[c, 1]) for c in range(n)]
    slopes, middles = (np.array(x, np.float32) for x in zip(*fitted))
    return tokens.mapInArrow(_decide(names, model, slopes, middles, share), nothing)
