"""Problem 10: subject areas of documents, from latent Dirichlet topic models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import stored

# --- words and sentences ------------------------------------------------------------------------------

_SCAN = re.compile(r"([^\W\d_]{3,})|(\?[\"'»”)]*\s)|([.!…][\"'»”)]*\s|\n[ \t]*\n|\n(?=[#\-*>|]))")
_MARKUP = re.compile(r"```.*?```|<[^<>]{1,200}>|https?://\S+|`[^`]*`", re.S)
#: Words that open the answer to a question; both are one sentence.
_ANSWERS = frozenset("answer antwort réponse respuesta".split())

#: Frequent function words, to tell the language of a text (the column lang is not reliable).
FUNCTION_WORDS = {
    "en": "the and for that with this from are was has its not but which before",
    "de": "der die das und ist nicht auf aus ein eine zum bei mit wer von dem muss",
    "fr": "les des une est dans pour sur pas avec par cette qui entre reste encore",
    "es": "los las una que con por del hay para sobre antes ninguna entre cada todavía",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGE_OF = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}


def sentences(text: str) -> list[list[str]]:
    """Words (lower case, three letters or more) of each sentence that has any; a question and its answer are one."""
    if "`" in text or "<" in text or "://" in text:
        text = _MARKUP.sub(" ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[list[str]] = [[]]
    asked = False
    for word, question, end in _SCAN.findall(text.lower() + "\n\n"):
        if word:
            if asked:
                asked = False
                if word not in _ANSWERS and out[-1]:
                    out.append([])
            out[-1].append(word)
        elif question:
            asked = True
        elif out[-1] and not (asked := asked and end != "\n\n"):
            out.append([])
    return [s for s in out if s]


def language_of(words) -> int:
    """Place in LANGUAGES of the language with most function words; ties and none go to the first."""
    n = [0] * len(LANGUAGES)
    for w in words:
        for k in _LANGUAGE_OF.get(w, ()):
            n[LANGUAGES.index(k)] += 1
    return n.index(max(n))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One scan of the texts: language, sentences, distinct words and their counts, and for each word said its place among the distinct ones and its sentence."""
    for b in batches:
        rows: dict[str, list] = {k: [] for k in ("language", "sentences", "terms", "counts", "said", "sentence")}
        for text in b.column("text").to_pylist():
            told = sentences(text) if text else []
            place: dict[str, int] = {}
            counts: list[int] = []
            said, sentence = [], []
            for k, words in enumerate(told):
                for w in words:
                    i = place.setdefault(w, len(place))
                    if i == len(counts):
                        counts.append(0)
                    counts[i] += 1
                    said.append(i)
                    sentence.append(k)
            for name, value in zip(rows, (language_of(w for words in told for w in words), len(told), list(place), counts, said, sentence)):
                rows[name].append(value)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))], ["doc_id", *rows])


_SCANNED = "doc_id long, language int, sentences int, terms array<string>, counts array<int>, said array<int>, sentence array<int>"
_ENCODED = "doc_id long, language int, sentences int, word array<int>, sentence array<int>, batch int"


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _encoded(shared, batches_of: int):
    """Words as places in the vocabulary; words that don't belong to the language's vocabulary are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, allowed = shared.value
        known = pa.array(words, pa.string())
        for b in batches:
            terms = b.column("terms")
            ids = pc.index_in(terms.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])[:-1]
            said, off = _flat(b.column("said"))
            sentence, _ = _flat(b.column("sentence"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            language = b.column("language").to_numpy()
            word = ids[starts[doc] + said] if len(said) else np.empty(0, dtype=np.int64)
            keep = word >= 0
            keep[keep] = allowed[language[doc[keep]], word[keep]]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=b.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep].astype(np.int32))) for x in (word, sentence)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("language"), b.column("sentences"), *lists, pa.array((b.column("_h").to_numpy() % batches_of).astype(np.int32))], [c.split()[0] for c in _ENCODED.split(", ")])

    return run


# --- variational Bayes ------------------------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    out, y = np.zeros_like(x), x.copy()
    for _ in range(6):
        out -= 1 / y
        y += 1
    f = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f / 252))


def expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet distributions over the rows (words x topics: over the words of each topic)."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=0, keepdims=True)))


def infer(rows: np.ndarray, counts: np.ndarray, off: np.ndarray, alpha: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(Dirichlet weights of each document's topic proportions, each word's counts by topic); ``rows`` are the words' exp(E[log p])."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    gamma = alpha[None, :] + np.add.reduceat(counts, off[:-1])[:, None] / len(alpha)
    shares = rows
    for _ in range(rounds):
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
        shares = rows * theta[doc]
        shares *= (counts / np.maximum(shares.sum(axis=1), 1e-30))[:, None]
        gamma = alpha + np.add.reduceat(shares, off[:-1], axis=0)
    return gamma, shares


def bags(word: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, counts, offsets, places of the documents) of the documents that have words."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pairs, counts = np.unique(doc * size + word, return_counts=True)
    docs, words = np.divmod(pairs, size)
    places, first = np.unique(docs, return_index=True)
    return words, counts.astype(np.float64), np.append(first, len(words)), places


def _statistics(shared, alpha: np.ndarray, rounds: int):
    """Expected counts of words by topic, summed over the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        sums = {k: np.zeros_like(m) for k, m in models.items()}
        documents = dict.fromkeys(models, 0)
        for b in batches:
            language = b.column("language").to_numpy()
            for k, m in models.items():
                part = b.filter(pa.array(language == k))
                word, off = _flat(part.column("word"))
                if not len(word):
                    continue
                words, counts, ends, places = bags(word, off, len(m))
                _, shares = infer(m[words], counts, ends, alpha[: m.shape[1]], rounds)
                np.add.at(sums[k], words, shares)
                documents[k] += len(places)
        for k, s in sums.items():
            used = np.flatnonzero(s.sum(axis=1) > 0)
            if documents[k]:
                topics = np.zeros((len(used) + 1, len(alpha)))
                topics[1:, : s.shape[1]] = s[used]
                topics[0, 0] = documents[k]  # word -1: the number of documents
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(topics), k, dtype=np.int32)), pa.array(np.append(-1, used).astype(np.int32)), *(pa.array(t) for t in topics.T)], ["language", "word", *(f"t{i}" for i in range(len(alpha)))])

    return run


def spread_seeds(x: np.ndarray, count: int, rng: np.random.Generator) -> list[int]:
    """Places of rows (of length 1) far from each other: each the best of eight draws by distance."""
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < count:
        far = np.maximum(0.0, 1.0 - near) ** 2
        if far.sum() < 1e-9:
            break
        tries = rng.choice(len(x), 8, p=far / far.sum())
        best = min(tries.tolist(), key=lambda c: np.minimum(1 - near, 1 - x @ x[c]).sum())
        chosen.append(best)
        near = np.maximum(near, x @ x[best])
    return chosen


# --- topics to subjects -----------------------------------------------------------------------------------


def top_terms(phi: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
    """Places of a topic's terms, those more frequent in it than elsewhere, by probability times log-lift over all words."""
    score = phi * np.log(np.maximum(phi / base, 1e-9))
    return np.argsort(-score, kind="stable")[: min(most, int((score > 0).sum()))]


def mapped_subjects(said: np.ndarray, given: list[list[int]], subjects: int, rounds: int = 20) -> np.ndarray:
    """Share of each subject in each topic (topics x subjects), from how often labelled documents say the
    topics' top terms (``said``: documents x topics).  Each label of a document is put down to one of the topics
    whose terms it says, in proportion to what is known of them so far (expectation-maximisation), so that
    a document with two subjects doesn't tie either topic to both."""
    n, topics = said.shape
    share = np.full((topics, subjects), 1 / subjects)
    doc = np.array([i for i, g in enumerate(given) for _ in g], dtype=np.int64)
    label = np.array([s for g in given for s in g], dtype=np.int64)
    if not len(doc):
        return np.zeros((topics, subjects))
    weight = said / np.maximum(said.sum(axis=1, keepdims=True), 1e-12)
    blame = np.zeros((topics, subjects))
    for _ in range(rounds):
        parts = weight[doc] * share[:, label].T
        parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1e-30)
        blame = np.zeros((topics, subjects))
        np.add.at(blame.T, label, parts)
        share = (blame + 0.02) / (blame + 0.02).sum(axis=1, keepdims=True)
    return np.where(blame.sum(axis=1, keepdims=True) > 0, share, 0.0)


class SubjectModel:
    """Latent Dirichlet topics of all documents, mapped to subjects.

    1. Texts are scanned once; the words of each sentence and the language (by function words) are stored.
    2. The vocabulary of a language are the words that come in bursts: their residual inverse document
       frequency (log2 of the documents that a Poisson spread of their occurrences would reach, over those that
       have them) is ``residual_idf`` plus the share of documents that have them or more, and ``least_share`` of
       the language's documents, at least 2, have them.  In short documents words come in smaller bursts, so that ``residual_idf``
       should be lower there.  Counts are of all documents; no number of words is fixed.
    3. Each language has ``topics`` topics and one of the background, fitted by distributed online variational
       Bayes: all documents are dealt to four batches by hash, and ``iterations`` steps go round them, so
       that each document is used equally often, whatever the corpus size.  A task sums its documents' expected counts,
       Spark adds the sums by word; the driver holds words x topics.  Steps start from documents far from
       each other (found among about ``seed_documents`` of a language; this only sets the start).
    4. Topics are mapped to subjects by their ``terms`` top terms: those are looked for in the labelled documents (at most
       ``label_rows`` labels), and a topic belongs to the subject to which ``least_mapped`` or more of what they
       say there is put down.  Other topics belong to none.  ``inspection()`` lists terms and mapping.
    5. ``assign()``: a document's topic proportions are inferred, each word of a sentence is put down to topics by the
       document's proportions, and a sentence deals with the subject that has the most of it, if that are
       ``least_words`` words or more.  Subjects with ``least_sentences`` such sentences are the document's.
    """

    def __init__(
        self, documents: DataFrame, labels: DataFrame, topics: int = 20, residual_idf: float = 0.15, least_share: float = 0.00002, iterations: int = 12, rounds: int = 10, terms: int = 12, least_mapped: float = 0.5,
        label_rows: int = 50_000, seed_documents: int = 2_000, alpha: float = 0.05, background: float = 0.2, eta: float = 0.02, batches: int = 4, seed: int = 7,
    ):
        self.alpha, self.batches, self.rounds = np.array([background] + [alpha] * topics), batches, rounds
        self.topic_table: list[tuple] = []
        self.models: dict[int, np.ndarray] = {}  # language -> words x topics, Dirichlet weights; bounded by the vocabulary
        self.maps: dict[int, np.ndarray] = {}  # language -> topics x subjects, 0 or 1
        self.words: list[str] = []
        self.allowed = np.zeros((len(LANGUAGES), 0), dtype=bool)
        known = labels.where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "subject").distinct().orderBy(F.xxhash64("doc_id", "subject")).limit(label_rows)
        known = stored(known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("given")))
        self.subjects: list[str] = sorted(r[0] for r in known.select(F.explode("given")).distinct().collect())

        scanned = stored(self._scan(documents))
        sizes = {r["language"]: r["n"] for r in scanned.where("sentences > 0").groupBy("language").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            self.fitted = self._encode(scanned)
            return
        n = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]), F.col("language"))
        said = scanned.select("language", F.explode(F.arrays_zip("terms", "counts")).alias("_t")).groupBy("language", F.col("_t.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("_t.counts").alias("cf"))
        bursts = F.log2((1 - F.exp(-F.col("cf") / n)) * n / F.col("df")) >= residual_idf + F.col("df") / n
        rows = said.where((F.col("df") >= F.greatest(F.lit(2.0), n * least_share)) & bursts).orderBy("language", "term").collect()
        self.words = sorted({r["term"] for r in rows})
        place = {w: i for i, w in enumerate(self.words)}
        self.allowed = np.zeros((len(LANGUAGES), len(self.words)), dtype=bool)
        frequency = np.zeros((len(LANGUAGES), 2, len(self.words)))
        for r in rows:
            self.allowed[r["language"], place[r["term"]]] = True
            frequency[r["language"], :, place[r["term"]]] = r["df"], r["cf"]
        self.fitted = stored(self._encode(scanned), by="batch")
        if not self.words:
            return
        self._start(sizes, frequency, topics, seed_documents, eta, seed)
        for step in range(iterations):
            self._step(step, eta)
        self._map(known, terms, least_mapped)

    def _scan(self, documents: DataFrame) -> DataFrame:
        d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        return d.mapInArrow(_scanned, _SCANNED)

    def _encode(self, scanned: DataFrame) -> DataFrame:
        shared = scanned.sparkSession.sparkContext.broadcast((self.words, self.allowed))  # bounded by the vocabulary
        return scanned.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))).mapInArrow(_encoded(shared, self.batches), _ENCODED)

    def _start(self, sizes: dict[int, int], frequency: np.ndarray, topics: int, seed_documents: int, eta: float, seed: int) -> None:
        limit = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 1.2 * seed_documents / v))]), F.col("language"))
        drawn = self.fitted.where((F.size("word") > 0) & (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < limit * 1_000_000)).select("doc_id", "language", "word").orderBy("doc_id", "word").toPandas()
        for k in sorted(sizes):
            docs = drawn["word"][drawn["language"] == k].tolist()
            if not docs:
                continue
            df, cf = frequency[k]
            idf = np.where(df > 0, np.log(np.maximum(sizes[k], 2) / np.maximum(df, 1)), 0.0)
            x = np.zeros((len(docs), len(self.words)), dtype=np.float32)
            for i, words in enumerate(docs):
                np.add.at(x[i], words, idf[words])
            length = np.linalg.norm(x, axis=1)
            x = x[length > 0] / length[length > 0][:, None]
            if not len(x):
                continue
            seeds = spread_seeds(x, topics, np.random.default_rng(seed))
            total = cf.sum()
            start = np.zeros((len(self.words), len(seeds) + 1))
            start[:, 0] = 0.5 * cf
            start[:, 1:] = total / (2 * topics) * (x[seeds] / x[seeds].sum(axis=1, keepdims=True)).T + (0.05 / (2 * topics) * cf)[:, None]
            self.models[k] = np.where(self.allowed[k][:, None], start + eta, 1e-12)
        self.sizes = sizes

    def _step(self, step: int, eta: float) -> None:
        spark = self.fitted.sparkSession
        shared = spark.sparkContext.broadcast({k: expected(m) for k, m in self.models.items()})
        names = [f"t{i}" for i in range(len(self.alpha))]
        part = self.fitted.where(F.col("batch") == step % self.batches)
        summed = part.mapInArrow(_statistics(shared, self.alpha, self.rounds), "language int, word int, " + ", ".join(f"{t} double" for t in names)).groupBy("language", "word").agg(*[F.sum(t).alias(t) for t in names]).toPandas()
        rate = (2.0 + step) ** -0.6
        for k, m in self.models.items():
            mine = summed[summed["language"] == k]
            documents = mine.loc[mine["word"] == -1, "t0"].sum()
            if not documents:
                continue
            mine = mine[mine["word"] >= 0]
            new = np.zeros_like(m)
            new[mine["word"].to_numpy()] = mine[names].to_numpy()[:, : m.shape[1]]
            new = np.where(self.allowed[k][:, None], eta + new * (self.sizes[k] / documents), 1e-12)
            self.models[k] = (1 - rate) * m + rate * new
        shared.unpersist()

    def _map(self, known: DataFrame, terms: int, least_mapped: float) -> None:
        at = {s: i for i, s in enumerate(self.subjects)}
        labelled = self.fitted.select("doc_id", "language", "word").join(known, "doc_id").orderBy("doc_id").toPandas()  # at most label_rows documents
        for k, m in sorted(self.models.items()):
            phi, base = m / m.sum(axis=0, keepdims=True), m.sum(axis=1) / m.sum()
            tops = [top_terms(phi[:, t], base, terms) for t in range(1, m.shape[1])]
            mine = labelled[labelled["language"] == k]
            said = np.zeros((len(mine), len(tops)))
            for i, words in enumerate(mine["word"]):
                counts = np.bincount(words, minlength=len(self.words))
                said[i] = [counts[t].sum() for t in tops]
            said[said < 3] = 0  # less is a passing mention
            share = mapped_subjects(said, [[at[s] for s in g] for g in mine["given"]], len(at))
            chosen = np.zeros((m.shape[1], len(at)))
            for t, top in enumerate(tops):
                best = int(share[t].argmax()) if len(at) else -1
                fits = best >= 0 and share[t, best] >= least_mapped
                if fits:
                    chosen[t + 1, best] = 1
                self.topic_table.append((LANGUAGES[k], t, self.subjects[best] if fits else None, float(round(share[t, best], 4)) if best >= 0 else 0.0, int((said[:, t] > 0).sum()), [self.words[i] for i in top]))
            self.maps[k] = chosen

    def inspection(self, spark) -> DataFrame:
        """language, topic, subject (null: none), share, labelled_documents (that say its terms), top_terms."""
        return spark.createDataFrame(self.topic_table, "language string, topic int, subject string, share double, labelled_documents int, top_terms array<string>")

    def _told(self, documents: DataFrame | None, least_words: float, least_sentences: int, least_share: float) -> DataFrame:
        """doc_id, subject, sentences, share (of the document's sentences), proportion (of its topics)."""
        encoded = self.fitted if documents is None else self._encode(self._scan(documents))
        shared = encoded.sparkSession.sparkContext.broadcast((self.models, self.maps, self.subjects, self.alpha))
        rounds = self.rounds + 5

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, maps, names, alpha = shared.value
            ready = {k: (expected(m), m / m.sum(axis=0, keepdims=True)) for k, m in models.items() if k in maps and len(names)}
            for b in batches:
                language = b.column("language").to_numpy()
                for k, (rows, phi) in ready.items():
                    part = b.filter(pa.array(language == k))
                    word, off = _flat(part.column("word"))
                    if not len(word):
                        continue
                    sentence, _ = _flat(part.column("sentence"))
                    words, counts, ends, places = bags(word, off, len(phi))
                    gamma, _ = infer(rows[words], counts, ends, alpha[: phi.shape[1]], rounds)
                    theta = np.zeros((part.num_rows, phi.shape[1]))
                    theta[places] = gamma / gamma.sum(axis=1, keepdims=True)
                    doc = np.repeat(np.arange(part.num_rows), np.diff(off))
                    blame = phi[word] * theta[doc]
                    blame = (blame / np.maximum(blame.sum(axis=1, keepdims=True), 1e-30)) @ maps[k]
                    firsts = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(sentence) != 0)))
                    mass = np.add.reduceat(blame, firsts, axis=0)
                    best = mass.argmax(axis=1)
                    dealt = mass[np.arange(len(mass)), best] >= least_words
                    n = np.zeros((part.num_rows, len(names)), dtype=np.int64)
                    np.add.at(n, (doc[firsts][dealt], best[dealt]), 1)
                    shares = theta @ maps[k]
                    i, s = np.nonzero((n >= least_sentences) & (shares >= least_share))
                    total = part.column("sentences").to_numpy()
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), pa.array([names[x] for x in s], pa.string()), pa.array(n[i, s].astype(np.int32)), pa.array(n[i, s] / np.maximum(total[i], 1)), pa.array(shares[i, s])], ["doc_id", "subject", "sentences", "share", "proportion"])

        return encoded.select("doc_id", "language", "sentences", "word", "sentence").mapInArrow(run, "doc_id long, subject string, sentences int, share double, proportion double")

    def assign(self, documents: DataFrame | None = None, least_sentences: int = 2, least_words: float = 1.5) -> DataFrame:
        """doc_id, subject, sentences (that deal with it), share (of the document's sentences), proportion (of the
        document's topics), for each subject of a document; of the fitted documents, or of others.

        A document without such a subject gives no row; null and empty texts give none; of repeated
        rows of a doc_id the largest values win."""
        told = self._told(documents, least_words, least_sentences, 0.0)
        return told.groupBy("doc_id", "subject").agg(F.max("sentences").alias("sentences"), F.round(F.max("share"), 6).alias("share"), F.round(F.max("proportion"), 6).alias("proportion"))

    def by_topics(self, spark, least_share: float = 0.25) -> DataFrame:
        """doc_id, subject, share: subjects that have ``least_share`` or more of a fitted document's topic proportions, whatever its sentences."""
        told = self._told(None, 0.0, 0, least_share)
        return told.groupBy("doc_id", "subject").agg(F.round(F.max("proportion"), 6).alias("share"))
