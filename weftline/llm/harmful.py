"""Abusive, hateful or sexual content, scored by a support vector machine on a subsequence string kernel.

The kernel counts common subsequences of three and four characters that lie close together, each gap
weighing ``DECAY``; so an insult with inserted, starred or exchanged characters still shares most of its
subsequences with the plain one. Nyström landmarks turn the kernel into a space of as many dimensions, in
which a linear machine is trained on labelled sentences. The kernel has an explicit feature map, so the
trained machine folds into one weight per hashed subsequence, and scoring a text is a sum of weights over
its places, vectorised over all texts of an Arrow batch, whatever the number of landmarks.

Labels are of whole documents, and one sentence makes a document harmful. Training therefore repeats: fit,
let the highest sentence of each harmful document stand for it, fit again. It runs in tasks on the workers:
one pass cuts labelled documents into sentences, one fills the kernel between sentences and landmarks, and
each fold's machine is a task. Only labels train it; texts without one take no part.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.storage import shared_folder, written

BITS = 18
SIZE = 1 << BITS
DECAY = 0.6
SPAN3, SPAN4 = 5, 6
PATTERNS = [(0, *c) for c in combinations(range(1, SPAN3), 2)] + [(0, *c) for c in combinations(range(1, SPAN4), 3)]
WEIGHTS = np.array([DECAY ** (p[-1] + 1 - len(p)) for p in PATTERNS], np.float32)
PAD = SPAN4
#: Parameters of training: most labelled documents, landmarks and how many times as many are looked at, folds, cost of the machine, rounds of witnesses.
MAX_LABELLED = 20_000
LANDMARKS, CANDIDATES = 1_000, 4
FOLDS = 3
COST, REPEATS = 30.0, 3
#: Power of the kernel that makes a landmark near; weight of other sentences of harmful documents.
NEAR, OTHERS = 12, 0.3
#: Held-out scores beyond which a label counts as wrong.
DOUBT, SURE = 0.2, 0.3
#: Harmless documents are so many times rarer among reviewed ones than elsewhere.
RARER = 4

# Digits and signs that stand for letters inside words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_LEET_WORD = re.compile(r"[^\W_]*(?:[^\W\d_][0-9@$!€]|[0-9@$!€][^\W\d_])[\w@$!€*]*")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
#: Kana and ideographs say as much as several letters, so each takes two places and short subsequences hold words.
_IDEOGRAM = re.compile("([\u3040-\u30ff\u3400-\u9fff])")
_REPEAT = re.compile(r"(.)\1{2,}")
_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])|\n+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, blank ones left out; a text without ends is one sentence."""
    return [s for s in _END.split(text) if s.strip()] if text else []


def normal(sentence: str) -> str:
    """Compatible forms, small letters without marks, letters for the signs that stand for them."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", sentence).lower())
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    s = _LEET_WORD.sub(lambda m: m[0].rstrip("!").translate(LEET) + "!" * (len(m[0]) - len(m[0].rstrip("!"))), s)
    s = _NUMBER.sub("0", s)
    s = _REPEAT.sub(r"\1", s)
    s = _IDEOGRAM.sub(r"\1|", s)
    return " " + " ".join(s.split()) + " "


@dataclass
class Features:
    """Hashed subsequences of many strings: ``ids[p][k]`` of pattern p at place k, SIZE where there is none."""

    ids: np.ndarray  # patterns x places, int32
    of: np.ndarray  # the string of each place
    norms: np.ndarray


def features(strings: list[str]) -> Features:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    gap = "\0" * PAD
    points = np.frombuffer((gap.join(strings) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(strings)), lengths + PAD)[: len(points)] if len(strings) else np.zeros(0, np.int64)
    n = len(points)
    padded = np.concatenate([points, np.zeros(PAD, np.uint32)])
    ids = np.empty((len(PATTERNS), n), np.int32)
    for k, pattern in enumerate(PATTERNS):
        h = np.full(n, (0x9E3779B1 * (len(pattern))) & 0xFFFFFFFF, np.uint32)
        live = np.ones(n, bool)
        for at in pattern:
            c = padded[at : at + n]
            live &= c != 0
            h = (h ^ c) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        for at in range(pattern[-1]):
            live &= padded[at : at + n] != 0
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        ids[k] = np.where(live, h, SIZE)
    square = np.zeros(n, np.float64)
    for k in range(len(PATTERNS)):
        square += (ids[k] < SIZE) * float(WEIGHTS[k]) ** 2
    norms = np.sqrt(np.bincount(of, square, len(strings)))
    return Features(ids, of, np.maximum(norms, 1e-9))


def project(f: Features, weights: np.ndarray) -> np.ndarray:
    """The product of every string's normalised features with a vector of SIZE + 1 weights (the last 0)."""
    per = np.zeros(f.ids.shape[1], np.float64)
    for k in range(len(PATTERNS)):
        per += weights[f.ids[k]] * WEIGHTS[k]
    return np.bincount(f.of, per, len(f.norms)) / f.norms


def gram(f: Features, landmarks: Features, width: int = 50, places: int = 20_000) -> np.ndarray:
    """The kernel between every string and every landmark, some landmarks and places at a time."""
    many, m = len(f.norms), len(landmarks.norms)
    out = np.zeros((many, m))
    for first in range(0, m, width):
        stop = min(m, first + width)
        v = np.zeros((SIZE + 1, stop - first), np.float32)
        for k in range(len(PATTERNS)):
            mine = (landmarks.of >= first) & (landmarks.of < stop)
            np.add.at(v, (landmarks.ids[k][mine], landmarks.of[mine] - first), WEIGHTS[k])
        v[SIZE] = 0
        for at in range(0, len(f.of), places):
            ids = f.ids[:, at : at + places]
            part = v[ids[0]] * WEIGHTS[0]
            for k in range(1, len(PATTERNS)):
                part += v[ids[k]] * WEIGHTS[k]
            of = f.of[at : at + places]
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[heads], first:stop] += np.add.reduceat(part, heads, axis=0)
    return out / f.norms[:, None] / landmarks.norms[None, :]


def fold(f: Features, coefficients: np.ndarray) -> np.ndarray:
    """The vector of SIZE + 1 weights that is the sum of the strings' normalised features, each times its coefficient."""
    out = np.zeros(SIZE + 1, np.float64)
    c = (coefficients / f.norms)[f.of]
    for k in range(len(PATTERNS)):
        out += np.bincount(f.ids[k], c * WEIGHTS[k], SIZE + 1)
    out[SIZE] = 0
    return out.astype(np.float32)


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 15) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last coefficient is the offset."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        margin = 1 - y * (z @ w)
        on = margin > 0
        a, b = z[on], weight[on]
        gradient = ridge @ w - 2 * c * (a.T @ (b * y[on] * margin[on]))
        step = np.linalg.solve(ridge + 2 * c * (a.T * b) @ a, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def spread(k: np.ndarray, many: int) -> list[int]:
    """``many`` of the strings with this kernel that lie far apart: each next one is the worst explained by
    those before (the pivots of an incomplete Cholesky factor)."""
    left = k.diagonal().astype(np.float64)
    factor = np.zeros((len(k), min(many, len(k))))
    picked: list[int] = []
    for n in range(factor.shape[1]):
        i = int(np.argmax(left))
        if left[i] < 1e-3:
            break
        picked.append(i)
        factor[:, n] = (k[:, i] - factor[:, :n] @ factor[i, :n]) / np.sqrt(left[i])
        left = np.maximum(left - factor[:, n] ** 2, 0)
        left[picked] = 0
    return picked


@dataclass
class Sentences:
    """Distinct sentences of labelled documents: their kernel with the landmarks, and where they occur."""

    kernel: np.ndarray  # sentences x landmarks
    item: np.ndarray  # the sentence of each occurrence
    owner: np.ndarray  # its document, numbered from 0
    y: np.ndarray  # per document
    trust: np.ndarray  # per document; labels that seem wrong have 0

    def highest(self, score: np.ndarray) -> np.ndarray:
        out = np.full(len(self.y), -1.0)
        np.maximum.at(out, self.owner, score[self.item])
        return out

    def rates(self, use: np.ndarray) -> np.ndarray:
        """How often documents that hold something like a sentence are harmful, by the landmarks near it."""
        near = np.maximum(self.kernel, 0) ** NEAR
        near /= near.sum(1, keepdims=True) + 1e-12
        on = use[self.owner]
        bad = np.bincount(self.item[on], self.y[self.owner[on]].astype(float), len(near))
        both = np.bincount(self.item[on], minlength=len(near))
        return near @ ((near.T @ bad + 2 * self.y[use].mean()) / (near.T @ both + 2))


def fit(s: Sentences, use: np.ndarray, root: np.ndarray, c: float = COST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """The machine over the landmarks' space from the documents in ``use``, and the scores of all sentences.

    Labels are of documents: one sentence, the witness, makes a document harmful. At first that is the one
    whose like is most often in harmful documents, later the one that the machine puts highest. A sentence
    that is as often in harmless documents is no witness. Other sentences of harmful documents that score
    as harmless count as such, with less weight.
    """
    use = use & (s.trust > 0)
    n = len(s.kernel)
    z = s.kernel @ root
    score = s.rates(use)
    w = np.zeros(z.shape[1] + 1)
    harmful, harmless = (s.y & use)[s.owner], (~s.y & use)[s.owner]
    for turn in range(repeats):
        own = score[s.item]
        bad = np.bincount(s.item[harmful & (own >= s.highest(score)[s.owner] - 1e-12)], minlength=n).astype(float)
        good = np.bincount(s.item[harmless], minlength=n).astype(float)
        bad[good >= bad] = 0
        if turn:
            good += OTHERS * np.bincount(s.item[harmful & (own < 0)], minlength=n)
        bad, good = np.minimum(bad, 3), np.minimum(good, 3)  # a sentence counts no more for being repeated often
        if not bad.any() or not good.any():
            return w - np.eye(len(w))[-1], score * 0 - 1
        good *= min(1.0, 3 * bad.sum() / good.sum())
        sides = [bad > 0, good > 0]
        y = np.concatenate([np.ones(sides[0].sum()), -np.ones(sides[1].sum())])
        w = _machine(np.vstack([z[k] for k in sides]), y, np.concatenate([bad[sides[0]], good[sides[1]]]), c)
        score = z @ w[:-1] + w[-1]
    return w, score


def border(y: np.ndarray, held: np.ndarray) -> float:
    """The threshold of the best F1 on scores by models that haven't seen the documents; harmless ones weigh
    RARER times, as reviews prefer suspicious texts. The middle of the best, smoothed stretch is taken."""
    grid = np.linspace(-0.8, 0.8, 65)
    hit, false = np.array([(y & (held > t)).sum() for t in grid]), np.array([(~y & (held > t)).sum() for t in grid])
    f1 = 2 * hit / np.maximum(1, hit + RARER * false + y.sum())
    smooth = np.convolve(np.pad(f1, 4, "edge"), np.ones(9) / 9, "valid")
    return float(np.mean(grid[smooth >= smooth.max() - 1e-9]))


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    threshold: float

    def score(self, texts: list[str | None]) -> list[float]:
        """The highest sentence's score per text; 0 is the border, texts without sentences have -1."""
        strings, owner = [], []
        for n, t in enumerate(texts):
            own = [normal(s) for s in sentences(t)]
            strings += own
            owner += [n] * len(own)
        out = np.full(len(texts), -1.0)
        if strings:
            s = project(features(strings), self.weights) + self.offset - self.threshold
            np.maximum.at(out, np.array(owner), np.maximum(s, -1.0))
        return out.tolist()


# --- training on the workers ------------------------------------------------------------------------


def labelled_sentences(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, harmful, fold, sentence`` of labelled documents, distinct normalised sentences, whole texts.

    The label is what most reviews say; documents whose reviews are evenly split are left out, and so are
    documents without a sentence. At most ``most`` documents are taken, chosen by a hash of their id; this
    is the one bound of training, and only labelled rows fall under it.
    """
    votes = labels.where("is_harmful is not null").select("doc_id", "reviewer", "is_harmful", "labelled_at").distinct()
    votes = votes.groupBy("doc_id").agg(F.avg("is_harmful").alias("share")).where("share <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("doc_id").cast("bigint"), (F.col("share") > 0.5).alias("harmful"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), F.col("text").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted({normal(s) for s in sentences(t)}) for t in b.column(3).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at)) for k in range(3)] + [pa.array([x for o in own for x in o], pa.string())], names=["doc_id", "harmful", "fold", "sentence"])

    return rows.mapInArrow(cut, "doc_id bigint, harmful boolean, fold int, sentence string").distinct()


def kernel_rows(strings: DataFrame, against: list[str]) -> DataFrame:
    """``sentence, kernel`` (float32) of the distinct sentences against some strings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features(against)
        for b in batches:
            g = gram(features(b.column(0).to_pylist()), f).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in g], pa.binary())], names=["sentence", "kernel"])

    # few bytes but dear: spread over all cores, which AQE would not
    own = strings.select("sentence").distinct()
    return own.repartition(own.sparkSession.sparkContext.defaultParallelism).mapInArrow(rows, "sentence string, kernel binary")


def find_landmarks(flat: DataFrame, many: int) -> list[str]:
    """Landmarks for the sentences: the ``many`` that lie farthest apart of CANDIDATES times as many, chosen by a hash."""
    chosen = flat.select("sentence").distinct().orderBy(F.xxhash64("sentence"), "sentence").limit(CANDIDATES * many)
    strings = [r.sentence for r in chosen.collect()]
    place = {x: n for n, x in enumerate(strings)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros((len(place), len(place)), np.float32)
        for b in batches:
            for x, row in zip(b.column(0).to_pylist(), b.column(1)):
                k[place[x]] = np.frombuffer(row.as_py(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(spread(k, many), pa.int32())], names=["n"])

    rows = kernel_rows(flat.sparkSession.createDataFrame([(x,) for x in strings], "sentence string"), strings)
    return [strings[r.n] for r in rows.repartition(1).mapInArrow(pick, "n int").collect()]


def _gathered(table: pa.Table, landmarks: int) -> tuple[Sentences, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``_fold_jobs`` as Sentences, with each document's id, fold and held-out score."""
    kernel = np.frombuffer(b"".join(table["kernel"].to_pylist()), np.float32).reshape(-1, landmarks).astype(np.float64)
    docs = table["docs"].combine_chunks()
    item = np.repeat(np.arange(len(table)), np.diff(docs.offsets.to_numpy()))
    flat = docs.flatten()
    column = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
    ids, first, owner = np.unique(column["doc_id"], return_index=True, return_inverse=True)
    y, fold, held = column["harmful"][first].astype(bool), column["fold"][first], column["held"][first].astype(float)
    return Sentences(kernel, item, owner, y, column["trust"][first].astype(float)), ids, fold, held


def _root(landmarks: list[str]) -> tuple[Features, np.ndarray]:
    """The landmarks' features, and the inverse root of their kernel (Nyström)."""
    f = features(landmarks)
    k = gram(f, f)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6 * value[-1]
    return f, vector[:, keep] / np.sqrt(value[keep])


def train(documents: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, most: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents, as of train_and_judge."""
    return train_and_judge(documents, labels, landmarks, most)[0]


def train_and_judge(documents: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS, most: int = MAX_LABELLED) -> tuple[Model, DataFrame | None]:
    """A model from the labelled documents, and ``id, score`` of each by a model of the second round that hasn't
    seen it (None where there is nothing to learn from). All work is done in tasks; the driver holds the landmarks
    and the finished weights.

    Some labels are wrong, so documents are first scored by models that haven't seen them (one task for
    each fold); where such a score contradicts the label by more than DOUBT (harmful) or SURE (harmless),
    the document is left out of the second round, whose held-out scores give the threshold. The last model
    is of all folds. With labels of one kind only, or none, nothing scores above the border.
    """
    flat = written(labelled_sentences(documents, labels, most), "harm-sentences")
    kinds = {r.harmful for r in flat.select("harmful").distinct().collect()}
    if len(kinds) < 2:
        return Model(np.zeros(SIZE + 1, np.float32), -1.0, 0.0), None
    chosen = find_landmarks(flat, landmarks)
    width = len(chosen)

    table = written(kernel_rows(flat, chosen), "harm-kernel")

    def held_out(group: pa.Table) -> pa.Table:
        s, ids, fold, _ = _gathered(group, width)
        out = fold == group["model"][0].as_py()
        _, score = fit(s, ~out, _root(chosen)[1])
        return pa.table({"id": ids[out], "score": s.highest(score)[out]})

    def scored(docs: DataFrame) -> DataFrame:
        return docs.withColumn("model", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).groupBy("model").applyInArrow(held_out, "id bigint, score double")

    def placed(doubt: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
        """Sentences with their kernel and documents; labels that the scores in ``doubt`` contradict have trust 0."""
        rows = flat.withColumns({"trust": F.lit(1.0), "held": F.lit(0.0)})
        if doubt is not None:
            wrong = F.when(F.col("harmful"), F.col("score") < -DOUBT).otherwise(F.col("score") > SURE)
            rows = rows.join(doubt.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("trust", F.when(wrong, 0.0).otherwise(1.0)).drop("score")
        if held is not None:
            rows = rows.join(held.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("held", F.col("score")).drop("score")
        docs = rows.groupBy("sentence").agg(F.collect_list(F.struct("doc_id", "harmful", "fold", "held", "trust")).alias("docs"))
        return table.join(docs, "sentence").select("kernel", "docs")

    def finish(group: pa.Table) -> pa.Table:
        s, ids, _, held = _gathered(group, width)
        kept = s.trust > 0
        f, root = _root(chosen)
        w, _ = fit(s, np.ones(len(ids), bool), root)
        return pa.table({"weights": [fold(f, root @ w[:-1]).tobytes()], "offset": [float(w[-1])], "threshold": [border(s.y[kept], held[kept])]})

    first = written(scored(placed()), "harm-held")
    second = written(scored(placed(first)), "harm-held")
    row = placed(first, second).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(finish, "weights binary, offset double, threshold double").first()
    return Model(np.frombuffer(row.weights, np.float32), row.offset, row.threshold), second


def quality(documents: DataFrame, labels: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """One row: ``documents, harmful, found, right, precision, recall`` on labelled documents that several reviewers
    agree about, each scored by a model that hasn't seen it. Reviewed documents are not as others: harmful ones
    are several times as frequent among them, so precision on a whole corpus is another."""
    model, held = train_and_judge(documents, labels, landmarks)
    votes = labels.where("is_harmful is not null").select("doc_id", "reviewer", "is_harmful").distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("is_harmful").alias("share"))
    sure = votes.where("n > 1 and share in (0, 1)").select("doc_id", (F.col("share") == 1).alias("y"))
    held = held if held is not None else sure.select(F.col("doc_id").alias("id"), F.lit(-1.0).alias("score")).limit(0)
    judged = sure.join(held, F.col("doc_id") == F.col("id")).select("y", (F.col("score") > model.threshold).alias("p"))
    counts = judged.agg(F.count("*").alias("documents"), F.count_if("y").alias("harmful"), F.count_if("p").alias("found"), F.count_if(F.col("y") & F.col("p")).alias("right"))
    return counts.select("*", (F.col("right") / F.expr("nullif(found, 0)")).alias("precision"), (F.col("right") / F.expr("nullif(harmful, 0)")).alias("recall"))


def saved_model(documents: DataFrame, labels: DataFrame, key: str) -> Model:
    """The model below the shared folder that has this key; trained and written if there is none yet.

    ``key`` must tell apart the tables and their versions; another version of this module trains anew.
    """
    spark = documents.sparkSession
    code = hashlib.sha256(inspect.getsource(inspect.getmodule(train)).encode()).hexdigest()[:16]
    path = f"{shared_folder(spark).rstrip('/')}/harm-model-{code}-{key}"
    schema = "weights binary, offset double, threshold double"
    try:
        row = spark.read.schema(schema).parquet(path).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row is not None:
        return Model(np.frombuffer(row.weights, np.float32), row.offset, row.threshold)
    m = train(documents, labels)
    spark.createDataFrame([(m.weights.tobytes(), m.offset, m.threshold)], schema).coalesce(1).write.mode("overwrite").parquet(path)
    return m


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, score, is_harmful`` of every document, whole texts, in one pass without a shuffle.

    Null, empty and blank texts score -1. Texts of any length are scored sentence by sentence.
    """
    weights, offset, threshold = model.weights, model.offset, model.threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, offset, threshold)
        for b in batches:
            texts = b.column(2).to_pylist()
            first = 0
            while first < len(texts):
                size, stop = 0, first
                while stop < len(texts) and (size < 200_000 or stop == first):
                    size += len(texts[stop] or "")
                    stop += 1
                s = own.score(texts[first:stop])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, stop - first), b.column(1).slice(first, stop - first), pa.array(s, pa.float64()), pa.array([x > 0 for x in s], pa.bool_())],
                    names=["doc_id", "source", "score", "is_harmful"],
                )
                first = stop

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(score, "doc_id bigint, source string, score double, is_harmful boolean")


def rates(scored: DataFrame) -> DataFrame:
    """``source, documents, harmful, rate`` per source, a null source as its own."""
    g = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("is_harmful").alias("harmful"))
    return g.withColumn("rate", F.col("harmful") / F.col("documents"))
