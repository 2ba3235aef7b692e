"""Language identification by a string kernel.

The kernel is a blended spectrum of presence: how many n-grams (n = 1 to 3,
over an alphabet of all letters of the training texts, everything else being
a gap) two texts share, over the geometric mean of how many each
has. Alphabets with more n-grams than SPACE_MOST have them hashed onto so many.
Nyström landmarks are drawn from the training texts, the same number a
language; a one-versus-rest kernel ridge regression is solved in the
landmarks' space. A batch of texts is scored by products of its presence
matrix: (P Z) W, where Z holds the landmarks' grams and W the regression's
weights; as Z W does not depend on the texts, it is multiplied once.

Training takes a bounded sample: about ``per_language`` labelled documents of
each language, those of least hash of the id. Whole texts are trained on and
predicted. The driver holds the landmarks' grams, as lists, and passes over the
other lists of the sample, summing the normal equations a few rows at a time:
its memory is (landmarks x languages) squared and SPACE_MOST x languages at most.

Cases: null text, or text without a letter, gives "und" and score 0; so does
any text if nothing was learned. Null ids count as not held out and are
never trained on. Repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices
from .tokens import mix

ALPHABET = 63  # classes 1..63; 0 is a gap. Up to so many letters, flags find distinct n-grams; more are sorted
SPACE = (ALPHABET + 1) ** 3
OFFSETS = (0, 64, 64 + 64**2)
GRAMS = 64 + 64**2 + 64**3
#: Grams that are told apart; of larger alphabets they are hashed.
SPACE_MOST = 3 << 19
#: Columns of a presence matrix, and training rows, that are held at once.
COLUMNS, ROWS = 1 << 16, 256
#: So many labels' counts are broadcast; more are joined by a shuffle.
LABELS = 10_000
PER_LANGUAGE, LANDMARKS = 300, 48
RIDGE = 1e-2
UNKNOWN = "und"
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def grams(text: str, table: np.ndarray, seen: np.ndarray | None, base: int = ALPHABET + 1) -> np.ndarray:
    """Distinct n-grams of ``text`` as sorted codes. ``seen``: GRAMS flags, all false before and after, or None for a ``base`` beyond 64."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = table[points]
    # One gap between words is enough.
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    if seen is None:
        c = np.concatenate([[0], c[keep], [0]]).astype(np.int64)
        two = c[:-1] * base + c[1:]
        found = np.unique(np.concatenate([c, two + base, two[:-1] * base + c[2:] + base + base**2]))
        found = found[~np.isin(found, [0, base, base + base**2])]
        if base + base**2 + base**3 > SPACE_MOST:
            found = np.unique(mix(found.astype(np.uint64)) % np.uint64(SPACE_MOST)).astype(np.int64)
        return found
    c = np.concatenate([[0], c[keep], [0]]).astype(np.int32)
    seen[c] = True
    two = c[:-1] * 64 + c[1:]
    seen[two + OFFSETS[1]] = True
    three = two[:-1] * 64 + c[2:]
    seen[three + OFFSETS[2]] = True
    seen[[0, OFFSETS[1], OFFSETS[2]]] = False  # gaps alone say nothing
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def class_table(letters: str) -> np.ndarray:
    table = np.zeros(0x110000, np.uint8 if len(letters) <= ALPHABET else np.int32)
    for i, c in enumerate(letters):
        table[ord(c)] = i + 1
    return table


def flags_for(letters: str) -> tuple[np.ndarray | None, int]:
    """Flags and base for grams."""
    return (np.zeros(GRAMS, bool), ALPHABET + 1) if len(letters) <= ALPHABET else (None, len(letters) + 1)


def _letters(batches):
    counts: dict[str, int] = {}
    for batch in slices(batches, "text"):
        joined = "".join(t or "" for t in column(batch, "text").to_pylist()).lower()
        points, n = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_counts=True)
        for p, k in zip(points.tolist(), n.tolist(), strict=True):
            if chr(p).isalpha():
                counts[chr(p)] = counts.get(chr(p), 0) + k
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["letter", "n"])


def _gram_lists(letters: str):
    def run(batches):
        table, (seen, base) = class_table(letters), flags_for(letters)
        for batch in slices(batches, "text"):
            lists = [grams(t or "", table, seen, base).astype(np.int32) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), pa.array([x.tobytes() for x in lists], pa.binary())], ["doc_id", "lang", "grams"])

    return run


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` labelled documents a language, of those not held out. Only ids and labels are counted."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    if sizes.limit(LABELS + 1).count() <= LABELS:
        sizes = F.broadcast(sizes)
    return labelled.join(sizes, "lang").filter(chance * F.col("size") < per_language).select("doc_id", "text", "lang")


class Model:
    """Languages, letters, the landmarks' grams (sorted) and their weights, one column a language."""

    def __init__(self, languages=(), letters="", vocabulary=None, weights=None):
        self.languages, self.letters = list(languages), letters
        self.vocabulary = np.zeros(0, np.int64) if vocabulary is None else vocabulary
        self.weights = np.zeros((0, len(self.languages)), np.float32) if weights is None else weights

    @classmethod
    def fit(cls, lists: list[tuple[str, np.ndarray]], letters: str, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """From (language, gram codes) in a fixed order."""
        lists = [(lang, g) for lang, g in lists if len(g)]
        sizes: dict[str, int] = {}
        marks = []
        for lang, g in lists:
            sizes[lang] = sizes.get(lang, 0) + 1
            if sizes[lang] <= landmarks:
                marks.append((lang, g))
        return cls.solve(marks, lists, sizes, letters, ridge)

    @classmethod
    def solve(cls, marks: list[tuple[str, np.ndarray]], rows, sizes: dict[str, int], letters: str, ridge: float = RIDGE) -> Model:
        """From the landmarks, all training rows (an iterable of language and gram codes, none empty) and how many each language has."""
        if not sizes:
            return cls()
        languages, total = sorted(sizes), sum(sizes.values())
        marks = [g for _, g in sorted(marks, key=lambda x: x[0])]
        scale = 1 / np.sqrt([len(g) for g in marks])
        codes = np.concatenate(marks)
        owner = np.repeat(np.arange(len(marks), dtype=np.int32), [len(g) for g in marks])
        order = np.argsort(codes, kind="stable")
        vocabulary, first = np.unique(codes[order], return_index=True)
        owner, first = owner[order], np.r_[first, len(order)]
        del codes, order

        def kernel(g: np.ndarray) -> np.ndarray:
            """Of one text with each landmark."""
            at = np.searchsorted(vocabulary, g)
            at[at == len(vocabulary)] = 0
            at = at[vocabulary[at] == g]
            times = first[at + 1] - first[at]
            ref = np.repeat(first[at] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            return np.bincount(owner[ref], minlength=len(marks)) * scale / np.sqrt(len(g))

        left, right = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
        rows = iter(rows)
        while part := list(islice(rows, ROWS)):
            k = np.stack([kernel(g) for _, g in part])
            of = np.array([languages.index(lang) for lang, _ in part])
            weighted = k * np.array([total / (sizes[lang] * len(languages)) for lang, _ in part])[:, None]  # languages count alike
            left += k.T @ weighted
            for x in range(len(languages)):
                right[:, x] += weighted[of == x].sum(axis=0)
        kmm = np.stack([kernel(g) for g in marks])
        w = np.linalg.solve(left + ridge * total * (kmm / len(marks) + 1e-3 * np.eye(len(marks))), right)
        weights = np.zeros((len(vocabulary), len(languages)), np.float32)
        for j, g in enumerate(marks):
            weights[np.searchsorted(vocabulary, g)] += (w[j] * scale[j]).astype(np.float32)
        return cls(languages, letters, vocabulary, weights)

    @staticmethod
    def _presence(g: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        row = np.zeros(len(vocabulary), np.float32)
        at = np.searchsorted(vocabulary, g)
        at[at == len(vocabulary)] = 0
        row[at[vocabulary[at] == g]] = 1
        return row

    def predict(self, texts: list[str | None], rows: int = 64) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each text."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return labels, scores
        table, (seen, base) = class_table(self.letters), flags_for(self.letters)
        where = np.full(SPACE_MOST, -1, np.int32)
        where[self.vocabulary] = np.arange(len(self.vocabulary))
        held, place = np.zeros(len(self.vocabulary), bool), np.zeros(len(self.vocabulary), np.int32)
        todo = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for a in range(0, len(todo), rows):
            part = todo[a : a + rows]
            norms, at = np.ones(len(part), np.float32), []
            for r, i in enumerate(part):
                g = grams(texts[i], table, seen, base)
                norms[r] = max(1, len(g))
                g = where[g]
                at.append(g[g >= 0])
                held[at[-1]] = True
            # The columns that any of these texts has, some of them at a time.
            used = np.flatnonzero(held)
            held[used] = False
            place[used] = np.arange(len(used))
            f = np.zeros((len(part), len(self.languages)), np.float32)
            for low in range(0, len(used), COLUMNS):
                some = used[low : low + COLUMNS]
                p = np.zeros((len(part), len(some)), np.float32)
                for r, g in enumerate(at):
                    col = place[g] - low
                    p[r, col[(col >= 0) & (col < len(some))]] = 1
                f += p @ self.weights[some]
            f /= np.sqrt(norms)[:, None]
            best = f.argmax(axis=1)
            for r, i in enumerate(part):
                labels[i], scores[i] = self.languages[best[r]], float(np.clip(f[r, best[r]], 0, 1))
        return labels, scores


def _order(doc_id: int) -> int:
    """By what landmarks are drawn."""
    return doc_id * 0x9E3779B97F4A7C15 % (1 << 64)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on the labelled sample. Its letter counts, ids and landmarks are collected, its gram lists pass by."""
    chosen = sample(docs, per_language)
    counted = chosen.mapInArrow(_letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "letter").collect()  # as many as there are letters, at most
    letters = "".join(r.letter for r in top)
    lists = cut(chosen.mapInArrow(_gram_lists(letters), "doc_id long, lang string, grams binary").filter(F.octet_length("grams") > 0), "grams")
    ids: dict[str, list[int]] = {}
    for r in lists.select("lang", "doc_id").collect():  # of the sample
        ids.setdefault(r.lang, []).append(r.doc_id)
    drawn = {(lang, d) for lang, of in ids.items() for d in sorted(of, key=_order)[:landmarks]}
    if not drawn:
        return Model()
    spark = docs.sparkSession
    # Rows of one id are told apart by their grams; equal ones stand for each other.
    rows = lists.join(F.broadcast(spark.createDataFrame(sorted(drawn), "lang string, doc_id long")), ["lang", "doc_id"])
    near: dict[str, list] = {}
    for r in rows.select("lang", "doc_id", "grams").toLocalIterator():
        near.setdefault(r.lang, []).append((_order(r.doc_id), bytes(r.grams)))
        if len(near[r.lang]) > 2 * landmarks:
            near[r.lang] = sorted(near[r.lang])[:landmarks]
    marks = [(lang, np.frombuffer(g, np.int32)) for lang in sorted(near) for _, g in sorted(near[lang])[:landmarks]]
    passing = ((r.lang, np.frombuffer(bytes(r.grams), np.int32)) for r in lists.select("lang", "grams").toLocalIterator())
    return Model.solve(marks, passing, {lang: len(of) for lang, of in ids.items()}, letters)


def _predicted(parts: tuple):
    def run(batches):
        model = Model(*parts)
        for batch in slices(batches, "text"):
            labels, scores = model.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def _typed(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; trained on those not held out."""
    own = _typed(docs)
    model = train(own, per_language, landmarks)
    parts = (model.languages, model.letters, model.vocabulary, model.weights)
    asked = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(_predicted(parts), "doc_id long, held_out boolean, lang_pred string, score double")


def _kept(parts: tuple, names: list[str], least: float):
    def run(batches):
        model = Model(*parts)
        at = names.index("text")
        for batch in slices(batches, "text"):
            labels, scores = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(labels, scores, strict=True)], pa.bool_()))

    return run


def keep_known(docs: DataFrame, least: float = 0.0, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """The documents in a known language: not "und", and of a score of ``least`` or more. Columns stay. Where no language was learned, nothing can be rejected and all stay."""
    model = train(_typed(docs), per_language, landmarks)
    parts = (model.languages, model.letters, model.vocabulary, model.weights)
    if not model.languages:
        return docs
    return docs.mapInArrow(_kept(parts, docs.columns, least), docs.schema)
