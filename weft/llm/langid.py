"""Language identification by hierarchical discrimination.

A linear model first predicts the language's family; within it, one-versus-one linear support vector machines
separate the closely related languages. Features are the relative frequencies of byte bigrams and hashed byte
trigrams of the lower-cased text, so a score is a sum of table lookups over the whole text, done in NumPy for
many documents at once.

Training takes a bounded sample (see `train`); prediction reads every whole text. The model is a few MB
whatever the corpus, and goes to the executors inside the function that applies it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm.common import per_batch, tune
from weft.llm.textnum import chunks, utf8

#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic",
}
UNDETERMINED = "und"

#: Bounds of the training sample: documents a language, and bytes of one such document.
SAMPLE_PER_LANGUAGE = 800
SAMPLE_BYTES = 16_384

_BI, _TRI = 1 << 16, 1 << 16
_DIM = _BI + _TRI

# Digits and ASCII punctuation say nothing about the language: all become a space.
_CLASS = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalpha():
        _CLASS[_c] = 32


def _ids(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the bigram and of the trigram that starts at each byte (padded with spaces at the end)."""
    padded = np.full(len(raw) + 2, 32, np.uint32)
    padded[: len(raw)] = _CLASS[raw]
    two = (padded[:-2] << np.uint32(8)) | padded[1:-1]
    three = ((two << np.uint32(8)) | padded[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return two, three


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse relative frequencies of one text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    two, three = _ids(raw)
    ids, counts = np.unique(np.concatenate([two, three + np.uint32(_BI)]), return_counts=True)
    return ids.astype(np.int64), counts / max(len(raw), 1)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """L2-regularised hinge-loss SVM by dual coordinate descent; the bias is a feature of value 1.

    Each class counts alike: the cost of a row is divided by its class's share.
    """
    weight, bias = np.zeros(_DIM), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows])
    caps = np.where(signs > 0, cost * len(signs) / (2 * max((signs > 0).sum(), 1)), cost * len(signs) / (2 * max((signs < 0).sum(), 1)))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, values = rows[i]
            gradient = signs[i] * (weight[ids] @ values + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                weight[ids] += step * signs[i] * values
                bias += step * signs[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


@dataclass
class LanguageModel:
    """families: name -> languages; weights: one column a classifier, over features; a classifier's output is
    positive for its first side. family_of: classifier column of each family (one versus the rest)."""

    families: dict[str, list[str]]
    family_column: dict[str, int] = field(default_factory=dict)
    pair_column: dict[tuple[str, str], int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, _DIM), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def outputs(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Classifier outputs, one row a document."""
        n = len(off) - 1
        out = np.tile(self.bias, (n, 1)).astype(np.float64)
        if not len(raw) or not len(self.bias):
            return out
        lengths = np.diff(off)
        full = np.flatnonzero(lengths)
        two, three = _ids(raw)
        # An n-gram that reaches over a document's end would depend on its neighbour: as if spaces followed.
        ends = off[1:][lengths > 0]
        last = np.full(len(ends), 32, np.uint32)
        b1 = _CLASS[raw[ends - 1]].astype(np.uint32)
        two[ends - 1] = (b1 << np.uint32(8)) | last
        three[ends - 1] = ((b1 << np.uint32(16)) | np.uint32(32 << 8 | 32)) * np.uint32(0x9E3779B1) >> np.uint32(16)
        more = ends[lengths[full] > 1]
        b2 = _CLASS[raw[more - 2]].astype(np.uint32)
        three[more - 2] = ((b2 << np.uint32(16)) | (_CLASS[raw[more - 1]].astype(np.uint32) << np.uint32(8)) | np.uint32(32)) * np.uint32(0x9E3779B1) >> np.uint32(16)
        for c in range(len(self.bias)):
            table = self.weights[c]
            each = table[:_BI][two] + table[_BI:][three]
            out[full, c] += np.add.reduceat(each, off[:-1][full], dtype=np.float64) / lengths[full]
        return out

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (0 to 1) of each document of a chunk."""
        got = self.outputs(raw, off)
        n = len(got)
        names = sorted(self.families)
        if not names:
            return np.full(n, UNDETERMINED, object), np.zeros(n)
        sure = lambda x: 1.0 / (1.0 + np.exp(-np.clip(2.0 * x, -50, 50)))
        if len(names) > 1:
            margins = np.stack([got[:, self.family_column[f]] for f in names], 1)
            family = margins.argmax(1)
            score = sure(margins[np.arange(n), family])
        else:
            family, score = np.zeros(n, int), np.ones(n)
        lang = np.empty(n, object)
        for k, name in enumerate(names):
            at = np.flatnonzero(family == k)
            members = self.families[name]
            if not len(at):
                continue
            if len(members) == 1:
                lang[at] = members[0]
                continue
            votes, sums = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for i, j in combinations(range(len(members)), 2):
                x = got[at, self.pair_column[members[i], members[j]]]
                votes[:, i] += x > 0
                votes[:, j] += x <= 0
                sums[:, i] += x
                sums[:, j] -= x
            best = (votes + 1e-3 * np.tanh(sums)).argmax(1)
            lang[at] = np.array(members, object)[best]
            score[at] *= sure(sums[np.arange(len(at)), best] / (len(members) - 1))
        return lang, score


def train(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES, families: dict[str, str] | None = None) -> LanguageModel:
    """Fit on rows with text and language: at most per_language rows of each, of at most most_bytes each.

    The sample is chosen by a hash of the id, so it does not depend on partitioning. Its size is
    bounded by languages * per_language * most_bytes; the rows counted to set the rate are all rows.
    """
    known = FAMILIES if families is None else families
    usable = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text").between(1, most_bytes)))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("row_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({})
    rates = F.create_map(*[x for name, n in sorted(counts.items()) for x in (F.lit(name), F.lit(int(min(1.0, 1.2 * per_language / n) * (1 << 30))))])
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < rates[F.col("lang")])
    sample: dict[str, list] = {name: [] for name in sorted(counts)}
    for r in drawn.select("draw", "row_id", "lang", "text").toLocalIterator():
        sample[r["lang"]].append((r["draw"], -1 if r["row_id"] is None else r["row_id"], r["text"]))
    rows, of = [], []
    for name, found in sample.items():
        for _, _, body in sorted(found)[:per_language]:
            rows.append(_features(body))
            of.append(name)
    if not rows:
        return LanguageModel({})
    # Frequent n-grams vary more in number: scale each feature by the root of its mean.
    mean = np.zeros(_DIM)
    for ids, values in rows:
        mean[ids] += values / len(rows)
    scale = 1.0 / np.sqrt(mean + 1e-6)
    scaled = [(ids, values * scale[ids]) for ids, values in rows]
    of_row = np.array(of, object)
    members: dict[str, list[str]] = {}
    for name in sorted(set(of)):
        members.setdefault(known.get(name, name), []).append(name)
    model, weights, bias = LanguageModel(members), [], []

    def fit(at: np.ndarray, positive: np.ndarray) -> int:
        w, b = _svm([scaled[i] for i in at], np.where(positive, 1.0, -1.0))
        weights.append((w * scale).astype(np.float32))
        bias.append(b)
        return len(bias) - 1

    family_of_row = np.array([known.get(x, x) for x in of], object)
    everything = np.arange(len(rows))
    if len(members) == 2:
        a, b = sorted(members)
        model.family_column[a] = fit(everything, family_of_row == a)
        weights.append(-weights[-1])
        bias.append(-bias[-1])
        model.family_column[b] = len(bias) - 1
    elif len(members) > 2:
        for name in sorted(members):
            model.family_column[name] = fit(everything, family_of_row == name)
    for languages in members.values():
        for a, b in combinations(languages, 2):
            at = np.flatnonzero((of_row == a) | (of_row == b))
            model.pair_column[a, b] = fit(at, of_row[at] == a)
    model.weights, model.bias = np.array(weights, np.float32).reshape(len(bias), _DIM), np.array(bias)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append lang_pred (a learned language, or `und`) and score (double, 0 to 1) to docs' columns.

    `und`, with score 0: the text is null or has no letter, or the model learned no language. Only the text decides.
    Repeated rows are repeated. Columns of docs with these two names are replaced; text is none of them. No shuffle.
    """
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    at = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(at)
        raw, off = utf8(_lower(column))
        lang, score = np.empty(len(b), object), np.zeros(len(b))
        for lo, hi in chunks(off):
            lang[lo:hi], score[lo:hi] = model.predict(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        lang[~letters] = UNDETERMINED
        score[lang == UNDETERMINED] = 0.0
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(per_batch(batch), schema)


def held_out(row_id: str | Column = "doc_id") -> Column:
    """Rows that training never sees: CRC-32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string") if isinstance(row_id, str) else row_id.cast("string")) % 4 == 2, F.lit(False))
