"""Language of texts, by words.

The script of a word narrows its candidates to the languages that write in it. Every word has a score
per candidate: log-probabilities of its character trigrams and four-grams, learned per language. A
Viterbi path over the words, with a penalty for each switch, labels spans of one language; the language
with most letters is the text's.

The model is fitted on whole texts of a bounded sample of the rows of each label (SAMPLE_ROWS, those with the
smallest hash); prediction reads whole texts and nothing else.
"""

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.arrow import pieces
from logfold.llm.common import small_batches, text_of

# Rows of a language that are learned from.
SAMPLE_ROWS = 2_000
# More languages are refused: the model, which every task gets, grows with them.
MOST_LANGUAGES = 500
BUCKET_BITS = 15
SMOOTHING = 0.5
SWITCH = 14.0
# A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
PIECE = 1 << 20

# First code points of the scripts told apart, and their names; letters below belong to the one before.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
NAMES = sorted({name for _, name in SCRIPTS})

_letters = None


def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark that goes with one, else 0."""
    global _letters
    if _letters is None:
        kinds = {"L": 2, "M": 1}
        _letters = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return _letters


class Words:
    """The words of several texts as arrays: letters, hashed grams at each letter, and bounds of words and texts."""

    def __init__(self, texts: list[str]):
        # Two blanks between texts keep grams within one word, as blanks within a text do.
        points = np.frombuffer("".join(f"  {t.lower()}" for t in texts).encode("utf-32-le", "surrogatepass") + b"\0" * 8, "<u4")
        kind = _kinds()[np.minimum(points, sys.maxunicode)]
        letter = kind > 0
        c = np.where(letter, points, 0).astype(np.uint32)
        at = np.flatnonzero(letter)
        one, two, nxt = c[at - 1] if len(at) else c[:0], c[at - 2] if len(at) else c[:0], c[at + 1] if len(at) else c[:0]
        # Beyond the blank before a word lies another word, which its score has nothing to do with.
        here, two = c[at], np.where(one > 0, two, 0).astype(np.uint32)
        shift = np.uint32(32 - BUCKET_BITS)
        three = (one * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA6B)) ^ (nxt * np.uint32(0xC2B2AE35))
        three = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        four = (three ^ (two * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        self.grams = ((three >> shift).astype(np.int64), (four >> shift).astype(np.int64) + (1 << BUCKET_BITS))
        self.starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        self.lengths = np.diff(self.starts, append=len(at))
        begin = np.cumsum([0, *[len(t.lower()) + 2 for t in texts]])
        self.texts = np.searchsorted(at[self.starts] if len(at) else at, begin)
        self.letters = np.searchsorted(at, begin)
        # Marks alone are no text in any language.
        real = np.append(0, np.cumsum(kind == 2))
        self.has_letters = real[begin[1:]] > real[begin[:-1]]
        first = here[self.starts] if len(at) else here
        script = np.searchsorted([s for s, _ in SCRIPTS], first, "right") - 1
        self.scripts = np.array([NAMES.index(n) for _, n in SCRIPTS])[script]


def _counted(batches):
    """(lang, bucket, n): grams of labelled texts, and letters by script in buckets below zero."""
    for batch in pieces(batches, "_text", PIECE):
        langs = batch.column("_lang").to_pylist()
        words = Words(batch.column("_text").to_pylist())
        out = []
        for lang in sorted(set(langs)):
            own = [i for i, x in enumerate(langs) if x == lang]
            counts = np.zeros(2 << BUCKET_BITS, np.int64)
            scripts = np.zeros(len(NAMES), np.int64)
            for i in own:
                a, b = words.letters[i], words.letters[i + 1]
                for g in words.grams:
                    counts += np.bincount(g[a:b], minlength=len(counts))
                w = slice(words.texts[i], words.texts[i + 1])
                scripts += np.bincount(words.scripts[w], words.lengths[w], len(NAMES)).astype(np.int64)
            used = np.flatnonzero(counts)
            out.append((lang, np.concatenate([used, -1 - np.arange(len(NAMES))]), np.concatenate([counts[used], scripts])))
        for lang, bucket, n in out:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])


class Model:
    """Languages in order, log-probabilities by gram bucket and language, and candidates by script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        half = counts.reshape(len(langs), 2, 1 << BUCKET_BITS) + SMOOTHING
        logs = np.log(half / half.sum(axis=2, keepdims=True)).reshape(len(langs), -1)
        self.table = np.ascontiguousarray((logs - logs.max(axis=0)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.candidates = (share >= SCRIPT_SHARE).T

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        grams = self.table[words.grams[0]] + self.table[words.grams[1]]
        scores = np.add.reduceat(grams, words.starts, axis=0)
        allowed = self.candidates[words.scripts]
        # A script that no language writes says nothing; else a language that does not write it loses.
        none = ~allowed.any(axis=1)
        scores[none] = 0
        return np.where(allowed | none[:, None], scores, np.minimum(scores.min(axis=1, keepdims=True), 0) - np.float32(8))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path.

    If no run of words favours another language over the best single one by more than half the
    penalty, no switch can pay, and the path is found without stepping through the words.
    """
    if not len(scores):
        return np.zeros(0, np.int64)
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), gain[:-1]]), axis=0)
    if (gain - low).max() <= switch / 2:
        return np.full(len(scores), best)
    back = np.empty(len(scores), object)
    total, n = scores[0].tolist(), scores.shape[1]
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(total)
        source, moved = total.index(top), top - switch
        back[t] = [i if total[i] >= moved else source for i in range(n)]
        total = [max(total[i], moved) + row[i] for i in range(n)]
    path = np.empty(len(scores), np.int64)
    state = total.index(max(total))
    for t in range(len(scores) - 1, 0, -1):
        path[t] = state
        state = back[t][state]
    path[0] = state
    return path


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` rows of each language, those with the smallest hash of id and text.

    Rows that share a hash with the last one are taken as well: copies of one row. Without labels the model has no
    languages. Counts per language and gram come to the driver: 2 ** (BUCKET_BITS + 1) for each of MOST_LANGUAGES.
    """
    place = F.xxhash64(F.col(id).cast("string"), "_text").alias("_h")
    labelled = docs.filter(F.col(lang).isNotNull()).withColumn("_text", text_of(text)).select(F.col(lang).cast("string").alias("_lang"), "_text", place)
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    first = labelled.select("_lang", "_h").withColumn("_rank", rank).filter(F.col("_rank") <= rows)
    cuts = first.groupBy("_lang").agg(F.max("_h").alias("_cut")).limit(MOST_LANGUAGES + 1).collect()
    if len(cuts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    cuts = docs.sparkSession.createDataFrame(cuts, "_lang string, _cut bigint")
    sample = labelled.join(F.broadcast(cuts), "_lang").filter("_h <= _cut").repartition("_h").select("_lang", "_text")
    found = sample.mapInArrow(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts, scripts = np.zeros((len(langs), 2 << BUCKET_BITS)), np.zeros((len(langs), len(NAMES)))
    row = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    gram = bucket >= 0
    counts[row[gram], bucket[gram]] = n[gram]
    scripts[row[~gram], -1 - bucket[~gram]] = n[~gram]
    return Model(langs, counts, scripts)


def spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(first word, one after the last, language) of every span of each text."""
    words = Words(texts)
    scores = model.word_scores(words) if model.langs else np.zeros((len(words.starts), 0), np.float32)
    out = []
    for a, b in zip(words.texts[:-1], words.texts[1:]):
        path = viterbi(scores[a:b]) if model.langs else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(path, prepend=-1)).tolist() if len(path) else []
        out.append([(i, j, model.langs[path[i]]) for i, j in zip(cuts, [*cuts[1:], len(path)])])
    return out


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every row.

    ``score`` is the share of letters in spans of the predicted language. A text that is null or has no
    letters (marks alone are none), or a model without languages, gives `und` and 0. Texts of any length are read whole. The first language in order wins a tie.
    Only the text is read: other columns, repeated rows and null ids change nothing.
    """

    def run(batches):
        for batch in pieces(batches, "_text", PIECE):
            words = Words(batch.column("_text").to_pylist())
            scores = model.word_scores(words) if model.langs else None
            langs, shares, numbers = [], [], []
            for a, b, known in zip(words.texts[:-1], words.texts[1:], words.has_letters):
                if not known or scores is None:
                    langs.append(UNKNOWN), shares.append(0.0), numbers.append(0)
                    continue
                path = viterbi(scores[a:b])
                letters = np.bincount(path, words.lengths[a:b], len(model.langs))
                top = int(letters.argmax())
                langs.append(model.langs[top]), shares.append(float(letters[top] / letters.sum()))
                numbers.append(int(np.count_nonzero(np.diff(path))) + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(numbers, pa.int64()),
            ], ["_id", "lang_pred", "score", "n_spans"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id).cast("bigint").alias("_id"), text_of(text).alias("_text"))
    out = source.mapInArrow(run, "_id bigint, lang_pred string, score double, n_spans bigint")
    return out.withColumnRenamed("_id", id)


def held_out(id: Column) -> Column:
    """Rows that are kept from learning."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))
