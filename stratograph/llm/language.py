"""Language of documents and of the passages in them.

Word-first backoff: a known word scores by its log frequency in each language; a word the model has never
seen falls back to its character 5-grams, where these are unknown to 4-grams, and so on down to
single characters. Sentences are scored one by one, smoothed by their neighbours, and runs of one
language become segments.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratograph.session import cut, spread

#: Bound of the training sample: labelled rows per language; their texts are read whole.
TRAIN_ROWS = 2000
#: Bounds of the classifier: words per language it is fitted from (the most frequent), and entries per language and
#: table that are kept. They bound what reaches the driver and what is sent to the executors.
FIT_WORDS, TOP_WORDS, TOP_GRAMS = 200_000, 20_000, 20_000
#: How often the labels of the sample are corrected sentence by sentence before the last fit.
CORRECTIONS = 2
LONGEST_GRAM = 5
#: Words whose score a task remembers.
REMEMBERED = 200_000
SEGMENT_SCHEMA = "doc_id long, segment int, begin int, end int, sentences int, lang string, confidence double"
DOCUMENT_SCHEMA = "doc_id long, lang string, confidence double, langs array<string>"

_FENCE = regex.compile(r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)|^ {0,3}>[> \t]*(```+|~~~+)[^\n]*(?:\n {0,3}>(?![> \t]*\2)[^\n]*)*(?:\n {0,3}>[> \t]*\2[^\n]*)?|`+[^`\n]*`+|<(pre|code)\b.*?</\3>")
#: Lines of tool output, quoted or not; a quote of anything else is prose, of which only the mark is no text.
_OUTPUT = regex.compile(r"(?m)^(?: {0,3}(?:>(?!>> )[ \t]?+)++)?+(?:\$ |>>> |[ \t]*at [\w.$]+\(|Traceback \(|[ \t]+File \"|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:    |\t)\S|\[[A-Z]+\]|(?:ERROR|WARN|INFO|DEBUG|FATAL|panic)\b[: ]).*$")
_QUOTE = regex.compile(r"(?m)^ {0,3}(?:>[ \t]?)+")
_NAME = regex.compile(r"\b(?:https?://|www\.)\S+|\b[\w.-]+@[\w-]+\.\w+|(?<![\p{L}])(?:[./~]?[\w-]+/)+[\w.-]+|\b\p{L}+_[\w]+|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b(?:[A-Z][a-z0-9]+){2,}\b|\b[\w-]+\.(?:py|go|js|ts|tsx|java|md|json|ya?ml|toml|rs|cs|php|kt|swift|c|h|cpp|sh|txt|sql)\b|\b\w+\(\)|\b[0-9a-f]{7,}\b|\{\{.*?\}\}|\$\{.*?\}|--?[a-z][\w-]*")
_STOP = regex.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』”]?|\n\s*\n|\n(?=\s*(?:[-*+•#>|]|\d+[.)])\s)|\s*\|\s*|\n")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_LETTER, _NO_BREAK = regex.compile(r"\p{L}"), regex.compile(r"[^\n]")
_HANGUL = regex.compile(r"\p{Hangul}")
_ENDED = regex.compile(r"[.!?…。！？][\s\"'”’»)\]」』]*$")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+")


def fold(text: str) -> str:
    """Lower case without accents: the form in which texts that lost theirs still meet the model."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)) if not _CJK.search(text) and not _HANGUL.search(text) else text.lower()


def words(text: str) -> list[str]:
    """Words in lower case; runs of Han and kana, which have no spaces, give their two-letter pieces."""
    found = _WORD.findall(text.lower())
    if not _CJK.search(text):
        return found
    out = []
    for w in found:
        at = 0
        for m in _CJK.finditer(w):
            if m.start() > at:
                out.append(w[at:m.start()])
            run = m.group()
            out += [run[i:i + 2] for i in range(len(run) - 1)] or [run]
            at = m.end()
        if at < len(w):
            out.append(w[at:])
    return out


def blank(text: str) -> str:
    """The text with code, tool output, names, links and the marks of quotes blanked out, every place kept."""
    keep = lambda m: _NO_BREAK.sub(" ", m.group()) if "\n" in m.group() else " " * len(m.group())
    return _NAME.sub(keep, _QUOTE.sub(keep, _OUTPUT.sub(keep, _FENCE.sub(keep, text))))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, words of it) of each sentence of natural language."""
    bare, out, at = blank(text), [], 0
    for m in [*_STOP.finditer(bare), None]:
        end = m.start() if m else len(bare)
        piece = bare[at:end]
        if _LETTER.search(piece):
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + len(piece.rstrip()), piece.strip()))
        at = m.end() if m else end
    return out


class Model:
    """Log frequencies per language: words as written, words folded, and character n-grams of both.

    A table is the place of each entry and one matrix, entries by languages.
    """

    def __init__(self, langs: list[str], tables: list[tuple[dict[str, int], np.ndarray]]):
        self.langs, self.tables = langs, tables
        self._place: dict[str, int] = {}
        self._scores = np.zeros((1024, len(langs)))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "tables": self.tables}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["langs"], state["tables"])

    @classmethod
    def fit(cls, samples: dict[str, Counter]) -> Model:
        """samples: per language the counts of words (as :func:`words` gives them)."""
        langs = sorted(samples)
        levels: list[list[Counter]] = [[Counter() for _ in langs] for _ in range(2 + LONGEST_GRAM)]
        for k, lang in enumerate(langs):
            levels[0][k] = Counter(samples[lang])
            for w, n in samples[lang].items():
                plain = fold(w)
                levels[1][k][plain] += n
                for form in {w, plain}:
                    padded = f" {form} "
                    for size in range(1, LONGEST_GRAM + 1):
                        counts = levels[1 + size][k]
                        for i in range(len(padded) - size + 1):
                            counts[padded[i:i + size]] += n
        tables = []
        for level, counts in enumerate(levels):
            top = TOP_WORDS if level < 2 else TOP_GRAMS
            # of equal counts the first by the alphabet stay, so that the order of the sample does not matter
            kept = sorted({w for c in counts for w, _ in (c.items() if len(c) <= top else heapq.nsmallest(top, c.items(), key=lambda x: (-x[1], x[0])))})
            totals = np.array([sum(c.values()) for c in counts], dtype=float) + 0.05 * (len(kept) + 1)
            logs = np.log((np.array([[c[w] for c in counts] for w in kept], dtype=float).reshape(len(kept), len(langs)) + 0.05) / totals)
            tables.append((dict(zip(kept, range(len(kept)))), logs))
        return cls(langs, tables)

    def word(self, w: str) -> np.ndarray | None:
        """Score of one word per language against the best one, None where no n-gram of it is known."""
        found = None
        for (place, logs), form in zip(self.tables, (w, None)):
            if (i := place.get(fold(w) if form is None else form)) is not None:
                found = logs[i]
                break
        if found is None:
            padded = f" {w} "
            for size in range(min(LONGEST_GRAM, len(padded)), 0, -1):
                place, logs = self.tables[1 + size]
                hits = [j for i in range(len(padded) - size + 1) if (j := place.get(padded[i:i + size])) is not None]
                if len(hits) * 2 >= len(padded) - size + 1 or size == 1 and hits:
                    found = logs[hits].mean(axis=0)
                    break
        # a word tells at most so much, so that one foreign name does not decide a sentence
        return None if found is None else np.maximum(found - found.max(), -6.0)

    def _places(self, found: list[str]) -> list[int]:
        """Rows of the words that have a score in ``_scores``; each word is looked up once."""
        out = []
        for w in found:
            i = self._place.get(w)
            if i is None:
                told = self.word(w)
                if told is None:
                    i = -1
                else:
                    i = len(self._place)
                    if i >= len(self._scores):
                        self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                    self._scores[i] = told
                self._place[w] = i
            if i >= 0:
                out.append(i)
        return out

    def score(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Per piece the sum of its words' scores, and how many had one."""
        if len(self._place) > REMEMBERED:
            self._place, self._scores = {}, np.zeros((1024, len(self.langs)))
        places = [self._places(p) for p in pieces]
        counts = np.array([len(p) for p in places], dtype=int)
        out = np.zeros((len(pieces), len(self.langs)))
        if counts.any():
            there = np.flatnonzero(counts)
            rows = self._scores[np.concatenate([np.asarray(places[i], dtype=int) for i in there])]
            out[there] = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(counts[there])[:-1]]), axis=0)
        return out, counts

    def segments(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(begin, end, sentences, language, confidence) of each run of sentences in one language."""
        pieces = sentences(text)
        scores, counts = self.score([words(p) for _, _, p in pieces])
        # headings and captions belong to a passage but are no sentence of it
        rows = [(*pieces[i][:2], counts[i] >= 6 or _ENDED.search(pieces[i][2]) is not None) for i in np.flatnonzero(counts)]
        if not rows:
            return []
        scores, counts = scores[counts > 0], counts[counts > 0]
        whole = scores.sum(axis=0)
        near = np.zeros_like(scores)
        near[1:] += scores[:-1]
        near[:-1] += scores[1:]
        near = scores + 0.15 * near + 0.02 * np.maximum(whole - whole.max(), -60.0)
        short = counts < 4
        best = np.argmax(np.where(short[:, None], near, scores + 0.02 * near), axis=1)
        out, i = [], 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and best[j + 1] == best[i]:
                j += 1
            total = scores[i:j + 1].sum(axis=0)
            p = np.exp(np.clip(total - total[best[i]], -50, 50))
            out.append((rows[i][0], rows[j][1], sum(r[2] for r in rows[i:j + 1]), self.langs[best[i]], float(1 / p.sum())))
            i = j + 1
        return out


def document_languages(segments: list[tuple[int, int, int, str, float]]) -> tuple[str | None, float, list[str]]:
    """(main language, confidence, languages).

    A text is mixed if passages of two or more sentences are in more than one language; these are
    then its languages. Otherwise its language is that of most of its characters.
    """
    if not segments:
        return None, 0.0, []
    size: Counter = Counter()
    for begin, end, _, lang, _ in segments:
        size[lang] += end - begin
    main = max(size, key=lambda x: (size[x], x))
    long = {lang for _, _, n, lang, _ in segments if n >= 2}
    langs = sorted(long if len(long) > 1 else {main})
    mine = [(e - b, c) for b, e, _, lang, c in segments if lang == main]
    return main, sum(w * c for w, c in mine) / max(1, sum(w for w, _ in mine)), langs


# ---- labels -----------------------------------------------------------------------------------
def label_of(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``label``: the code of ``codes`` that ``lang`` names in any notation, else null.

    Case, blanks around, region after ``-`` or ``_``, three-letter codes and English names are
    notations of one language. ``codes`` is the table of languages and small by nature; how it is
    joined is left to its size.
    """
    names = codes.select(F.explode(F.array(*[F.lower(F.trim(c)) for c in ("lang_code", "iso3", "english_name")])).alias("_name"), F.col("lang_code").alias("label")).filter("_name IS NOT NULL").dropDuplicates(["_name"])
    key = F.regexp_replace(F.lower(F.trim("lang")), r"[-_].*$", "")
    return documents.withColumn("_name", key).join(names, "_name", "left").drop("_name")


def fit_model(documents: DataFrame, codes: DataFrame, rows: int = TRAIN_ROWS, corrections: int = CORRECTIONS) -> Model:
    """A model from at most ``rows`` labelled documents a language (those of the smallest hashes of the id), read whole.

    Labels may be wrong, and a text may hold passages in another language: ``corrections`` times, each sentence of the
    sample is counted for the language that the model before gives it, backoff included, and a new model is fitted. The
    sample stays on the executors; what the driver holds are counts of at most ``FIT_WORDS`` words a language.
    """
    known = label_of(documents.select("doc_id", "text", "lang"), codes).filter("label IS NOT NULL AND trim(text) <> ''").withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    # a threshold on the hash, found from counts, makes the sample one narrow pass; the ranks that make it exact see hardly more than the sample
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    known, part = spread(known), F.lit(0)
    for label, n in counts.items():
        part = F.when(F.col("label") == label, F.lit(min(1 << 20, math.ceil((1 << 20) * 1.1 * (rows + 100) / n)))).otherwise(part)
    near = known.filter(F.col("_h") < part)
    first = near.select("doc_id", "label", "_h").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))).filter(F.col("_r") <= rows).select("doc_id", "label")
    sample = near.join(F.broadcast(first), ["doc_id", "label"], "left_semi").select("label", "text")  # at most ``rows`` ids a language

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: Counter = Counter()
            for label, text in batch.itertuples(index=False):
                for _, _, piece in sentences(text):
                    if found := words(piece):
                        out[(label, " ".join(found))] += 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["label", "piece", "n"])

    pieces = cut(spread(sample).mapInPandas(tokenized, "label string, piece string, n long"))
    langs = sorted(counts)

    def fitted(shared) -> Model:
        """One round: count words for the languages the sentences are in, by label or by the model before."""
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: Counter = Counter()
            for batch in batches:
                labels, texts, times = list(batch["label"]), [p.split(" ") for p in batch["piece"]], list(batch["n"])
                if shared is not None and texts:
                    m = shared.value
                    scores, known = m.score(texts)
                    labels = [m.langs[int(k)] if n else label for label, k, n in zip(labels, scores.argmax(axis=1), known)]
                for label, found, n in zip(labels, texts, times):
                    for w in found:
                        out[(label, w)] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["label", "word", "n"])

        told = spread(pieces).mapInPandas(count, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
        most = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
        frame = told.withColumn("_r", most).filter(F.col("_r") <= FIT_WORDS).select("label", "word", "n").toPandas()
        samples: dict[str, Counter] = {label: Counter() for label in langs}
        for label, w, n in frame.itertuples(index=False):
            samples[label][w] = int(n)
        return Model.fit({k: v for k, v in samples.items() if v})

    model = fitted(None)
    for _ in range(corrections if model.langs else 0):
        model = fitted(documents.sparkSession.sparkContext.broadcast(model))  # bounded by TOP_WORDS and TOP_GRAMS
    return model


def segment_languages(documents: DataFrame, model: Model) -> DataFrame:
    """One row per segment: doc_id, segment, begin, end (characters), sentences, lang, confidence.

    Texts without natural language (null, empty, only code) have no segment. Repeated rows of a
    document give the same rows and count once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by TOP_WORDS and TOP_GRAMS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [(d, i, *s) for d, text in batch.itertuples(index=False) if text and m.langs for i, s in enumerate(m.segments(text))]
            yield pd.DataFrame(out, columns=["doc_id", "segment", "begin", "end", "sentences", "lang", "confidence"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, SEGMENT_SCHEMA).distinct()


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, langs): main language and all languages; null and empty where there is none."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by TOP_WORDS and TOP_GRAMS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [(d, *document_languages(m.segments(text) if text and m.langs else [])) for d, text in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "confidence", "langs"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, DOCUMENT_SCHEMA).dropDuplicates(["doc_id"])


def mislabelled(documents: DataFrame, codes: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang): languages of documents whose label is missing or wrong, or that mix languages."""
    labels = label_of(documents.select("doc_id", "lang"), codes).select("doc_id", "label")
    told = identify(documents, model)
    cases = labels.join(told, "doc_id").filter((F.size("langs") > 0) & (F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
