"""The languages of each document and of each stretch of its prose: multilingual mixture inference.

A document is a mixture of languages. Each sentence is likely under each language by the n-grams of
its words; expectation-maximisation finds the proportions that explain all sentences of a document
best, and the set of languages is the one with the best likelihood less a penalty for each language.

The n-gram counts are fitted to a bounded sample of labelled documents, and refitted to what the
fit says of that sample's sentences, since labels are partly wrong. All documents are then inferred
where they are scanned: nothing is shuffled but the sample's counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespan.llm.prose import folded, stretches
from kinespan.workspace import written

#: Labelled documents of each language to which the model is fitted, about.
SAMPLE_DOCS = 1500
#: Labelled documents that a language needs to be told at all.
LEAST_DOCS = 3
#: N-grams of the model: those most frequent in the sample. It bounds what goes to the driver and to every task.
MAX_GRAMS = 60_000
#: Longest n-gram of letters; whole words count as well.
ORDER = 4
#: Weight of all languages' n-grams together against those of one.
SMOOTHING = 0.02
REFITS = 2
#: Expectation-maximisation ends for a document when no proportion moves by more.
STILL = 1e-4
#: Gain in log-likelihood that a further language must bring, for each unit of log(words).
PENALTY = 2.0
#: A language counts as found in a document from so many words on.
LEAST_WORDS = 25
#: Words whose scores a worker keeps.
CACHE = 200_000

#: Names and longer codes of languages that labels use, by ISO 639-1 code.
NAMES = {
    "de": "deu ger german deutsch alemán aleman alemão alemao allemand tedesco",
    "en": "eng english inglés ingles inglês anglais englisch inglese",
    "es": "spa spanish español espanol castellano espanhol espagnol spanisch spagnolo",
    "fr": "fra fre french français francais francés frances francês französisch francese",
    "it": "ita italian italiano italien italienisch",
    "pt": "por portuguese português portugues portugués portugais portugiesisch portoghese",
    "ca": "cat catalan català catalán",
    "gl": "glg galician galego gallego",
    "nl": "nld dut dutch nederlands neerlandés holandés",
    "pl": "pol polish polski polaco",
    "ro": "ron rum romanian română rumano",
    "sv": "swe swedish svenska sueco",
}
#: The codes of ISO 639-1; other pairs of letters stand for no language.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz "
    "ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu "
    "rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Fixed values: `na` is Nauru's language, but in labels says that there is none.
NO_LANGUAGE = ["na"]
#: Frequent words by which languages are told apart where no label names one.
SEEDS = {
    "de": "der die das und nicht mit ist ein eine für auf wird von den dem",
    "en": "the and of to is for that with this from are not it as be",
    "es": "el los las una y por con para del que se es en como más",
    "fr": "le les des une et dans pour que est sur avec pas du au ne",
    "it": "il gli della che di una per con non sono dei nel alla più è",
    "pt": "os das uma e não com para do da em que ao mais pelo são",
    "ca": "els les una i amb per del que es dels als és més no en",
    "nl": "het een en van niet met voor zijn dat op de wordt aan bij ook",
    "pl": "nie jest do na się że przez oraz dla z w jak od po tym",
    "ro": "și nu este pentru care din cu la pe sunt mai un o cel prin",
    "sv": "och att det som en är för inte med av på till den ett om",
}
#: Seed words that a sentence needs of one language, more than of any other, to count as its.
LEAST_SEEDS = 2
#: Share of such sentences that a language needs to be told where no label names one: fewer are chance.
SEED_SHARE = 0.005


def named_languages(label: Column) -> Column:
    """The ISO 639-1 codes that a label names, by code, regional variant or name; an empty array for any other text and null."""
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)]
    names = F.create_map(*pairs)
    words = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}_\-0-9]+")

    def code(word: Column) -> Column:
        first = F.regexp_extract(word, r"^(\p{L}+)", 1)
        two = F.when(first.isin(CODES) & ~first.isin(NO_LANGUAGE), first)
        return F.coalesce(F.try_element_at(names, first), two)

    return F.array_sort(F.array_distinct(F.filter(F.transform(words, code), lambda x: x.isNotNull())))


def grams(word: str) -> list[str]:
    """The n-grams of a word with its ends marked, and the word itself."""
    marked = f"<{word}>"
    size = len(marked)
    return [marked[i : i + n] for n in range(2, ORDER + 1) for i in range(size - n + 1)] + [f"={word}"]


class Model:
    """Log-likelihoods of n-grams in `languages`, against all languages together."""

    def __init__(self, languages: list[str], counts: dict[str, list[float]]):
        self.languages = languages
        table = np.array(list(counts.values()), float).reshape(-1, len(languages))
        each = np.maximum(table.sum(axis=0), 1)
        both = table.sum(axis=1, keepdims=True) / max(table.sum(), 1)
        share = (table / each + SMOOTHING * both) / (1 + SMOOTHING)
        self.scores = np.log(np.maximum(share, 1e-12) / np.maximum(both, 1e-12)).astype(np.float32) / ORDER
        self.index = {g: i for i, g in enumerate(counts)}
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.languages)), np.float32)

    def _row(self, word: str) -> int:
        at = len(self.words)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = [self.index[g] for g in grams(word) if g in self.index]
        self.rows[at] = self.scores[known].sum(axis=0) if known else 0
        self.words[word] = at
        return at

    def of(self, sentences: list[list[str]]) -> np.ndarray:
        """The log-likelihood of each non-empty sentence in each language, against all languages together."""
        if len(self.words) > CACHE:
            self._forget()
        get = self.words.get
        ids = [i if (i := get(w)) is not None else self._row(w) for s in sentences for w in s]
        starts = np.cumsum([0, *map(len, sentences[:-1])])
        return np.add.reduceat(self.rows[ids].astype(np.float64), starts, axis=0)


def mixtures(score: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] and posteriors [sentence, language].

    `score`: log-likelihoods of sentences, `size`: their words, `doc`: their document 0..n-1, ascending.
    """
    n_docs, n_langs = int(doc[-1]) + 1, score.shape[1]
    like = np.exp(score - score.max(axis=1, keepdims=True))
    starts, ends = np.searchsorted(doc, np.arange(n_docs)), np.searchsorted(doc, np.arange(n_docs), side="right")
    words = np.add.reduceat(size, starts)

    def fitted(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions that stand still, and the posteriors by them; a document that stands still takes no part in further rounds."""
        theta, going = theta.copy(), np.arange(n_docs)
        while len(going):
            rows = np.concatenate([np.arange(starts[d], ends[d]) for d in going]) if len(going) < n_docs else slice(None)
            count = ends[going] - starts[going]
            own, first = np.repeat(np.arange(len(going)), count), np.cumsum(count) - count
            p = theta[going][own] * like[rows]
            p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            now = np.add.reduceat(p * size[rows][:, None], first, axis=0) / words[going][:, None]
            moved = np.abs(now - theta[going]).max(axis=1)
            theta[going] = now
            going = going[moved > STILL]
        p = theta[doc] * like
        return theta, p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def likelihood(theta: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.log(np.maximum((theta[doc] * like).sum(axis=1), 1e-300)), starts)

    theta, _ = fitted(np.full((n_docs, n_langs), 1 / n_langs))
    price = PENALTY * np.log(words + 1)
    settled = np.zeros(n_docs, bool)
    for _ in range(n_langs - 1):
        least = np.where(theta > 0, theta, 2).argmin(axis=1)
        trial = theta.copy()
        trial[np.arange(n_docs), least] = 0
        several = (theta > 0).sum(axis=1) > 1
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-300)
        drop = several & ~settled & (likelihood(theta) - likelihood(trial) < price)
        settled |= ~drop
        if settled.all():
            break
        theta[drop] = trial[drop]
    return fitted(theta)


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sample's sentences with their document's language."""
    for batch in batches:
        rows = [(code, " ".join(s.words)) for code, text in zip(batch["code"], batch["text"]) for s in stretches(text)]
        yield pd.DataFrame(rows, columns=["code", "words"])


def _gram_counts(model: Model | None, languages: list[str]) -> Callable:
    """Counts by n-gram and language, of a partition: by the labels, or by the model where there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter()
        for batch in batches:
            codes, sentences = batch["code"].tolist(), [w.split(" ") for w in batch["words"]]
            if model is not None and sentences:
                codes = [languages[i] for i in model.of(sentences).argmax(axis=1)]
            for code, words in zip(codes, sentences):
                held.update((code, w) for w in words)
        total = Counter()
        for (code, word), n in held.items():
            for g in grams(word):
                total[code, g] += n
        yield pd.DataFrame([(c, g, n) for (c, g), n in total.items()], columns=["code", "gram", "n"])

    return run


def _seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences with the language whose seed words they have most of, if they have enough and no other has as many."""
    of = {folded(w): [c for c, words in SEEDS.items() if folded(w) in map(folded, words.split())] for words in SEEDS.values() for w in words.split()}
    for batch in batches:
        rows = []
        for text in batch["text"]:
            for s in stretches(text):
                told = Counter(c for w in s.words for c in of.get(w, ())).most_common(2)
                if told and told[0][1] >= LEAST_SEEDS and (len(told) == 1 or told[1][1] < told[0][1]):
                    rows.append((told[0][0], " ".join(s.words)))
        yield pd.DataFrame(rows, columns=["code", "words"])


def fitted_model(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of all languages that single labels name; without any, of those whose seed words the texts have; None without those either.

    The model is fitted to a sample: about SAMPLE_DOCS labelled documents of a language, or, where no
    document is labelled, as many of all for each language with seed words. The languages are at most those
    of ISO 639-1, so the model has at most MAX_GRAMS rows of as many numbers.
    """
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), named_languages(F.col(lang)).alias("codes")).where(F.col("text").isNotNull())
    labelled = texts.where(F.size("codes") == 1).withColumn("code", F.col("codes")[0])
    counted = labelled.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).collect()
    place = F.pmod(F.xxhash64(F.lit("languages"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    if counted:
        share = F.create_map(*[F.lit(x) for r in counted for x in (r["code"], SAMPLE_DOCS / r["n"])])
        chosen = labelled.where(place < F.try_element_at(share, F.col("code"))).select("code", "text")
        sample = written(chosen.mapInPandas(_sentences, "code string, words string"), "sentences")
        languages = sorted(r["code"] for r in counted)
    else:
        chosen = texts.where(place < F.lit(SAMPLE_DOCS * len(SEEDS) / max(texts.count(), 1))).select("text")
        sample = written(chosen.mapInPandas(_seeded, "code string, words string"), "sentences")
        seeded = {r["code"]: r["n"] for r in sample.groupBy("code").agg(F.count("*").alias("n")).collect()}
        languages = sorted(c for c, n in seeded.items() if n >= max(LEAST_DOCS, SEED_SHARE * sum(seeded.values())))
        sample = sample.where(F.col("code").isin(languages))
    if not languages:
        return None
    model = None
    for _ in range(1 + REFITS):
        counts = sample.mapInPandas(_gram_counts(model, languages), "code string, gram string, n long").groupBy("gram")
        each = [F.sum(F.when(F.col("code") == c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(languages)]
        top = counts.agg(F.sum("n").alias("n"), *each).orderBy(F.desc("n"), "gram").limit(MAX_GRAMS).collect()
        model = Model(languages, {r["gram"]: list(r[2:]) for r in top})
    return model


#: What `languages_of` adds to each document.
RESULT = (
    "n_words int, languages array<struct<lang:string,n_words:int,share:double,confidence:double>>, "
    "segments array<struct<start:int,end:int,lang:string,n_words:int,confidence:double>>"
)


def _infer(model: Model | None) -> Callable:
    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [stretches(t) if isinstance(t, str) else [] for t in batch["_text"]]
            n_words = np.array([sum(len(s.words) for s in x) for x in found], np.int32)
            languages: list[list[dict]] = [[] for _ in found]
            segments: list[list[dict]] = [[] for _ in found]
            with_prose = [i for i, x in enumerate(found) if x]
            if with_prose and model is not None:
                sentences = [s.words for i in with_prose for s in found[i]]
                size = np.array([len(s) for s in sentences], float)
                doc = np.repeat(np.arange(len(with_prose)), [len(found[i]) for i in with_prose])
                theta, p = mixtures(model.of(sentences), size, doc)
                best, sure = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
                at = 0
                for i in with_prose:
                    told: dict[int, list[float]] = {}
                    runs: list[list] = []
                    for s in found[i]:
                        b, c, n = best[at], sure[at], len(s.words)
                        own = told.setdefault(b, [0, 0.0])
                        own[0] += n
                        own[1] += n * c
                        if runs and runs[-1][2] == b:
                            runs[-1][1] = s.end
                            runs[-1][3] += n
                            runs[-1][4] += n * c
                        else:
                            runs.append([s.start, s.end, b, n, n * c])
                        at += 1
                    names = model.languages
                    languages[i] = [
                        {"lang": names[b], "n_words": int(n), "share": n / float(n_words[i]), "confidence": c / n}
                        for b, (n, c) in sorted(told.items(), key=lambda x: (-x[1][0], x[0]))
                    ]
                    segments[i] = [{"start": a, "end": e, "lang": names[b], "n_words": n, "confidence": c / n} for a, e, b, n, c in runs]
            yield pd.DataFrame({"_key": batch["_key"], "n_words": n_words, "languages": languages, "segments": segments})

    return infer


def languages_of(documents: DataFrame, key: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """The columns `key` with the words of prose, the languages (most words first) and the stretches of each document.

    Offsets of stretches count code points of the text as it is stored. A document without prose, with an empty or a null text, or
    without a model, has no languages. Columns of `key` named like a result are replaced by it. Repeated rows come out repeated; an empty table gives no rows.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(_infer(model), f"_key {kind}, {RESULT}").select(*[F.col(f"_key.`{c}`") for c in key if c not in ("n_words", "languages", "segments")], "n_words", "languages", "segments")


def main_language(found: DataFrame) -> DataFrame:
    """Of each row of `languages_of` the language with most words; `und` with confidence 0 where there is none."""
    first = F.try_element_at("languages", F.lit(1))
    rest = [c for c in found.columns if c not in ("languages", "segments")]
    confidence = F.coalesce(first["confidence"] * first["share"], F.lit(0.0))
    return found.select(*rest, F.coalesce(first["lang"], F.lit("und")).alias("language"), confidence.alias("confidence"))
