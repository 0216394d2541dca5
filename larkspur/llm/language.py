"""Language of short texts, piece by piece, with calibrated confidence.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams
(hashed), trained online by follow-the-regularised-leader with elastic-net
penalties until its loss settles, then calibrated by a single temperature on
rows held out of training.

Training uses a bounded sample of labelled rows (``sample_rows``, chosen by the
hash of the text); the document frequencies behind IDF and the word counts that
tell names from words cover all distinct texts. Labels are noisy, so each third of the
sample is judged by a model of the other two, rows that contradict it are left
out, and the final model is trained on the rest. All models are trained in
executor tasks, the three thirds side by side; the driver only hands weights on.

Segments: a text is cut at separators into pieces; pieces that hold only names
have no language and join the stretch around them; neighbouring pieces of one
language are one stretch. A word counts as known, and not as a name, if the
lower bound of its share among the texts of some label reaches ``share``: more
texts sharpen the bound, no number of texts switches it, and a language that
few texts are written in is measured by its own texts.

Defined results: null, blank and name-only texts give no segment; texts of any
length are read whole; equal texts get equal results, and repeated rows change
nothing; with no labelled row at all the built-in seed words alone train the
model; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.session import cut

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "ko", "ja", "zh", "vi")
BUCKETS = 1 << 16
FOLDS = 3
# Notations of language labels (lower case, without region).
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais", "es": "es spa spanish espanol castellano",
    "it": "it ita italian italiano", "pt": "pt por portuguese portugues", "nl": "nl nld dut dutch nederlands flemish", "ru": "ru rus russian",
    "ko": "ko kor korean", "ja": "ja jpn japanese jp", "zh": "zh zho chi chinese mandarin cmn cn", "vi": "vi vie vietnamese",
}
# Common words, the least a model starts from.
SEEDS = {
    "en": "the and of to in is that for with about from how what this are", "de": "der die und das ist nicht mit von für über ein auf sich auch wie",
    "fr": "le la les des et est une du dans pour sur que avec au ce", "es": "el la los las y es una del en para sobre que con por lo",
    "it": "il lo gli le di che è una della per con sulla dei nel sono", "pt": "o os as e é uma do da em para sobre que com não ao",
    "nl": "de het een en van is niet met voor over op dat zijn ook wat", "ru": "и в не на что это как для о по из за от мы все",
    "ko": "이 그 및 에 는 을 를 의 가 와 으로 대한 하는 있다 이야기", "ja": "の は を に が で と も する した です ます まとめ から について",
    "zh": "的 和 是 在 了 与 不 有 我们 关于 报道 这 个 人 对", "vi": "và của là các cho không được về những một với trong người có này",
}
_SEPARATOR = re.compile(r"\s*(?:[|¦\n\r\t()\[\]{}<>«»“”\"：:;；•·/]|\s[-–—]+\s|–|—|[.!?。！？]+(?=\s|$)|(?<=[。！？])|,\s|，|、|\s{2,})\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SCRIPT_MARKS = [(b"\0kana", re.compile(r"[぀-ヿ]")), (b"\0hangul", re.compile(r"[가-힣]")), (b"\0cyrillic", re.compile(r"[Ѐ-ӿ]")), (b"\0han", re.compile(r"^[㐀-鿿]+$"))]
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")


def label_of(column: Column) -> Column:
    """The language a label states, whatever its notation and region; null if none."""
    names = F.create_map(*[F.lit(x) for code, ws in LABELS.items() for w in ws.split() for x in (w, code)])
    key = F.translate(F.regexp_replace(F.lower(F.trim(column)), r"[-_ (].*$", ""), "çñêõ", "cneo")
    return F.try_element_at(names, key)


def pieces_of(text: str | None) -> list[str]:
    """The parts of a text between separators."""
    if not text:
        return []
    return [p for p in (x.strip(" 　-–—.,'’") for x in _SEPARATOR.split(text)) if p]


def words_of(piece: str) -> list[str]:
    """Lower-case words; scripts without spaces give pairs of characters."""
    out = []
    for w in _WORD.findall(piece.lower()):
        if _CJK.search(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


@lru_cache(maxsize=200_000)
def _word_buckets(word: str) -> np.ndarray:
    """Hashed character 1- to 4-grams of one word, with its scripts, repeated as often as they stand in it."""
    t = f" {word} "
    grams = [name for name, script in _SCRIPT_MARKS if script.search(word)]
    grams += [g.encode() for n in (1, 2, 3, 4) for i in range(len(t) - n + 1) if (g := t[i : i + n]) != " "]
    return np.array([zlib.crc32(g) % BUCKETS for g in grams], np.int64)


def buckets_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 1- to 4-grams of a text, and its words' scripts, with their counts."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    # long words are no vocabulary and are not remembered
    at, n = np.unique(np.concatenate([_word_buckets(w) if len(w) < 40 else _word_buckets.__wrapped__(w) for w in words]), return_counts=True)
    return at, n.astype(float)


class LanguageModel:
    """Weights (buckets x languages), intercept, IDF by bucket, temperature."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.temperature = idf, 1.0
        self.weights = np.zeros((BUCKETS, len(LANGUAGES)), np.float32)
        self.bias = np.zeros(len(LANGUAGES))

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = buckets_of(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return x @ self.weights[at] + self.bias if len(at) else self.bias * 0

    def probabilities(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def train_ftrl(model: LanguageModel, texts: list[str], labels: list[int], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7, batch: int = 32, settled: float = 0.1, most_passes: int = 40) -> None:
    """FTRL-proximal in small batches: per-coordinate rates, L1 for sparsity and L2
    for size. It ends when a pass lowers the mean log loss by less than the share ``settled``."""
    k = len(LANGUAGES)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    feats = [(at, x, y) for (at, x), y in zip(map(model.features, texts), labels) if len(at)]
    order, before = np.random.default_rng(seed), np.inf

    def solve(zz: np.ndarray, nn: np.ndarray, l1_: float) -> np.ndarray:
        w = -(zz - np.sign(zz) * l1_) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1_, 0.0, w)

    for _ in range(most_passes if feats else 0):
        loss, shuffled = 0.0, order.permutation(len(feats))
        for start in range(0, len(feats), batch):
            rows = [feats[i] for i in shuffled[start : start + batch]]
            at, inverse = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(at)))
            x[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), inverse] = np.concatenate([r[1] for r in rows])
            y = (np.arange(len(rows)), [r[2] for r in rows])
            w, b = solve(z[at], n[at], l1), solve(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            loss -= float(np.log(np.maximum(p[y], 1e-12)).sum())
            p[y] -= 1.0
            g, gb = x.T @ p, p.sum(0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
        if loss > (1 - settled) * before:
            break
        before = loss
    model.weights = solve(z, n, l1).astype(np.float32)
    model.bias = solve(zb, nb, 0.0)


def calibrate(model: LanguageModel, texts: list[str], labels: list[int]) -> None:
    """The temperature of least held-out log loss, drawn towards 1 as by one row, so that no row at all leaves it there."""
    zs = np.stack([model.logits(t) for t in texts]) if texts else np.zeros((0, len(LANGUAGES)))
    y = np.array(labels, int)

    def loss(t: float) -> float:
        s = zs / t
        s = s - s.max(1, keepdims=True)
        return float(np.sum(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y])) + float(np.log(t)) ** 2

    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 61))
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])


def corpus_counts(votes: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(kind, key, label, n) over distinct texts, counted in the tasks first: kind 0
    counts the texts with an n-gram bucket, 1 the texts of a label with a word, 2 the texts of a label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            words: Counter = Counter()
            for t, a, first in zip(batch[text], batch[label], batch["first"]):
                if first:  # a text under several labels is one text
                    buckets[buckets_of(t)[0]] += 1
                a = a or ""
                words.update((1, w, a) for w in set(words_of(_DOMAIN.sub(" ", t))))
                words[2, "", a] += 1
            yield pd.DataFrame([(*k, n) for k, n in words.items()], columns=["kind", "key", "label", "n"])
        at = np.flatnonzero(buckets)
        yield pd.DataFrame({"kind": 0, "key": at.astype(str), "label": "", "n": buckets[at]})

    return votes.select(text, label, "first").mapInPandas(count, "kind int, key string, label string, n bigint").groupBy("kind", "key", "label").agg(F.sum("n").alias("n"))


def distinct_texts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(text, label, n, first) for the distinct pairs; ``first`` marks one label of each text, its most frequent."""
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"), label_of(F.col(f"`{label}`")).alias("label")).filter(F.col("text").rlike(r"\S"))
    votes = texts.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("text").orderBy(F.col("label").isNull(), F.desc("n"), "label")  # a group holds the labels of one text
    return cut(votes.withColumn("first", F.row_number().over(best) == 1))


def lower_share(n: Column, total: Column, z: float = 1.64) -> Column:
    """Wilson's lower bound of a share."""
    p, zz = n / total, z * z
    return (p + zz / (2 * total) - z * F.sqrt(p * (1 - p) / total + zz / (4 * total * total))) / (1 + zz / total)


def known_words(counts: DataFrame, share: float = 0.001, least: int = 3) -> frozenset[str]:
    """Words whose share among the texts of a label (or of those without one) is at
    least ``share`` by its lower bound, seen in ``least`` texts, and the seed words: a text of n words has at most n of them, so
    there are at most n / share for each label."""
    totals = counts.filter("kind = 2").select("label", F.col("n").alias("total"))  # one row for each label
    common = counts.filter("kind = 1").join(F.broadcast(totals), "label").filter(lower_share(F.col("n"), F.col("total")) >= share).filter(F.col("n") >= least)
    return frozenset(r["key"] for r in common.select("key").distinct().collect()) | {w for ws in SEEDS.values() for w in words_of(ws)}


def _train(texts: list[tuple[str, int]], idf: np.ndarray, settled: float = 0.1) -> LanguageModel:
    model = LanguageModel(idf)
    train_ftrl(model, [t for t, _ in texts], [y for _, y in texts], settled=settled)
    return model


def fit_languages(votes: DataFrame, counts: DataFrame, sample_rows: int = 8_000) -> LanguageModel:
    """Trains on at most ``sample_rows`` distinct labelled texts; n-grams are counted over all.

    ``votes``: from :func:`distinct_texts`; ``counts``: from :func:`corpus_counts` of it."""
    spark = votes.sparkSession
    frequency = np.zeros(BUCKETS)
    for r in counts.filter("kind = 0").select("key", "n").collect():  # at most BUCKETS rows, whatever the data
        frequency[int(r["key"])] = r["n"]
    total = max(votes.filter("first").count(), 1)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows = votes.filter("first and label is not null").select("text", "label", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample_rows).collect()
    pool = [(p, LANGUAGES.index(r["label"]), r["h"] % 10 == 0) for r in rows for p in pieces_of(r["text"]) if len(words_of(p)) > 2]
    seeds = [(w, LANGUAGES.index(k)) for k, ws in SEEDS.items() for w in [ws, *(" ".join(ws.split()[i : i + 5]) for i in range(0, 15, 5))]] * 3
    shared = spark.sparkContext.broadcast((pool, seeds, idf))  # bounded by the sample

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, seeds, idf = shared.value
        for fold in (int(x) for batch in batches for x in batch["id"]):
            model = _train([(t, y) for i, (t, y, _) in enumerate(pool) if i % FOLDS != fold] + seeds, idf, settled=0.3)  # ended early: a judge must not learn wrong labels by heart
            mine = range(fold, len(pool), FOLDS)
            p = [model.probabilities(pool[i][0]) for i in mine]
            yield pd.DataFrame({"i": list(mine), "ok": [bool(q.argmax() == pool[i][1] or q.max() < 0.4) for i, q in zip(mine, p)]}).astype({"i": "int64", "ok": "bool"})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, seeds, idf = shared.value
        for _ in batches:
            model = _train([(t, y) for i, (t, y, h) in enumerate(pool) if agrees[i] and not h] + seeds, idf)
            held = [(t, y) for i, (t, y, h) in enumerate(pool) if agrees[i] and h]
            calibrate(model, [t for t, _ in held], [y for _, y in held])
            yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias.tolist()], "temperature": [model.temperature]})

    # labels are noisy: each third is judged by a model of the other two, and rows that contradict it are left out
    agrees = {r["i"]: r["ok"] for r in spark.range(0, FOLDS, 1, FOLDS).mapInPandas(judge, "i bigint, ok boolean").collect()}
    fitted = spark.range(0, 1, 1, 1).mapInPandas(fit, "weights binary, bias array<double>, temperature double").first()  # a model of fixed size
    model = LanguageModel(idf)
    model.weights, model.bias, model.temperature = np.frombuffer(fitted["weights"], np.float32).reshape(BUCKETS, -1), np.array(fitted["bias"]), fitted["temperature"]
    return model


_DOMAIN = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b", re.I)


def stretches(text: str | None, model: LanguageModel, known: frozenset[str]) -> list[tuple[str, float, str]]:
    """(language, confidence, text) for each stretch, in reading order.

    A piece of at most three words, none of which is a ``known`` word, is a
    name. A piece of one or two words follows its neighbours, if it has any."""
    judged: list[tuple[str | None, float, int, str]] = []
    pieces = [(p, words_of(p)) for p in pieces_of(_DOMAIN.sub(" ", text or ""))]
    alone = not any(len(words) > 2 for _, words in pieces)
    for piece, words in pieces:
        if not words or (len(words) <= 3 and not known.intersection(words)):
            judged.append((None, 0.0, 0, piece))
            continue
        p = model.probabilities(piece)
        best = int(p.argmax())
        judged.append((None if len(words) <= 2 and not alone else LANGUAGES[best], float(p[best]), len(piece), piece))
    out: list[list] = []
    for language, conf, size, piece in judged:
        if language is None:
            if out:
                out[-1][3].append(piece)
        elif out and out[-1][0] == language:
            out[-1][1] += conf * size
            out[-1][2] += size
            out[-1][3].append(piece)
        else:
            out.append([language, conf * size, size, [piece]])
    return [(language, conf / size, " ".join(parts)) for language, conf, size, parts in out]


def language_segments(df: DataFrame, key: str, text: str, label: str, model: LanguageModel | None = None) -> DataFrame:
    """(key, stated, segment, language, confidence, segment_text) for each stretch of each text."""
    votes = distinct_texts(df, text, label)
    counts = cut(corpus_counts(votes))
    model = model or fit_languages(votes, counts)
    shared = df.sparkSession.sparkContext.broadcast((model, known_words(counts)))  # fixed size: BUCKETS x languages, and the bounded word list

    @F.pandas_udf("array<struct<language: string, confidence: double, segment_text: string>>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = shared.value
        for batch in batches:
            yield pd.Series([[{"language": a, "confidence": b, "segment_text": c} for a, b, c in stretches(t, model, known)] for t in batch])

    rows = df.select(F.col(f"`{key}`").alias(key), label_of(F.col(f"`{label}`")).alias("stated"), segment(F.col(f"`{text}`").cast("string")).alias("s"))
    return rows.select(key, "stated", F.size("s").alias("n_segments"), F.posexplode("s").alias("pos", "x")).select(key, "stated", "n_segments", (F.col("pos") + 1).alias("segment"), "x.*")
