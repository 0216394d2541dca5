"""Finding passages of evaluation items inside training documents.

1. Texts become words: compatibility-normalised, freed of markup and invisible
   characters, lower case.
2. Seeds are n-grams of three words, adjacent or with one word left out between
   them, so that a copy of which every third word is replaced still has some.
   Rare ones - in few *classes* of items, where near-equal items are one class -
   are joined with the n-grams of the documents; a document is compared
   with an item only where several distinct seeds of the item stand close together.
3. A Smith-Waterman alignment of the words around those seeds, in which rare
   words weigh more, scores exact, partial and edited copies alike; where it
   bridges foreign text, its dense parts and unbroken runs are judged alone.

Scale: the documents are scanned once, however many items there are, and read
once more for the texts of the pairs found. Python turns
them to n-gram hashes and passes on the hits of those documents of which several hashes
stand in a bitmap of fixed size (2 ** 27 bits, the only thing that is broadcast
unmeasured); the seed join, the counts of seeds and words over all items and the
classes are ordinary joins and aggregations. Items are aligned in overlapping
passages of at most ``PASSAGE`` words, so an alignment needs bounded memory.

Defined results: null, empty and wordless texts leak nothing and are leaked
into nothing; long texts are read whole and aligned only around seeds; an item
or document that occurs twice is reported for each of its ids (and once for
each pair of ids); rows without a key are reported under null; empty tables
give an empty table.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.orphans import hot_keys, salted_join
from larkspur.session import cut, small_side

#: places of a seed's three words
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
SEED_WORDS, SEED_SPAN = 3, 4
PASSAGE = 512
BITMAP_WORDS = 1 << 21
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_MARK = re.compile(r"[*_`~#]+")
_WORD = re.compile(r"[^\W_]+")
# The format characters of Unicode (category Cf).
_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890-\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")


def words_of(text: str | None) -> list[str]:
    """The comparable words of a text."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        t = _FORMAT.sub("", unicodedata.normalize("NFKC", t))
    return _WORD.findall(_MARK.sub("", _TAG.sub(" ", t) if "<" in t else t).lower())


class _WordHashes(dict):
    """64 bits for each word, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def seeds_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all seeds of a text, those of one mask after those of another."""
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    places, hashes = [], []
    for no, mask in enumerate(MASKS):
        n = len(ids) - mask[-1]
        if n > 0:
            h = sum(ids[o : o + n] * f for o, f in zip(mask, _FACTORS)) + np.uint64(no * 0x27D4EB2F165667C5)
            h = (h ^ (h >> np.uint64(31))) * _FACTORS[1]
            places.append(np.arange(n, dtype=np.int32))
            hashes.append((h ^ (h >> np.uint64(29))).view(np.int64))
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(hashes)


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    return (bitmap[(h >> np.uint64(6)) & np.uint64(BITMAP_WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _path(doc: list[str], item: list[str], weight: dict[str, float], gap: float = 0.25, mismatch: float = 0.3) -> tuple[np.ndarray, float, int, int, int, int]:
    """Smith-Waterman over words -> (pairs of item and document word that match, in
    order; their weight; first and end item word; first and end document word)."""
    ids: dict[str, int] = {}
    d = np.fromiter((ids.setdefault(w, len(ids)) for w in doc), np.int64, len(doc))
    m, n = len(item), len(doc)
    ramp = gap * np.arange(n + 1)
    score = np.zeros((m + 1, n + 1))
    for r, w in enumerate(item, 1):
        same = d == ids.get(w, -1)
        diagonal = score[r - 1, :-1] + np.where(same, weight.get(w, 1.0), -mismatch)
        row = np.maximum(np.maximum(diagonal, score[r - 1, 1:] - gap), 0.0)
        row = np.concatenate(([0.0], row))
        score[r] = np.maximum(np.maximum.accumulate(row + ramp) - ramp, 0.0)
    r, c = np.unravel_index(int(score.argmax()), score.shape)
    end_r, end_c = int(r), int(c)
    pairs, mass = [], 0.0
    while r > 0 and c > 0 and score[r, c] > 1e-9:
        w = item[r - 1]
        hit = ids.get(w, -1) == d[c - 1]
        step = weight.get(w, 1.0) if hit else -mismatch
        if abs(score[r, c] - (score[r - 1, c - 1] + step)) < 1e-9:
            r, c = r - 1, c - 1
            if hit:
                pairs.append((r, c))
                mass += step
        elif abs(score[r, c] - (score[r - 1, c] - gap)) < 1e-9:
            r -= 1
        else:
            c -= 1
    return np.array(pairs[::-1], np.int64).reshape(-1, 2), mass, int(r), end_r, int(c), end_c


def align(doc: list[str], item: list[str], weight: dict[str, float], gap: float = 0.25, mismatch: float = 0.3) -> tuple[int, float, int, int, int]:
    """(matched words, matched weight, item words spanned, document words
    spanned, longest unbroken run) of the best local alignment."""
    pairs, mass, r, end_r, c, end_c = _path(doc, item, weight, gap, mismatch)
    breaks = np.flatnonzero((np.diff(pairs, axis=0) != 1).any(axis=1)) + 1
    longest = int(np.diff(np.concatenate(([0], breaks, [len(pairs)]))).max())
    return len(pairs), mass, end_r - r, end_c - c, longest


def unbroken(doc: list[str], item: list[str], least_words: int = 1) -> int:
    """Length of the longest run of words that doc and item share, or 0 if it is shorter than ``least_words``."""
    known, longest, start = set(item), 0, 0
    for end in range(len(doc) + 1):
        if end < len(doc) and doc[end] in known:
            continue
        if end - start >= max(least_words, longest + 1):  # a run holds only words of the item
            ids: dict[str, int] = {}
            d = np.fromiter((ids.setdefault(w, len(ids)) for w in doc[start:end]), np.int64, end - start)
            run = np.zeros(end - start + 1, np.int64)
            for w in item:
                run[1:] = np.where(d == ids.get(w, -1), run[:-1] + 1, 0)
                longest = max(longest, int(run.max()))
        start = end + 1
    return longest if longest >= least_words else 0


def dense_part(pairs: np.ndarray, least_words: int, identity: float) -> tuple[int, float] | None:
    """(matched words, identity) of the longest part of an alignment that holds both bounds."""
    best, most = None, least_words
    for i in range(len(pairs) - least_words + 1):
        if len(pairs) - i < most:
            break
        counts = np.arange(1, len(pairs) - i + 1)
        alike = counts / (pairs[i:] - pairs[i] + 1).max(axis=1)
        held = np.flatnonzero((counts >= most) & (alike >= identity))
        if len(held):
            best, most = (int(counts[held[-1]]), float(alike[held[-1]])), int(counts[held[-1]]) + 1
    return best


def _judge(words: list[str], low: int, high: int, seeds: list[tuple[int, int]], target: list[str], weight: dict[str, float], least_seeds: int, least_words: int, identity: float) -> tuple[int, float] | None:
    """(matched words, identity) of the item's passage in words[low:high].

    The best alignment may bridge foreign words between two excerpts. If it does
    not hold as a whole, its dense parts, the longest unbroken run, and the words
    before and after it, as far as enough seeds stand there, are judged by themselves."""
    found: list[tuple[int, float]] = []
    known = set(target)
    stretches = [(low, min(high, len(words)))]
    while stretches:
        a, b = stretches.pop()
        if sum(w in known for w in words[a:b]) < least_words:  # no more than these can match
            continue
        pairs, _, r, end_r, c, end_c = _path(words[a:b], target, weight)
        alike = len(pairs) / max(end_r - r, end_c - c, 1)
        if len(pairs) >= least_words and alike >= identity:
            found.append((len(pairs), alike))
            continue
        if part := dense_part(pairs, least_words, identity):
            found.append(part)
        if run := unbroken(words[a:b], target, least_words):
            found.append((run, 1.0))
        for x, y in ((a, a + c), (a + end_c, b)):
            # shorter than [a, b): the alignment of a stretch with seeds is not empty
            if y - x >= least_words and len({h for p, h in seeds if x <= p <= y - SEED_SPAN}) >= least_seeds:
                stretches.append((x, y))
    return max(found, default=None)


def leaked(words: list[str], seeds: list[tuple[int, int]], target: list[str], weight: dict[str, float], least_seeds: int, least_words: int, identity: float) -> tuple[int, float] | None:
    """(matched words, identity) of the best leak of one item into a text; ``seeds``: (place, hash) of the item's seeds there."""
    reach = len(target) + SEED_SPAN
    positions = sorted(seeds)
    best = None
    start = 0
    for k in range(1, len(positions) + 1):  # seeds further apart than the item is long are separate passages
        if k < len(positions) and positions[k][0] - positions[k - 1][0] <= 2 * reach:
            continue
        near = positions[start:k]
        start = k
        # a long run of seeds is aligned in overlapping windows of bounded size
        whole = near[-1][0] - near[0][0] <= 8 * reach
        at = 0
        for first in range(near[0][0], near[-1][0] + 1, 6 * reach):
            while at < len(near) and near[at][0] < first:
                at += 1
            seen = near if whole else near[at : bisect_left(near, (first + 8 * reach,))]
            if len({h for _, h in seen}) >= least_seeds:
                held = _judge(words, max(0, seen[0][0] - reach), seen[-1][0] + reach, seen, target, weight, least_seeds, least_words, identity)
                best = max(filter(None, (best, held)), default=None)
            if whole:
                break
    return best


def _passages(words: list[str]) -> list[list[str]]:
    """A text in overlapping passages of at most PASSAGE words."""
    return [words[i : i + PASSAGE] for i in range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2)]


def item_classes(seeds: DataFrame, alike: float = 0.5) -> DataFrame:
    """(item, class): items that share at least ``alike`` of their seeds with an earlier one are of its class.

    ``seeds``: (item, h), distinct. Each seed links its items to the first of
    them, not to one another; links are followed to their ends."""
    first = seeds.groupBy("h").agg(F.min("item").alias("rep"))
    sizes = seeds.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    shared = seeds.join(first, "h").filter("rep < item").groupBy("item", "rep").agg(F.count(F.lit(1)).alias("shared"))
    close = shared.join(sizes, "item").join(sizes.select(F.col("item").alias("rep"), F.col("n").alias("rep_n")), "rep").filter(F.col("shared") >= alike * F.least("n", "rep_n"))
    links = cut(close.groupBy("item").agg(F.min(F.struct(-F.col("shared"), "rep"))["rep"].alias("rep")))
    classes = sizes.select("item").join(links, "item", "left").select("item", F.coalesce("rep", "item").alias("class"))
    if links.isEmpty():
        return classes
    step = links.select(F.col("item").alias("class"), "rep")
    while True:
        new = cut(classes.join(step, "class", "left").select("item", F.coalesce("rep", "class").alias("class"), F.col("rep").isNotNull().alias("moved")))
        classes = new.select("item", "class")
        if new.filter("moved").isEmpty():
            return classes


def rare_seeds(parts: DataFrame, max_classes: int = 3) -> DataFrame:
    """(h, item, part) of the seeds that stand in at most ``max_classes`` classes of items; ``parts``: (item, part, hs)."""
    exploded = parts.select("item", "part", F.explode(F.array_distinct("hs")).alias("h"))
    seeds = cut(exploded.select("item", "h").distinct())
    classes = item_classes(seeds)
    rare = seeds.join(classes, "item").groupBy("h").agg(F.countDistinct("class").alias("df")).filter(F.col("df") <= max_classes)
    return exploded.join(rare.select("h"), "h").select("h", "item", "part")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The seeds' hashes as bits: at most BITMAP_WORDS rows come to the driver, however many seeds there are."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    rows = seeds.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP_WORDS, np.uint64)
    bitmap[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", least_words: int = 16, identity: float = 0.65, least_seeds: int = 6) -> DataFrame:
    """(doc, item, matched words, identity) for each item leaked into a document.

    ``least_words`` words of the item must stand aligned in running order, with
    at least the share ``identity`` of the aligned stretch matching. Of an item
    of more than ``PASSAGE`` words the best passage counts."""
    spark = documents.sparkSession
    doc_type, item_type = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, [{"part": n, "words": p, "hs": seeds_of(p)[1]} for n, p in enumerate(_passages(words_of(t))) if len(p) >= SEED_WORDS]) for key, t in zip(batch["key"], batch["text"])]
            yield pd.DataFrame(rows, columns=["key", "passages"])

    # rows are numbered once and written, so that a number stays with its row
    given = items.select(F.col(f"`{item_key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    given = cut(given.mapInPandas(split, f"key {item_type}, passages array<struct<part: int, words: array<string>, hs: array<bigint>>>").withColumn("item", F.monotonically_increasing_id()))
    parts = given.select("key", "item", F.explode("passages").alias("p")).select("key", "item", "p.part", "p.words", "p.hs")
    seeds = cut(rare_seeds(parts))
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))  # fixed size

    # a row is known by its key and the hash of its text: the same on every read, so texts need not be written
    docs = documents.select(F.col(f"`{doc_key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null").withColumn("th", F.xxhash64("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, th, t in zip(batch["key"], batch["th"], batch["text"]):
                places, hashes = seeds_of(words_of(t))
                hit = np.flatnonzero(_in_bitmap(bitmap.value, hashes))
                if len(np.unique(hashes[hit])) >= least_seeds:
                    rows.append((key, th, places[hit], hashes[hit]))
            yield pd.DataFrame(rows, columns=["key", "th", "places", "hs"])

    met = cut(docs.mapInPandas(scan, f"key {doc_type}, th bigint, places array<int>, hs array<bigint>"))
    hits = met.select("key", "th", F.explode(F.arrays_zip("places", "hs")).alias("x")).select("key", "th", F.col("x.hs").alias("h"), F.col("x.places").alias("place"))
    few_seeds = seeds.limit(500_001).count() <= 500_000
    found = hits.join(F.broadcast(seeds) if few_seeds else seeds, "h").select("key", "th", "item", "part", "place", "h")
    pair_type = f"key {doc_type}, th bigint, item bigint, part int, places array<int>, hs array<bigint>"

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The hits of each document and passage; a document's rows follow one another, over batches too."""
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = whole["th"].to_numpy() == whole["th"].iloc[-1]
            start = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            rest = whole.iloc[start:]
            yield grouped(whole.iloc[:start])
        if rest is not None:
            yield grouped(rest)

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            key, th, item, part, place, h = (rows[c].to_numpy() for c in ("key", "th", "item", "part", "place", "h"))
            # documents that follow one another keep apart by their change of hash or key
            doc = np.cumsum(np.concatenate(([True], (th[1:] != th[:-1]) | (pd.Series(key[1:]).astype(str).to_numpy() != pd.Series(key[:-1]).astype(str).to_numpy()))))
            order = np.lexsort((part, item, doc))
            edge = np.flatnonzero(np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1]) | (part[order][1:] != part[order][:-1]))))
            for a, b in zip(edge, [*edge[1:], len(order)]):
                if b - a >= least_seeds:
                    at = order[a:b]
                    if len(np.unique(h[at])) >= least_seeds:
                        out.append((key[at[0]], th[at[0]], item[at[0]], part[at[0]], place[at], h[at]))
        return pd.DataFrame(out, columns=["key", "th", "item", "part", "places", "hs"])

    if few_seeds:  # a broadcast join leaves a document's hits together: they are gathered where they are
        pairs = cut(found.mapInPandas(gather, pair_type))
    else:
        by = found.groupBy("key", "th", "item", "part").agg(F.collect_list(F.struct("place", "h")).alias("s"), F.countDistinct("h").alias("n")).filter(F.col("n") >= least_seeds)
        pairs = cut(by.select("key", "th", "item", "part", F.col("s.place").alias("places"), F.col("s.h").alias("hs")))

    # weights of words: rare ones, by items, weigh more
    total = max(1, parts.select("item").distinct().count())
    spoken = parts.select("item", F.explode("words").alias("word")).distinct()
    weights = spoken.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.greatest(F.lit(0.1), F.log((1 + F.lit(total)) / F.col("df")) / F.log(F.lit(1.0 + total))).alias("weight"))
    placed_words = parts.select("item", "part", F.posexplode("words").alias("at", "word")).join(weights, "word").groupBy("item", "part").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("weights"))
    targets = parts.select(F.col("key").alias("item_key"), "item", "part", F.array_join("words", " ").alias("target")).join(placed_words.select("item", "part", F.col("weights.weight").alias("weights")), ["item", "part"])

    def align_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item, t, places, hashes, target, weight in zip(batch["key"], batch["item_key"], batch["text"], batch["places"], batch["hs"], batch["target"], batch["weights"]):
                target = target.split(" ")
                held = leaked(words_of(t), list(zip(places.tolist(), hashes.tolist())), target, dict(zip(target, weight)), least_seeds, least_words, identity)
                if held:
                    rows.append((key, item, *held))
            yield pd.DataFrame(rows, columns=["key", "item_key", "matched_words", "identity"])

    # the texts are read once more for the pairs found; few pairs go to the documents, many meet them by shuffle
    few = small_side(pairs, 100_000)
    same_row = docs["key"].eqNullSafe(few["key"]) & (docs["th"] == few["th"])
    placed = docs.join(few, same_row).select(docs["key"], "text", "item", "part", "places", "hs")
    if parts.limit(10_001).count() <= 10_000:
        with_target = placed.join(F.broadcast(targets), ["item", "part"])
    else:  # an item that leaked into very many documents is a hot key
        with_target = salted_join(placed, targets, ["item", "part"], by="text", how="inner", hot=hot_keys(pairs, ["item", "part"]))
    judged = with_target.select("key", "item_key", "text", "places", "hs", "target", "weights").mapInPandas(align_all, f"key {doc_type}, item_key {item_type}, matched_words int, identity double")
    best = judged.groupBy("key", "item_key").agg(F.max(F.struct("matched_words", "identity")).alias("best"))
    return best.select(F.col("key").alias(doc_key), F.col("item_key").alias(item_key), "best.matched_words", "best.identity")
