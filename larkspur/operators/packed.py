"""Splitting fields that pack several values into one text.

The delimiters and quotes differ from text to text. Every text is parsed once,
under each dialect that could apply (a set of delimiters and a quoting style),
and the dialect of least description length is taken. All costs are learned
from the field itself:

* a dialect costs its code length under the shares of the dialects;
* a value costs its code length under the distribution of values over the
  distinct texts of the field (the text itself left out) or, if it is new, the
  code lengths of its letters under the field's letters. A delimiter or quote that a
  dialect leaves inside a value is such a letter, and a rare one;
* a parse that breaks the declared precedence - it leaves a delimiter or a pair
  of quotes unused that it could have used - has a prior of 2 ** -``DECLARED_BITS``,
  once, however many it leaves. The other costs can outweigh it.

Letters and dialects are first counted over the texts that have one parse only;
they choose a parse for every text; from these values, letters and dialects are
counted, and decide.

Scale: texts are made distinct before parsing and known by 128 bits of hash;
only hashes and parses are shuffled, and only values of texts with several
parses are looked up; the codes of hot values, of which there can be but few, are
broadcast, the others joined by shuffle; rows meet their text's parse by hash,
hot texts alone being salted.

Defined results: null, empty and blank texts have no values; empty slots do not
count; positions run from 1; rows repeated under one key with one text give one
set of values, and texts of one key that give the same values do too; texts of any length are parsed whole; an unclosed quote is an
ordinary character; the noncharacters U+FDD0 and U+FDD1 are no text and are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.orphans import salted_join
from larkspur.session import cut

#: delimiters that separate wherever they stand outside quotes, by name
STRONG = {"semicolon": r"[;；]", "pipe": r"\|+", "bullet": r"[•·]", "tab": r"\t", "line": r"\r\n|\r|\n", "break": r"<br\s*/?>", "slash": r"(?<=\s)/(?=\s)", "ideographic": "、"}
COMMA, AMPERSAND = r"[,，]", r"(?<=\s)&(?=\s)"
QUOTED = re.compile(r'\s*(?:\(?\d{1,3}[.)]\s+)?"((?:[^"\\]|""|\\.)*)"\s*')
NUMBER = re.compile(r"^\(?\d{1,3}(?:\)|\.(?=\s))\s*")
#: prior of a parse that leaves unused what it could have used
DECLARED_BITS = 14.0
HOT_BITS = 10.0
#: noncharacters: between the values of a stored parse (and for the end of a value among the letters), and between its parts
BETWEEN, PARTS = "\ufdd0", "\ufdd1"
_NO_TEXT = str.maketrans("", "", BETWEEN + PARTS)
#: dialects that one field may be written in, for the shares of those not seen
KINDS = 24


_ANY = re.compile("|".join(["\"", r"^\s*\[", *STRONG.values(), COMMA, AMPERSAND]))


def clean_item(item: str) -> str:
    """Trimmed and freed of list numbering."""
    item = " ".join(item.split()) if "\n" in item or "\t" in item else item.strip()
    return NUMBER.sub("", item).strip()


def split_text(text: str, pattern: re.Pattern | None, quotes: bool) -> list[str]:
    """The non-empty values of ``text`` between matches of ``pattern``."""
    items, at, n = [], 0, len(text)
    while at <= n:
        hit = QUOTED.match(text, at) if quotes else None
        end = hit.end() if hit else at
        if hit:  # a quoted value only if a delimiter or the end follows
            after = pattern.match(text, end) if pattern and end < n else None
            if pattern and not after and end < n and text[end - 1 : end].isspace():
                after = pattern.search(text, end - 1, end + 8)
                after = after if after and after.start() <= end else None
            if end >= n or after:
                items.append(re.sub(r"\\(.)", r"\1", hit[1].replace('""', '"')).strip())
                at = after.end() if after else n + 1
                continue
        after = pattern.search(text, at) if pattern else None
        items.append(clean_item(text[at : after.start()] if after else text[at:]))
        at = after.end() if after else n + 1
    return [x for x in items if x]


def outside_quotes(text: str) -> tuple[str, int]:
    """``text`` with its quoted values blanked, to look for delimiters in, and their number."""
    return re.subn(r'(^\s*|[;|,•\t\n/>&]\s*|\d[.)]\s+)"((?:[^"\\]|""|\\.)*)"', r"\1_", text)


def _bracketed(text: str) -> list[str] | None:
    t = text.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    try:
        values = json.loads(t)
    except ValueError:
        values = split_text(t[1:-1], re.compile(COMMA), True)
    if any(not isinstance(v, (str, int, float, type(None))) for v in values):
        return None
    return [x for x in (str(v).strip() for v in values if v is not None) if x]


def _dialects(text: str, ampersand: bool) -> list[tuple[str, bool, str | None, bool]]:
    """(name, whether it leaves anything unused, delimiters, quotes) of every dialect that could apply to a text."""
    bare, n_quoted = outside_quotes(text)
    n_strong = {k: n for k, p in STRONG.items() if (n := len(re.findall(p, bare)))}
    weak = [p for p in ([COMMA] + [AMPERSAND] * ampersand) if re.search(p, bare)]
    patterns: dict[str, tuple[str | None, bool]] = {}
    if n_strong:
        patterns["strong"] = ("|".join(STRONG[k] for k in n_strong), False)
        if len(n_strong) > 1:
            patterns |= {k: (STRONG[k], True) for k in n_strong}
    if weak:
        patterns["comma"] = ("|".join(weak), bool(n_strong))
    patterns["whole"] = (None, bool(n_strong or weak))
    kinds = ((True, "", False), (False, "_unquoted", n_quoted > 0)) if '"' in text else ((True, "", False),)
    return [(name + mark, left or ignored, pattern, quotes) for quotes, mark, ignored in kinds for name, (pattern, left) in patterns.items()]


def candidate_parses(text: str | None, ampersand: bool = False) -> list[tuple[str, bool, int, list[str]]]:
    """(dialect, whether it leaves anything unused, line breaks and tabs left, values) for every parse that differs."""
    if text is None or not text.strip():
        return []
    if not _ANY.search(text):
        item = clean_item(text)
        return [("whole", False, 0, [item] if item else [])]
    listed = _bracketed(text)
    if listed is not None:
        return [("bracketed", False, 0, listed)]
    out, seen = [], set()
    blanks = len(re.findall(r"\r\n|[\r\n\t]", text.strip()))
    for name, unused, pattern, quotes in _dialects(text, ampersand):
        items = split_text(text, re.compile(pattern) if pattern else None, quotes)
        if tuple(items) not in seen:
            seen.add(tuple(items))
            used = len(re.findall(r"\r\n|[\r\n\t]", "".join(m[0] for m in re.finditer(pattern, text.strip())))) if pattern and blanks else 0
            out.append((name, unused, blanks - used, items))
    return out


class LetterBits(dict):
    """Code lengths of values, letter by letter, under the letters' counts; no counts make all letters cost the same."""

    def __init__(self, counts: dict[str, int]):
        super().__init__()
        self.counts, total, kinds = counts, sum(counts.values()), len(counts) + 64
        self.unseen = math.log2(total + kinds)
        self.bits = defaultdict(lambda: self.unseen, {c: math.log2((total + kinds) / (n + 1)) for c, n in counts.items()})

    def __missing__(self, value: str) -> float:
        bits = self.bits[BETWEEN] + sum(map(self.bits.__getitem__, value))
        if len(value) < 100:  # values repeat; long ones are not remembered
            if len(self) > 200_000:
                self.clear()
            self[value] = bits
        return bits

    def __reduce__(self):
        return (LetterBits, (self.counts,))


class Model:
    """The letters and dialects of each field."""

    def __init__(self, letters: dict[str, dict[str, int]], dialects: dict[str, dict[str, int]]):
        self.letters, self.dialects = {f: LetterBits(c) for f, c in letters.items()}, dialects

    def costs(self, field: str, dialect: str, unused: bool, blanks: int, values: list[str]) -> tuple[float, list[float]]:
        """(bits of the parse without its values, bits of each value as new)."""
        seen = self.dialects.get(field, {})
        letters = self.letters.setdefault(field, LetterBits({}))
        own = math.log2((sum(seen.values()) + KINDS) / (seen.get(dialect, 0) + 1)) + DECLARED_BITS * unused + letters.unseen * blanks + len(values)
        return own, [letters[v] for v in values]


def _counted(parses: DataFrame) -> Model:
    """The model of (field, dialect, packed): a count for each letter and dialect of a field comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, part in batch.groupby("field"):
                codes = np.frombuffer((BETWEEN.join(part["packed"]) + BETWEEN).encode("utf-32-le", "surrogatepass"), np.uint32)
                rows += [(field, False, chr(c), int(n)) for c, n in zip(*np.unique(codes, return_counts=True)) if not 0xD800 <= c < 0xE000]
                rows += [(field, True, d, int(n)) for d, n in part["dialect"].value_counts().items()]
            yield pd.DataFrame(rows, columns=["field", "is_dialect", "name", "n"])

    rows = parses.mapInPandas(count, "field string, is_dialect boolean, name string, n bigint").groupBy("field", "is_dialect", "name").agg(F.sum("n").alias("n")).collect()
    letters: dict[str, dict[str, int]] = defaultdict(dict)
    dialects: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows:
        (dialects if r["is_dialect"] else letters)[r["field"]][r["name"]] = r["n"]
    return Model(letters, dict(dialects))


def pick_by_letters(model: Model, field: str, parses: list[tuple[str, bool, int, list[str]]]) -> int:
    """The place of the shortest parse if every value is new."""
    lengths = [own + sum(new) for own, new in (model.costs(field, *p) for p in parses)]
    return lengths.index(min(lengths))


def split_packed(df: DataFrame, field: str, key: str, text: str, ampersand_fields: tuple[str, ...] = ()) -> DataFrame:
    """(field, row_key, pos, item, dialect) for a table of packed texts.

    ``field`` is a column of few names; ``ampersand_fields`` are those in which
    an ampersand separates like a comma."""
    rows = df.select(F.col(field).alias("field"), F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text")).dropna().filter(F.trim("text") != "")

    def stored(dialect: str, unused: bool, blanks: int, values: list[str]) -> str:
        return PARTS.join((dialect, str(int(unused)), str(blanks), BETWEEN.join(values)))

    def restored(parse: str) -> tuple[str, bool, int, list[str]]:
        dialect, unused, blanks, values = parse.split(PARTS)
        return dialect, unused == "1", int(blanks), values.split(BETWEEN)

    # parses are plain strings, which cross to Python and back several times faster than structures
    @F.arrow_udf("array<string>")
    def parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for fields, texts in batches:
            yield pa.array([[stored(*p) for p in candidate_parses(t.translate(_NO_TEXT), f in ampersand_fields)] for f, t in zip(fields.to_pylist(), texts.to_pylist())], pa.list_(pa.string()))

    def dialect_of(parse: Column) -> Column:
        return F.substring_index(parse, PARTS, 1)

    def packed_of(parse: Column) -> Column:
        return F.substring_index(parse, PARTS, -1)

    spark = df.sparkSession
    ids = [F.xxhash64("field", "text").alias("id1"), F.xxhash64("text", F.lit(1), "field").alias("id2")]
    keyed = rows.select("field", "row_key", *ids)
    texts = cut(rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n")).select("field", *ids, "n", parsed("field", "text").alias("parses")))
    single, open_ = texts.filter(F.size("parses") == 1), texts.filter(F.size("parses") > 1)
    first = spark.sparkContext.broadcast(_counted(single.select("field", dialect_of(F.col("parses")[0]).alias("dialect"), packed_of(F.col("parses")[0]).alias("packed"))))

    @F.arrow_udf("int")
    def shortest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for fields, parses in batches:
            yield pa.array([pick_by_letters(first.value, f, [restored(p) for p in ps]) for f, ps in zip(fields.to_pylist(), parses.to_pylist())], pa.int32())

    chosen = open_.select("field", F.get("parses", shortest("field", "parses")).alias("p")).unionByName(single.select("field", F.col("parses")[0].alias("p")))
    chosen = cut(chosen.select("field", dialect_of(F.col("p")).alias("dialect"), packed_of(F.col("p")).alias("packed")).filter("packed != ''"))
    model = spark.sparkContext.broadcast(_counted(chosen))
    # in how many distinct texts a value stands, each in its parse so far
    counts = chosen.select("field", F.explode(F.array_distinct(F.split("packed", BETWEEN))).alias("item")).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))  # one row a field
    codes = cut(counts.filter("n > 1").join(F.broadcast(totals), "field").select("field", "item", F.log2(F.col("total") / (F.col("n") - 1)).alias("known")))
    # a value with less than HOT_BITS stands for more than 2 ** -HOT_BITS of all values: there are at most that many, and they are broadcast
    hot, cold = codes.filter(F.col("known") < HOT_BITS), codes.filter(F.col("known") >= HOT_BITS)

    @F.arrow_udf("array<struct<no: int, own: double, item: string, new: double>>")
    def priced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for fields, parses in batches:
            ends, nos, owns, items, bits = [0], [], [], [], []
            for f, ps in zip(fields.to_pylist(), parses.to_pylist()):
                for no, p in enumerate(ps):
                    dialect, unused, blanks, values = restored(p)
                    own, new = model.value.costs(f, dialect, unused, blanks, values)
                    nos += [no] * len(values)
                    owns += [own] + [0.0] * (len(values) - 1)
                    items += values
                    bits += new
                ends.append(len(items))
            columns = [pa.array(nos, pa.int32()), pa.array(owns, pa.float64()), pa.array(items, pa.string()), pa.array(bits, pa.float64())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["no", "own", "item", "new"]))

    placed = open_.select("field", "id1", "id2", F.explode(priced("field", "parses")).alias("x")).select("field", "id1", "id2", "x.*")
    seen = placed.join(F.broadcast(hot), ["field", "item"], "left")
    met = seen.filter("known IS NOT NULL").select("id1", "id2", "no", "own", F.least("known", "new").alias("bits"))
    rest = seen.filter("known IS NULL").drop("known").join(cold, ["field", "item"], "left").select("id1", "id2", "no", "own", F.least("known", "new").alias("bits"))
    lengths = met.unionByName(rest).groupBy("id1", "id2", "no").agg(F.sum(F.col("own") + F.col("bits")).alias("length"))
    cheapest = lengths.groupBy("id1", "id2").agg(F.min(F.struct("length", "no"))["no"].alias("no"))
    decided = texts.join(cheapest, ["id1", "id2"], "left").select("id1", "id2", "n", F.get("parses", F.coalesce("no", F.lit(0))).alias("p"))
    decided = cut(decided.select("id1", "id2", "n", dialect_of(F.col("p")).alias("dialect"), packed_of(F.col("p")).alias("packed")).filter("packed != ''"))

    # one row for each key and text; a text that holds over a 64th of all rows is salted
    most = texts.agg(F.sum("n")).first()[0] or 0  # one number
    hot_texts = decided.filter(F.col("n") > most / 64).select("id1", "id2")
    by_key = keyed.groupBy("field", "row_key").agg(F.collect_set(F.struct("id1", "id2")).alias("ids"))  # the texts stored under one key
    one = by_key.filter(F.size("ids") == 1).select("field", "row_key", F.col("ids")[0]["id1"].alias("id1"), F.col("ids")[0]["id2"].alias("id2"))
    several = by_key.filter(F.size("ids") > 1).select("field", "row_key", F.explode("ids").alias("i")).select("field", "row_key", "i.*")

    def values(of: DataFrame) -> DataFrame:
        found = salted_join(of, decided.drop("n"), ["id1", "id2"], by="row_key", how="inner", salts=8, hot=hot_texts)
        return found.select("field", "row_key", "dialect", F.posexplode(F.split("packed", BETWEEN)).alias("pos", "item")).select("field", "row_key", (F.col("pos") + 1).alias("pos"), "item", "dialect")

    same = values(several).groupBy("field", "row_key", "pos", "item").agg(F.min("dialect").alias("dialect"))
    return values(one).unionByName(same)
