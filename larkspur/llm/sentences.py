"""Sentence units with offsets, for many languages and scripts.

A pushdown automaton reads each text: its stack holds the open list levels (with
the number that comes next), and within a paragraph the open quotations and
brackets; its input are the marks at which a sentence may end. A mark ends a
unit only while no quotation or bracket is open; full stops are checked against a trie of
abbreviations read backwards, decimals, initials and dates. Blank lines, list
lines and headings end units whatever follows.

Every step looks as far as it must and no text is read twice at one place, so
the time is in proportion to the length, and no number of characters or marks
changes how a text is cut.

Defined results: null, empty and blank texts have no units; texts of any length
are read whole; a quotation or bracket that is never closed in its paragraph is
an ordinary character; units never overlap, are numbered from 1 and cover every
character that is not white space; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what may follow them.
#: never end a sentence (titles, connectives, ...)
INSIDE = """ee dr mr mrs ms mx prof gov sen rep st mt hon gen col lt capt sgt rev messrs sra dra srta mme mlle mlles mm
e.g i.e cf viz vs v ca approx esp resp bzw vgl sog zzgl inkl evtl ggf usf z.b d.h u.a o.ä i.d.r m.e p.ex c.-à-d p.ej т.е т.ч т.к т.н т.д
ул г-н г-жа проф акад гл им см ср д-р डॉ श्री सं मि.ग्रा कि.मी रु पृ mio mrd tsd str hr fr hrsg nat med avda av pza ud uds vda ehem""".split()
#: continue before a number (also a Roman one or a section mark)
BEFORE_NUMBER = """no nos vol vols pp p fig figs sec secs art arts abs nr az al pág págs pag ch chap eq par para ex tab app n núm num ст п гл рис табл стр ж т anm ziff kap bd s f ff §""".split()
#: may end a sentence: it does before a capital that can open one
MAY_END = """inc co corp ltd plc llc jr sr etc a.m p.m a.m u.s u.k u.n e.u d.c ph.d m.d b.a m.a et.al p.a b.c a.d s.a ee.uu usw руб коп тыс млн млрд г гг р др пр u.s.c gmbh cie
jan feb mar apr jun jul aug sep sept oct nov dec est dept ave blvd rd""".split()
#: those of MAY_END that end a sentence before a number too: it is no part of them
ENDS_BEFORE_NUMBER = frozenset("inc co corp ltd plc llc jr sr etc a.m p.m ph.d m.d b.a m.a s.a gmbh cie".split())
_MONTH = re.compile(r"\s*(?:jan|feb|mär|mar|apr|mai|may|jun|jul|aug|sep|okt|oct|nov|dez|dec|enero|janv|fév|avr|juil|août|déc|янв|фев|мар|апр|мая|июн|июл|авг|сен|окт|ноя|дек)", re.I)
_SPEECH = re.compile(r"\b(?:said|says|say|asked|asks|shouted|told|replied|wrote|answered|cried|called|added|warned|insisted|whispered|noted|explained|declared|sagte|fragte|rief|schrieb|meinte|antwortete|erklärte|dit|demandé|demanda|répondu|écrit|crié|dijo|preguntó|gritó|respondió|escribió|сказал|сказала|спросил|спросила|крикнул|ответил)\b")
_CJK_SPEECH = re.compile(r"[说說道问問]|表示|と|고|라고")
_CLAUSE_EDGE = re.compile(r"[，,、“「『\"«„]")

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "〈": "〉", "《": "》"}
CLOSE = frozenset("”»›」』)]）】〉》")
QUOTES = frozenset("\"“„«‹「『")
_MARKS = re.compile(r"[.!?…。！？｡．।॥؟\"“”„«»‹›「」『』()\[\]（）【】〈〉《》]")
_ENDERS = frozenset(".!?…。！？｡．।॥؟")
_WIDE_ENDERS = frozenset("。！？｡．।॥؟")
_LIST = re.compile(r"[ \t]*(?:[-*•‣▪–+]|(\d{1,3})[.)]|\(?([a-zA-Z])\))[ \t]+\S")
_THAI = re.compile(r"[฀-๿]")
_WIDE = re.compile(r"[\u2E80-\uFFFF]")
_SPACE = re.compile(r"\s+")
# What stands before an apostrophe in French and Italian without being part of the next word.
_ELIDED = frozenset("l d qu n s c j m t dell all nell sull un".split())


def _contraction(text: str, i: int, start: int) -> bool:
    """Does an apostrophe at ``i`` join two parts of one word, other than an elided article (l'art., d'ex.)?"""
    if i < start or text[i] not in "'’":
        return False
    k = i
    while k > start and text[k - 1].isalpha():
        k -= 1
    return text[k:i].lower() not in _ELIDED


class Trie:
    """Abbreviations, read backwards from their last full stop."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def before(self, text: str, stop: int, start: int) -> bool:
        """Does an abbreviation end at the full stop ``text[stop]``? White space after inner full stops is skipped."""
        node, i = self.root, stop - 1
        while True:
            if "" in node and (i < start or not text[i].isalnum()) and not _contraction(text, i, start) and not (i >= start and text[i] == "." and i > start and text[i - 1].isalnum()):
                return True
            if i < start:
                return False
            c = text[i].lower()
            if c.isspace() and "." in node:  # "z. B." is "z.b"
                i -= 1
                continue
            if c not in node:
                return False
            node, i = node[c], i - 1


_PARTED = frozenset(w for w in INSIDE + MAY_END if w.count(".") == 1)
_INSIDE, _BEFORE_NUMBER, _MAY_END, _BEFORE_COUNT = Trie(INSIDE), Trie(BEFORE_NUMBER), Trie(MAY_END), Trie(sorted(ENDS_BEFORE_NUMBER))


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Opening mark -> closing mark, for those that are closed in the paragraph."""
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in _MARKS.finditer(text, start, end):
        c, i = m[0], m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            before, after = text[i - 1 : i] if i > start else " ", text[i + 1 : i + 2]
            opens = (before.isspace() or before in "([（「“") and not (after.isspace() or not after)
            if at is not None and not (opens and stack[-1][0] in "(（"):
                out[stack[at][1]] = i
                del stack[at:]
            else:
                stack.append((c, i))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in OPEN.get(stack[k][0], "")), None)
        if at is not None:
            out[stack[at][1]] = i
            del stack[at:]
        elif c in OPEN:
            stack.append((c, i))
    return out


def _opens_sentence(text: str, i: int, end: int) -> bool:
    """Can a sentence begin at ``i`` (past white space)?"""
    while i < end and (text[i] in "\"“„«‹「『([（【'‘—–-¿¡*_" or text[i].isspace()):
        i += 1
    if i >= end:
        return True
    c = text[i]
    if c.islower():  # pH, eGFR
        return text[i + 1 : i + 2].isupper() and i + 1 < end
    return c.isalnum() or c in "$€£¥§#"


def _stop_ends(text: str, i: int, start: int, end: int) -> bool:
    """Does the full stop at ``i`` end a sentence, judging by what stands around it?"""
    before, after = text[i - 1 : i] if i > start else "", text[i + 1 : i + 2] if i + 1 < end else ""
    if after and not after.isspace() and after not in CLOSE and after not in '"“„«‹':
        if after in ".!?…":
            return False  # the last of several marks decides
        # no space: only between a word or number and a capitalised word
        more = text[i + 2 : i + 3]
        if not (after.isupper() and (more.islower() or more.isspace() or more in "'’" or re.match(r"\.\s+[^\W\d_]", text[i + 2 : i + 6]))):
            return ord(after) > 0x2E7F and not before.isdigit()
        if not (before.islower() or before.isdigit()) or (i - 2 >= start and text[i - 2] == "."):
            return False
        return not (_INSIDE.before(text, i, start) or _BEFORE_NUMBER.before(text, i, start))
    k = i + 1
    while k < end and (text[k] in CLOSE or text[k] == '"'):
        k += 1
    k = _SPACE.match(text, k, end).end() if _SPACE.match(text, k, end) else k
    following = text[k : k + 1] if k < end else ""
    if not following:
        return True
    if before == ".":
        return _opens_sentence(text, k, end)
    if not _opens_sentence(text, k, end):
        return False
    at = i
    while at > start and text[at - 1].isalnum():
        at -= 1
    w = text[at:i]
    if text[k + 1 : k + 2] == "." and f"{w}.{following}".lower() in _PARTED:
        return False  # the first half of "z. B."
    if _INSIDE.before(text, i, start):
        return False
    if _BEFORE_NUMBER.before(text, i, start):
        if following.isdigit() or following in "§([" or re.match(r"[IVXLC]+\b", text[k : k + 6]):
            return False
        if len(w) <= 2 and not following.isupper():
            return False
    if len(w) == 1 and w.isalpha() and (w.isupper() or text[i - 2 : i - 1] == "."):
        lone = i - 2 < start or not (text[i - 2].isalnum())
        if w.isupper() and (lone or re.search(r"(?:^|[\s(])[^\W\d_]\.\s[^\W\d_]$", text[max(start, i - 6) : i])) and not (text[i - 2 : i - 1] == "." and _MAY_END.before(text, i, start)):
            return False  # an initial
    if w.isdigit():
        if len(w) == 4 and re.match(r"\d{1,2}\.\s?\d{1,2}\.", text[k : k + 8]):
            return False
        if re.search(r"\b\d{4}\.\s?(?:\d{1,2}\.\s?)?\d{0,2}$", text[max(start, i - 14) : i]) and (following.isdigit() or re.search(r"\d{4}\.\s?\d{1,2}\.\s?\d{1,2}$", text[max(start, i - 14) : i])):
            return False  # 2011. 7. 7.
        if len(w) <= 2 and _MONTH.match(text, k):
            return re.search(r"(?:\bam|\bvom|\bzum|\bdem|\bbis|\bden|\bder|,)\s+\d{1,2}$", text[max(start, i - 12) : i], re.I) is None and not text[k].islower()
        if len(w) <= 2 and following.islower():
            return False
    if _MAY_END.before(text, i, start):
        if following.isdigit():
            return _BEFORE_COUNT.before(text, i, start)
        return _opens_sentence(text, k, end)
    if "ऀ" <= before <= "ॿ":
        return False  # Devanagari ends sentences with a danda
    return True


def _paragraph(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Units of one paragraph (without white space at its edges)."""
    pairs = _pairs(text, start, end)
    closers = {b: a for a, b in pairs.items()}
    stack: list[int] = []
    unit = start
    i = start
    marks = [m.start() for m in _MARKS.finditer(text, start, end)]
    thai = len(_THAI.findall(text, start, end)) * 2 > (end - start)
    if thai:  # white space on one line, outside quotations and brackets, ends a unit beside Thai
        spans, inside, covered = sorted(pairs.items()), 0, start  # outermost first
        gaps = []
        for m in re.compile(r"[ \t\u00A0\u3000]+").finditer(text, start, end):
            while inside < len(spans) and spans[inside][0] < m.start():
                covered = max(covered, spans[inside][1])
                inside += 1
            if m.start() >= covered:
                gaps.append(m.span())
        written = False  # does the unit hold Thai so far?
        for (at, after), piece, following in zip(gaps, [start, *(b for _, b in gaps)], [a for a, _ in gaps[1:]] + [end]):
            written = written or _THAI.search(text, piece, at) is not None
            if at > unit and (written or _THAI.search(text, after, following)):
                yield unit, at
                unit, written = after, False
        if unit < end:
            yield unit, end
        return
    end_of_clause = -1  # place in marks of the first end of a sentence from k on, once sought
    speech: list[int] | None = None
    n, k = len(marks), 0
    while k < n:
        i = marks[k]
        k += 1
        c = text[i]
        if i < unit:
            continue
        if i in pairs:
            stack.append(i)
            continue
        opener = closers.get(i)
        if opener is not None:
            while stack and stack[-1] >= opener:
                stack.pop()
            if stack:
                continue
            # a closed quotation or bracket: does it end the unit?
            inner = text[i - 1 : i]
            j = i - 1
            while j > opener and (text[j].isspace() or text[j] in CLOSE or text[j] == '"'):
                j -= 1
            inner = text[j]
            if inner not in _ENDERS:
                continue
            rest = _SPACE.match(text, i + 1, end)
            nxt = rest.end() if rest else i + 1
            if nxt >= end:
                continue
            follow = text[nxt]
            if follow in _ENDERS and nxt == i + 1:
                continue  # the mark after it decides
            if text[opener] not in QUOTES:
                # in brackets: a unit of its own only if the bracket opened it
                j = opener
                while j > unit and text[j - 1] in "\"“„«*_ \n":
                    j -= 1
                if j == unit:
                    if _opens_sentence(text, nxt, end):
                        yield unit, i + 1
                        unit = nxt
                continue
            opened = opener == unit
            if end_of_clause < k:  # the clause that may report the speech
                end_of_clause = k
                while end_of_clause < n and not (text[marks[end_of_clause]] in _ENDERS and (text[marks[end_of_clause]] != "." or _stop_ends(text, marks[end_of_clause], start, end))):
                    end_of_clause += 1
            clause_end = marks[end_of_clause] if end_of_clause < n else end
            if opened:
                if follow in ",;:，；：、—–-" or (follow.islower() and not _opens_sentence(text, nxt, end)):
                    continue
                if ord(follow) > 0x2E7F and inner in "。！？｡．…!?.":
                    edge = _CLAUSE_EDGE.search(text, nxt, clause_end)
                    if follow == "と" or (follow not in QUOTES and _CJK_SPEECH.search(text, nxt, edge.start() if edge else clause_end)):
                        continue
                elif inner in "!?…" and follow not in QUOTES:
                    if speech is None:
                        speech = [m.start() for m in _SPEECH.finditer(text, start, end)]
                    at = bisect_left(speech, nxt)
                    if at < len(speech) and speech[at] < clause_end:
                        continue
                if not _opens_sentence(text, nxt, end):
                    continue
            else:
                if follow in ",;:，；：、—–-)" or (follow.islower() and not _opens_sentence(text, nxt, end)):
                    continue
                if inner in ".…" and not _opens_sentence(text, nxt, end):
                    continue
            yield unit, i + 1
            unit = nxt
            continue
        if stack or c not in _ENDERS:
            continue
        # the last mark of a run decides
        j = i
        while j + 1 < end and text[j + 1] in _ENDERS:
            j += 1
        run = text[i : j + 1]
        while k < n and marks[k] <= j:
            k += 1
        stop = j + 1
        # closing marks without partner belong to the unit
        while stop < end and text[stop] in CLOSE and stop not in closers:
            stop += 1
        rest = _SPACE.match(text, stop, end)
        nxt = rest.end() if rest else stop
        if nxt >= end:
            break
        if run == ".":
            ends = _stop_ends(text, i, unit, end)
        elif run[-1] in _WIDE_ENDERS:
            ends = True
        elif set(run) <= set(".…"):
            ends = _opens_sentence(text, nxt, end) and (nxt > stop or ord(text[nxt]) > 0x2E7F or text[nxt].isupper() or (len(run) > 1 and ord(text[max(start, i - 1)]) > 0x2E7F))
        else:
            ends = _opens_sentence(text, nxt, end) and (nxt > stop or text[nxt].isupper() or ord(text[nxt]) > 0x2E7F or text[nxt] in QUOTES)
        if ends:
            yield unit, stop
            unit = nxt
    if unit < end:
        yield unit, end


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _line_groups(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of lines that are not blank."""
    group: list[tuple[int, int]] = []
    at = 0
    for line in re.split("(\r\n|\r|\n)", text):
        if line in ("\r\n", "\r", "\n"):
            pass
        elif line and not line.isspace():
            group.append((at, at + len(line)))
        elif group:
            yield group
            group = []
        at += len(line)
    if group:
        yield group


def _list_lines(text: str, lines: list[tuple[int, int]], levels: list[list[int]]) -> list[bool]:
    """Which lines of a run are list lines.

    ``levels`` is the stack of open numbered lists as [indent, number that comes
    next]; it lives on over blank lines. A line closes the levels deeper than its
    indent and goes on with the one at it; the number 1 opens a level."""
    marks = [_LIST.match(text, a, b) for a, b in lines]
    listed: list[bool] = []
    for k, (hit, (a, _)) in enumerate(zip(marks, lines)):
        ok = False
        if hit:
            introduced = k > 0 and text[lines[k - 1][0] : lines[k - 1][1]].rstrip().endswith((":", "："))
            follows = k == 0 or listed[-1] or introduced
            indent = len(hit[0]) - len(hit[0].lstrip(" \t"))
            if hit[1]:
                number = int(hit[1])
                open_ = [level for level in levels if level[0] <= indent]
                if open_ and open_[-1] == [indent, number]:
                    ok = True
                    levels[:] = open_
                    levels[-1][1] += 1
                elif number == 1 and (follows or (k + 1 < len(lines) and marks[k + 1] is not None and marks[k + 1][1] == "2")):
                    ok = True
                    levels[:] = [level for level in open_ if level[0] < indent] + [[indent, 2]]
            elif hit[2]:
                ok = (k == 0 or listed[-1]) and len(lines) > 1
            else:
                ok = follows or (k + 1 < len(lines) and bool(marks[k + 1]))
                if ok:
                    levels[:] = [level for level in levels if level[0] <= indent]
        listed.append(ok)
    if not any(listed):
        levels.clear()  # a paragraph of running text ends all lists
    return listed


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of paragraphs, list lines and headings."""
    levels: list[list[int]] = []
    for lines in _line_groups(text):
        width = max(b - a for a, b in lines)
        listed = _list_lines(text, lines, levels)
        start = None
        for k, (a, b) in enumerate(lines):
            if listed[k]:
                if start is not None:
                    yield "text", start[0], start[1]
                start = None
                yield "line", a, b
                continue
            if start is None:
                line = text[a:b].strip()
                alone = line and line[-1] not in ".!?…。！？।:,;)”\"»" and k + 1 < len(lines) and not listed[k + 1]
                if alone and k == 0 and len(line) >= 8 and len(line.split()) > 1 - bool(_WIDE.search(line)):
                    first = text[lines[1][0] : lines[1][1]].split(None, 1)[0]
                    if len(line) + 1 + len(first) < width - 10 and text[lines[1][0]].isupper():
                        yield "line", a, b
                        continue
                start = (a, b)
            else:
                start = (start[0], b)
        if start is not None:
            a, b = _trim(text, *start)
            line = text[a:b]
            heading = len(lines) == 1 and not any(c in _ENDERS for c in line) and (re.search(r"[:：]\s*[^\W\d_]+ \d+$", line) or " " not in line)
            yield ("line" if heading else "text"), start[0], start[1]


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit, in code points."""
    if not text or not text.strip():
        return []
    out = []
    for kind, a, b in _blocks(text):
        a, b = _trim(text, a, b)
        if a >= b:
            continue
        for u, v in [(a, b)] if kind == "line" else _paragraph(text, a, b):
            u, v = _trim(text, u, v)
            if u < v:
                out.append((u, v))
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_no, start_char, end_char) for every unit of every text."""

    @F.pandas_udf("array<struct<start_char: int, end_char: int>>")
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"start_char": a, "end_char": b} for a, b in sentence_units(t)])

    rows = df.select(F.col(key).alias(key), F.posexplode(units(F.col(text).cast("string"))).alias("pos", "u"))
    return rows.select(key, (F.col("pos") + 1).cast("int").alias("sent_no"), "u.start_char", "u.end_char")
