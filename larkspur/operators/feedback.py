"""Iterative query expansion by relevance feedback.

Term scores of a round are one aggregation, added to the totals of all terms so
far; only the terms of the query and the best unused ones come to the driver,
where the next query is made up by small rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.vectors import feedback_terms, keyword_relevance
from larkspur.session import cut


@dataclass
class Expander:
    """State of an expansion: scored terms, terms used, the query and the precisions so far.

    ``totals`` (term, total) has the score of every term after a round of :func:`learn`, ``scores`` those that matter to the next query."""

    seeds: list[str]
    scores: dict[str, float] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)
    query: list[str] = field(default_factory=list)
    precisions: list[float] = field(default_factory=list)
    totals: DataFrame | None = None

    def __post_init__(self) -> None:
        self.scores |= {t: 1 - 0.05 * i for i, t in enumerate(self.seeds)}
        self.query = self.query or self.seeds[:3]

    def best(self, n: int, unused: bool = True) -> list[str]:
        """The best terms with a positive score, those not used so far alone if ``unused``."""
        rows = sorted((-s, t) for t, s in self.scores.items() if s > 0 and not (unused and t in self.used))
        return [t for _, t in rows[:n]]

    def adjust(self, precision: float) -> None:
        """Reweights the query's terms; then the next query: the best terms of all, one more on low
        and one less on high precision, the last place for the best unused one; without one
        of the first two seeds, the first seed takes the first place."""
        self.precisions.append(precision)
        for t in self.query:
            self.scores[t] = self.scores.get(t, 0.0) * precision
            self.used.add(t)
        size = len(self.query)
        size = (size + 1 if size < 5 else size) if precision < 0.5 else size - 1 if precision > 0.8 and size > 2 else size
        query = self.best(size - 1, unused=False)
        query += [t for t in self.best(1) if t not in query]
        if query and self.seeds and not set(query) & set(self.seeds[:2]):
            query[0] = self.seeds[0]
        self.query = query[:size]

    def goes_on(self) -> bool:
        last = self.precisions[-3:]
        return len(self.precisions) < 10 and not (len(last) == 3 and sum(last) / 3 < 0.2)

    def search_strings(self) -> list[str]:
        q = self.query
        return [" ".join(q), f"{q[0]} RSS feed", f"{q[0]} blog", " ".join(q[:2]) + " news"] if q else []


def learn(expander: Expander, pages: DataFrame, key: str, text: str, relevant: Column) -> float:
    """One round: precision of the pages, and their feedback added to the total of every term."""
    stats = pages.agg(F.avg(relevant.cast("double"))).first()
    precision = float(stats[0] or 0.0)
    before = expander.totals
    if before is None:
        before = pages.sparkSession.createDataFrame(list(expander.scores.items()), "term string, total double")
    both = before.join(feedback_terms(pages, key, text, relevant), "term", "full")
    totals = cut(both.select("term", (F.coalesce("total", F.lit(0.0)) + F.coalesce("score", F.lit(0.0))).alias("total")))
    asked = list(expander.query)
    held = sorted({*asked, *expander.used, *expander.seeds})
    unused = totals.filter((F.col("total") > 0) & ~F.col("term").isin(sorted({*asked, *expander.used})))
    # the longest query has five terms, so no more than that of the best and of the best unused ones can matter to it, the asked ones aside
    top = lambda df: df.orderBy(F.desc("total"), "term").limit(5 + len(asked))
    best = top(unused).unionByName(top(totals.filter("total > 0"))).distinct()
    expander.scores = {r["term"]: r["total"] for r in totals.filter(F.col("term").isin(held)).unionByName(best).distinct().collect()}
    expander.adjust(precision)
    expander.totals = totals.withColumn("total", F.when(F.col("term").isin(asked), F.col("total") * precision).otherwise(F.col("total")))
    return precision


def find_seeds(search: Callable[[list[str]], DataFrame], seeds: list[str], key: str, text: str, rounds: int = 3, least: float = 0.3) -> DataFrame:
    """Searches, scores, learns and searches again; the distinct hits of all rounds with their best score."""
    expander, found = Expander(seeds), None
    for _ in range(rounds):
        hits = search(expander.query).withColumn("score", F.round(keyword_relevance(F.col(text), seeds), 6))
        kept = hits.filter(F.col("score") >= least).select(key, "score")
        found = kept if found is None else found.unionByName(kept)
        learn(expander, hits, key, text, F.col("score") >= least)
        if not expander.goes_on():
            break
    return found.groupBy(key).agg(F.max("score").alias("score"))
