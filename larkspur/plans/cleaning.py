"""The pN_ queries of the general cleaning problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.orphans import MATCHES, failed_references, hot_keys, orphan_keys
from larkspur.operators.packed import split_packed
from larkspur.operators.spikes import implausible_readings
from larkspur.operators.timestamps import normalise_times
from larkspur.operators.units import convert_units, load_in_megawatts
from larkspur.session import table


PACKED = {"clinical_trials": ("nct_id", ["conditions", "interventions"]), "pubmed_articles": ("pmid", ["authors"]), "congress_bills": ("bill_id", ["committees"])}


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.lit(f"{name}.{col}").alias("field"), F.col(key).alias("row_key"), F.col(col).alias("text"))
        for name, (key, cols) in PACKED.items()
        for col in cols
    ]
    return split_packed(reduce(DataFrame.unionByName, parts), "field", "row_key", "text", ampersand_fields=("pubmed_articles.authors",))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields with its position."""
    return _packed(spark, sf_dir).select("field", "row_key", "pos", "item")


def p2_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts and values of each field are in which dialect."""
    return _packed(spark, sf_dir).groupBy("field", "dialect").agg(F.count_if(F.col("pos") == 1).alias("n_texts"), F.count(F.lit(1)).alias("n_values"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four fields, united so that one mixture pass and one reading pass serve
    them all. Each field is declared month first but legal_cases, whose sources
    keep their own orders."""

    def one(name: str, key: str, col: str, source: str | None = None, zone: str | None = None) -> DataFrame:
        field = F.lit(f"{name}.{col}")
        origin = F.concat_ws(" ", field, F.col(source)) if source else field
        return table(spark, sf_dir, name).select(field.alias("field"), F.col(key).cast("string").alias("row_key"), F.col(col).alias("value"), origin.alias("origin"), F.lit(zone).cast("string").alias("zone"), F.lit(source is None).alias("month_first"))

    rows = (
        one("clinical_trials", "nct_id", "start_date")
        .unionByName(one("pubmed_articles", "pmid", "pub_date"))
        .unionByName(one("legal_cases", "case_id", "date_filed", source="source"))
        .unionByName(one("ercot_prices", "id", "timestamp", zone="America/Chicago"))
    )
    return normalise_times(rows, "value", source="origin", zone=F.col("zone"), month_first=F.col("month_first"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normal form per record whose date or time can be read.

    The ids of ercot_prices, by far the most rows, are unique; only the other tables store records twice."""
    read = _times(spark, sf_dir).filter(F.col("normal_form").isNotNull() & F.col("row_key").isNotNull()).select("field", "row_key", "normal_form")
    unique = F.col("field") == "ercot_prices.timestamp"
    return read.filter(unique).unionByName(read.filter(~unique).distinct())


def p4_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each field are in which layout, how many are ambiguous or unreadable."""
    return _times(spark, sf_dir).groupBy("field", F.coalesce("layout", F.lit("unreadable")).alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("ambiguous"), F.lit(False)).cast("int")).alias("n_ambiguous"))


#: What no power market prints, in dollars a megawatthour: far beyond any price cap or floor in force.
PRICE_BOUNDS = (-1_000.0, 10_000.0)


def _spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "ercot_prices").select("id", "zone", "price_type", "price", "timestamp")
    timed = normalise_times(prices, "timestamp", zone="America/Chicago", month_first=True)
    # only forms with a time of day, read as UTC whatever the session's zone is
    seconds = F.unix_seconds(F.try_to_timestamp(F.when(F.col("normal_form").endswith("Z"), F.col("normal_form"))))
    return implausible_readings(timed.withColumn("t", seconds), ["zone", "price_type"], "t", "price", "id", PRICE_BOUNDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of implausible readings of ercot_prices."""
    return _spikes(spark, sf_dir).filter("id is not null").select("id").distinct()


def _eia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "eia_series").select("id", "series_id", "name", "description", "units", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("series_group", F.regexp_extract("series_id", r"^([^.]+\.[^.]+)", 1))
    return convert_units(rows, "series_group", "units", "value", ["description", "name"])


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entsoe_load").select("id", "country_code", "load_mw", "forecast_mw", "timestamp")
    timed = normalise_times(rows, "timestamp", month_first=True)
    seconds = F.unix_seconds(F.try_to_timestamp(F.when(F.col("normal_form").endswith("Z"), F.col("normal_form"))))
    return load_in_megawatts(timed.withColumn("t", seconds), "country_code", "t", "load_mw", "forecast_mw")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that was not recorded in its common unit, converted."""
    eia = _eia(spark, sf_dir).select(F.lit("eia_series.value").alias("field"), "id", "factor", "common_value")
    load = _load(spark, sf_dir).select(F.lit("entsoe_load.load_mw").alias("field"), "id", "factor", "common_value")
    whole = F.floor(F.round(F.col("common_value"), 6) + 0.5).cast("bigint")
    return eia.unionByName(load).filter("id is not null and common_value is not null and abs(factor - 1.0) > 1e-9").select("field", "id", whole.alias("common_value")).distinct()


def p6_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each series group are in which unit, or in none that is known."""
    rows = _eia(spark, sf_dir).filter("value is not null")
    return rows.groupBy("series_group", F.coalesce("unit", F.lit("unknown")).alias("unit"), "factor").agg(F.count(F.lit(1)).alias("n"))


def _bill_key(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"[\s.]+", ""))


def _split_bill(df: DataFrame) -> DataFrame:
    """A bill id as a composite key (bill, congress), empty where a part is not written."""
    return df.withColumn("bill", F.regexp_extract("bill_id", r"^(.*?)(?:-(\d+))?$", 1)).withColumn("congress", F.regexp_extract("bill_id", r"^(.*?)(?:-(\d+))?$", 2))


def _failed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes whose bill fails, with the moment, period and kind of failure.

    A bill id is a composite key (bill, congress), null in both parts where the
    vote names no bill; such a reference is satisfied (match simple)."""
    votes = table(spark, sf_dir, "congress_votes").select("vote_id", F.nullif(_bill_key("bill_id"), F.lit("")).alias("bill_id"), "date", "created_at").filter("vote_id is not null")
    first = votes.groupBy("vote_id").agg(F.min("created_at").alias("seen"), F.min(F.struct(F.col("created_at").isNull(), "created_at", "bill_id", "date")).alias("first"))
    first = first.select("vote_id", "seen", "first.bill_id", F.substring("first.date", 1, 7).alias("period"))
    bills = table(spark, sf_dir, "congress_bills").select(_bill_key("bill_id").alias("bill_id"), "created_at").filter("bill_id is not null")
    removals = table(spark, sf_dir, "bill_removals").select(_bill_key("bill_id").alias("bill_id"), "removed_at").filter("bill_id is not null")
    on = ["bill", "congress"]
    hot = hot_keys(_split_bill(votes.filter("bill_id is not null")), on)
    return failed_references(_split_bill(first), _split_bill(bills), _split_bill(removals), on, seen="seen", stored="created_at", removed="removed_at", by="vote_id", hot=hot)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes with a bill that was deleted, is missing, or came later."""
    return _failed_votes(spark, sf_dir).select("vote_id", "bill_id", "period", "kind")


def p7_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report per table and period: how many references fail, and how."""
    return _failed_votes(spark, sf_dir).groupBy(F.lit("congress_votes.bill_id").alias("reference"), "period", "kind").agg(F.count(F.lit(1)).alias("n_votes"), F.countDistinct("bill_id").alias("n_bills"))


def p7_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references (bill, congress of the vote) by null mask under the three match semantics.

    A vote that names no bill still names its congress: a reference with a null part."""
    votes = table(spark, sf_dir, "congress_votes").select(F.nullif(F.regexp_replace(_bill_key("bill_id"), r"-\d+$", ""), F.lit("")).alias("bill"), F.col("congress").cast("string").alias("congress"))
    bills = _split_bill(table(spark, sf_dir, "congress_bills").select(_bill_key("bill_id").alias("bill_id"))).select("bill", F.nullif("congress", F.lit("")).alias("congress"))
    parts = [orphan_keys(votes, bills, ["bill", "congress"], m).groupBy(F.lit(m).alias("match"), "null_mask").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").cast("bigint").alias("n_refs")) for m in MATCHES]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "p2_found": p2_found,
    "p2_dialects": p2_dialects,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_layouts": p4_layouts,
    "p6_found": p6_found,
    "p6_units": p6_units,
    "p7_found": p7_found,
    "p7_by_period": p7_by_period,
    "p7_masks": p7_masks,
}

_FAILED = """
WITH v AS (SELECT vote_id, min(created_at) AS seen, min(lower(regexp_replace(bill_id, '[\\s.]+', '', 'g'))) AS bill_id, min(substr(date, 1, 7)) AS period
           FROM congress_votes WHERE vote_id IS NOT NULL AND bill_id IS NOT NULL GROUP BY vote_id),
     b AS (SELECT lower(regexp_replace(bill_id, '[\\s.]+', '', 'g')) AS bill_id, min(created_at) AS stored FROM congress_bills GROUP BY 1),
     r AS (SELECT lower(regexp_replace(bill_id, '[\\s.]+', '', 'g')) AS bill_id, min(removed_at) AS removed FROM bill_removals GROUP BY 1),
     f AS (SELECT vote_id, bill_id, period, CASE WHEN removed <= seen THEN 'deleted' WHEN stored IS NULL THEN 'missing' WHEN stored > seen THEN 'late' END AS kind
           FROM v LEFT JOIN b USING (bill_id) LEFT JOIN r USING (bill_id))
"""
SQL = {
    "p7_found": _FAILED + "SELECT vote_id, bill_id, period, kind FROM f WHERE kind IS NOT NULL",
    "p7_by_period": _FAILED + "SELECT 'congress_votes.bill_id' AS reference, period, kind, count(*) AS n_votes, count(DISTINCT bill_id) AS n_bills FROM f WHERE kind IS NOT NULL GROUP BY period, kind",
    "p7_masks": """
WITH v AS (SELECT nullif(regexp_replace(lower(regexp_replace(bill_id, '[\\s.]+', '', 'g')), '-[0-9]+$', ''), '') AS bill, CAST(congress AS VARCHAR) AS congress, count(*) AS n FROM congress_votes GROUP BY 1, 2),
     k AS (SELECT DISTINCT regexp_extract(b, '^(.*?)(-([0-9]+))?$', 1) AS bill, nullif(regexp_extract(b, '^(.*?)(-([0-9]+))?$', 3), '') AS congress FROM (SELECT lower(regexp_replace(bill_id, '[\\s.]+', '', 'g')) AS b FROM congress_bills)),
     c AS (SELECT v.*, CASE WHEN bill IS NULL THEN '1' ELSE '0' END || CASE WHEN congress IS NULL THEN '1' ELSE '0' END AS null_mask,
                  EXISTS (SELECT 1 FROM k WHERE k.bill = v.bill AND k.congress = v.congress) AS whole,
                  EXISTS (SELECT 1 FROM k WHERE (v.bill IS NULL OR k.bill = v.bill) AND (v.congress IS NULL OR k.congress = v.congress)) AS part FROM v),
     f AS (SELECT 'simple' AS match, * FROM c WHERE null_mask = '00' AND NOT whole
           UNION ALL SELECT 'partial', * FROM c WHERE null_mask <> '11' AND NOT part
           UNION ALL SELECT 'full', * FROM c WHERE null_mask IN ('01', '10') OR (null_mask = '00' AND NOT whole))
SELECT match, null_mask, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_refs FROM f GROUP BY match, null_mask""",
}
