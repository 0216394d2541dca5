"""Payloads of public web APIs -> rows, declared as data.

A source is a schema, the path of its records, one SQL expression for each
column and the key of its table. :func:`parse` turns a column of raw payloads
into rows with built-in expressions only (``from_json``, ``from_xml``, arrays),
so reading is one narrow pass with nothing collected; a malformed payload gives no rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    schema: str
    records: str  # SQL for the array of records, of the parsed payload p
    columns: dict[str, str]  # SQL of the record r, its position i and the payload p
    key: tuple[str, ...]
    kind: str = "json"
    where: str = "true"
    note: str = ""
    extra: dict[str, str] = field(default_factory=dict)


def _joined(array: str, item: str = "x", sep: str = "; ") -> str:
    return f"array_join(filter(transform({array}, x -> {item}), x -> coalesce(x, '') != ''), '{sep}')"


def _or(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ")"


_PS = "r.protocolSection"
_NUTRIENTS = {"calories": 1008, "protein_g": 1003, "fat_g": 1004, "carbs_g": 1005, "fiber_g": 1079, "sugar_g": 2000, "sodium_mg": 1093}
_ENTSOE = "TimeSeries array<struct<`MktPSRType`: struct<psrType: string>, `in_Domain.mRID`: string, Period: struct<timeInterval: struct<start: string>, Point: array<struct<position: int, quantity: double>>>>>"
_POINTS = "flatten(transform(p.TimeSeries, t -> transform(t.Period.Point, q -> named_struct('psr', t.MktPSRType.psrType, 'start', t.Period.timeInterval.start, 'position', q.position, 'quantity', q.quantity))))"
_AT = "try_to_timestamp(r.start, \"yyyy-MM-dd'T'HH:mmX\") + make_dt_interval(0, 0, 15 * (r.position - 1), 0)"
# Production types of the European grid.
PSR = {
    "B01": "Biomass", "B02": "Fossil Brown Coal/Lignite", "B03": "Fossil Coal-derived Gas", "B04": "Fossil Gas", "B05": "Fossil Hard Coal", "B06": "Fossil Oil", "B07": "Fossil Oil Shale", "B08": "Fossil Peat", "B09": "Geothermal",
    "B10": "Hydro Pumped Storage", "B11": "Hydro Run-of-river and poundage", "B12": "Hydro Water Reservoir", "B13": "Marine", "B14": "Nuclear", "B15": "Other renewable", "B16": "Solar", "B17": "Waste", "B18": "Wind Offshore", "B19": "Wind Onshore", "B20": "Other",
}
_PSR = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in PSR.items()) + ")"
# Settlement zones, the first that a point starts with.
ZONES = ("LZ_HOUSTON", "LZ_NORTH", "LZ_SOUTH", "LZ_WEST", "LZ_AEN", "LZ_CPS", "LZ_LCRA", "LZ_RAYBN", "HB_HOUSTON", "HB_NORTH", "HB_SOUTH", "HB_WEST", "HB_HUBAVG", "HB_BUSAVG")


def zone_sql(point: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN startswith({point}, '{z}') THEN '{z}' END" for z in ZONES) + f", {point})"


_MEAL = "struct<idMeal: string, strMeal: string, strCategory: string, strArea: string, strInstructions: string, strMealThumb: string, strTags: string, strYoutube: string, strSource: string, " + ", ".join(f"strIngredient{i}: string, strMeasure{i}: string" for i in range(1, 16)) + ">"
_PAIRS = "array(" + ", ".join(f"CASE WHEN trim(coalesce(r.strIngredient{i}, '')) != '' THEN trim(concat_ws(' ', nullif(trim(coalesce(r.strMeasure{i}, '')), ''), trim(r.strIngredient{i}))) END" for i in range(1, 16)) + ")"
_BILL = "struct<congress: int, type: string, number: string, title: string, originChamber: string, introducedDate: string, latestAction: struct<actionDate: string, text: string>, url: string, policyArea: struct<name: string>, sponsors: array<struct<fullName: string, party: string, state: string>>, cosponsors: struct<count: int>>"
_BILL_COLUMNS = {
    "bill_id": "concat('us_', r.congress, '_', lower(r.type), '_', r.number)", "bill_number": "concat(r.type, r.number)", "title": "r.title", "congress": "cast(r.congress as string)", "chamber": "r.originChamber",
    "sponsor": "get(r.sponsors, 0).fullName", "sponsor_party": "get(r.sponsors, 0).party", "sponsor_state": "get(r.sponsors, 0).state", "policy_area": "r.policyArea.name",
    "latest_action": "r.latestAction.text", "latest_action_date": "r.latestAction.actionDate", "introduced_date": "r.introducedDate", "cosponsors_count": "coalesce(r.cosponsors.count, 0)", "jurisdiction": "'US'", "source": "'congress'", "url": "r.url",
}
_DART = {"rcept_no": "r.rcept_no", "corp_code": "r.corp_code", "corp_name": "r.corp_name", "corp_cls": "r.corp_cls", "report_nm": "r.report_nm", "flr_nm": "r.flr_nm", "rcept_dt": "r.rcept_dt", "rm": "r.rm", "url": "concat('https://dart.fss.or.kr/dsaf001/main.do?rcpNo=', r.rcept_no)"}
_MEMBER = {"mona_cd": "r.MONA_CD", "name": "r.HG_NM", "name_en": "r.ENG_NM", "party": "r.POLY_NM", "district": "r.ORIG_NM", "committees": "r.CMITS", "email": "r.E_MAIL"}

SOURCES: dict[str, Source] = {
    "clinical_trials": Source(
        "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string, organization: struct<fullName: string>>, statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, completionDateStruct: struct<date: string>>, designModule: struct<phases: array<string>>, conditionsModule: struct<conditions: array<string>>, armsInterventionsModule: struct<interventions: array<struct<name: string, type: string>>>, descriptionModule: struct<briefSummary: string>>>>",
        "p.studies",
        {
            "nct_id": f"{_PS}.identificationModule.nctId", "title": f"{_PS}.identificationModule.briefTitle", "sponsor": f"{_PS}.identificationModule.organization.fullName",
            "phase": f"array_join({_PS}.designModule.phases, ', ')", "status": f"{_PS}.statusModule.overallStatus", "conditions": f"array_join({_PS}.conditionsModule.conditions, '; ')",
            "interventions": _joined(f"{_PS}.armsInterventionsModule.interventions", "concat(x.type, ': ', x.name)"), "brief_summary": f"{_PS}.descriptionModule.briefSummary",
            "start_date": f"{_PS}.statusModule.startDateStruct.date", "completion_date": f"{_PS}.statusModule.completionDateStruct.date",
        },
        ("nct_id",),
    ),
    "pubmed": Source(
        "PubmedArticle array<struct<MedlineCitation: struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, Journal: struct<Title: string, ISOAbbreviation: string>, ELocationID: array<struct<_EIdType: string, _VALUE: string>>>, DateCompleted: struct<Year: string>>>>",
        "p.PubmedArticle",
        {
            "pmid": "r.MedlineCitation.PMID", "title": "r.MedlineCitation.Article.ArticleTitle", "abstract": "array_join(r.MedlineCitation.Article.Abstract.AbstractText, ' ')",
            "authors": _joined("r.MedlineCitation.Article.AuthorList.Author", "trim(concat_ws(' ', x.LastName, x.ForeName))"), "journal": "r.MedlineCitation.Article.Journal.Title",
            "journal_abbrev": "r.MedlineCitation.Article.Journal.ISOAbbreviation", "pub_year": "try_cast(r.MedlineCitation.DateCompleted.Year as int)",
            "doi": "get(filter(r.MedlineCitation.Article.ELocationID, x -> x._EIdType = 'doi'), 0)._VALUE",
        },
        ("pmid",), kind="xml",
    ),
    "pubmed_ids": Source("IdList struct<Id: array<string>>", "p.IdList.Id", {"pmid": "r"}, ("pmid",), kind="xml"),
    "fda_approvals": Source(
        "results array<struct<application_number: string, sponsor_name: string, products: array<struct<brand_name: string, active_ingredients: array<struct<name: string>>>>, submissions: array<struct<submission_type: string, submission_status: string, submission_status_date: string>>>>",
        "p.results",
        {
            "application_number": "r.application_number", "brand_name": "get(r.products, 0).brand_name", "generic_name": "get(get(r.products, 0).active_ingredients, 0).name", "sponsor_name": "r.sponsor_name",
            "approval_date": "get(filter(r.submissions, s -> s.submission_status = 'AP'), 0).submission_status_date", "submission_type": "get(filter(r.submissions, s -> s.submission_status = 'AP'), 0).submission_type",
        },
        ("application_number",),
    ),
    "fda_adverse_events": Source(
        "results array<struct<safetyreportid: string, serious: string, receivedate: string, patient: struct<drug: array<struct<medicinalproduct: string>>, reaction: array<struct<reactionmeddrapt: string>>>>>",
        "p.results",
        {"report_id": "r.safetyreportid", "drug_names": _joined("r.patient.drug", "x.medicinalproduct"), "reactions": _joined("r.patient.reaction", "x.reactionmeddrapt"), "serious": "coalesce(try_cast(r.serious as int), 0)", "receive_date": "r.receivedate"},
        ("report_id",),
    ),
    "sec_filings": Source(
        "hits struct<hits: array<struct<_id: string, _source: struct<display_names: array<string>, tickers: string, form: string, file_date: string, file_description: string>>>>",
        "p.hits.hits",
        {"accession_number": "split_part(r._id, ':', 1)", "company_name": "get(r._source.display_names, 0)", "ticker": "r._source.tickers", "form_type": "r._source.form", "filed_date": "r._source.file_date", "description": "r._source.file_description", "url": "concat('https://www.sec.gov/Archives/edgar/data/', r._id)"},
        ("accession_number",),
    ),
    "arxiv": Source(
        "entry array<struct<id: string, title: string, summary: string, published: string, updated: string, author: array<struct<name: string>>, category: array<struct<_term: string>>, link: array<struct<_href: string, _title: string, _type: string>>>>",
        "p.entry",
        {
            "paper_id": r"regexp_extract(r.id, '/abs/(.+?)(?:v[0-9]+)?$', 1)", "source": "'arxiv'", "title": r"trim(regexp_replace(r.title, '\\s+', ' '))", "abstract": r"trim(regexp_replace(r.summary, '\\s+', ' '))",
            "authors": _joined("r.author", "x.name"), "categories": _joined("r.category", "x._term", ", "), "published": "r.published", "updated": "r.updated",
            "pdf_link": "coalesce(get(filter(r.link, x -> x._title = 'pdf' OR x._type = 'application/pdf'), 0)._href, replace(r.id, '/abs/', '/pdf/'))", "url": "r.id",
        },
        ("paper_id",), kind="xml",
    ),
    "semantic_scholar": Source(
        "data array<struct<paperId: string, title: string, abstract: string, year: int, venue: string, citationCount: int, influentialCitationCount: int, url: string, authors: array<struct<name: string>>, externalIds: struct<ArXiv: string>>>",
        "p.data",
        {"paper_id": "r.paperId", "source": "'semantic_scholar'", "title": "r.title", "abstract": f"{_or('r.abstract')[:-1]}, 'No abstract available')", "authors": _joined("r.authors", "x.name"), "published": "cast(r.year as string)", "citation_count": "coalesce(r.citationCount, 0)", "influential_citations": "coalesce(r.influentialCitationCount, 0)", "venue": "r.venue", "arxiv_id": "r.externalIds.ArXiv", "url": "r.url"},
        ("paper_id",),
    ),
    "huggingface_models": Source(
        "models array<struct<modelId: string, id: string, author: string, downloads: bigint, likes: bigint, tags: array<string>, pipeline_tag: string, library_name: string, lastModified: string, private: boolean>>",
        "p.models",
        {"model_id": _or("r.modelId", "r.id"), "source": "'huggingface'", "author": "r.author", "downloads": "coalesce(r.downloads, 0)", "likes": "coalesce(r.likes, 0)", "tags": "array_join(r.tags, ', ')", "pipeline_tag": "r.pipeline_tag", "library_name": "r.library_name", "last_updated": "r.lastModified"},
        ("model_id",), where="NOT coalesce(r.private, false)", note="a payload that is a bare array is wrapped as {\"models\": ...}",
    ),
    "papers_with_code": Source(
        "results array<struct<id: string, arxiv_id: string, title: string, abstract: string, published: string, proceeding: string, url_pdf: string, url_abs: string>>",
        "p.results",
        {"paper_id": f"{_or('r.id')[:-1]}, concat('pwc:', r.arxiv_id))", "source": "'papers_with_code'", "title": "r.title", "abstract": f"{_or('r.abstract')[:-1]}, 'No abstract available')", "authors": "''", "published": "r.published", "proceeding": "r.proceeding", "arxiv_id": "r.arxiv_id", "pdf_link": "r.url_pdf", "url": "r.url_abs"},
        ("paper_id",),
    ),
    "court_cases": Source(
        "results array<struct<id: bigint, absolute_url: string, caseName: string, caseNameFull: string, court: string, court_id: string, date_filed: string, citation: array<struct<volume: int, reporter: string, page: string>>, snippet: string, status: string>>",
        "p.results",
        {"case_id": "concat('cl_', r.id)", "case_name": "r.caseName", "case_name_full": "r.caseNameFull", "court": "r.court", "court_id": "r.court_id", "date_filed": "r.date_filed", "citation": _joined("r.citation", "concat_ws(' ', x.volume, x.reporter, x.page)"), "snippet": "r.snippet", "status": "r.status", "source": "'courtlistener'", "url": "concat('https://www.courtlistener.com', r.absolute_url)"},
        ("case_id",),
    ),
    "congress_bill_list": Source(f"bills array<{_BILL}>", "p.bills", _BILL_COLUMNS, ("bill_id",)),
    "congress_bill": Source(f"bill {_BILL}", "array(p.bill)", _BILL_COLUMNS, ("bill_id",)),
    "federal_register": Source(
        "results array<struct<document_number: string, title: string, abstract: string, type: string, agencies: array<struct<raw_name: string, name: string>>, publication_date: string, effective_on: string, html_url: string, pdf_url: string, citation: string, topics: array<string>, cfr_references: array<struct<title: int, part: int>>>>",
        "p.results",
        {"document_number": "r.document_number", "title": "r.title", "abstract": "r.abstract", "document_type": "r.type", "agencies": _joined("r.agencies", _or("x.name", "x.raw_name")), "publication_date": "r.publication_date", "effective_date": "r.effective_on", "citation": "r.citation", "topics": "array_join(r.topics, '; ')", "cfr_references": _joined("r.cfr_references", "format_string('%d CFR %d', x.title, x.part)"), "url": "r.html_url", "pdf_url": "r.pdf_url"},
        ("document_number",),
    ),
    "state_bills": Source(
        "data struct<bills: struct<edges: array<struct<node: struct<id: string, identifier: string, title: string, subject: array<string>, latestAction: struct<description: string, date: string>, fromOrganization: struct<name: string>, legislativeSession: struct<identifier: string, jurisdiction: struct<name: string>>, sponsorships: array<struct<name: string, primary: boolean>>, openstatesUrl: string>>>>>",
        "transform(p.data.bills.edges, x -> x.node)",
        {"bill_id": "r.id", "bill_number": "r.identifier", "title": "r.title", "congress": "r.legislativeSession.identifier", "chamber": "r.fromOrganization.name", "sponsor": "coalesce(get(filter(r.sponsorships, x -> x.primary), 0).name, get(r.sponsorships, 0).name)", "policy_area": "array_join(r.subject, '; ')", "latest_action": "r.latestAction.description", "latest_action_date": "r.latestAction.date", "jurisdiction": "r.legislativeSession.jurisdiction.name", "source": "'openstates'", "url": "r.openstatesUrl"},
        ("bill_id",),
    ),
    "fred_observations": Source(
        "seriess array<struct<id: string, title: string, units: string, frequency: string, seasonal_adjustment: string>>, observations array<struct<date: string, value: string>>",
        "p.observations",
        {"series_id": "get(p.seriess, 0).id", "title": "get(p.seriess, 0).title", "observation_date": "r.date", "value": "try_cast(r.value as double)", "units": "get(p.seriess, 0).units", "frequency": "get(p.seriess, 0).frequency", "seasonal_adjustment": "get(p.seriess, 0).seasonal_adjustment"},
        ("series_id", "observation_date"), where="try_cast(r.value as double) IS NOT NULL",
    ),
    "stock_quotes": Source(
        "quoteResponse struct<result: array<struct<symbol: string, shortName: string, longName: string, regularMarketPrice: double, regularMarketChange: double, regularMarketChangePercent: double, regularMarketVolume: bigint, marketCap: bigint, fiftyTwoWeekHigh: double, fiftyTwoWeekLow: double, trailingPE: double, dividendYield: double, currency: string, exchange: string>>>",
        "p.quoteResponse.result",
        {"symbol": "r.symbol", "name": _or("r.longName", "r.shortName"), "price": "r.regularMarketPrice", "change": "r.regularMarketChange", "change_percent": "r.regularMarketChangePercent", "volume": "r.regularMarketVolume", "market_cap": "r.marketCap", "fifty_two_week_high": "r.fiftyTwoWeekHigh", "fifty_two_week_low": "r.fiftyTwoWeekLow", "pe_ratio": "r.trailingPE", "dividend_yield": "r.dividendYield", "currency": "r.currency", "exchange": "r.exchange"},
        ("symbol",),
    ),
    "stock_daily_prices": Source(
        "`Meta Data` struct<`2. Symbol`: string>, `Time Series (Daily)` map<string, struct<`1. open`: string, `2. high`: string, `3. low`: string, `4. close`: string, `5. volume`: string>>",
        "map_entries(p.`Time Series (Daily)`)",
        {"symbol": "p.`Meta Data`.`2. Symbol`", "date": "r.key", **{c: f"try_cast(r.value.`{i}. {c}` as double)" for i, c in enumerate(("open", "high", "low", "close"), 1)}, "volume": "try_cast(r.value.`5. volume` as bigint)"},
        ("symbol", "date"),
    ),
    "stock_latest": Source(
        "`Global Quote` struct<`01. symbol`: string, `05. price`: string, `06. volume`: string, `09. change`: string, `10. change percent`: string>",
        "array(p.`Global Quote`)",
        {"symbol": "r.`01. symbol`", "price": "coalesce(try_cast(r.`05. price` as double), 0)", "change": "coalesce(try_cast(r.`09. change` as double), 0)", "change_percent": "coalesce(try_cast(replace(r.`10. change percent`, '%', '') as double), 0)", "volume": "coalesce(try_cast(r.`06. volume` as bigint), 0)"},
        ("symbol",), where="coalesce(r.`01. symbol`, '') != ''",
    ),
    "korean_disclosures": Source("list array<struct<corp_code: string, corp_name: string, corp_cls: string, report_nm: string, rcept_no: string, flr_nm: string, rcept_dt: string, rm: string>>", "p.list", _DART, ("rcept_no",)),
    "eia_series": Source(
        "response struct<data: array<struct<period: string, value: double, `series-id`: string, `product-name`: string, `area-name`: string, units: string>>, description: string, frequency: string>",
        "p.response.data",
        {"series_id": "r.`series-id`", "name": "concat_ws(' - ', nullif(r.`product-name`, ''), nullif(r.`area-name`, ''))", "description": "p.response.description", "units": "r.units", "frequency": "p.response.frequency", "source": "'EIA'", "period": "r.period", "value": "r.value"},
        ("series_id", "period"),
    ),
    "ercot_prices": Source(
        "data array<struct<deliveryDate: string, hourEnding: string, settlementPoint: string, spp: double>>",
        "p.data",
        {"zone": zone_sql("r.settlementPoint"), "settlement_point": "r.settlementPoint", "price_type": "'SPP'", "price": "r.spp", "timestamp": "concat(r.deliveryDate, ' ', r.hourEnding)"},
        ("zone", "price_type", "timestamp"),
    ),
    "kpx_prices": Source("result struct<list: array<struct<trdDt: string, trdHr: int, smp: double, maxSmp: double, minSmp: double>>>", "p.result.list", {"market_type": "'SMP'", "price_type": "'land'", "trade_date": "r.trdDt", "trade_hour": "r.trdHr", "price": "r.smp", "max_price": "r.maxSmp", "min_price": "r.minSmp"}, ("market_type", "price_type", "trade_date", "trade_hour")),
    "kpx_demand": Source("data struct<demand: double, supply: double, reserve: double, reserveRate: double, timestamp: string>", "array(p.data)", {"timestamp": "r.timestamp", "demand_mw": "r.demand", "supply_mw": "r.supply", "reserve_mw": "r.reserve", "reserve_rate": "r.reserveRate"}, ("timestamp",), where="r.timestamp IS NOT NULL"),
    "entsoe_generation": Source(_ENTSOE, _POINTS, {"production_type": f"coalesce(try_element_at({_PSR}, r.psr), r.psr)", "timestamp": _AT, "generation_mw": "r.quantity"}, ("production_type", "timestamp"), kind="xml"),
    "entsoe_load": Source(_ENTSOE, _POINTS, {"timestamp": _AT, "load_mw": "r.quantity"}, ("timestamp",), kind="xml"),
    "entsoe_crossborder": Source(_ENTSOE, _POINTS, {"timestamp": _AT, "flow_mw": "r.quantity"}, ("timestamp",), kind="xml"),
    "usda_foods": Source(
        "foods array<struct<fdcId: bigint, description: string, dataType: string, brandOwner: string, brandName: string, ingredients: string, servingSize: double, servingSizeUnit: string, foodNutrients: array<struct<nutrientId: int, value: double>>>>",
        "p.foods",
        {"fdc_id": "cast(r.fdcId as string)", "name": "r.description", "brand": _or("r.brandOwner", "r.brandName"), "data_type": "r.dataType", "serving_size": "r.servingSize", "serving_unit": "r.servingSizeUnit", **{k: f"coalesce(try_element_at(filter(r.foodNutrients, x -> x.nutrientId = {n}), -1).value, 0)" for k, n in _NUTRIENTS.items()}, "ingredients": "r.ingredients"},
        ("fdc_id",),
    ),
    "open_food": Source(
        "products array<struct<code: string, product_name: string, brands: string, ingredients_text: string, serving_size: string, nutriments: struct<`energy-kcal_100g`: double, proteins_100g: double, fat_100g: double, carbohydrates_100g: double, fiber_100g: double, sugars_100g: double, sodium_100g: double>>>",
        "p.products",
        {"fdc_id": "concat('OFF_', r.code)", "name": "r.product_name", "brand": "r.brands", "data_type": "'open_food_facts'", "serving_size": "coalesce(try_cast(nullif(regexp_extract(r.serving_size, '^[0-9.]+', 0), '') as double), 100)", "serving_unit": "'g'", "calories": "r.nutriments.`energy-kcal_100g`", "protein_g": "r.nutriments.proteins_100g", "fat_g": "r.nutriments.fat_100g", "carbs_g": "r.nutriments.carbohydrates_100g", "fiber_g": "r.nutriments.fiber_100g", "sugar_g": "r.nutriments.sugars_100g", "sodium_mg": "r.nutriments.sodium_100g * 1000", "ingredients": "r.ingredients_text"},
        ("fdc_id",), where="coalesce(r.product_name, '') != ''",
    ),
    "meals": Source(
        f"meals array<{_MEAL}>",
        "p.meals",
        {"recipe_id": "concat('MDB_', r.idMeal)", "name": "r.strMeal", "category": "r.strCategory", "cuisine": "r.strArea", "instructions": "r.strInstructions", "ingredients": f"array_join(array_compact({_PAIRS}), '; ')", "tags": "r.strTags", "image_url": "r.strMealThumb", "video_url": "r.strYoutube", "source_url": "r.strSource", "source_type": "'themealdb'"},
        ("recipe_id",),
    ),
    "spoonacular": Source(
        "results array<struct<id: bigint, title: string, image: string, servings: int, readyInMinutes: int, sourceUrl: string, summary: string, cuisines: array<string>, dishTypes: array<string>, diets: array<string>>>",
        "p.results",
        {"recipe_id": "concat('SP_', r.id)", "name": "r.title", "category": "array_join(r.dishTypes, ', ')", "cuisine": "array_join(r.cuisines, ', ')", "instructions": "r.summary", "tags": "array_join(r.diets, ', ')", "image_url": "r.image", "source_url": "r.sourceUrl", "source_type": "'spoonacular'", "servings": "r.servings", "prep_time_min": "r.readyInMinutes"},
        ("recipe_id",),
    ),
    "recipes_by_ingredients": Source("results array<struct<id: bigint, title: string, image: string, usedIngredients: array<struct<name: string>>, missedIngredients: array<struct<name: string>>>>", "p.results", {"recipe_id": "concat('SP_', r.id)", "name": "r.title", "ingredients": _joined("concat(r.usedIngredients, r.missedIngredients)", "x.name"), "image_url": "r.image", "source_type": "'spoonacular'"}, ("recipe_id",)),
    "meal_categories": Source("categories array<struct<idCategory: string, strCategory: string, strCategoryDescription: string>>", "p.categories", {"category_id": "r.idCategory", "category": "r.strCategory", "description": "r.strCategoryDescription"}, ("category_id",)),
    "congress_members": Source(
        "results array<struct<congress: string, chamber: string, members: array<struct<id: string, first_name: string, last_name: string, party: string, state: string, title: string, twitter_account: string, url: string, next_election: string, total_votes: int, missed_votes_pct: double, votes_with_party_pct: double>>>>",
        "flatten(transform(p.results, g -> transform(g.members, m -> named_struct('g', g, 'm', m))))",
        {"member_id": "r.m.id", "first_name": "r.m.first_name", "last_name": "r.m.last_name", "party": "r.m.party", "state": "r.m.state", "chamber": "r.g.chamber", "congress": "r.g.congress", "title": "r.m.title", "url": "r.m.url", "total_votes": "r.m.total_votes", "missed_votes_pct": "r.m.missed_votes_pct", "votes_with_party_pct": "r.m.votes_with_party_pct"},
        ("member_id",),
    ),
    "congress_votes": Source(
        "results struct<votes: struct<vote: struct<congress: int, session: int, chamber: string, roll_call: int, bill: struct<bill_id: string>, question: string, description: string, vote_type: string, date: string, time: string, result: string, total: struct<yes: int, no: int, not_voting: int>>>>",
        "array(p.results.votes.vote)",
        {"vote_id": "concat_ws('-', r.congress, r.session, r.chamber, r.roll_call)", "congress": "r.congress", "session": "r.session", "chamber": "r.chamber", "roll_call": "r.roll_call", "bill_id": "r.bill.bill_id", "question": "r.question", "description": "r.description", "vote_type": "r.vote_type", "date": "r.date", "time": "r.time", "result": "r.result", "total_yes": "r.total.yes", "total_no": "r.total.no", "total_not_voting": "r.total.not_voting"},
        ("vote_id",), where="r.congress IS NOT NULL",
    ),
    "campaign_finance": Source("summary struct<_cid: string, _cand_name: string, _cycle: string, _party: string, _state: string, _chamber: string, _total: string, _spent: string, _cash_on_hand: string, _debt: string>", "array(p.summary)", {"cid": "r._cid", "name": "r._cand_name", "cycle": "r._cycle", "party": "r._party", "state": "r._state", "chamber": "r._chamber", "total": "try_cast(r._total as double)", "spent": "try_cast(r._spent as double)", "cash_on_hand": "try_cast(r._cash_on_hand as double)", "debt": "try_cast(r._debt as double)"}, ("cid", "cycle"), kind="xml"),
    "contributors": Source("contributors struct<_cid: string, _cycle: string, contributor: array<struct<_org_name: string, _total: string, _pacs: string, _indivs: string>>>", "p.contributors.contributor", {"pac_id": "replace(lower(r._org_name), ' ', '_')", "candidate_id": "p.contributors._cid", "cycle": "p.contributors._cycle", "name": "r._org_name", "total": "try_cast(r._total as double)", "pacs": "try_cast(r._pacs as double)", "individuals": "try_cast(r._indivs as double)"}, ("pac_id", "candidate_id", "cycle"), kind="xml"),
    "korean_members": Source("ALLNAMEMBER array<struct<`row`: array<struct<MONA_CD: string, HG_NM: string, ENG_NM: string, POLY_NM: string, ORIG_NM: string, CMITS: string, E_MAIL: string>>>>", "flatten(filter(transform(p.ALLNAMEMBER, x -> x.`row`), x -> x IS NOT NULL))", _MEMBER, ("mona_cd",)),
    "korean_bills": Source("TVBPMBILL11 array<struct<`row`: array<struct<BILL_ID: string, BILL_NO: string, BILL_NAME: string, PROPOSER: string, PROPOSE_DT: string, COMMITTEE: string, PROC_RESULT: string, LINK_URL: string>>>>", "flatten(filter(transform(p.TVBPMBILL11, x -> x.`row`), x -> x IS NOT NULL))", {"bill_id": "r.BILL_ID", "bill_no": "r.BILL_NO", "bill_name": "r.BILL_NAME", "proposer": "r.PROPOSER", "propose_date": "r.PROPOSE_DT", "committee": "r.COMMITTEE", "result": "r.PROC_RESULT", "url": "r.LINK_URL"}, ("bill_id",)),
    "candidate_bios": Source(
        "bio struct<candidate: struct<candidateId: string, firstName: string, middleName: string, lastName: string, suffix: string, nickName: string, birthDate: string, birthPlace: string, gender: string, family: string, homeCity: string, homeState: string, education: string, profession: string, political: string, religion: string>>",
        "array(p.bio.candidate)",
        {"candidate_id": "r.candidateId", "first_name": "r.firstName", "middle_name": "r.middleName", "last_name": "r.lastName", "suffix": "r.suffix", "nick_name": "r.nickName", "birth_date": "r.birthDate", "birth_place": "r.birthPlace", "gender": "r.gender", "family": "r.family", "home_city": "r.homeCity", "home_state": "r.homeState", "education": "r.education", "profession": "r.profession", "political": "r.political", "religion": "r.religion"},
        ("candidate_id",),
    ),
    "candidate_ratings": Source(
        "candidateRating struct<rating: array<struct<ratingId: string, ratingName: string, sigId: string, sigName: string, rating: string, ratingText: string, timespan: string>>>",
        "p.candidateRating.rating",
        {"rating_id": "r.ratingId", "rating_name": "r.ratingName", "group_id": "r.sigId", "group_name": "r.sigName", "rating": "r.rating", "rating_text": "r.ratingText", "timespan": "r.timespan"},
        ("rating_id",), note="the candidate is that of the request: carry it along with keep",
    ),
    "video_metadata": Source("title string, author_name string, author_url string, thumbnail_url string", "array(struct(p.*))", {"title": "r.title", "channel": "r.author_name", "channel_url": "r.author_url", "thumbnail": "r.thumbnail_url"}, ("title",), where="r.title IS NOT NULL"),
    "repositories": Source("items array<struct<full_name: string, html_url: string, description: string, stargazers_count: int, language: string>>", "p.items", {"name": "r.full_name", "feed_url": "concat(r.html_url, '/releases.atom')", "title": "r.description", "stars": "r.stargazers_count", "score": "least(greatest(r.stargazers_count / 10000.0, 0), 1)"}, ("name",)),
}

#: sources fetched together, by domain
GROUPS = {
    "ai": ("arxiv", "semantic_scholar", "papers_with_code", "huggingface_models"), "legal": ("court_cases", "congress_bill_list", "federal_register"), "finance": ("fred_observations", "stock_quotes", "stock_daily_prices", "korean_disclosures"),
    "energy": ("eia_series", "ercot_prices", "kpx_prices", "entsoe_load"), "food": ("usda_foods", "open_food", "meals", "spoonacular"), "politics": ("congress_members", "congress_bill_list", "congress_votes", "korean_members", "korean_bills"),
}


def parse(payloads: DataFrame, source: str, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a source from a column of raw payloads; repeats of a key within the input are left out.

    ``keep``: further columns of the input to carry along (a country, a query)."""
    s = SOURCES[source]
    read = F.from_json(F.col(column), s.schema) if s.kind == "json" else F.from_xml(F.col(column), s.schema)
    rows = payloads.select(*keep, read.alias("p")).select(*keep, "p", F.expr(f"explode({s.records})").alias("r")).filter("r IS NOT NULL").filter(s.where)
    out = rows.select(*keep, *[F.expr(e).alias(c) for c, e in s.columns.items()])
    missing = " OR ".join(f"coalesce(cast(`{k}` as string), '') = ''" for k in s.key)
    return out.filter(f"NOT ({missing})").dropDuplicates([*keep, *s.key])


def parse_group(payloads: DataFrame, group: str, column: str = "payload", name: str = "source_name") -> DataFrame:
    """(source, n) of a group's payloads, told apart by column ``name``."""
    out = None
    for s in GROUPS[group]:
        n = parse(payloads.filter(F.col(name) == s), s, column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("source"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def ercot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Settlement point, timestamp, price; the header is skipped, a bad price is 0, a ragged row fails the read."""
    raw = spark.read.schema("settlement_point string, timestamp string, price string").option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(F.expr(zone_sql("settlement_point")).alias("zone"), "settlement_point", "timestamp", F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"))


def authority_registry(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of trusted sources; malformed lines are skipped, trust defaults to 0.95."""
    raw = spark.read.schema("topic string, name string, url string, language string, tier int, feed_type string, source string, trust_score double").option("mode", "DROPMALFORMED").json(path)
    return raw.filter("url IS NOT NULL").withColumn("trust_score", F.coalesce("trust_score", F.lit(0.95)))


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """The http(s) URLs of a text file, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter(F.col("url").rlike("^https?://"))


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(category, kw) of a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("category", "kws")).select("category", F.explode("kws").alias("kw"))
