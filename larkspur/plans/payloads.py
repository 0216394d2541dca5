"""Round trips of API payloads: rows of the tables are written in an API's form
and read back by its parser; the SQL states what has to come out of them.

Each entry of CASES is (source, table, payload as SQL, columns wanted, SQL of
the result). Payloads hold what the parsers have to deal with: nested lists,
missing parts, values to be left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import table
from larkspur.sources import apis, html

_X = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
_GRID = (
    "concat('<GL_MarketDocument><TimeSeries><MktPSRType><psrType>', {psr}, '</psrType></MktPSRType><Period><timeInterval><start>', date_format(timestamp_seconds(1700000000 + 900 * id), \"yyyy-MM-dd'T'HH:mm\"), 'Z</start></timeInterval>"
    "<Point><position>1</position><quantity>', id, '</quantity></Point><Point><position>3</position><quantity>', id + 0.5, '</quantity></Point></Period></TimeSeries></GL_MarketDocument>')"
)
_PSR_SQL = (
    "CASE id % 22 WHEN 1 THEN 'Biomass' WHEN 2 THEN 'Fossil Brown Coal/Lignite' WHEN 3 THEN 'Fossil Coal-derived Gas' WHEN 4 THEN 'Fossil Gas' WHEN 5 THEN 'Fossil Hard Coal' WHEN 6 THEN 'Fossil Oil' WHEN 7 THEN 'Fossil Oil Shale' WHEN 8 THEN 'Fossil Peat' WHEN 9 THEN 'Geothermal' "
    "WHEN 10 THEN 'Hydro Pumped Storage' WHEN 11 THEN 'Hydro Run-of-river and poundage' WHEN 12 THEN 'Hydro Water Reservoir' WHEN 13 THEN 'Marine' WHEN 14 THEN 'Nuclear' WHEN 15 THEN 'Other renewable' WHEN 16 THEN 'Solar' WHEN 17 THEN 'Waste' WHEN 18 THEN 'Wind Offshore' WHEN 19 THEN 'Wind Onshore' WHEN 20 THEN 'Other' ELSE 'B' || lpad((id % 22)::VARCHAR, 2, '0') END"
)
_GRID_SQL = "FROM feeds, (VALUES (0, 0.0), (2, 0.5)) v(step, more)"
_AT_SQL = "strftime(make_timestamp((1700000000 + 900 * id - (1700000000 + 900 * id) % 60 + 900 * step) * 1000000), '%Y-%m-%d %H:%M:%S')"
_BILL = "named_struct('congress', 118, 'type', upper(bill_type), 'number', number, 'title', title, 'originChamber', 'House', 'introducedDate', introduced_date, 'latestAction', named_struct('actionDate', latest_major_action_date, 'text', latest_major_action), 'policyArea', named_struct('name', primary_subject), 'sponsors', IF(sponsor_name IS NULL, NULL, array(named_struct('fullName', sponsor_name, 'party', sponsor_party, 'state', sponsor_state))))"
_BILL_COLS = ["bill_id", "bill_number", "title", "sponsor", "sponsor_party", "policy_area", "cosponsors_count", "jurisdiction"]
_BILL_SQL = "SELECT 'us_118_' || lower(bill_type) || '_' || number AS bill_id, max(upper(bill_type) || number) AS bill_number, max(title) AS title, max(sponsor_name) AS sponsor, max(CASE WHEN sponsor_name IS NOT NULL THEN sponsor_party END) AS sponsor_party, max(primary_subject) AS policy_area, 0 AS cosponsors_count, 'US' AS jurisdiction FROM congress_bills GROUP BY 1"

CASES: dict[str, tuple[str, str, str, list[str], str]] = {
    "src02_pubmed": (
        "pubmed", "pubmed_articles",
        f"concat('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>', pmid, '</PMID><DateCompleted><Year>', pub_year, '</Year></DateCompleted><Article><ArticleTitle>', {_X.format('title')}, '</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><LastName>Roe</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>')",
        ["pmid", "title", "abstract", "authors", "pub_year"],
        "SELECT pmid, max(title) AS title, 'One. Two.' AS abstract, 'Doe J; Roe' AS authors, max(pub_year) AS pub_year FROM pubmed_articles WHERE title IS NOT NULL AND pub_year IS NOT NULL GROUP BY pmid",
    ),
    "src02_pubmed_ids": ("pubmed_ids", "pubmed_articles", "concat('<eSearchResult><IdList><Id>', pmid, '</Id><Id>x', pmid, '</Id></IdList></eSearchResult>')", ["pmid"], "SELECT DISTINCT unnest([pmid, 'x' || pmid]) AS pmid FROM pubmed_articles"),
    "src03_approvals": (
        "fda_approvals", "part",
        "to_json(named_struct('results', array(named_struct('application_number', concat('NDA', p_partkey), 'sponsor_name', ('M ' || p_brand), 'products', IF(p_partkey % 5 = 0, NULL, array(named_struct('brand_name', p_name, 'active_ingredients', array(named_struct('name', p_type))), named_struct('brand_name', 'second', 'active_ingredients', NULL))), 'submissions', array(named_struct('submission_type', 'SUPPL', 'submission_status', 'TA', 'submission_status_date', '2000'), named_struct('submission_type', 'ORIG', 'submission_status', 'AP', 'submission_status_date', concat('2001', p_size)))))))",
        ["application_number", "brand_name", "generic_name", "sponsor_name", "approval_date", "submission_type"],
        "SELECT 'NDA' || p_partkey AS application_number, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS brand_name, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS generic_name, ('M ' || p_brand) AS sponsor_name, '2001' || p_size AS approval_date, 'ORIG' AS submission_type FROM part",
    ),
    "src04_adverse_events": (
        "fda_adverse_events", "part",
        "to_json(named_struct('results', array(named_struct('safetyreportid', concat('R', p_partkey), 'serious', IF(p_partkey % 3 = 0, NULL, cast(p_partkey % 3 as string)), 'receivedate', '20240101', 'patient', named_struct('drug', array(named_struct('medicinalproduct', p_name), named_struct('medicinalproduct', ''), named_struct('medicinalproduct', p_brand)), 'reaction', array(named_struct('reactionmeddrapt', p_type)))))))",
        ["report_id", "drug_names", "reactions", "serious"],
        "SELECT 'R' || p_partkey AS report_id, p_name || '; ' || p_brand AS drug_names, p_type AS reactions, (p_partkey % 3)::INT AS serious FROM part",
    ),
    "src05_filings": (
        "sec_filings", "supplier",
        "to_json(named_struct('hits', named_struct('hits', array(named_struct('_id', concat('0001-', s_suppkey, ':doc.htm'), '_source', named_struct('display_names', array(s_name, 'other'), 'form', '10-K', 'file_date', '2024-01-02', 'file_description', ('ph ' || s_suppkey)))))))",
        ["accession_number", "company_name", "form_type", "filed_date", "description", "url"],
        "SELECT '0001-' || s_suppkey AS accession_number, s_name AS company_name, '10-K' AS form_type, '2024-01-02' AS filed_date, ('ph ' || s_suppkey) AS description, 'https://www.sec.gov/Archives/edgar/data/0001-' || s_suppkey || ':doc.htm' AS url FROM supplier",
    ),
    "src06_arxiv": (
        "arxiv", "part",
        f"concat('<feed><entry><id>http://arxiv.org/abs/', p_partkey, '.0001v', 1 + p_partkey % 3, '</id><title>', {_X.format('p_name')}, '  \n in brief</title><summary> a   b </summary><published>2024</published><author><name>', ('M ' || p_brand), '</name></author><author><name>Z</name></author><category term=\"cs.DB\"/><category term=\"cs.AI\"/></entry></feed>')",
        ["paper_id", "title", "abstract", "authors", "categories", "pdf_link"],
        "SELECT p_partkey || '.0001' AS paper_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' in brief' AS title, 'a b' AS abstract, ('M ' || p_brand) || '; Z' AS authors, 'cs.DB, cs.AI' AS categories, 'http://arxiv.org/pdf/' || p_partkey || '.0001v' || (1 + p_partkey % 3) AS pdf_link FROM part",
    ),
    "src07_scholar": (
        "semantic_scholar", "part",
        "to_json(named_struct('data', array(named_struct('paperId', concat('S', p_partkey), 'title', p_name, 'abstract', IF(p_partkey % 2 = 0, '', p_type), 'year', 2000 + p_size, 'venue', p_brand, 'citationCount', IF(p_partkey % 3 = 0, NULL, p_size), 'authors', array(named_struct('name', ('M ' || p_brand)), named_struct('name', 'Y')), 'externalIds', named_struct('ArXiv', '1.2')))))",
        ["paper_id", "title", "abstract", "authors", "published", "citation_count", "venue", "arxiv_id"],
        "SELECT 'S' || p_partkey AS paper_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'No abstract available' ELSE p_type END AS abstract, ('M ' || p_brand) || '; Y' AS authors, (2000 + p_size)::VARCHAR AS published, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END::INT AS citation_count, p_brand AS venue, '1.2' AS arxiv_id FROM part",
    ),
    "src08_models": (
        "huggingface_models", "part",
        "to_json(named_struct('models', array(named_struct('modelId', IF(p_partkey % 4 = 0, '', concat('m/', p_partkey)), 'id', concat('i/', p_partkey), 'author', ('M ' || p_brand), 'downloads', p_size, 'tags', array(p_brand, 'x'), 'private', p_partkey % 7 = 0))))",
        ["model_id", "author", "downloads", "likes", "tags"],
        "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'i/' ELSE 'm/' END || p_partkey AS model_id, ('M ' || p_brand) AS author, p_size::BIGINT AS downloads, 0::BIGINT AS likes, p_brand || ', x' AS tags FROM part WHERE p_partkey % 7 <> 0",
    ),
    "src09_papers": (
        "papers_with_code", "part",
        "to_json(named_struct('results', array(named_struct('id', IF(p_partkey % 3 = 0, '', concat('P', p_partkey)), 'arxiv_id', concat('a', p_partkey), 'title', p_name, 'abstract', IF(p_partkey % 2 = 0, NULL, p_type), 'url_pdf', 'u'))))",
        ["paper_id", "title", "abstract", "pdf_link"],
        "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'pwc:a' || p_partkey ELSE 'P' || p_partkey END AS paper_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'No abstract available' ELSE p_type END AS abstract, 'u' AS pdf_link FROM part",
    ),
    "src12_bills": ("congress_bill_list", "congress_bills", f"to_json(named_struct('bills', array({_BILL})))", _BILL_COLS, _BILL_SQL),
    "src13_bill": ("congress_bill", "congress_bills", f"to_json(named_struct('bill', {_BILL}))", _BILL_COLS, _BILL_SQL),
    "src14_register": (
        "federal_register", "part",
        "to_json(named_struct('results', array(named_struct('document_number', concat('D', p_partkey), 'title', p_name, 'type', IF(p_partkey % 2 = 0, 'Rule', 'Notice'), 'agencies', array(named_struct('raw_name', upper(('M ' || p_brand)), 'name', IF(p_partkey % 3 = 0, '', ('M ' || p_brand))), named_struct('raw_name', 'EPA', 'name', NULL)), 'topics', array(p_brand, 'air'), 'publication_date', '2024-01-01'))))",
        ["document_number", "title", "document_type", "agencies", "topics", "publication_date"],
        "SELECT 'D' || p_partkey AS document_number, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Rule' ELSE 'Notice' END AS document_type, CASE WHEN p_partkey % 3 = 0 THEN upper(('M ' || p_brand)) ELSE ('M ' || p_brand) END || '; EPA' AS agencies, p_brand || '; air' AS topics, '2024-01-01' AS publication_date FROM part",
    ),
    "src16_state_bills": (
        "state_bills", "part",
        "to_json(named_struct('data', named_struct('bills', named_struct('edges', array(named_struct('node', named_struct('id', concat('ocd/', p_partkey), 'identifier', p_brand, 'title', p_name, 'subject', array(p_type, 's'), 'legislativeSession', named_struct('identifier', '2024'), 'sponsorships', array(named_struct('name', 'first', 'primary', false), named_struct('name', ('M ' || p_brand), 'primary', p_partkey % 2 = 0)))))))))",
        ["bill_id", "bill_number", "title", "congress", "sponsor", "policy_area"],
        "SELECT 'ocd/' || p_partkey AS bill_id, p_brand AS bill_number, p_name AS title, '2024' AS congress, CASE WHEN p_partkey % 2 = 0 THEN ('M ' || p_brand) ELSE 'first' END AS sponsor, p_type || '; s' AS policy_area FROM part",
    ),
    "src18_observations": (
        "fred_observations", "part",
        "to_json(named_struct('seriess', array(named_struct('id', concat('F', p_partkey), 'title', p_name, 'units', 'Index', 'frequency', 'Monthly')), 'observations', array(named_struct('date', '2024-01-01', 'value', cast(p_size as string)), named_struct('date', '2024-02-01', 'value', '.'), named_struct('date', '2024-03-01', 'value', '1.5'))))",
        ["series_id", "title", "observation_date", "value", "units"],
        "SELECT 'F' || p_partkey AS series_id, p_name AS title, v.d AS observation_date, coalesce(v.x, p_size)::DOUBLE AS value, 'Index' AS units FROM part, (VALUES ('2024-01-01', NULL), ('2024-03-01', 1.5)) v(d, x)",
    ),
    "src20_quotes": (
        "stock_quotes", "part",
        "to_json(named_struct('quoteResponse', named_struct('result', array(named_struct('symbol', concat('Q', p_partkey), 'shortName', p_brand, 'longName', IF(p_partkey % 2 = 0, '', p_name), 'regularMarketPrice', p_size + 0.25, 'regularMarketVolume', p_size)))))",
        ["symbol", "name", "price", "volume"],
        "SELECT 'Q' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS name, p_size + 0.25::DOUBLE AS price, p_size::BIGINT AS volume FROM part",
    ),
    "src21_daily": (
        "stock_daily_prices", "part",
        "to_json(named_struct('Meta Data', named_struct('2. Symbol', concat('D', p_partkey)), 'Time Series (Daily)', map('2024-01-02', named_struct('1. open', cast(p_size as string), '2. high', '9', '3. low', 'x', '4. close', '2.5', '5. volume', '77'), '2024-01-03', named_struct('1. open', '1', '2. high', '2', '3. low', '3', '4. close', '4', '5. volume', '5'))))",
        ["symbol", "date", "open", "high", "low", "close", "volume"],
        "SELECT 'D' || p_partkey AS symbol, '2024-01-02' AS date, p_size::DOUBLE AS open, 9::DOUBLE AS high, NULL::DOUBLE AS low, 2.5::DOUBLE AS close, 77::BIGINT AS volume FROM part UNION ALL SELECT 'D' || p_partkey, '2024-01-03', 1, 2, 3, 4, 5 FROM part",
    ),
    "src22_latest": (
        "stock_latest", "part",
        "to_json(named_struct('Global Quote', named_struct('01. symbol', IF(p_partkey % 5 = 0, '', concat('L', p_partkey)), '05. price', cast(p_size as string), '09. change', 'n/a', '10. change percent', concat(p_size, '.5%'), '06. volume', '12')))",
        ["symbol", "price", "change", "change_percent", "volume"],
        "SELECT 'L' || p_partkey AS symbol, p_size::DOUBLE AS price, 0::DOUBLE AS change, p_size + 0.5::DOUBLE AS change_percent, 12::BIGINT AS volume FROM part WHERE p_partkey % 5 <> 0",
    ),
    "src23_disclosures": (
        "korean_disclosures", "supplier",
        "to_json(named_struct('list', array(named_struct('rcept_no', cast(s_suppkey as string), 'corp_name', s_name, 'report_nm', ('ph ' || s_suppkey), 'rcept_dt', '20240101'))))",
        ["rcept_no", "corp_name", "report_nm", "rcept_dt", "url"],
        "SELECT s_suppkey::VARCHAR AS rcept_no, s_name AS corp_name, ('ph ' || s_suppkey) AS report_nm, '20240101' AS rcept_dt, 'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || s_suppkey AS url FROM supplier",
    ),
    "src28_prices": (
        "ercot_prices", "ercot_prices",
        "to_json(named_struct('data', array(named_struct('deliveryDate', '2024-01-01', 'hourEnding', cast(id as string), 'settlementPoint', concat(zone, '_N', id % 3), 'spp', price))))",
        ["zone", "settlement_point", "price", "timestamp"],
        "SELECT CASE WHEN zone IN ('LZ_HOUSTON', 'LZ_NORTH', 'LZ_SOUTH', 'LZ_WEST', 'LZ_AEN', 'LZ_CPS', 'LZ_LCRA', 'LZ_RAYBN', 'HB_HOUSTON', 'HB_NORTH', 'HB_SOUTH', 'HB_WEST', 'HB_HUBAVG', 'HB_BUSAVG') THEN zone ELSE zone || '_N' || id % 3 END AS zone, zone || '_N' || id % 3 AS settlement_point, price, '2024-01-01 ' || id AS timestamp FROM ercot_prices WHERE zone IS NOT NULL",
    ),
    "src30_smp": ("kpx_prices", "part", "to_json(named_struct('result', named_struct('list', array(named_struct('trdDt', concat('D', p_partkey), 'trdHr', 7, 'smp', p_size + 0.5, 'maxSmp', 99.0, 'minSmp', 1.0)))))", ["market_type", "trade_date", "trade_hour", "price"], "SELECT 'SMP' AS market_type, 'D' || p_partkey AS trade_date, 7 AS trade_hour, p_size + 0.5::DOUBLE AS price FROM part"),
    "src31_demand": ("kpx_demand", "part", "to_json(named_struct('data', named_struct('timestamp', concat('T', p_partkey), 'demand', p_size + 0.0, 'reserveRate', 1.5)))", ["timestamp", "demand_mw", "reserve_rate"], "SELECT 'T' || p_partkey AS timestamp, p_size::DOUBLE AS demand_mw, 1.5::DOUBLE AS reserve_rate FROM part"),
    "src32_generation": ("entsoe_generation", "feeds", _GRID.format(psr="concat('B', lpad(id % 22, 2, '0'))"), ["production_type", "at", "generation_mw"], f"SELECT DISTINCT {_PSR_SQL} AS production_type, {_AT_SQL} AS at, id + more::DOUBLE AS generation_mw {_GRID_SQL}"),
    "src34_flows": ("entsoe_crossborder", "feeds", _GRID.format(psr="'B01'"), ["n", "low", "high"], f"SELECT count(*) AS n, min(ts) AS low, max(ts) AS high FROM (SELECT DISTINCT {_AT_SQL} AS ts {_GRID_SQL})"),
    "src36_foods": (
        "usda_foods", "part",
        "to_json(named_struct('foods', array(named_struct('fdcId', p_partkey, 'description', p_name, 'brandOwner', IF(p_partkey % 2 = 0, '', ('M ' || p_brand)), 'brandName', p_brand, 'foodNutrients', array(named_struct('nutrientId', 1008, 'value', p_size + 0.0), named_struct('nutrientId', 1003, 'value', 2.5), named_struct('nutrientId', 1008, 'value', p_size + 1.0))))))",
        ["fdc_id", "name", "brand", "calories", "protein_g", "fat_g"],
        "SELECT p_partkey::VARCHAR AS fdc_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE ('M ' || p_brand) END AS brand, p_size + 1::DOUBLE AS calories, 2.5::DOUBLE AS protein_g, 0::DOUBLE AS fat_g FROM part",
    ),
    "src37_products": (
        "open_food", "part",
        "to_json(named_struct('products', array(named_struct('code', cast(p_partkey as string), 'product_name', IF(p_partkey % 9 = 0, '', p_name), 'brands', p_brand, 'serving_size', IF(p_partkey % 2 = 0, '', concat(p_size, ' g')), 'nutriments', named_struct('proteins_100g', 3.5)))))",
        ["fdc_id", "name", "brand", "serving_size"],
        "SELECT 'OFF_' || p_partkey AS fdc_id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE p_size END::DOUBLE AS serving_size FROM part WHERE p_partkey % 9 <> 0",
    ),
    "src38_meals": (
        "meals", "part",
        "to_json(named_struct('meals', array(named_struct('idMeal', cast(p_partkey as string), 'strMeal', p_name, 'strCategory', p_brand, 'strArea', ('M ' || p_brand), 'strIngredient1', ' salt ', 'strMeasure1', '1 tsp', 'strIngredient2', '', 'strMeasure2', 'x', 'strIngredient3', p_type, 'strMeasure3', ''))))",
        ["recipe_id", "name", "category", "cuisine", "ingredients"],
        "SELECT 'MDB_' || p_partkey AS recipe_id, p_name AS name, p_brand AS category, ('M ' || p_brand) AS cuisine, '1 tsp salt; ' || trim(p_type) AS ingredients FROM part",
    ),
    "src39_recipes": (
        "spoonacular", "part",
        "to_json(named_struct('results', array(named_struct('id', p_partkey, 'title', p_name, 'servings', p_size, 'cuisines', array(p_brand, 'any'), 'dishTypes', array('main'), 'summary', p_type))))",
        ["recipe_id", "name", "category", "cuisine", "instructions"],
        "SELECT 'SP_' || p_partkey AS recipe_id, p_name AS name, 'main' AS category, p_brand || ', any' AS cuisine, p_type AS instructions FROM part",
    ),
    "src40_categories": ("meal_categories", "nation", "to_json(named_struct('categories', array(named_struct('idCategory', cast(n_nationkey as string), 'strCategory', n_name, 'strCategoryDescription', n_name))))", ["category_id", "category"], "SELECT n_nationkey::VARCHAR AS category_id, n_name AS category FROM nation"),
    "src42_members": (
        "congress_members", "supplier",
        "to_json(named_struct('results', array(named_struct('congress', '118', 'chamber', 'Senate', 'members', array(named_struct('id', concat('M', s_suppkey), 'first_name', s_name, 'last_name', ('ph ' || s_suppkey), 'party', 'D', 'state', 'NY', 'total_votes', 12))))))",
        ["member_id", "first_name", "last_name", "chamber", "congress", "total_votes"],
        "SELECT 'M' || s_suppkey AS member_id, s_name AS first_name, ('ph ' || s_suppkey) AS last_name, 'Senate' AS chamber, '118' AS congress, 12 AS total_votes FROM supplier",
    ),
    "src43_contributors": (
        "contributors", "supplier",
        f"concat('<response><contributors cid=\"N', s_suppkey, '\" cycle=\"2024\"><contributor org_name=\"', {_X.format('s_name')}, '\" total=\"10\" pacs=\"4\" indivs=\"6\"/><contributor org_name=\"Big Org\" total=\"1\" pacs=\"0\" indivs=\"1\"/></contributors></response>')",
        ["pac_id", "candidate_id", "cycle"],
        "SELECT unnest([replace(lower(s_name), ' ', '_'), 'big_org']) AS pac_id, 'N' || s_suppkey AS candidate_id, '2024' AS cycle FROM supplier",
    ),
    "src44_members": ("korean_members", "supplier", "to_json(named_struct('ALLNAMEMBER', array(named_struct('row', NULL), named_struct('row', array(named_struct('MONA_CD', concat('K', s_suppkey), 'HG_NM', s_name, 'POLY_NM', ('ph ' || s_suppkey)))))))", ["mona_cd", "name", "party"], "SELECT 'K' || s_suppkey AS mona_cd, s_name AS name, ('ph ' || s_suppkey) AS party FROM supplier"),
    "src44_bills": ("korean_bills", "supplier", "to_json(named_struct('TVBPMBILL11', array(named_struct('row', array(named_struct('BILL_ID', concat('B', s_suppkey), 'BILL_NAME', s_name, 'PROPOSER', ('ph ' || s_suppkey)))))))", ["bill_id"], "SELECT 'B' || s_suppkey AS bill_id FROM supplier"),
    "src45_bios": ("candidate_bios", "supplier", "to_json(named_struct('bio', named_struct('candidate', named_struct('candidateId', cast(s_suppkey as string), 'firstName', s_name, 'lastName', ('ph ' || s_suppkey)))))", ["candidate_id", "first_name", "last_name"], "SELECT s_suppkey::VARCHAR AS candidate_id, s_name AS first_name, ('ph ' || s_suppkey) AS last_name FROM supplier"),
    "src45_ratings": ("candidate_ratings", "supplier", "to_json(named_struct('candidateRating', named_struct('rating', array(named_struct('ratingId', concat('r', s_suppkey), 'ratingName', s_name, 'sigId', '7', 'rating', '88'), named_struct('ratingId', concat('q', s_suppkey), 'ratingName', 'x', 'sigId', '8', 'rating', '1')))))", ["rating_id", "rating_name", "group_id", "rating"], "SELECT 'r' || s_suppkey AS rating_id, s_name AS rating_name, '7' AS group_id, '88' AS rating FROM supplier UNION ALL SELECT 'q' || s_suppkey, 'x', '8', '1' FROM supplier"),
    "src55_repositories": ("repositories", "part", "to_json(named_struct('items', array(named_struct('full_name', concat('o/', p_partkey), 'html_url', concat('https://x.example/', p_partkey), 'description', p_name, 'stargazers_count', p_size))))", ["name", "feed_url", "title", "stars"], "SELECT 'o/' || p_partkey AS name, 'https://x.example/' || p_partkey || '/releases.atom' AS feed_url, p_name AS title, p_size::INT AS stars FROM part"),
}

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: rows that the payloads are made of, where not all of a table
_ROWS = {"src02_pubmed": "title IS NOT NULL AND pub_year IS NOT NULL", "src28_prices": "zone IS NOT NULL"}


def _round_trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, of, payload, columns, _ = CASES[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = apis.parse(table(s, d, of).filter(_ROWS.get(name, "true")).selectExpr(f"{payload} AS payload"), source)
        if name == "src34_flows":
            return rows.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        if name == "src32_generation":
            rows = rows.withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
        return rows.select(*columns)

    run.__name__, run.__doc__ = name, f"Round trip of {source} payloads made of {of}."
    return run


for _name, _case in CASES.items():
    QUERIES[_name], SQL[_name] = _round_trip(_name), _case[4]


# ---- pages ----
_T = "replace(replace(replace(coalesce(split_part(text, chr(10), 1), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each document, its parts in three different forms."""
    docs = table(s, d, "documents").filter("doc_id IS NOT NULL").selectExpr("doc_id", f"{_T} AS t")
    return docs.selectExpr(
        "doc_id",
        """concat('<html><head>', CASE doc_id % 3 WHEN 0 THEN concat('<meta property="og:title" content="og ', doc_id, '">') ELSE '' END, '<title>page ', doc_id, '</title>
        <meta name="author" content="Ann ', doc_id, '"><meta property="article:published_time" content="2024-01-02T03:04:05Z">
        <link rel="alternate" type="application/rss+xml" href="/feed-', doc_id, '.xml"><link rel="alternate" type="application/atom+xml" href="https://a.example/atom/', doc_id, '"></head><body>',
        CASE doc_id % 3 WHEN 1 THEN concat('<h1>head ', doc_id, '</h1>') ELSE '' END, '<nav>menu</nav><script>var x = 1;</script><p>', t, '</p>
        <a href="/news/', doc_id, '">News</a><a href="/about">About</a><footer>foot</footer></body></html>') AS page""",
    )


def htm01_title(s: SparkSession, d: str) -> DataFrame:
    """og:title, else the first heading, else the title."""
    return _pages(s, d).select("doc_id", html.title(F.col("page")).alias("title"))


def htm03_author(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("doc_id", html.author(F.col("page")).alias("author"))


def htm08_feeds(s: SparkSession, d: str) -> DataFrame:
    """Feeds that a page announces."""
    return _pages(s, d).select("doc_id", F.explode(html.feed_links(F.col("page"))).alias("href"))


QUERIES |= {"htm01_title": htm01_title, "htm03_author": htm03_author, "htm08_feeds": htm08_feeds}
SQL |= {
    "htm01_title": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'og ' || doc_id WHEN 1 THEN 'head ' || doc_id ELSE 'page ' || doc_id END AS title FROM documents",
    "htm03_author": "SELECT doc_id, 'Ann ' || doc_id AS author FROM documents",
    "htm08_feeds": "SELECT doc_id, unnest(['/feed-' || doc_id || '.xml', 'https://a.example/atom/' || doc_id]) AS href FROM documents",
}
