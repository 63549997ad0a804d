"""Landed payloads as tables: JSON text in a column, whatever its envelope.

A payload that is no JSON, or of another form, gives no rows; `payload_errors` lists those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPES = ("data", "pressReleases", "results")
RELEASES_PER_TICKER = 250
#: Fields of feeds by the name that the operators use; several source names may mean one.
CALL_FIELDS = {"content": ["content"], "transcript": ["transcript"], "text": ["text"]}
DATE_FIELDS = {"year": ["year", "fiscalYear"], "fiscal_year": ["fiscalYear"], "quarter": ["quarter"], "call_date": ["date", "callDate", "fillingDate"]}
RELEASE_FIELDS = {
    "title": ["title"], "headline": ["headline"], "subject": ["subject"], "published_date": ["publishedDate"], "date": ["date"], "accepted_date": ["acceptedDate"], "filing_date": ["filingDate"],
    "created_at": ["createdAt"], "updated_at": ["updatedAt"], "url": ["url"], "link": ["link"], "source_url": ["sourceURL", "sourceUrl"], "final_url": ["finalUrl"], "text": ["text"],
    "content": ["content"], "body": ["body"], "summary": ["summary"], "description": ["description"], "publisher": ["publisher"], "site": ["site"], "source": ["source"], "symbol": ["symbol"],
    "company_name": ["companyName"], "company": ["company"], "name": ["name"],
}
#: How all texts begin that can be cast to a number: with what a cast trims, then a sign, a point, a digit, or i and n of infinity and nan.
NUMBER_START = r"^[\x00-\x20\x7F]*[-+.0-9iInN]"
STATEMENT_FIELDS = {"fiscal_year": ["calendarYear", "year", "fiscalYear"], "period": ["period", "quarter"]}


def objects(payload: Column, envelopes: tuple[str, ...] = ()) -> Column:
    """The JSON objects of a payload, as an array of JSON texts: those of a list, of a list under one of the keys, or, without
    such keys, the object itself."""
    text = F.trim(payload)
    listed = F.from_json(text, "array<string>")
    inner = [F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>") for k in envelopes]
    single = [] if envelopes else [F.when(text.startswith("{") & F.get_json_object(text, "$").isNotNull(), F.array(text))]
    found = F.coalesce(F.when(text.startswith("["), listed), *inner, *single)
    return F.filter(found, lambda x: F.trim(x).startswith("{"))


def payload_rows(payloads: DataFrame, fields: dict[str, list[str]], keys: list[str], payload_col: str = "payload", envelopes: tuple[str, ...] = (), most: int | None = None, entries: str | None = None) -> DataFrame:
    """(keys, row_ord, fields as text, raw) for every object of every payload, in order; empty values count as missing. `entries`
    names a column for all of an object, as a map of texts."""
    own = objects(F.col(payload_col), envelopes)
    rows = payloads.select(*keys, F.posexplode(F.slice(own, 1, most) if most else own).alias("row_ord", "raw"))
    rows = rows.withColumn("_m", F.from_json("raw", "map<string, string>"))  # parsed once for all fields
    value = lambda names: F.coalesce(*[F.nullif(F.try_element_at("_m", F.lit(n)), F.lit("")) for n in names])
    return rows.select(*keys, "row_ord", *[value(names).alias(name) for name, names in fields.items()], "raw", *([F.col("_m").alias(entries)] if entries else []))


def transcript_items(payloads: DataFrame) -> DataFrame:
    """Calls (symbol, year, quarter, payload) as items for `transcripts.transcript_text`."""
    return payload_rows(payloads, CALL_FIELDS, ["symbol", "year", "quarter"]).withColumnRenamed("row_ord", "item_ord")


def transcript_dates(payloads: DataFrame) -> DataFrame:
    return payload_rows(payloads, DATE_FIELDS, ["symbol"])


def press_releases(payloads: DataFrame, most: int | None = RELEASES_PER_TICKER) -> DataFrame:
    """Feeds (ticker, payload): a list, or one under a known key; the first `most` of a payload, as the feed has them, or all."""
    return payload_rows(payloads, RELEASE_FIELDS, ["ticker"], envelopes=ENVELOPES, most=most)


def statements(payloads: DataFrame, newest: int | None = None) -> DataFrame:
    """Statement tables (symbol, table_name, freq, payload) as rows with measures: a map of all that is a number.

    Where at most `newest` rows of a table are asked for later, by their order, no object of a payload behind its first `newest`
    can be among them, whatever other payloads of the table hold: those are found, but not taken apart."""
    rows = payload_rows(payloads, STATEMENT_FIELDS, ["symbol", "table_name", "freq"], most=newest, entries="_every")
    # A cast that fails costs many times one that does not: it is tried on what begins as a number does.
    double = lambda v: F.when(v.rlike(NUMBER_START), v.try_cast("double"))
    number = F.map_filter(F.transform_values("_every", lambda k, v: double(v)), lambda k, v: v.isNotNull())
    return rows.withColumn("measures", number).drop("_every")


def ticker_map(payloads: DataFrame) -> DataFrame:
    """One payload, an object of objects (cik_str, ticker, title), as rows in order."""
    entries = F.from_json("payload", "map<string, struct<cik_str: long, ticker: string, title: string>>")
    return payloads.select(F.posexplode(F.map_values(entries)).alias("row_ord", "e")).select("row_ord", F.col("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik_int"), F.col("e.title").alias("title"))


def filing_index(payloads: DataFrame) -> DataFrame:
    """Directories of filings (accession, cik_int, primary_document, payload) as documents; one item may stand without a list."""
    item = F.get_json_object("payload", "$.directory.item")
    fields = {"name": ["name"], "type": ["type"], "description": ["description"]}
    return payload_rows(payloads.withColumn("_item", item), fields, ["accession", "cik_int", "primary_document"], "_item").drop("raw", "row_ord")


def submission_blocks(payloads: DataFrame) -> DataFrame:
    """Blocks (symbol, payload) of parallel arrays, for `filings.submissions_rows`; what is no array is left out."""
    names = {"form": "form", "filing_date": "filingDate", "report_date": "reportDate", "items": "items", "accession": "accessionNumber", "primary_document": "primaryDocument", "primary_doc_description": "primaryDocDescription"}
    block = F.coalesce(F.get_json_object("payload", "$.filings.recent"), F.col("payload"))
    return payloads.select("symbol", *[F.from_json(F.get_json_object(block, f"$.{k}"), "array<string>").alias(c) for c, k in names.items()])


def payload_errors(payloads: DataFrame, keys: list[str], payload_col: str = "payload", envelopes: tuple[str, ...] = ()) -> DataFrame:
    """(keys, error) for payloads without a readable object."""
    bad = F.when(F.col(payload_col).isNull() | (F.trim(payload_col) == ""), "empty_payload").when(objects(F.col(payload_col), envelopes).isNull(), "payload_not_readable")
    return payloads.select(*keys, bad.alias("error")).where(F.col("error").isNotNull())
