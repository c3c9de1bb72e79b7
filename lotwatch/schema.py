"""The two canonical tables and the vector table."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "double": T.DoubleType(),
        "bigint": T.LongType(),
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(),
    }
    fields = [part.split() for part in text.strip().split("\n")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


TENDERS = _struct(
    """tender_id string
    tender_number string
    title string
    status string
    procurement_method string
    procurement_method_type string
    main_procurement_category string
    date_created timestamp
    date_modified timestamp
    notice_publication_date timestamp
    cpv_main string
    cpv_description string
    n_items bigint
    budget_amount double
    budget_currency string
    vat_included boolean
    awarded_amount double
    awarded_currency string
    n_bids bigint
    n_awards bigint
    n_contracts bigint
    supplier_name string
    supplier_edrpou string
    buyer_name string
    buyer_edrpou string
    buyer_kind string
    buyer_region string
    buyer_country string
    source_file string
    price_deviation_pct double"""
)

# The flattener fills all but the derived last column.
TENDER_COLUMNS = [f.name for f in TENDERS.fields if f.name != "price_deviation_pct"]

ITEMS = _struct(
    """tender_id string
    item_id string
    description string
    cpv string
    cpv_description string
    quantity double
    unit_name string
    unit_code string
    unit_amount double
    unit_currency string
    line_total double
    delivery_region string
    delivery_end_date timestamp
    source_file string"""
)

ITEM_COLUMNS = ITEMS.fieldNames()

# The parts of a raw document that are used.  Amounts are text: they may be
# numbers, numeric strings, empty or unreadable.
_MONEY = "STRUCT<amount: STRING, currency: STRING>"
RAW_FIELDS = {
    "id": "STRING",
    "tenderID": "STRING",
    "title": "STRING",
    "status": "STRING",
    "procurementMethod": "STRING",
    "procurementMethodType": "STRING",
    "mainProcurementCategory": "STRING",
    "dateCreated": "STRING",
    "dateModified": "STRING",
    "noticePublicationDate": "STRING",
    "value": "STRUCT<amount: STRING, currency: STRING, valueAddedTaxIncluded: BOOLEAN>",
    "procuringEntity": "STRUCT<name: STRING, kind: STRING, identifier: STRUCT<id: STRING>, "
    "address: STRUCT<region: STRING, countryName: STRING>>",
    "bids": "ARRAY<STRUCT<id: STRING>>",
    "awards": f"ARRAY<STRUCT<status: STRING, value: {_MONEY}, "
    "suppliers: ARRAY<STRUCT<name: STRING, identifier: STRUCT<id: STRING>>>>>",
    "contracts": f"ARRAY<STRUCT<status: STRING, value: {_MONEY}>>",
    "items": "ARRAY<STRUCT<id: STRING, description: STRING, quantity: STRING, "
    f"classification: STRUCT<id: STRING, description: STRING>, unit: STRUCT<name: STRING, code: STRING, value: {_MONEY}>, "
    "deliveryAddress: STRUCT<region: STRING>, deliveryDate: STRUCT<endDate: STRING>>>",
}
RAW_DOCUMENT = "STRUCT<" + ", ".join(f"{name}: {kind}" for name, kind in RAW_FIELDS.items()) + ">"

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
