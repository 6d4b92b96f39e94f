"""Readers for outside card and account corpora, and their mapping to canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers of the corpora, category codes.
CARD_COLUMNS = ("trans_date_trans_time", "cc_num", "merchant", "category", "amt", "lat", "long", "merch_lat",
                "merch_long", "city_pop", "trans_num", "is_fraud")
CATEGORY_TO_MCC = {
    "entertainment": 7996, "food_dining": 5812, "gas_transport": 5541, "grocery_net": 5411, "grocery_pos": 5411,
    "health_fitness": 8099, "home": 5200, "kids_pets": 5995, "misc_net": 5399, "misc_pos": 5399,
    "personal_care": 7230, "shopping_net": 5651, "shopping_pos": 5651, "travel": 4722,
}
UNKNOWN_MCC = 5999
PCA_COLUMNS = ("Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class")
ACCOUNT_COLUMNS = (("Timestamp", "event_time", "string"), ("From Bank", "from_bank", "string"), ("Account", "src", "string"),
                   ("To Bank", "to_bank", "string"), ("Account", "dst", "string"),
                   ("Amount Received", "amount_received", "double"), ("Receiving Currency", "receiving_currency", "string"),
                   ("Amount Paid", "amount", "double"), ("Payment Currency", "currency", "string"),
                   ("Payment Format", "payment_format", "string"), ("Is Laundering", "is_laundering", "int"))
# End of fixed values.


def _require(path: str, columns: Sequence[str], needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")


def read_card_csv(spark: SparkSession, path: str) -> DataFrame:
    """Card CSV with its required columns checked, in canonical columns."""
    raw = spark.read.csv(path, header=True)
    _require(path, raw.columns, CARD_COLUMNS)
    return to_canonical(raw)


def to_canonical(raw: DataFrame) -> DataFrame:
    """Corpus columns to canonical ones. The merchant is both merchant and payee; the rail is
    constant; the authorisation outcome is absent, so null; a missing fraud flag is 0.

    Row order is not part of a table: sort by event_ts where an order is needed.
    """
    codes = F.create_map(*[F.lit(x) for item in CATEGORY_TO_MCC.items() for x in item])
    number = lambda c: F.col(c).cast("string").try_cast("double")
    card, merchant = F.col("cc_num").cast("string"), F.col("merchant").cast("string")
    return raw.select(
        F.try_to_timestamp(F.col("trans_date_trans_time").cast("string")).alias("event_ts"),
        F.col("trans_num").cast("string").alias("event_id"), card.alias("pan_token"), merchant.alias("merchant_id"),
        merchant.alias("payee_entity_id"), card.alias("payer_entity_id"), number("amt").alias("amount"),
        F.coalesce(F.element_at(codes, F.col("category")), F.lit(UNKNOWN_MCC)).alias("mcc"),
        number("lat").alias("payer_lat"), number("long").alias("payer_lon"), number("merch_lat").alias("payee_lat"),
        number("merch_long").alias("payee_lon"), number("city_pop").alias("city_pop"),
        F.lit(None).cast("string").alias("response_code"), F.lit("CARD_CNP").alias("rail"),
        F.coalesce(number("is_fraud").cast("int"), F.lit(0)).alias("is_fraud"))


def read_pca_csv(spark: SparkSession, path: str) -> DataFrame:
    """Time, V1..V28, Amount, Class, as the files have them: who needs the order of Time sorts or cuts by it."""
    head = spark.read.csv(path, header=True).columns
    _require(path, head, ("Time", "Amount", "Class"))
    types = ", ".join(f"`{c}` {'int' if c == 'Class' else 'double'}" for c in head)
    return spark.read.csv(path, header=True, schema=types)


def read_account_graph_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Account transfers. Two header columns share a name, so columns are read by position."""
    head = spark.read.csv(path, header=False).first()
    names = [c for c, _, _ in ACCOUNT_COLUMNS]
    if head is None or list(head) != names:
        raise ValueError(f"{path} does not have the columns {names}")
    schema = ", ".join(f"{n} {t}" for _, n, t in ACCOUNT_COLUMNS)
    frame = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    return frame if rows is None else frame.limit(rows)
