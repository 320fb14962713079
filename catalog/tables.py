"""Inputs of the queries: the given tables, and texts derived from their rows.

The derived texts carry the entity types that the document table lacks.  Their SQL runs unchanged in
both engines; keys decide which rows hold valid, invalid and no values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_TS = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _digits(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


K, C = "o_orderkey", "o_custkey"
_LONG = f"({K} * 7919 + {C} * 104729 + 1234567)"


def _pick(values: list[str], by: str) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case {by} % {len(values)} {whens} end)"


# entity type -> SQL text over `orders`
CASE_TEXT = {
    "US_SSN": (
        f"'Order ' || cast({K} as string) || ', SSN ' || {_digits(f'{K} * 37 % 1000', 3)} || '-' || "
        f"{_digits(f'{C} % 100', 2)} || '-' || {_digits(f'{K} * 7 % 10000', 4)} || ' on file.'"
    ),
    "CREDIT_CARD": (
        f"'Paid with ' || {_digits(f'4000 + {K} % 999', 4)} || '-' || {_digits(f'{C} % 10000', 4)} || "
        f"'-' || {_digits(f'{K} * 31 % 10000', 4)} || '-' || {_digits(f'{K} * 17 % 10000', 4)} || "
        f"' or ' || {_digits(f'5000 + {C} % 999', 4)} || {_digits(f'{_LONG} % 1000000000', 9)} || "
        f"{_digits(f'{K} % 1000', 3)} || '.'"
    ),
    "US_BANK_NUMBER": (
        f"case when {K} % 3 = 0 then 'Transfer from bank account ' when {K} % 3 = 1 then "
        f"'Reference ' else 'The bank was closed on that long and quiet day when nobody came, see ' end "
        f"|| {_digits(f'{_LONG} % 100000000000', 12)} || ' now'"
    ),
    "IBAN_CODE": (
        f"'Wire to GB' || {_digits(f'{K} % 97', 2)} || 'WEST' || {_digits(f'{_LONG} % 100000000', 8)} "
        f"|| {_digits(f'{C} % 1000000', 6)} || ' or GB82 WEST 1234 5698 7654 ' || "
        f"{_digits(f'{K} % 40', 2)} || '.'"
    ),
    "CRYPTO": (
        f"'Coin 1BoatSLRHtKNngkdXEeobR76b53LETt' || {_pick(['pyT', '0yT', 'pIT'], K)} || ' or bc1q' || "
        f"{_pick(['w508d6qejxtdg4y5r3zarvary', 'shortx', 'w508d6bejxtdg4y5r3zarvar'], C)} || '.'"
    ),
    "US_PASSPORT": (
        f"{_pick(['Passport no ', 'Ticket ', 'Travel document '], K)} || "
        f"{_pick(['', 'C', 'cc'], C)} || {_digits(f'{_LONG} % 100000000', 8)} || "
        f"{_pick(['1', ''], C)} || '!'"
    ),
    "UK_NHS": (
        f"'NHS ' || {_digits(f'{K} * 13 % 1000', 3)} || {_pick([' ', '', '-'], K)} || "
        f"{_digits(f'{C} % 1000', 3)} || {_pick([' ', '', '-'], K)} || {_digits(f'{_LONG} % 10000', 4)} "
        "|| ' seen'"
    ),
    "MEDICAL_LICENSE": (
        f"'Prescriber AB' || {_digits(f'{_LONG} % 10000000', 7)} || ' and ' || "
        f"{_pick(['B', 'b', 'BX'], C)} || 'F' || {_digits(f'{K} * 11 % 10000000', 7)}"
    ),
    "EMAIL_ADDRESS": (
        f"'Mail é' || {_pick(['', 'a.', 'x+y%'], K)} || 'user' || cast({C} as string) || "
        f"{_pick(['@', ' @', '@@'], C)} || 'mail' || cast({K} % 9 as string) || "
        f"{_pick(['.example.com', '.co', '.x', '-x.org', ''], K)} || ' today'"
    ),
    "PHONE_NUMBER": (
        f"'Call ' || {_pick(['+1 (', '(', '', '+44-', '1'], K)} || {_digits(f'{C} % 1000', 3)} || "
        f"{_pick([') ', ')', '-', '.', ''], K)} || {_digits(f'{_LONG} % 1000', 3)} || "
        f"{_pick(['-', '.', ' ', '/'], C)} || {_digits(f'{K} % 10000', 4)} || ' or +' || "
        f"{_digits(f'{_LONG} % 1000000000', 10)} || ','"
    ),
    "PERSON": (
        f"'Signed by ' || {_pick(['John', 'Mary', 'Xanthor', 'Johnny', 'Samuel'], K)} || "
        f"{_pick([' Smith', ' van Dyke', ' Lee Jones Brown', 's', ''], C)} || ' in person. Alice'"
    ),
    "US_DRIVER_LICENSE": (
        f"{_pick(['Driver license ', 'Locker ', 'Permit '], K)} || {_pick(['D', 'DD', 'd'], C)} || "
        f"{_digits(f'{_LONG} % 10000000', 7)} || '.'"
    ),
    "IP_ADDRESS": (
        f"'Host ' || cast({K} % 300 as string) || '.' || cast({C} % 260 as string) || '.' || "
        f"cast({K} % 7 as string) || '.' || cast({C} % 256 as string) || ' via fe80:1:2:3:4:5:' || "
        f"{_pick(['ab:cd', 'ab', 'xy:cd', 'AB:00ff0'], K)} || ' ok'"
    ),
    "LOCATION": (
        f"'Ship to ' || {_pick(['Paris', 'New York', 'Parish', 'Mexico City', 'paris'], K)} || ', ' || "
        f"{_pick(['France', 'Atlantis', 'South Africa'], C)} || '.'"
    ),
    "URL": (
        f"'See ' || {_pick(['http://', 'https://', 'ftp://', 'xhttp://'], K)} || 'site' || "
        f"cast({C} as string) || '.example.com/a?b=' || cast({K} as string) || "
        f"{_pick([').', '', ' next'], C)}"
    ),
    "DATE_TIME": (
        f"'Due ' || cast({K} % 15 as string) || '/' || cast({C} % 35 as string) || '/' || "
        f"{_digits(f'1990 + {K} % 40', 4)} || ', paid 2026-' || {_digits(f'{C} % 12 + 1', 2)} || '-' || "
        f"{_digits(f'{K} % 28 + 1', 2)} || {_pick(['', 'T10:30', ' 23:59:59'], K)} || ', seen ' || "
        f"cast({C} % 33 as string) || '.' || cast({K} % 14 as string) || '.2024'"
    ),
    "NRP": (
        f"'A ' || {_pick(['German', 'Catholic', 'Germanic', 'Democrat'], K)} || ' and a ' || "
        f"{_pick(['Sikh', 'sikh', 'Swiss'], C)} || ' customer'"
    ),
    "TITLE": (
        f"'Dear ' || {_pick(['Mr. ', 'Mrs. ', 'Mr ', 'Dr.', 'XDr. ', 'Prof. '], K)} || 'Xu, cc ' || "
        f"{_pick(['Ms. Yo', 'Miss. Yo'], C)}"
    ),
    "MIXED": (
        f"{_pick(['John Smith', 'The buyer'], K)} || ' (user' || cast({C} as string) || "
        f"'@example.com) called from 555-' || {_digits(f'{C} % 1000', 3)} || '-' || "
        f"{_digits(f'{K} % 10000', 4)} || '. His SSN is 123-45-' || {_digits(f'{K} % 10000', 4)} || "
        f"' and the bank card is ' || {_pick(['4111-1111-1111-1111', '4111111111111111', 'lost'], C)} || "
        "' 😀.'"
    ),
}


def case_sql(kind: str) -> str:
    """SQL (either engine) for the derived texts of one kind."""
    return f"select {K} as id, {CASE_TEXT[kind]} as text from orders"


def cases(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    # Two narrow columns are dealt out evenly first: the work on the texts is many times that of reading, and a file's
    # row groups may be fewer than the cores.
    orders = table(spark, sf_dir, "orders").select(K, C).repartition(4 * spark.sparkContext.defaultParallelism)
    return orders.selectExpr(f"{K} as id", f"{CASE_TEXT[kind]} as text")
