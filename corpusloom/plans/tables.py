"""The stored tables, and what their SQL twins have in common."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import dims
from corpusloom.operators import corpus

CLASSES = dims.INVENTED_CLASS
#: Period of the statistics; its complete years are 2002 to 2024.
START, END = date(2001, 2, 1), date(2025, 1, 31)
#: First and last day of each legislature, in order.
TERMS = [(51, date(1999, 2, 1), date(2003, 1, 31)), (52, date(2003, 2, 1), date(2007, 1, 31)), (53, date(2007, 2, 1), date(2011, 1, 31)), (54, date(2011, 2, 1), date(2015, 1, 31)), (55, date(2015, 2, 1), date(2019, 1, 31)), (56, date(2019, 2, 1), date(2023, 1, 31)), (57, date(2023, 2, 1), date(2027, 1, 31))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with dates, classes and regions."""
    return corpus.classified(corpus.with_dates(table(spark, sf_dir, "speeches")), CLASSES)


_DATE = r"CASE WHEN regexp_full_match(data, '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(data, '%d/%m/%Y') AS DATE) END"
#: WITH list that ends in ``clean``, the SQL twin of ``prepared``.
CLEAN = ", ".join(
    [
        dims.sql_values(dims.canonical_spellings(CLASSES), "sp", "up", "name"),
        dims.sql_values({**dims.PARTY_CLASS, **CLASSES}, "c7", "party", "class7"),
        dims.sql_values(dims.classes_3(CLASSES), "c3", "party", "class3"),
        dims.sql_values(dims.REGION, "rg", "uf", "regiao"),
        f"dated AS (SELECT *, {_DATE} AS data_dt FROM speeches)",
        f"""named AS (SELECT d.* EXCLUDE (partido), CASE WHEN NOT regexp_full_match(coalesce(estado, ''), '[A-Z]{{2}}') THEN '{dims.GUEST}' ELSE coalesce(sp.name, trim(partido)) END AS partido
FROM dated d LEFT JOIN sp ON sp.up = upper(trim(partido)) WHERE data_dt IS NOT NULL)""",
        f"""clean AS (SELECT n.*, CAST(year(data_dt) AS BIGINT) AS ano, CAST(month(data_dt) AS BIGINT) AS mes, coalesce(class7, '{dims.NO_CLASS}') AS espectro7, coalesce(class3, '{dims.NO_CLASS}') AS espectro,
coalesce(regiao, '{dims.NO_REGION}') AS regiao FROM named n LEFT JOIN c7 ON c7.party = partido LEFT JOIN c3 ON c3.party = partido LEFT JOIN rg ON rg.uf = estado)""",
    ]
)
