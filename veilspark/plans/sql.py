"""What SQL sees of the library: the functions ``entropy`` and ``restore`` and the view ``categories``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilspark.functions import patterns as P
from veilspark.functions.text import ENTROPY_SQL
from veilspark.operators.reports import categories_table

# Unknown words stay; a null text stays null.
RESTORE_SQL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION restore(reply STRING, names MAP<STRING, STRING>) RETURNS STRING RETURN
  array_join(
    transform(
      split(reply, r'{P.PLACEHOLDER}', -1),
      (piece, i) -> concat(
        piece,
        coalesce(element_at(names, get(regexp_extract_all(reply, r'{P.PLACEHOLDER}', 0), i)),
                 get(regexp_extract_all(reply, r'{P.PLACEHOLDER}', 0), i), ''))),
    '')
"""


def register(spark: SparkSession) -> None:
    """Create the functions and the view in the session. ``ScanResult.create_views`` adds the results of a scan."""
    spark.sql(ENTROPY_SQL)
    spark.sql(RESTORE_SQL)
    categories_table(spark).createOrReplaceTempView("categories")
