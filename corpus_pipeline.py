"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, secret scans
and best-fit packing, each on what the one before has kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of their
input; the last returns the places of token pieces in training sequences. Nulls,
empty and very long texts, ties, repeated rows, empty tables and further columns
have the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import materialise, table
from spindrift.llm.linededup import drop_boilerplate
from spindrift.llm.packing import pack_stage
from spindrift.llm.quality import keep_good
from spindrift.llm.secrets import hide_secrets
from spindrift.llm.simhash import keep_first

STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", keep_first),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_stage),
]

#: The label model and the search of components are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
