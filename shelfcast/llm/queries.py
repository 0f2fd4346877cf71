"""Queries of the operators on the test tables, and SQL for those that one statement can express."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm.decontamination import op8_benchmark_decontamination
from shelfcast.llm.hard_negatives import ORACLE_SQL as HARD_NEGATIVES_SQL
from shelfcast.llm.hard_negatives import op11_hard_negatives
from shelfcast.llm.language_id import op2_language_id
from shelfcast.llm.ngram_jaccard import op5_ngram_jaccard_join
from shelfcast.llm.periodic_runs import op12_periodic_runs
from shelfcast.llm.pfair_mixing import op10_pfair_mixing
from shelfcast.llm.piece_spans import op13_piece_spans
from shelfcast.llm.quality_rules import op7_quality_rules
from shelfcast.llm.site_quality import op9_site_quality
from shelfcast.llm.suffix_dedup import op3_suffix_array_dedup
from shelfcast.llm.token_records import op1_token_records
from shelfcast.llm.toxicity import op4_toxicity
from shelfcast.llm.warc import op6_warc

Query = Callable[[SparkSession, str], DataFrame]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors the package once per application, so that tasks find it wherever the driver was started."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="shelfcast-package-"), "shelfcast_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "shelfcast")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def _shipped_first(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _shipped_first(query)
    for query in (
        op1_token_records, op2_language_id, op3_suffix_array_dedup, op4_toxicity, op5_ngram_jaccard_join, op6_warc,
        op7_quality_rules, op8_benchmark_decontamination, op9_site_quality, op10_pfair_mixing, op11_hard_negatives,
        op12_periodic_runs, op13_piece_spans,
    )
}
ORACLES = {"op11_hard_negatives": HARD_NEGATIVES_SQL}
