"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import encodings, languages, leaks, mixture, pages, spans, tokens
from quern.runtime import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda spark, folder: languages.mislabelled(table(spark, folder, "documents")),
        "p1_languages": lambda spark, folder: languages.label_languages(table(spark, folder, "documents")),
        "p2_found": lambda spark, folder: mixture.scarce(table(spark, folder, "mixture_stages"), table(spark, folder, "lane_plans")),
        "p2_shares": lambda spark, folder: mixture.shares(table(spark, folder, "mixture_stages"), table(spark, folder, "lane_plans")),
        "p2_blocks": lambda spark, folder: mixture.blocks(table(spark, folder, "mixture_stages"), table(spark, folder, "lane_plans")),
        "p2_repeats": lambda spark, folder: mixture.repeats(table(spark, folder, "documents"), table(spark, folder, "mixture_stages")),
        "p2_documents": lambda spark, folder: mixture.placed(table(spark, folder, "documents"), table(spark, folder, "mixture_stages")),
        "p3_found": lambda spark, folder: leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_registry")).select("doc_id", "item_id"),
        "p3_spans": lambda spark, folder: leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_registry")),
        "p4_found": lambda spark, folder: pages.chrome_lines(table(spark, folder, "extracted_pages")),
        "p4_bodies": lambda spark, folder: pages.bodies(table(spark, folder, "extracted_pages")),
        "p5_found": lambda spark, folder: encodings.found(table(spark, folder, "clean_records")),
        "p5_restored": lambda spark, folder: encodings.inspect(table(spark, folder, "clean_records")),
        "p6_budget": lambda spark, folder: tokens.budget(table(spark, folder, "documents")),
        "p7_ids": lambda spark, folder: tokens.encode(table(spark, folder, "documents")),
        "p8_containers": lambda spark, folder: tokens.containers(table(spark, folder, "documents")),
        "p9_found": lambda spark, folder: spans.shared_pairs(table(spark, folder, "documents")),
        "p9_classes": lambda spark, folder: spans.shared_classes(table(spark, folder, "documents")),
        "p9_spans": lambda spark, folder: spans.shared_spans(table(spark, folder, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": mixture.SCARCE_SQL, "p2_shares": mixture.SHARES_SQL, "p2_repeats": mixture.REPEATS_SQL}
