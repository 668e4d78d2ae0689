"""Small fixed reference tables (SRC-06, SRC-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.intel import internal_list, mitre_table, sample_provider
from ..operators.investigate import template_hypotheses, template_steps
from ..operators.parse import source_catalogue
from ..operators.prioritise import sla_table
from ..operators.respond import action_table
from ..operators.retrieve import default_knowledge
from ..operators.rules import rule_catalogue


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """Every reference table by name; each is a constant of this library, not data that grows."""
    return {
        "mitre_technique": mitre_table(spark), "intel_provider": sample_provider(spark), "internal_list": internal_list(spark), "sla": sla_table(spark),
        "response_action": action_table(spark), "template_step": template_steps(spark), "template_hypothesis": template_hypotheses(spark),
        "knowledge_chunk": default_knowledge(spark), "rule": rule_catalogue(spark), "source": source_catalogue(spark),
    }


def register_views(spark: SparkSession) -> None:
    for name, df in dimensions(spark).items():
        df.createOrReplaceTempView(name)
