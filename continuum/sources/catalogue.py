"""Run catalogue, model registry and comparison groups: small, fixed configuration.

Users edit or pass their own tuples; nothing here grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimensions built from these tuples may be broadcast or inlined up to this many rows.
BROADCAST_ROWS = 10_000  # configuration rows of some hundred bytes


class Model(NamedTuple):
    model: str
    is_base: bool = False
    is_reasoning: bool = False
    is_vlm: bool = False
    is_mistral: bool = False


class Run(NamedTuple):
    run_no: int
    run: str
    model: str
    tensor_parallel_size: int = 1
    thinking: bool = False
    max_tokens_mult: float = 1.3
    quantization: str | None = None


class GroupMember(NamedTuple):
    group_id: str
    kind: str
    ord: int
    run_no: int


# Class membership of the 18 models of the study.
MODELS = (
    Model("Qwen/Qwen2.5-32B", is_base=True),
    Model("Qwen/Qwen2.5-32B-Instruct"),
    Model("mistralai/Mistral-Small-24B-Base-2501", is_base=True, is_mistral=True),
    Model("mistralai/Mistral-Small-24B-Instruct-2501", is_mistral=True),
    Model("google/gemma-4-31B", is_base=True, is_vlm=True),
    Model("google/gemma-4-31B-it", is_vlm=True),
    Model("meta-llama/Llama-4-Scout-17B-16E", is_base=True, is_vlm=True),
    Model("meta-llama/Llama-4-Scout-17B-16E-Instruct", is_vlm=True),
    Model("Qwen/Qwen3-32B", is_reasoning=True),
    Model("Qwen/Qwen3.5-35B-A3B", is_reasoning=True, is_vlm=True),
    Model("Qwen/QwQ-32B", is_reasoning=True),
    Model("allenai/Olmo-3-1125-32B", is_base=True),
    Model("allenai/Olmo-3.1-32B-Instruct-SFT"),
    Model("allenai/Olmo-3.1-32B-Instruct-DPO"),
    Model("allenai/Olmo-3.1-32B-Instruct"),
    Model("allenai/Olmo-3-32B-Think-SFT", is_reasoning=True),
    Model("allenai/Olmo-3-32B-Think-DPO", is_reasoning=True),
    Model("allenai/Olmo-3.1-32B-Think", is_reasoning=True),
)

# The class each model is meant to have; the registry above is checked against it.
EXPECTED_CLASSES = (
    ("Qwen/Qwen2.5-32B", "base"),
    ("Qwen/Qwen2.5-32B-Instruct", "instruct"),
    ("mistralai/Mistral-Small-24B-Base-2501", "base"),
    ("mistralai/Mistral-Small-24B-Instruct-2501", "instruct"),
    ("google/gemma-4-31B", "base"),
    ("google/gemma-4-31B-it", "instruct"),
    ("meta-llama/Llama-4-Scout-17B-16E", "base"),
    ("meta-llama/Llama-4-Scout-17B-16E-Instruct", "instruct"),
    ("Qwen/Qwen3-32B", "reasoning"),
    ("Qwen/Qwen3.5-35B-A3B", "reasoning"),
    ("Qwen/QwQ-32B", "reasoning"),
    ("allenai/Olmo-3-1125-32B", "base"),
    ("allenai/Olmo-3.1-32B-Instruct-SFT", "instruct"),
    ("allenai/Olmo-3.1-32B-Instruct-DPO", "instruct"),
    ("allenai/Olmo-3.1-32B-Instruct", "instruct"),
    ("allenai/Olmo-3-32B-Think-SFT", "reasoning"),
    ("allenai/Olmo-3-32B-Think-DPO", "reasoning"),
    ("allenai/Olmo-3.1-32B-Think", "reasoning"),
)

# The 20 runs of the study, in their published order.
RUNS = (
    Run(1, "qwen25_32b_base", "Qwen/Qwen2.5-32B"),
    Run(2, "qwen25_32b_instruct", "Qwen/Qwen2.5-32B-Instruct"),
    Run(3, "mistral_small_24b_base", "mistralai/Mistral-Small-24B-Base-2501"),
    Run(4, "mistral_small_24b_instruct", "mistralai/Mistral-Small-24B-Instruct-2501"),
    Run(5, "gemma4_31b_base", "google/gemma-4-31B"),
    Run(6, "gemma4_31b_it", "google/gemma-4-31B-it"),
    Run(7, "llama4_scout_base", "meta-llama/Llama-4-Scout-17B-16E", 4),
    Run(8, "llama4_scout_instruct", "meta-llama/Llama-4-Scout-17B-16E-Instruct", 4),
    Run(9, "qwen3_32b_nothinking", "Qwen/Qwen3-32B"),
    Run(10, "qwen3_32b_thinking", "Qwen/Qwen3-32B", 1, True, 2.0),
    Run(11, "qwen35_35b_a3b_nothinking", "Qwen/Qwen3.5-35B-A3B"),
    Run(12, "qwen35_35b_a3b_thinking", "Qwen/Qwen3.5-35B-A3B", 1, True, 2.0),
    Run(13, "qwq_32b", "Qwen/QwQ-32B", 1, True, 2.0),
    Run(14, "olmo3_base", "allenai/Olmo-3-1125-32B"),
    Run(15, "olmo31_instruct_sft", "allenai/Olmo-3.1-32B-Instruct-SFT"),
    Run(16, "olmo31_instruct_dpo", "allenai/Olmo-3.1-32B-Instruct-DPO"),
    Run(17, "olmo31_instruct", "allenai/Olmo-3.1-32B-Instruct"),
    Run(18, "olmo3_think_sft", "allenai/Olmo-3-32B-Think-SFT", 1, True, 2.0),
    Run(19, "olmo3_think_dpo", "allenai/Olmo-3-32B-Think-DPO", 1, True, 2.0),
    Run(20, "olmo31_think", "allenai/Olmo-3.1-32B-Think", 1, True, 2.0),
)

# Which runs are compared. Pairs, one run on its own, and two chains of stages.
COMPARISON_GROUPS = (
    GroupMember("qwen25", "pair", 1, 1),
    GroupMember("qwen25", "pair", 2, 2),
    GroupMember("mistral_small", "pair", 1, 3),
    GroupMember("mistral_small", "pair", 2, 4),
    GroupMember("gemma4", "pair", 1, 5),
    GroupMember("gemma4", "pair", 2, 6),
    GroupMember("llama4_scout", "pair", 1, 7),
    GroupMember("llama4_scout", "pair", 2, 8),
    GroupMember("qwen3_thinking", "pair", 1, 9),
    GroupMember("qwen3_thinking", "pair", 2, 10),
    GroupMember("qwen35_thinking", "pair", 1, 11),
    GroupMember("qwen35_thinking", "pair", 2, 12),
    GroupMember("qwq", "single", 1, 13),
    GroupMember("olmo3_instruct", "stages", 1, 14),
    GroupMember("olmo3_instruct", "stages", 2, 15),
    GroupMember("olmo3_instruct", "stages", 3, 16),
    GroupMember("olmo3_instruct", "stages", 4, 17),
    GroupMember("olmo3_think", "stages", 1, 14),
    GroupMember("olmo3_think", "stages", 2, 18),
    GroupMember("olmo3_think", "stages", 3, 19),
    GroupMember("olmo3_think", "stages", 4, 20),
)

_MODEL_SCHEMA = "model string, is_base boolean, is_reasoning boolean, is_vlm boolean, is_mistral boolean"
_RUN_SCHEMA = (
    "run_no int, run string, model string, tensor_parallel_size int, thinking boolean, "
    "max_tokens_mult double, quantization string"
)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from configuration, broadcast if it has few rows and joined as any other if not."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def models(spark: SparkSession, registry: Sequence[Model] = MODELS) -> DataFrame:
    return dimension(spark, registry, _MODEL_SCHEMA)


def expected_models(spark: SparkSession) -> DataFrame:
    return dimension(spark, EXPECTED_CLASSES, "model string, expected_type string")


def group_members(
    spark: SparkSession, kind: str, members: Sequence[GroupMember] = COMPARISON_GROUPS, runs: Sequence[Run] = RUNS
) -> DataFrame:
    """``(group_id, ord, run)`` of one kind of comparison."""
    names = {r.run_no: r.run for r in runs}
    rows = [(m.group_id, m.ord, names[m.run_no]) for m in members if m.kind == kind]
    return dimension(spark, rows, "group_id string, ord int, run string")


def classify(df: DataFrame, registry: Sequence[Model] = MODELS) -> DataFrame:
    """Add the class flags of ``model``. A model that is not registered counts as instruct."""
    flags = ["is_base", "is_reasoning", "is_vlm", "is_mistral"]
    known = models(df.sparkSession, registry)
    named = F.when(F.col("is_base"), "base").when(F.col("is_reasoning"), "reasoning").otherwise("instruct")
    return df.join(known, "model", "left").na.fill(False, flags).withColumn("model_class", named)


def with_run_flags(runs: DataFrame, registry: Sequence[Model] = MODELS) -> DataFrame:
    """Add prompt mode and the two thinking flags; both need a reasoning model *and* the switch."""
    thinks = F.col("is_reasoning") & F.col("thinking")
    return (
        classify(runs, registry)
        .withColumn("prompt_mode", F.when(F.col("is_base"), "base_raw").otherwise("chat"))
        .withColumn("enable_thinking", thinks)
        .withColumn("strip_think", thinks)
    )


def run_table(spark: SparkSession, runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS) -> DataFrame:
    """The run catalogue with its class and mode columns, as a broadcastable table."""
    table = with_run_flags(dimension(spark, runs, _RUN_SCHEMA), registry)
    return F.broadcast(table) if len(runs) <= BROADCAST_ROWS else table


def run_structs(
    fields: Sequence[str], runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS
) -> Column:
    """The named fields of all runs as one literal array."""
    by_name = {m.model: m for m in registry}
    rows = []
    for r in runs:
        m = by_name.get(r.model, Model(r.model))
        thinks = m.is_reasoning and r.thinking
        known = {
            "run_no": F.lit(r.run_no),
            "run": F.lit(r.run),
            "model": F.lit(r.model),
            "prompt_mode": F.lit("base_raw" if m.is_base else "chat"),
            "is_reasoning": F.lit(m.is_reasoning),
            "enable_thinking": F.lit(thinks),
            "strip_think": F.lit(thinks),
            "tensor_parallel_size": F.lit(r.tensor_parallel_size),
            "quantization": F.lit(r.quantization).cast("string"),
            "max_tokens_mult": F.lit(float(r.max_tokens_mult)),
        }
        rows.append(F.struct(*[known[f].alias(f) for f in fields]))
    return F.array(*rows)


def fan_out(
    df: DataFrame, fields: Sequence[str], runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS
) -> DataFrame:
    """One row per input row and run, with the named run fields. Narrow: no join, no shuffle."""
    return df.select("*", F.inline(run_structs(fields, runs, registry)))


def stripping_runs(runs: Sequence[Run] = RUNS, registry: Sequence[Model] = MODELS) -> list[str]:
    """Names of the runs whose outputs carry reasoning to strip."""
    reasoning = {m.model for m in registry if m.is_reasoning}
    return [r.run for r in runs if r.thinking and r.model in reasoning]
