"""Model response texts, made from part rows and from whole conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.functions import responses as answer
from kinefuse.operators.roles import maps_from_responses
from kinefuse.workloads.registry import query, table


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """Six kinds of answers: tagged, untagged, nested, two blocks, lines only, broken JSON with lines."""
    name, brand = F.col("p_name"), F.col("p_brand")
    block = F.concat(F.lit('{"speed_col": "'), name, F.lit('", "flow_col": null, "time_col": " none ", "k": 1.0}'))
    turn = F.col("p_partkey") % 6
    text = (
        F.when(turn == 0, F.concat(F.lit("<think>\n "), brand, F.lit(" }{ \n</think>\n"), block))
        .when(turn == 1, F.concat(brand, F.lit(" says\t\n"), block, F.lit(" end")))
        .when(turn == 2, F.concat(F.lit("<think>"), brand, F.lit('{"a": {"speed_col": "'), name, F.lit('"}, "b": {}}')))
        .when(turn == 3, F.concat(F.lit('{"flow_col": "x"} then '), block))
        .when(
            turn == 4,
            F.concat(
                F.lit("<think>why</think>\nspeed_col = \""), name, F.lit("\",\nflow_col=NULL\nnote\nintensity_col='"),
                brand, F.lit("'\nspeed_col=a=b"),
            ),
        )
        .otherwise(F.concat(F.lit("time_col="), name, F.lit("\n{oops: "), brand, F.lit("}")))
    )
    return table(spark, folder, "part").select("p_partkey", text.alias("text"))


def _whole_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with a block behind the whole text."""
    block = F.concat(F.lit('{"role": "'), "role", F.lit('", "inner": {"turn": '), F.col("turn").cast("string"), F.lit("}}"))
    text = F.concat(F.translate("text", "{}", "()"), F.lit("\n"), block, F.lit("\nbye"))
    return table(spark, folder, "conversations", "conv_id").select("conv_id", "turn", "role", text.alias("answer"))


def _entry(column: str, name: str) -> Column:
    return F.try_element_at(column, F.lit(name))


@query(
    """
SELECT conv_id, turn, role AS found, CAST(turn AS VARCHAR) AS inner_turn,
       CAST(length(role) + length(CAST(turn AS VARCHAR)) + 33 AS BIGINT) AS characters
FROM conversations"""
)
def response_json(spark: SparkSession, folder: str) -> DataFrame:
    """Last balanced JSON block behind whole texts."""
    read = _whole_turns(spark, folder).select(
        "conv_id", "turn", answer.last_json(F.col("answer")).alias("record"), answer.last_json_text(F.col("answer")).alias("block")
    )
    return read.select(
        "conv_id",
        "turn",
        _entry("record", "role").alias("found"),
        F.get_json_object(_entry("record", "inner"), "$.turn").alias("inner_turn"),
        F.length("block").cast("long").alias("characters"),
    )


@query(
    """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || ' }{' WHEN 1 THEN p_brand || ' says' WHEN 2 THEN p_brand
    WHEN 3 THEN '{"flow_col": "x"} then' WHEN 4 THEN 'why' ELSE 'time_col=' || p_name END AS reasoning
FROM part"""
)
def response_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    """Reasoning inside the tags, or before the last block."""
    return _parts(spark, folder).select("p_partkey", answer.reasoning(F.col("text")).alias("reasoning"))


_SQL_FIELDS = """
SELECT p_partkey,
       CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN p_name WHEN p_partkey % 6 = 4 THEN 'a=b' END AS speed_col,
       CASE WHEN p_partkey % 6 = 4 THEN p_brand END AS intensity_col,
       CASE WHEN p_partkey % 6 = 5 THEN p_name END AS time_col,
       CASE p_partkey % 6 WHEN 2 THEN 'a,b' WHEN 4 THEN 'speed_col,intensity_col' WHEN 5 THEN 'time_col' ELSE 'speed_col,k' END AS names
FROM part"""


@query(_SQL_FIELDS)
def response_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Fields from the JSON block, or from KEY=VALUE lines."""
    read = _parts(spark, folder).select("p_partkey", answer.response_fields(F.col("text")).alias("fields"))
    return read.select(
        "p_partkey",
        _entry("fields", "speed_col").alias("speed_col"),
        _entry("fields", "intensity_col").alias("intensity_col"),
        _entry("fields", "time_col").alias("time_col"),
        F.array_join(F.map_keys("fields"), ",").alias("names"),
    )


@query(
    """
SELECT CAST(p_partkey AS VARCHAR) AS source,
       CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN p_name WHEN p_partkey % 6 = 4 THEN 'a=b' END AS speed_col,
       CAST(NULL AS VARCHAR) AS flow_col, CASE WHEN p_partkey % 6 = 4 THEN p_brand END AS intensity_col,
       CAST(NULL AS VARCHAR) AS distance_col, CASE WHEN p_partkey % 6 = 5 THEN p_name END AS time_col,
       CAST(NULL AS VARCHAR) AS occupancy_col, CAST(0.99 AS DOUBLE) AS confidence_score
FROM part"""
)
def response_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Kinematic maps from the answers."""
    answers = _parts(spark, folder).select(F.col("p_partkey").cast("string").alias("source"), "text")
    return maps_from_responses(answers)


@query(
    """
SELECT p_partkey, CASE p_partkey % 6
    WHEN 2 THEN 'speed_col,flow_col,intensity_col,distance_col,time_col,occupancy_col'
    WHEN 4 THEN 'flow_col,distance_col,time_col,occupancy_col'
    WHEN 5 THEN 'speed_col,flow_col,intensity_col,distance_col,occupancy_col'
    ELSE 'flow_col,intensity_col,distance_col,time_col,occupancy_col' END AS missing
FROM part"""
)
def response_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Required keys each answer lacks."""
    fields = answer.response_fields(F.col("text"))
    return _parts(spark, folder).select(
        "p_partkey", F.array_join(answer.missing_roles(fields), ",").alias("missing")
    )
