"""Text logs of a service as telemetry: metric exposition lines and token-stream chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: one exposition line, name, optional labels, number.
METRIC_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+([-+]?(?:[0-9]*\.?[0-9]+)(?:[eE][-+]?[0-9]+)?)$"


def metric_rows(scrapes: DataFrame, body: str = "body") -> DataFrame:
    """Exposition bodies to one row per sample. Comments and malformed lines drop; a body may be a
    JSON-quoted string."""
    text = F.col(body)
    quoted = F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')) & (F.length(text) >= 2)
    plain = F.when(quoted, F.coalesce(F.from_json(F.concat(F.lit('{"b":'), text, F.lit("}")), "b string")["b"], text)).otherwise(text)
    lines = scrapes.withColumn("_line", F.explode(F.split(plain, r"\r?\n"))).withColumn("_line", F.trim("_line"))
    value = F.regexp_extract("_line", METRIC_LINE, 3)
    kept = lines.where(F.col("_line").rlike(METRIC_LINE))
    return kept.select(
        *[c for c in scrapes.columns if c != body], F.regexp_extract("_line", METRIC_LINE, 1).alias("metric_name"),
        value.try_cast("double").alias("metric_value"), F.regexp_extract("_line", METRIC_LINE, 2).alias("labels"))


def counter_values(rows: DataFrame, keys: Sequence[str], column: str = "counters") -> DataFrame:
    """Packed ``name=value;name=value`` counters to rows."""
    return rows.select(*keys, F.explode(F.str_to_map(F.col(column), F.lit(";"), F.lit("="))).alias("counter", "_v")).select(
        *keys, "counter", F.col("_v").try_cast("bigint").alias("value"))


CHUNK = (
    "choices array<struct<text:string,delta:struct<content:string>,finish_reason:string>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_n:bigint,predicted_n:bigint,prompt_ms:double,predicted_ms:double>, "
    "timings struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_n:bigint,predicted_n:bigint,prompt_ms:double,predicted_ms:double>"
)


def chunk_payload(line: Column) -> Column:
    """Payload of one stream line; null for blanks, comments and the end mark."""
    text = F.trim(line)
    body = F.when(F.startswith(text, F.lit("data:")), F.trim(F.substring(text, 6, 1 << 30))).otherwise(text)
    return F.when((text != "") & ~F.startswith(text, F.lit(":")) & (body != "") & (body != "[DONE]"), body)


def stream_timing(chunks: DataFrame, keys: Sequence[str], ts: str = "ts", line: str = "line") -> DataFrame:
    """First content time, last finish reason, token usage and completion per request.

    Every output is a min, max or max-by, so chunks combine before the shuffle.
    """
    df = chunks.withColumns({"_p": chunk_payload(F.col(line)), "_done": F.trim(F.regexp_replace(line, "^data:", "")) == "[DONE]"})
    df = df.withColumn("_c", F.from_json("_p", CHUNK))
    first = F.get(F.col("_c.choices"), F.lit(0))
    content = F.coalesce(F.nullif(first["text"], F.lit("")), first["delta"]["content"], F.lit(""))
    use = F.coalesce("_c.usage", "_c.timings")
    last = lambda e: F.max_by(e, F.when(e.isNotNull(), F.col(ts)))
    return df.groupBy(*keys).agg(
        F.min(F.when(content != "", F.col(ts))).alias("first_token_time"), F.max(ts).alias("completion_time"),
        last(first["finish_reason"]).alias("finish_reason"),
        last(F.coalesce(use["prompt_tokens"], use["prompt_n"])).alias("server_prompt_tokens"),
        last(F.coalesce(use["completion_tokens"], use["predicted_n"])).alias("server_output_tokens"),
        last(use["prompt_ms"] / 1000.0).alias("server_prompt_seconds"), last(use["predicted_ms"] / 1000.0).alias("server_generation_seconds"),
        F.count_if(content != "").alias("content_chunks"), F.max(F.col("_done").cast("int")).alias("saw_end"))
