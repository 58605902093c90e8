"""Batch inference with a model the caller brings, and what is made of its answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.functions.parsing import (
    chat_content,
    field_flag,
    field_list,
    field_number,
    field_text,
    parse_model_json,
)
from imgcurate.operators.geometry import fit_within
from imgcurate.operators.ranking import join_in_order, with_position
from imgcurate.session import written

Model = Callable[[pd.DataFrame], pd.Series]

WIRE_SHAPES = ("generate", "chat")


def request_size(df: DataFrame, max_size: int = 1024) -> DataFrame:
    """M1: ``sent_w``, ``sent_h``: size of the picture that is sent."""
    w, h = fit_within(F.col("width"), F.col("height"), max_size)
    return df.withColumns({"sent_w": w, "sent_h": h})


def build_requests(
    df: DataFrame,
    prompt: Column | str,
    model: str,
    shape: str = "generate",
    temperature: float = 0.1,
    max_tokens: int = 500,
    encoded: str = "encoded",
    media_type: str = "image/png",
) -> DataFrame:
    """M1: ``request`` JSON from the file bytes in ``encoded``."""
    text = F.lit(prompt) if isinstance(prompt, str) else prompt
    # Spark breaks base64 into lines; JSON wants it in one piece.
    data = F.translate(F.base64(encoded), "\r\n", "")
    if shape == "generate":
        body = F.struct(
            F.lit(model).alias("model"),
            text.alias("prompt"),
            F.array(data).alias("images"),
            F.lit(True).alias("stream"),
            F.struct(F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("num_predict")).alias("options"),
        )
    elif shape == "chat":
        nothing = F.lit(None).cast("string")
        url = F.struct(F.concat(F.lit(f"data:{media_type};base64,"), data).alias("url"))
        no_url = F.lit(None).cast("struct<url:string>")
        # to_json leaves null fields out, so the two parts get different keys.
        parts = F.array(
            F.struct(F.lit("text").alias("type"), text.alias("text"), no_url.alias("image_url")),
            F.struct(F.lit("image_url").alias("type"), nothing.alias("text"), url.alias("image_url")),
        )
        body = F.struct(
            F.lit(model).alias("model"),
            F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages"),
            F.lit(temperature).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    else:
        raise ValueError(f"shape must be one of {WIRE_SHAPES}")
    return df.withColumn("request", F.to_json(body))


def assign_endpoint(df: DataFrame, urls: str, default: str, index: str = "image_id") -> DataFrame:
    """M2: give rows to the endpoints in turn, by their place in the order of ``index``.

    Places come from a sort of the index alone; gaps in it do not matter.
    """
    listed = F.filter(F.transform(F.split(F.lit(urls), ","), lambda u: F.trim(u)), lambda u: u != "")
    known = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(default)))
    placed = with_position(df.select(index).distinct(), [index], position="_place", total="_n").drop("_n")
    chosen = F.get(known, F.pmod("_place", F.size(known)).cast("int"))
    return df.join(placed, index, "left").withColumn("endpoint", chosen).drop("_place")


def map_model(
    df: DataFrame,
    model: Model,
    inputs: Sequence[str],
    partitions: int | None = None,
    out: str = "response",
    endpoint: str | None = None,
    calls: int = 1,
) -> DataFrame:
    """M3: add ``response`` and ``error``, one of which is null.

    The model gets batches of ``inputs`` and returns one text per row. When it
    raises, the batch is tried row by row, so only the rows at fault carry the
    error: it is halved until the rows at fault are alone, so good rows are asked few
    times. The other columns do not leave the JVM.

    Without bounds nothing is shuffled. ``partitions`` bounds how many calls run at a time.
    ``endpoint`` names a column of servers, each of which gets at most ``calls`` at a time: a
    partition is one of the calls that one server can take. Rows are dealt to the bounded
    partitions by a shuffle, so what comes before keeps its tasks. Rows without an endpoint
    share the partitions of one more.
    """
    names = list(inputs)

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        def ask(part: pd.DataFrame) -> list:
            try:
                got = [(a, None) for a in model(part.reset_index(drop=True))]
                if len(got) != len(part):
                    raise ValueError("the model must answer every row")
                return got
            except Exception as e:
                if len(part) == 1:
                    return [(None, str(e))]
                half = len(part) // 2
                return ask(part.iloc[:half]) + ask(part.iloc[half:])

        rows = [
            (None, error or "No response received") if answer is None or error else (str(answer), None)
            for answer, error in (ask(batch) if len(batch) else [])
        ]
        return pd.DataFrame(rows, columns=["response", "error"], dtype="object")

    # Nondeterministic: the optimizer must not run a model twice or move it.
    call = F.pandas_udf(lambda batch: answers(batch), "response string, error string").asNondeterministic()
    if endpoint is not None:
        # As many as there are servers.
        servers = [r[0] for r in df.select(endpoint).distinct().collect() if r[0] is not None]
        number = F.coalesce(F.array_position(F.array(*map(F.lit, sorted(servers))), F.col(endpoint)).cast("int"), F.lit(0)) if servers else F.lit(0)
        slot = number * calls + F.pmod(F.xxhash64(*names), F.lit(calls)).cast("int")
        spread = df.repartitionById((len(servers) + 1) * calls, slot)
    else:
        spread = df if partitions is None else df.repartition(partitions)
    return (
        spread.withColumn("_answer", call(F.struct(*names)))
        .withColumns({out: F.col("_answer.response"), "error": F.col("_answer.error")})
        .drop("_answer")
    )


def map_with_fallback(
    df: DataFrame, model: Model, inputs: Sequence[str], original: str, partitions: int | None = None, endpoint: str | None = None, calls: int = 1
) -> DataFrame:
    """M4: transform a column; a row that fails keeps its original and says so. Calls are bounded as in ``map_model``."""
    mapped = map_model(df, model, inputs, partitions, "_result", endpoint, calls)
    return mapped.withColumns(
        {"result": F.coalesce("_result", original), "used_fallback": F.col("_result").isNull()}
    ).drop("_result")


def assemble_stream(chunks: DataFrame, key: str = "request_id") -> DataFrame:
    """M5: join fragments ``(key, seq, fragment, done)`` in order, up to the first that is done."""
    ends = chunks.filter("done").groupBy(key).agg(F.min("seq").alias("_end"))
    used = chunks.join(ends, key, "left").filter("_end is null or seq <= _end")
    return join_in_order(used, [key], "seq", "fragment", "", "response")


def extract_chat_content(df: DataFrame, response: str = "response") -> DataFrame:
    """M6"""
    return df.withColumn("content", chat_content(F.col(response)))


def model_filter(df: DataFrame, min_quality: int | float = 5, response: str = "response") -> DataFrame:
    """M9: ``keep``, ``quality``, ``reason`` and a log line. What cannot be read is kept."""
    text = field_text(F.col("_data"), "quality")
    number = text.try_cast("double")
    quality = F.coalesce(number, F.lit(5.0))
    shown = F.when(number.isNotNull(), text).otherwise("5")
    poor = quality < min_quality
    asked = F.coalesce(field_flag(F.col("_data"), "keep"), F.lit(True))
    read = F.col("_data").isNotNull()
    return (
        df.withColumn("_data", parse_model_json(F.col(response)))
        .withColumns(
            {
                "keep": ~read | (asked & ~poor),
                "quality": F.when(read, quality).otherwise(5.0),
                "reason": F.when(~read, "parse error — keeping by default")
                .when(poor, F.concat(F.lit("quality "), shown, F.lit(f" < min {min_quality}")))
                .otherwise(F.coalesce(field_text(F.col("_data"), "reason"), F.lit("no reason"))),
                "_shown": F.when(read, shown).otherwise("5"),
            }
        )
        .withColumn(
            "log_line",
            F.concat(
                F.when(F.col("keep"), "KEEP ").otherwise("REJECT "),
                "filename",
                F.lit(": q="),
                "_shown",
                F.lit(" — "),
                "reason",
            ),
        )
        .drop("_data", "_shown")
    )


# Fields of an analysis answer.
ANALYSIS_NUMBERS = ("quality_score", "aesthetic_score")
ANALYSIS_TEXTS = ("pose", "camera_angle", "framing", "lighting", "setting", "reason")
ANALYSIS_LISTS = ("issues", "tags")
CORRECTIONS = (
    "brightness", "contrast", "sharpness",
    "crop_left_pct", "crop_right_pct", "crop_top_pct", "crop_bottom_pct",
)


def analysis_record(value: Column) -> Column:
    """The analysis answer as a typed struct."""
    return F.struct(
        *[field_number(value, f).alias(f) for f in ANALYSIS_NUMBERS],
        *[field_text(value, f).alias(f) for f in ANALYSIS_TEXTS],
        *[field_list(value, f, "string").alias(f) for f in ANALYSIS_LISTS],
        field_list(value, "subject_bbox", "double").alias("subject_bbox"),
        field_flag(value, "keep").alias("keep"),
        F.struct(*[field_number(value, f"corrections.{f}").alias(f) for f in CORRECTIONS]).alias("corrections"),
    )


def model_analyze(df: DataFrame, response: str = "response") -> DataFrame:
    """``metadata`` struct and the whole answer as JSON in ``record``, or ``error`` and the answer in ``raw``."""
    data = F.col("_data")
    read = data.isNotNull()

    def shown(field: str) -> Column:
        return F.coalesce(field_text(data, field), F.lit("?"))

    tags = F.array_join(F.slice(F.coalesce(field_list(data, "tags", "string"), F.array().cast("array<string>")), 1, 5), ", ")
    line = F.concat(
        "filename",
        F.lit(": quality="), shown("quality_score"),
        F.lit(" aesthetic="), shown("aesthetic_score"),
        F.lit(" pose="), shown("pose"),
        F.lit(" angle="), shown("camera_angle"),
        F.lit(" tags=["), tags, F.lit("]"),
    )
    start = F.coalesce(F.col(response), F.lit(""))
    return (
        df.withColumn("_data", parse_model_json(F.col(response)))
        .withColumns(
            {
                "metadata": F.when(read, analysis_record(data)),
                "error": F.when(~read, "Failed to parse model response"),
                "record": F.when(read, F.to_json(data)),
                "raw": F.when(~read, start),
                "log_line": F.when(read, line).otherwise(
                    F.concat("filename", F.lit(": PARSE ERROR — "), F.substring(start, 1, 100))  # a line of a log
                ),
            }
        )
        .drop("_data")
    )


def model_detect(df: DataFrame, response: str = "response") -> DataFrame:
    """``subject_bbox`` and ``confidence``, or an error."""
    data = F.col("_data")
    box = field_list(data, "bbox", "double")
    return (
        df.withColumn("_data", parse_model_json(F.col(response)))
        .withColumn("subject_bbox", box)
        .withColumns(
            {
                "confidence": F.when(
                    F.col("subject_bbox").isNotNull(), F.coalesce(field_number(data, "confidence"), F.lit(0.5))
                ),
                "error": F.when(F.col("subject_bbox").isNull(), "No bbox detected"),
            }
        )
        .drop("_data")
    )


def model_query(df: DataFrame, response: str = "response", index: str = "image_id", batch_size: int = 64) -> DataFrame:
    """Trimmed answers joined in order, one text per batch of rows."""
    rows = df.select(
        floor_div(index, batch_size).alias("batch"),
        F.col(index).alias("_index"),
        F.trim(response, F.lit(" \t\r\n\f\v")).alias("_text"),
    )
    counts = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("count"))
    joined = join_in_order(rows, ["batch"], "_index", "_text", "\n---\n", "responses")
    return joined.join(counts, "batch")


DEFAULT_PRESET = "natural"


def build_prompt(
    df: DataFrame,
    presets: DataFrame,
    trigger_word: str = "",
    custom_instructions: str = "",
    prompt_override: str = "",
    default: str = DEFAULT_PRESET,
) -> DataFrame:
    """``prompt`` per row from ``presets(preset, template)``; unknown presets use the default's.

    Templates may hold ``{extra}`` and ``{trigger_word}``. The presets table is
    small: it is looked up by the default once and joined by name. Of several templates
    of a preset the last in the alphabet counts, so rows are never multiplied.
    """
    begin = f"Begin the caption with the exact text: {trigger_word}"
    if prompt_override.strip():
        lines = [prompt_override.strip()]
        if trigger_word:
            lines.append(begin)
        if custom_instructions:
            lines.append(custom_instructions)
        return df.withColumn("prompt", F.lit("\n".join(lines)))
    extra = [begin] if trigger_word else []
    if custom_instructions:
        extra.append(f"Additional instructions: {custom_instructions}")
    presets = presets.groupBy("preset").agg(F.max("template").alias("template"))
    fallback = presets.filter(F.col("preset") == default).select("template").scalar()
    template = F.coalesce("template", fallback)
    filled = F.replace(template, F.lit("{extra}"), F.lit("\n".join(extra)))
    return df.join(presets, "preset", "left").withColumn(
        "prompt", F.replace(filled, F.lit("{trigger_word}"), F.lit(trigger_word))
    ).drop("template")


def caption_tokens(preset: Column, tag_presets: Sequence[str] = ()) -> Column:
    """Answers of tag presets are short."""
    return F.when(preset.isin(list(tag_presets)), 300).otherwise(500) if tag_presets else F.lit(500)


def finish_caption(
    df: DataFrame, trigger_word: str = "", structured: str = "structured", response: str = "response"
) -> DataFrame:
    """``caption`` from the answer, with the trigger in front.

    Answers to the structured preset are written anew as JSON where they can be
    read; the keys come out sorted.
    """
    blank = F.lit(" \t\r\n\f\v")
    plain = F.trim(F.col(response), blank)
    as_json = F.to_json(parse_model_json(F.col(response)))
    text = F.when(F.col("preset") == structured, F.coalesce(as_json, plain)).otherwise(plain)
    if trigger_word:
        text = F.when(F.startswith(text, F.lit(trigger_word)), text).otherwise(
            F.concat(F.lit(f"{trigger_word}, "), text)
        )
    return df.withColumn("caption", text).withColumn(
        "preview", F.concat(F.lit("["), "filename", F.lit("]\n"), "caption", F.lit("\n"))
    )


def error_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows and the failed ones. The rows are written first, so no model answers twice."""
    df = written(df, "answers")
    return df.filter("error is null"), df.filter("error is not null")
