"""Queries over model requests and answers, metadata, captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.functions.arith import floor_div
from imgcurate.functions.parsing import field_flag, field_number, field_text, parse_model_json, parse_model_json_array
from imgcurate.operators import metadata as md
from imgcurate.operators import model as mo
from imgcurate.operators.pixels import encode_for_model
from imgcurate.plans import tables as t
from imgcurate.plans.registry import query

PROMPT = 'Describe the "picture".'


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), "text", "lang", "source", F.encode("text", "UTF-8").alias("encoded")
    )


@query(
    "m1_request_size",
    f"""WITH {t.BOXES} SELECT l_orderkey, l_linenumber,
      CAST(CASE WHEN greatest(width, height) > 1024 THEN trunc(width * (1024.0::DOUBLE / greatest(width, height))) ELSE width END AS INTEGER) AS sent_w,
      CAST(CASE WHEN greatest(width, height) > 1024 THEN trunc(height * (1024.0::DOUBLE / greatest(width, height))) ELSE height END AS INTEGER) AS sent_h
    FROM boxes""",
)
def m1_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.request_size(t.boxes(spark, sf_dir)).select("l_orderkey", "l_linenumber", "sent_w", "sent_h")


@query(
    "m1_encode_pictures",
    """SELECT vec_id AS image_id, '89504E470D0A1A0A' AS signature, 24 AS sent_w, 24 AS sent_h, true AS intact FROM embeddings""",
)
def m1_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures scaled down, as PNG files in requests; sizes are read from the files."""
    encoded = encode_for_model(t.pictures(spark, sf_dir, repeat=4), 24)

    def number(first: int):
        return F.conv(F.hex(F.substring("encoded", first, 4)), 16, 10).cast("int")

    return mo.build_requests(encoded, "What is it?", "any").select(
        "image_id",
        F.hex(F.substring("encoded", 1, 8)).alias("signature"),
        number(17).alias("sent_w"),
        number(21).alias("sent_h"),
        (F.unbase64(F.get_json_object("request", "$.images[0]")) == F.col("encoded")).alias("intact"),
    )


@query(
    "m1_build_requests_generate",
    """SELECT doc_id AS image_id, '{"model":"any","prompt":"Describe the \\"picture\\".","images":["' || to_base64(encode(text))
      || '"],"stream":true,"options":{"temperature":0.1,"num_predict":150}}' AS request FROM documents""",
)
def m1_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.build_requests(_documents(spark, sf_dir), PROMPT, "any", max_tokens=150).select("image_id", "request")


@query(
    "m1_build_requests_chat",
    """SELECT doc_id AS image_id, '{"model":"any","messages":[{"role":"user","content":[{"type":"text","text":"Describe the \\"picture\\"."},'
      || '{"type":"image_url","image_url":{"url":"data:image/png;base64,' || to_base64(encode(text)) || '"}}]}],"temperature":0.1,"max_tokens":150}' AS request
    FROM documents""",
)
def m1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.build_requests(_documents(spark, sf_dir), PROMPT, "any", "chat", max_tokens=150).select("image_id", "request")


@query(
    "m2_assign_endpoint",
    "SELECT doc_id AS image_id, (['http://a:1', 'http://b:2', 'http://c:3'])[doc_id % 3 + 1] AS endpoint FROM documents",
)
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = "http://a:1, http://b:2,, http://c:3 "
    return mo.assign_endpoint(_documents(spark, sf_dir), urls, "http://d:4").select("image_id", "endpoint")


@query(
    "m2_assign_endpoint_sparse_ids",
    "SELECT o_orderkey * 7 AS image_id, (['http://a:1', 'http://b:2'])[(row_number() OVER (ORDER BY o_orderkey) - 1) % 2 + 1] AS endpoint "
    "FROM orders WHERE o_orderkey % 4 = 0",
)
def m2_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns go by place, not by id."""
    sparse = t.table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select((F.col("o_orderkey") * 7).alias("image_id"))
    return mo.assign_endpoint(sparse, "http://a:1,http://b:2", "http://d:4").select("image_id", "endpoint")


@query("m2_assign_default_endpoint", "SELECT doc_id AS image_id, 'http://d:4' AS endpoint FROM documents")
def m2_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.assign_endpoint(_documents(spark, sf_dir), " , ", "http://d:4").select("image_id", "endpoint")


def count_words(batch: pd.DataFrame) -> pd.Series:
    """Stands in for a model: it fails on Spanish and has nothing to say on German."""
    if (batch["lang"] == "es").any():
        raise ValueError("no Spanish")
    lengths = batch["text"].str.len().astype(str)
    return lengths.where(batch["lang"] != "de", None)


MODEL = """SELECT doc_id AS image_id, CASE WHEN lang NOT IN ('es', 'de') THEN CAST(length(text) AS VARCHAR) END AS response,
  CASE lang WHEN 'es' THEN 'no Spanish' WHEN 'de' THEN 'No response received' END AS error FROM documents"""


@query("m3_map_model", MODEL)
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.map_model(_documents(spark, sf_dir), count_words, ["text", "lang"], partitions=8).select(
        "image_id", "response", "error"
    )


@query("m3_map_model_by_endpoint", MODEL)
def m3_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three servers that take two calls at a time each."""
    rows = mo.assign_endpoint(_documents(spark, sf_dir), "http://a:1,http://b:2,http://c:3", "http://d:4")
    return mo.map_model(rows, count_words, ["text", "lang"], endpoint="endpoint", calls=2).select("image_id", "response", "error")


@query(
    "m4_map_with_fallback",
    """SELECT doc_id AS image_id, CASE WHEN lang NOT IN ('es', 'de') THEN CAST(length(text) AS VARCHAR) ELSE text END AS result,
      lang IN ('es', 'de') AS used_fallback FROM documents""",
)
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.map_with_fallback(_documents(spark, sf_dir), count_words, ["text", "lang"], "text").select(
        "image_id", "result", "used_fallback"
    )


@query(
    "m5_assemble_stream",
    """WITH ends AS (SELECT conv_id, min(turn) AS e FROM conversations WHERE length(text) < 40 GROUP BY conv_id)
    SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS response
    FROM conversations LEFT JOIN ends USING (conv_id) WHERE e IS NULL OR turn <= e GROUP BY conv_id""",
)
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as fragments; a short one is the last."""
    chunks = t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("seq"),
        F.col("text").alias("fragment"),
        (F.length("text") < 40).alias("done"),
    )
    return mo.assemble_stream(chunks)


@query("m6_extract_chat_content", "SELECT conv_id, turn, text AS content FROM conversations")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))
    wrapped = t.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(F.array(message).alias("choices"))).alias("response")
    )
    return mo.extract_chat_content(wrapped).select("conv_id", "turn", "content")


@query(
    "m7_parse_model_json",
    f"""WITH {t.ANSWERS} SELECT image_id, ok AS parsed, CASE WHEN ok THEN toxic = 0 END AS keep,
      CASE WHEN ok THEN (n % 11)::DOUBLE END AS quality, CASE WHEN ok THEN lang END AS pose FROM answers""",
)
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    return t.answers(spark, sf_dir).withColumn("data", parse_model_json(F.col("response"))).select(
        "image_id",
        data.isNotNull().alias("parsed"),
        field_flag(data, "keep").alias("keep"),
        field_number(data, "quality").alias("quality"),
        field_text(data, "pose").alias("pose"),
    )


@query(
    "m7_parse_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
)
def m7_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("answer: "), "props", F.lit(" ("), "event_type", F.lit(")"))
    return t.table(spark, sf_dir, "events").select(
        "event_id", field_number(parse_model_json(said), "k").alias("k")
    )


@query(
    "m8_parse_model_json_array",
    f"""WITH {t.ANSWERS} SELECT image_id, CASE WHEN form IN (0, 1, 7) AND n % 5 = 0 THEN [lang, source, 't' || image_id % 7, 'a', 'b', 'c'] END AS tags FROM answers""",
)
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with one array in them (no box) give it; with two, no array can be read."""
    found = parse_model_json_array(F.col("response"))
    return t.answers(spark, sf_dir).select(
        "image_id", F.try_variant_get(found, "$", "array<string>").alias("tags")
    )


@query(
    "m9_model_filter",
    f"""WITH {t.ANSWERS}, judged AS (
      SELECT *, CASE WHEN ok THEN n % 11 ELSE 5 END AS q, NOT ok OR (coalesce(toxic = 0, true) AND n % 11 >= 4) AS keep,
             CASE WHEN NOT ok THEN 'parse error — keeping by default' WHEN n % 11 < 4 THEN 'quality ' || n % 11 || ' < min 4' ELSE 'from ' || source END AS reason
      FROM answers
    ) SELECT image_id, keep, q::DOUBLE AS quality, reason,
        (CASE WHEN keep THEN 'KEEP ' ELSE 'REJECT ' END) || filename || ': q=' || q || ' — ' || reason AS log_line FROM judged""",
)
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.model_filter(t.answers(spark, sf_dir), 4).select("image_id", "keep", "quality", "reason", "log_line")


ANSWER_TEXT = """, texts AS (
  SELECT *, '{' || concat_ws(',', CASE WHEN toxic IS NOT NULL THEN '"keep":' || (toxic = 0) END, '"quality":' || n % 11,
      '"reason":"from ' || source || '"', '"pose":"' || lang || '"', '"camera_angle":"' || source || '"', '"quality_score":' || n % 101,
      '"tags":["' || lang || '","' || source || '","t' || image_id % 7 || '","a","b","c"]',
      CASE WHEN n % 5 <> 0 THEN '"bbox":[' || n % 40 || ',' || n % 30 || ',' || 50 + n % 50 || ',' || 40 + n % 60 || ']' END,
      CASE WHEN n % 5 <> 0 AND image_id % 2 = 0 THEN '"confidence":0.75' END) || '}' AS j
  FROM answers
), responses AS (
  SELECT *, CASE form WHEN 3 THEN '{}' WHEN 4 THEN '' WHEN 5 THEN 'No object: ' || translate(text, '{}[]', '()()')
    WHEN 6 THEN j || ' and ' || j WHEN 0 THEN j WHEN 1 THEN 'Sure, here it is: ' || j || ' Hope it helps.'
    WHEN 2 THEN replace(replace(j, ']', ',]'), '}', ',}') ELSE '```json' || chr(10) || j || chr(10) || '```' END AS response
  FROM texts
)"""


@query(
    "m10_model_analyze",
    f"""WITH {t.ANSWERS}{ANSWER_TEXT} SELECT image_id, CASE WHEN ok THEN (n % 101)::DOUBLE END AS quality_score,
      CASE WHEN ok THEN [lang, source, 't' || image_id % 7, 'a', 'b', 'c'] END AS tags,
      CASE WHEN NOT ok THEN 'Failed to parse model response' END AS error, CASE WHEN NOT ok THEN response END AS raw,
      CASE WHEN ok THEN filename || ': quality=' || n % 101 || ' aesthetic=? pose=' || lang || ' angle=' || source || ' tags=[' || lang || ', ' || source || ', t' || image_id % 7 || ', a, b]'
        ELSE filename || ': PARSE ERROR — ' || response[1:100] END AS log_line FROM responses""",
)
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.model_analyze(t.answers(spark, sf_dir)).select(
        "image_id", "metadata.quality_score", "metadata.tags", "error", "raw", "log_line"
    )


@query(
    "m11_model_detect",
    f"""WITH {t.ANSWERS} SELECT image_id, CASE WHEN ok AND n % 5 <> 0 THEN [n % 40, n % 30, 50 + n % 50, 40 + n % 60]::DOUBLE[] END AS subject_bbox,
      CASE WHEN ok AND n % 5 <> 0 THEN (CASE WHEN image_id % 2 = 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END) END AS confidence,
      CASE WHEN NOT (ok AND n % 5 <> 0) THEN 'No bbox detected' END AS error FROM answers""",
)
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.model_detect(t.answers(spark, sf_dir)).select("image_id", "subject_bbox", "confidence", "error")


@query(
    "m12_model_query",
    """WITH b AS (SELECT doc_id // 64 AS batch, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM documents)
    SELECT batch, string_agg(x, chr(10) || '---' || chr(10) ORDER BY doc_id) AS responses, count(*) AS "count" FROM b GROUP BY batch""",
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.model_query(_documents(spark, sf_dir), "text")


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates a caller may bring: one per region's first letters, and the default."""
    named = t.table(spark, sf_dir, "region").select(
        F.lower(F.substring("r_name", 1, 2)).alias("preset"),
        F.concat(F.lit("Describe it as seen in "), "r_name", F.lit(".\n{extra}\n<{trigger_word}>")).alias("template"),
    )
    default = spark.createDataFrame(
        [(mo.DEFAULT_PRESET, "Describe the picture.\n{extra}")], "preset string, template string"
    )
    return named.groupBy("preset").agg(F.min("template").alias("template")).unionByName(default)


PRESETS = """presets AS (
  SELECT lower(r_name[1:2]) AS preset, min('Describe it as seen in ' || r_name || '.' || chr(10) || '{extra}' || chr(10) || '<{trigger_word}>') AS template
  FROM region GROUP BY 1 UNION ALL SELECT 'natural', 'Describe the picture.' || chr(10) || '{extra}'
)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("image_id"), F.lower(F.substring("n_name", 1, 2)).alias("preset")
    )


@query(
    "m13_build_prompt",
    f"""WITH {PRESETS}, rows AS (SELECT n_nationkey::BIGINT AS image_id, lower(n_name[1:2]) AS preset FROM nation)
    SELECT image_id, replace(replace(coalesce(template, 'Describe the picture.' || chr(10) || '{{extra}}'),
      '{{extra}}', 'Begin the caption with the exact text: tok' || chr(10) || 'Additional instructions: be brief'), '{{trigger_word}}', 'tok') AS prompt
    FROM rows LEFT JOIN presets USING (preset)""",
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.build_prompt(_named(spark, sf_dir), _presets(spark, sf_dir), "tok", "be brief").select("image_id", "prompt")


@query(
    "m13_prompt_override",
    """SELECT n_nationkey::BIGINT AS image_id, 'Say what you see' || chr(10) || 'Begin the caption with the exact text: tok' || chr(10) || 'be brief' AS prompt FROM nation""",
)
def m13_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.build_prompt(
        _named(spark, sf_dir), _presets(spark, sf_dir), "tok", "be brief", " Say what you see "
    ).select("image_id", "prompt")


@query(
    "m14_finish_caption",
    """WITH c AS (SELECT doc_id AS image_id, 'doc_' || doc_id || '.jpg' AS filename, source AS preset,
        trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM documents),
    d AS (SELECT *, CASE WHEN starts_with(x, 'The') THEN x ELSE 'The, ' || x END AS caption FROM c)
    SELECT image_id, filename, caption, preset, '[' || filename || ']' || chr(10) || caption || chr(10) AS preview,
      CASE WHEN preset IN ('src1', 'src2') THEN 300 ELSE 500 END AS max_tokens FROM d""",
)
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"),
        F.col("source").alias("preset"),
        F.col("text").alias("response"),
    )
    return mo.finish_caption(answered, "The").select(
        "image_id", "filename", "caption", "preset", "preview",
        mo.caption_tokens(F.col("preset"), ("src1", "src2")).alias("max_tokens"),
    )


@query(
    "m14_finish_structured",
    """SELECT event_id AS image_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS caption FROM events""",
)
def m14_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("image_id"),
        F.col("event_type").alias("filename"),
        F.lit("structured").alias("preset"),
        F.concat(F.lit("Here: "), "props").alias("response"),
    )
    return mo.finish_caption(answered).select("image_id", "caption")


@query("m15_error_rows", f"SELECT image_id, error FROM ({MODEL}) WHERE error IS NOT NULL")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = mo.map_model(_documents(spark, sf_dir), count_words, ["text", "lang"])
    _, failed = mo.error_rows(answered)
    return failed.select("image_id", "error")


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        floor_div("doc_id", 50).alias("batch"),
        (F.col("doc_id") % 50).alias("index"),
    )


def _metadata_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list for every 50 documents; some records lack a usable index or share one."""
    labelled = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id") % 50
    index = F.when(F.col("doc_id") % 13 == 0, -1).when(F.col("doc_id") % 7 == 0, i - 1).otherwise(i)
    record = F.to_json(
        F.struct(index.alias("_index"), F.col("lang").alias("pose"), (F.col("n_chars") % 10).alias("level"), (F.col("toxic") == 1).alias("toxic"))
    )
    lists = (
        labelled.select(floor_div("doc_id", 50).alias("batch"), F.struct("doc_id", record.alias("r")).alias("p"))
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("ps", lambda p: p["r"]), ", "), F.lit("]"))
    broken = F.col("batch") % 9 == 8
    return lists.select("batch", F.when(broken, F.concat(text, F.lit("]"))).otherwise(text).alias("metadata_json"))


METADATA = """records AS (
  SELECT doc_id, doc_id // 50 AS batch, CASE WHEN doc_id % 13 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN doc_id % 50 - 1 ELSE doc_id % 50 END AS idx,
         lang, n_chars % 10 AS level, toxic = 1 AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)
), last_records AS (
  SELECT batch, idx, arg_max(lang, doc_id) AS pose, arg_max(level, doc_id) AS level, arg_max(coalesce(CAST(toxic AS VARCHAR), ''), doc_id) AS toxic
  FROM records WHERE idx >= 0 AND batch % 9 <> 8 GROUP BY batch, idx
), attached AS (
  SELECT d.doc_id AS image_id, d.doc_id // 50 % 9 <> 8 AS valid, pose, r.level, r.toxic
  FROM documents d LEFT JOIN last_records r ON r.batch = d.doc_id // 50 AND r.idx = d.doc_id % 50
)"""


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.attach_metadata(_image_rows(spark, sf_dir), _metadata_batches(spark, sf_dir))


@query("j1_attach_metadata", f"WITH {METADATA} SELECT image_id, valid AS metadata_valid, pose, level::DOUBLE AS level FROM attached")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.try_parse_json("metadata")
    return _attached(spark, sf_dir).select(
        "image_id", "metadata_valid", field_text(data, "pose").alias("pose"), field_number(data, "level").alias("level")
    )


@query(
    "j2_route",
    f"WITH {METADATA} SELECT image_id, NOT valid OR coalesce(pose IN ('en', 'de'), false) AS matched FROM attached",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.route(_attached(spark, sf_dir), "pose", "EN, de").select("image_id", "matched")


@query(
    "j2_route_numbers_and_missing",
    f"WITH {METADATA} SELECT image_id, NOT valid OR level IS NULL OR level IN (3, 8) AS matched FROM attached",
)
def j2_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.route(_attached(spark, sf_dir), "level", "3,8.0,").select("image_id", "matched")


@query(
    "j3_route_multi",
    f"WITH {METADATA} SELECT image_id, NOT valid OR (coalesce(pose = 'en', false) AND coalesce(toxic = 'true', false)) AS matched FROM attached",
)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.route_multi(_attached(spark, sf_dir), [("pose", "en"), ("toxic", "True")]).select("image_id", "matched")


CAPTIONS = """captions AS (
  SELECT doc_id AS position, 'f' || (doc_id - doc_id % 3) || '.jpg' AS filename, text AS caption FROM documents
), images AS (
  SELECT doc_id AS image_id, doc_id AS position, 'f' || doc_id || '.jpg' AS filename FROM documents
), by_name AS (SELECT filename, arg_max(caption, position) AS caption FROM captions GROUP BY filename)"""


def _captioned(spark: SparkSession, sf_dir: str, positional: bool) -> DataFrame:
    documents = t.table(spark, sf_dir, "documents")
    place = F.col("doc_id").alias("position")

    def name(number):
        return F.concat(F.lit("f"), number.cast("string"), F.lit(".jpg")).alias("filename")

    captions = documents.select(place, name(F.col("doc_id") - F.col("doc_id") % 3), F.col("text").alias("caption"))
    images = documents.select(F.col("doc_id").alias("image_id"), place, name(F.col("doc_id")))
    return md.join_captions(images, captions, positional).select("image_id", "filename", "caption")


@query(
    "j4_join_captions",
    f"WITH {CAPTIONS} SELECT image_id, filename, coalesce(caption, '') AS caption FROM images LEFT JOIN by_name USING (filename)",
)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captioned(spark, sf_dir, False)


@query(
    "j4_join_captions_positional",
    f"""WITH {CAPTIONS} SELECT image_id, i.filename, coalesce(nullif(b.caption, ''), c.caption, '') AS caption
    FROM images i LEFT JOIN by_name b USING (filename) LEFT JOIN captions c USING (position)""",
)
def j4_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captioned(spark, sf_dir, True)
