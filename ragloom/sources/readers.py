"""Sources: passage reader, language/split resolver, question lists, speech-service responses, eval pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.text import strip

# ISO 2-letter language -> 3-letter file prefix of the passage dataset.
# Telugu is absent on purpose (it has no train split).
LANG_CODE_MAP = {
    "as": "asm", "bn": "ben", "gu": "guj", "hi": "hin", "kn": "kan", "ml": "mal", "mr": "mar",
    "ne": "nep", "or": "ori", "pa": "pan", "sa": "san", "ta": "tam", "ur": "urd",
}

PASSAGES_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("Answer", T.StringType()),
    T.StructField("Eng_Query", T.StringType()),
    T.StructField("Eng_Answer", T.StringType()),
    T.StructField("passages", T.StructType([
        T.StructField("is_selected", T.ArrayType(T.IntegerType())),
        T.StructField("English_passages", T.ArrayType(T.StringType())),
        T.StructField("Translated_passages", T.ArrayType(T.StringType())),
    ])),
    T.StructField("source_lang", T.StringType()),
    T.StructField("target_lang", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


def read_passages(spark: SparkSession, paths, limit: int | None = None, order_by: str = "query_id") -> DataFrame:
    """Read nested passage rows with an explicit schema. A limit is taken over a stable order."""
    df = spark.read.schema(PASSAGES_SCHEMA).parquet(*([paths] if isinstance(paths, str) else paths))
    if limit is not None:
        df = df.orderBy(order_by).limit(limit)
    return df


def first_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """The repeatable "first n rows": file order is not a Spark concept, so order by a key."""
    return df.orderBy(order_by).limit(n)


#: split -> (folder, end of the file name)
SPLITS = {"train": ("train", "train")}
OTHER_SPLIT = ("validation", "val")


def split_path(root: str, code: Column | str, split: str = "train"):
    """``root/folder/<code><end>.parquet`` as a Column (for a Column code) or a string."""
    folder, end = SPLITS.get(split, OTHER_SPLIT)
    start = f"{root.rstrip('/')}/{folder}/"
    return F.concat(F.lit(start), code, F.lit(f"{end}.parquet")) if isinstance(code, Column) else f"{start}{code}{end}.parquet"


def dataset_path(root: str, language: str, split: str = "train") -> str:
    """File of one language; languages without a train file are refused."""
    try:
        return split_path(root, LANG_CODE_MAP[language], split)
    except KeyError:
        raise ValueError(f"no train file for language {language!r}. Available: {', '.join(sorted(LANG_CODE_MAP))}") from None


def lang_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANG_CODE_MAP.items()), "lang string, code string")


def resolve_languages(df: DataFrame, lang_col: str, root: str, split: str = "train") -> DataFrame:
    """Table form of the resolver: join to the 13-row code map (broadcast; fixed size)."""
    m = F.broadcast(lang_map_df(df.sparkSession))
    j = df.join(m, df[lang_col] == m["lang"], "left").drop(m["lang"])
    known = F.col("code").isNotNull()
    return j.withColumn("file_path", F.when(known, split_path(root, F.col("code"), split))).withColumn(
        "status", F.when(known, F.lit("ok")).otherwise(F.lit("unknown language")))


def question_lines(lines: DataFrame, text_col: str = "value", n: int | None = None, order_cols=None) -> DataFrame:
    """One question per line: strip, drop blank lines, optionally the first ``n`` by ``order_cols``."""
    out = lines.withColumn("question", strip(text_col)).where(F.col("question") != "")
    if n is not None:
        out = out.orderBy(*(order_cols or [])).limit(n)
    return out


def read_question_file(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    out = question_lines(lines, "value", n, ["line_no"])
    if out.isEmpty():
        raise ValueError("No queries found - check the question file path/content.")
    return out.select("line_no", "question")


STT_SCHEMA = T.StructType([
    T.StructField("transcript", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("language_code", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("language_probability", T.DoubleType()),
])


def parse_stt_response(json_col) -> Column:
    """Speech-service JSON -> struct(transcript, language, confidence).

    transcript: first non-empty of ``transcript``/``text``, stripped; language defaults to hi-IN only when the
    key is absent (an explicit null stays null); confidence: ``confidence`` unless missing or 0, else
    ``language_probability``.
    """
    raw = json_col if not isinstance(json_col, str) else F.col(json_col)
    j = F.from_json(raw, STT_SCHEMA)
    tr = strip(F.coalesce(F.nullif(j["transcript"], F.lit("")), F.nullif(j["text"], F.lit("")), F.lit("")))
    conf = F.coalesce(F.nullif(j["confidence"], F.lit(0.0)), j["language_probability"])
    has_language = F.array_contains(F.json_object_keys(raw), "language_code")
    language = F.when(has_language, j["language_code"]).otherwise(F.lit("hi-IN"))
    return F.struct(tr.alias("transcript"), language.alias("language"), conf.alias("confidence"))


def classify_stt_error(status_col, body_col) -> Column:
    """Speech-call log row -> struct(retryable, message). 400/401/403/422 are final; other >=400 retry."""
    status = F.col(status_col) if isinstance(status_col, str) else status_col
    body = F.col(body_col) if isinstance(body_col, str) else body_col
    client_err = status.isin(400, 401, 403, 422)
    part = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))  # noqa: E731 - an empty string falls through
    msg = F.coalesce(part("$.error.message"), part("$.detail"), F.when(client_err, part("$.message")), body)
    return F.struct((~client_err & (status >= 400)).alias("retryable"), msg.alias("message"))


EVAL_PAIRS_SCHEMA = "query string, expected_doc_id string"


def read_eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(EVAL_PAIRS_SCHEMA).csv(path)
