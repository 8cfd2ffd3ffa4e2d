"""Chat imports: JSON, JSON lines and CSV, with columns found by alias, and a report of what was left out.

Readers give one row for each record: row_number and rec, a map of the record's fields as strings. ``import_chat``
turns records into messages and rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import let, round_half_up

# Field names that imports use, in order of precedence.
TIME_NAMES = ("relativeMs", "elapsedMs", "offsetMs", "timeMs", "timestampMs", "relativeSeconds", "elapsedSeconds", "offsetSeconds", "timeSeconds", "timestampSeconds", "seconds", "relativeTime", "videoTime", "messageTime", "messageTimeRaw", "receivedAt", "createdAt", "timestamp", "time", "ts", "시간")
TEXT_NAMES = ("content", "message", "messageText", "text", "body", "comment", "chat", "내용", "메시지")
AUTHOR_NAMES = ("senderHash", "senderChannelId", "authorId", "userId", "channelId", "author", "username", "nickname", "senderName", "sender", "user", "작성자", "닉네임")
MS_NAMES, SECOND_NAMES = TIME_NAMES[:5], TIME_NAMES[5:11]


def _plain(name: str) -> str:
    return name.lower().replace(" ", "").replace("_", "").replace("-", "")


def detect_format(head: Column) -> Column:
    """json, jsonl, csv or empty, by the first marks of a file's text."""
    start = F.regexp_replace(head, r"^\x{FEFF}?\s*", "")
    lines = F.regexp_count(start, F.lit(r"\n\s*\{")) > 0
    return F.when(start == "", "empty").when(start.startswith("["), "json").when(start.startswith("{"), F.when(lines, "jsonl").otherwise("json")).otherwise("csv")


def records_from_lines(lines: DataFrame, order: str = "row_number", value: str = "value") -> DataFrame:
    """Records of JSON lines; a line that is not an object has a null record."""
    parsed = F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE"})
    return lines.select(F.col(order).alias("row_number"), F.when(F.col(value).rlike(r"^\s*\{"), parsed).alias("rec"))


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''")
    return records_from_lines(lines.withColumn("row_number", F.monotonically_increasing_id() + 1))


def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    return records_from_json(spark.read.text(path, wholetext=True))


def records_from_json(files: DataFrame) -> DataFrame:
    """Records of JSON arrays, or of objects that hold one as messages, chatMessages, chats or items: files(value)."""
    files = files.select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    held = F.from_json("value", "struct<messages:array<map<string,string>>,chatMessages:array<map<string,string>>,chats:array<map<string,string>>,items:array<map<string,string>>>")
    rows = F.when(F.col("value").startswith("["), F.from_json("value", "array<map<string,string>>")).otherwise(F.coalesce(held["messages"], held["chatMessages"], held["chats"], held["items"]))
    return files.select(F.posexplode(rows).alias("row_number", "rec")).withColumn("row_number", F.col("row_number") + 1)


def read_chat_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with a header; quotes, doubled quotes and line breaks in cells are read."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)
    names = F.array(*map(F.lit, rows.columns))
    rec = F.map_from_arrays(names, F.array(*(F.col(f"`{c}`") for c in rows.columns)))
    return rows.select((F.monotonically_increasing_id() + 1).alias("row_number"), rec.alias("rec"))


def find_alias(rec: Column, names: tuple[str, ...]) -> Column:
    """First field of rec by the names in order, as struct(name, value); rec as plain_keys gives it."""
    return F.coalesce(*(F.when(F.element_at(rec, _plain(n)).isNotNull(), F.struct(F.lit(_plain(n)).alias("name"), F.element_at(rec, _plain(n)).alias("value"))) for n in names))


def plain_keys(rec: Column) -> Column:
    """The non-null fields of rec; keys without case, spaces, underscores and dashes, the first of equal ones."""
    fields = F.transform(F.map_entries(rec), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), r"[\s_-]", "").alias("key"), e["value"].alias("value")))
    fields = F.filter(fields, lambda e: e["value"].isNotNull())
    return let(fields, lambda f: F.map_from_entries(F.filter(f, lambda e, i: F.array_position(F.transform(f, lambda x: x["key"]), e["key"]) == i + 1)))


def parse_time(found: Column) -> Column:
    """struct(basis, ms) of a time field: clock, ISO date, or number by size and name."""
    return let(found, _parse_time)


def _parse_time(found: Column) -> Column:
    value, name = F.trim(found["value"]), found["name"]
    part = lambda k: F.regexp_extract(value, r"^(\d{1,3}):([0-5]\d):([0-5]\d(?:\.\d{1,3})?)$", k).try_cast("double")
    clock, number = value.rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d(\.\d{1,3})?$"), value.rlike(r"^-?\d+(\.\d+)?$")
    x = value.try_cast("double")
    date = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.unix_millis(F.try_to_timestamp(value)))
    of = lambda basis, ms: F.struct(F.lit(basis).alias("basis"), round_half_up(ms).cast("long").alias("ms"))
    size = F.abs(x)
    return (
        F.when(clock, of("relative", ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000)).when(date.isNotNull(), of("absolute", date.cast("double"))).when(~number | x.isNull(), F.lit(None))
        .when(size >= 1e12, of("absolute", x)).when(size >= 1e9, of("absolute", x * 1000)).when(name.isin(*map(_plain, MS_NAMES)), of("relative", x))
        .when(name.isin(*map(_plain, SECOND_NAMES)), of("relative", x * 1000)).otherwise(of("relative", F.when(size > 172_800, x).otherwise(x * 1000)))
    )


def resolve(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """records with basis, ms, text, author_id and the code of what is missing."""
    keep = [*(keys or []), "row_number"]
    # a generator keeps the optimizer from copying the map's expression into each of its uses
    records = records.select(*keep, F.explode(F.array(plain_keys(F.col("rec")))).alias("rec"))
    found = records.select(*keep, F.col("rec").isNull().alias("_bad"), F.explode(F.array(find_alias(F.col("rec"), TIME_NAMES))).alias("_t"), "rec")
    found = found.select(*keep, "_bad", "_t", find_alias(F.col("rec"), TEXT_NAMES)["value"].alias("text"), find_alias(F.col("rec"), AUTHOR_NAMES)["value"].alias("author_id"))
    found = found.withColumn("_p", parse_time(F.col("_t")))
    code = F.when(F.col("_bad"), "malformed-row").when(F.col("_p").isNull(), "invalid-timestamp").when(F.col("text").isNull() | (F.trim("text") == ""), "missing-text")
    return found.select(*keep, F.col("_p.basis").alias("basis"), F.col("_p.ms").alias("ms"), "text", "author_id", code.alias("code"))


def import_chat(records: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects): the first valid row of each key sets the time basis; rows on another basis are left out,
    absolute times start from the first row's."""
    keys = keys or []
    rows = resolve(records, keys)
    good = rows.where("code is null")
    first = good.groupBy(*keys).agg(F.min_by(F.struct("basis", "ms"), "row_number").alias("first"))
    both = good.join(first, keys) if keys else good.crossJoin(F.broadcast(first))
    same = F.col("basis") == F.col("first.basis")
    messages = both.where(same).select(*keys, "row_number", (F.col("ms") - F.when(F.col("basis") == "absolute", F.col("first.ms")).otherwise(0)).alias("ts_ms"), "text", "author_id")
    rejects = rows.where("code is not null").select(*keys, "row_number", "code").unionByName(both.where(~same).select(*keys, "row_number", F.lit("mixed-basis").alias("code")))
    return messages, rejects


def alias_authors(messages: DataFrame, order: str = "row_number") -> DataFrame:
    """Authors as author_000001 and on, in order of their first message in a broadcast."""
    first = messages.where("author_id is not null").groupBy("broadcast_id", "author_id").agg(F.min(order).alias("_first"))
    number = F.row_number().over(W.partitionBy("broadcast_id").orderBy("_first"))
    named = first.select("broadcast_id", "author_id", F.concat(F.lit("author_"), F.lpad(number.cast("string"), 6, "0")).alias("alias"))
    return messages.join(named, ["broadcast_id", "author_id"], "left")
