"""Chat exports: JSON files of conversations, read into messages with what was skipped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import derived_id
from palimpsest.functions.temporal import readable

# Roles that an export may use.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant"}

_MESSAGE = "struct<id:string,role:string,content:variant,timestamp:string>"
_CONVERSATION = f"struct<id:string,title:string,lastUpdated:string,messages:array<{_MESSAGE}>>"


def conversations(files: DataFrame) -> DataFrame:
    """(filename, position, conversation) of whole files (filename, body): a list, {conversations|chats|items: list} or one object.

    A body that is no JSON gives no row; `rejected` lists those.
    """
    body = F.try_parse_json("body")
    listed = lambda path: F.try_variant_get(body, path, f"array<{_CONVERSATION}>")
    one = F.array(F.try_variant_get(body, "$", _CONVERSATION))
    every = F.coalesce(listed("$"), listed("$.conversations"), listed("$.chats"), listed("$.items"), one)
    return files.select("filename", F.posexplode(every).alias("position", "conversation")).filter("conversation is not null")


def rejected(files: DataFrame) -> DataFrame:
    """Files that can't be read, with the reason."""
    return files.filter(F.try_parse_json("body").isNull()).select("filename", F.lit("not JSON").alias("reason"))


def refused(files: DataFrame) -> DataFrame:
    """(filename, position, reason): everything of some files that can't be taken in, and why; position is null for a whole file.

    NOT_JSON; NO_CONVERSATIONS (JSON without a list of them or one); NOT_AN_OBJECT;
    NO_MESSAGES; NOTHING_READABLE (each message is skipped for its role, an empty
    content or no time); NOTHING_OWN (the person said nothing). A conversation has
    the first reason that holds; the others of its file are taken all the same.
    """
    body = F.try_parse_json("body")
    listed = lambda path: F.try_variant_get(body, path, "array<variant>")
    whole = F.when(F.schema_of_variant(body).startswith("OBJECT"), F.array(body))
    every = F.coalesce(listed("$"), listed("$.conversations"), listed("$.chats"), listed("$.items"), whole)
    broken = F.when(body.isNull(), "NOT_JSON").when(every.isNull() | (F.size(every) == 0), "NO_CONVERSATIONS")
    by_file = files.select("filename", F.lit(None).cast("int").alias("position"), broken.alias("reason")).filter("reason is not null")
    entries = files.select("filename", F.posexplode(every).alias("position", "entry"))
    said = messages(conversations(files)).groupBy("filename", "position").agg(F.count_if(F.col("skipped").isNull()).alias("read"), F.count_if(F.col("skipped").isNull() & (F.col("role") == "user")).alias("own"))
    kind = F.schema_of_variant("entry")
    held = F.try_variant_get("entry", "$.messages", "array<variant>")
    both = entries.join(said, ["filename", "position"], "left")
    why = (
        F.when(F.col("entry").isNull() | ~kind.startswith("OBJECT"), "NOT_AN_OBJECT").when(F.coalesce(F.size(held), F.lit(0)) <= 0, "NO_MESSAGES")
        .when(F.coalesce("read", F.lit(0)) == 0, "NOTHING_READABLE").when(F.col("own") == 0, "NOTHING_OWN")
    )
    return by_file.unionByName(both.select("filename", "position", why.alias("reason")).filter("reason is not null"))


def content_text(content: Column) -> Column:
    """A string, {text}, {content}, or a list or {parts} of those, joined by blank lines."""
    piece = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))
    listed = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.try_variant_get(content, "$.parts", "array<variant>"))
    pieces = F.filter(F.transform(listed, piece), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.trim(F.coalesce(F.array_join(pieces, "\n\n"), piece(content), F.lit("")))


def messages(chats: DataFrame) -> DataFrame:
    """(filename, position, seq, message_id, role, content, at, skipped): one row per message.

    A message without a time of its own has that of the last one before it, at
    first that of the conversation. `skipped` names why a message can't be used:
    its role, an empty content or no time at all; else it is null.
    """
    rows = chats.select("filename", "position", "conversation.lastUpdated", F.posexplode("conversation.messages").alias("seq", "m"))
    role = F.lower(F.trim("m.role"))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    before = Window.partitionBy("filename", "position").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = F.coalesce(F.last(readable(F.col("m.timestamp")), ignorenulls=True).over(before), readable(F.col("lastUpdated")))
    out = rows.select("filename", "position", "seq", F.col("m.id").alias("message_id"), F.try_element_at(known, role).alias("role"), content_text(F.col("m.content")).alias("content"), at.alias("at"))
    why = F.when(F.col("role").isNull(), "role").when(F.col("content") == "", "empty").when(F.col("at").isNull(), "undated")
    return out.withColumn("skipped", why)


def skip_counts(read: DataFrame) -> DataFrame:
    return read.filter("skipped is not null").groupBy("skipped").count()


def conversation_ids(read: DataFrame) -> DataFrame:
    """(filename, position, conversation_id): from the ids of the usable messages, in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_id"))), lambda x: F.coalesce(x["message_id"], F.lit("")))
    return read.filter("skipped is null").groupBy("filename", "position").agg(derived_id(ids).alias("conversation_id"))


def stage(new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("user_id", "source_conversation_id")) -> DataFrame:
    """The imports that aren't there yet, one per key; a repeated load adds nothing."""
    return new.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def staged(new: DataFrame, known: DataFrame) -> DataFrame:
    """What each import (user_id, source_conversation_id, import_id, label) comes to: the first import of its conversation, there before or the smallest id now, whether that is new, and its label.

    A label that the user has for another conversation gets the end of this one's
    id, so that the two can be told apart, by whatever load they came.
    """
    key = ["user_id", "source_conversation_id"]
    there = known.groupBy(*key).agg(F.min("import_id").alias("_there"), F.min("label").alias("_label"))
    first = new.groupBy(*key).agg(F.min("import_id").alias("_first"), F.min_by("label", "import_id").alias("_new"))
    one = first.join(there, key, "left")
    used = known.select("user_id", F.col("label").alias("_new")).distinct().withColumn("_used", F.lit(True))
    again = F.row_number().over(Window.partitionBy("user_id", "_new").orderBy("_first")) > 1
    one = one.join(used, ["user_id", "_new"], "left").withColumn("_again", again)
    clash = F.coalesce("_used", F.lit(False)) | F.col("_again")
    label = F.coalesce("_label", F.when(clash, F.concat("_new", F.lit("-"), F.right("source_conversation_id", F.lit(8)))).otherwise(F.col("_new")))
    return one.select(*key, F.coalesce("_there", "_first").alias("import_id"), F.col("_there").isNull().alias("new"), label.alias("label"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("body"))
