"""Personal information inside free text (problem 5).

The spans come from the semi-Markov model of ``pii_model``; each is replaced by a
placeholder of its type and the rest of the text stays as it is. Texts are cut out of
their JSON by Spark; the model runs in an Arrow batch function without a shuffle, so
no key is hot. Texts repeat often in logs: within a task equal texts are labelled once
(a memory of ``MEMORY`` texts, which changes time only).

Defined results: null, empty and unreadable texts hold nothing; a text of any length is
read whole; equal rows are cases of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.payloads import fields_of, payload_kind, plain_name
from quern.llm.pii_model import Gazetteer, candidates, decode, train
from quern.session import evaluated, table

MEMORY = 20_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def session_texts(session: DataFrame) -> DataFrame:
    """What is said in ``session_one.message.content``: ``tbl, row_id, block_no, text``."""
    content = F.col("message.content")
    rows = session.select("row_id", content.alias("content")).where("startswith(ltrim(content), '\"') or contains(content, '\"text\"')")
    rows = evaluated(rows, {"v": F.try_parse_json("content")}).drop("content").where("v is not null")
    rows = evaluated(rows, {"shape": F.schema_of_variant("v")})
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("block_no"), F.try_variant_get("v", "$", "string").alias("text")))
    blocks = F.try_variant_get("v", "$", "array<variant>")
    said = F.transform(blocks, lambda b, i: F.struct(i.cast("bigint").alias("block_no"), F.when((F.try_variant_get(b, "$.type", "string") == "text") & (F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING"), F.try_variant_get(b, "$.text", "string")).alias("text")))
    texts = F.when(F.col("shape") == "STRING", whole).when(F.col("shape").startswith("ARRAY"), said)
    return rows.select(F.lit("session_one").alias("tbl"), "row_id", F.inline(texts)).where("text is not null")


def rollout_texts(rollout: DataFrame) -> DataFrame:
    """Messages of users and agents in ``rollout.payload``, whatever their field is called."""
    likely = rollout.where("contains(payload, 'user_message') or contains(payload, 'agent_message')")
    rows = evaluated(likely.select("row_id", "type", "payload"), {"fields": fields_of(F.col("payload"))}).drop("payload")
    rows = evaluated(rows, {"kind": payload_kind(F.col("type"), F.col("fields"))}).where("kind in ('user_message', 'agent_message')")
    # a message held as a list is the strings and the texts of its blocks, one below the other
    element = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.text", "string"))
    listed = lambda v: F.nullif(F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), element), "\n"), F.lit(""))
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v).startswith("ARRAY"), listed(v)).when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.text", "string"))
    named = [string(F.element_at("fields", F.lit(k))) for k in ("message", "text", "body", "content", "msg")]
    renamed = F.filter(F.map_entries("fields"), lambda e: plain_name(e["key"]).isin("message", "text", "body", "content", "msg"))
    text = F.coalesce(*named, string(F.get(renamed, F.lit(0))["value"]))
    rows = evaluated(rows.drop("type", "kind"), {"text": text})
    return rows.select(F.lit("rollout").alias("tbl"), "row_id", F.lit(0).cast("bigint").alias("block_no"), "text").where("text is not null")


def spoken_texts(spark, sf_dir: str) -> DataFrame:
    return session_texts(table(spark, sf_dir, "session_one")).unionByName(rollout_texts(table(spark, sf_dir, "rollout")))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]


def label_texts(texts: DataFrame, name_list: DataFrame) -> DataFrame:
    """``tbl, row_id, block_no, masked, kinds`` of texts that hold personal information.

    ``name_list`` is a fixed table that does not grow with the data; it and the weights
    (some thousand numbers) travel with the function.
    """
    names = tuple((r["person_name"], r["name_kind"]) for r in name_list.where("person_name is not null").orderBy("person_name", "name_kind").collect())
    weights = dict(train(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer = Gazetteer(list(names))
        memory: dict[str, tuple | None] = {}
        for batch in batches:
            keep, masked, kinds = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                if text in memory:
                    found = memory[text]
                else:
                    spans = decode(candidates(text, gazetteer), weights)
                    found = (redact(text, spans), sorted({k for _, _, k in spans})) if spans else None
                    if len(memory) >= MEMORY:
                        memory.clear()
                    if len(text) < 2000:
                        memory[text] = found
                if found:
                    keep.append(i)
                    masked.append(found[0])
                    kinds.append(found[1])
            rows = batch.select(["tbl", "row_id", "block_no"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(masked, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["tbl", "row_id", "block_no", "masked", "kinds"])

    return texts.select("tbl", "row_id", "block_no", "text").where("length(text) > 2").mapInArrow(run, "tbl string, row_id bigint, block_no bigint, masked string, kinds array<string>")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Kinds of personal information per text: ``tbl, row_id, block_no, pii_kind``."""
    found = label_texts(spoken_texts(spark, sf_dir), table(spark, sf_dir, "name_list"))
    return found.select("tbl", "row_id", "block_no", F.explode("kinds").alias("pii_kind"))


def p5_masked(spark, sf_dir: str) -> DataFrame:
    """Texts with personal information, each piece replaced by its placeholder."""
    return label_texts(spoken_texts(spark, sf_dir), table(spark, sf_dir, "name_list")).select("tbl", "row_id", "block_no", "masked")
