"""Conversations: role rules, budgets, requests, response caching, and decoding of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import estimate_tokens

# Which roles may follow which; None is the start.
AFTER = {None: ["system", "user", "tool"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool"], "tool": ["assistant", "tool"]}


def follows(before: Column, role: Column) -> Column:
    out = F.lit(False)
    for last, roles in AFTER.items():
        out = F.when(before.isNull() if last is None else before == last, role.isin(roles)).otherwise(out)
    return out


def transitions(messages: DataFrame) -> DataFrame:
    """Add `valid`: may the message follow the one before it?"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("valid", follows(F.lag("role").over(w), F.col("role")))


def accept(messages: DataFrame) -> DataFrame:
    """Add `accepted`: messages pushed one by one, where a refused one leaves the conversation as it was. A fold over the
    rows in order that holds only the last role, so a conversation of any length streams through its task."""
    rows = messages.select("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = (), None
        for batch in batches:
            ok = []
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != (conv,):
                    at, last = (conv,), None
                fine = None if role is None else role in AFTER[last]
                if fine:
                    last = role
                ok.append(fine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], [*batch.schema.names, "accepted"])

    dealt = rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("accepted", "boolean")]))


def token_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(estimate_tokens("text").cast("long")).alias("tokens"), F.count("*").alias("messages"))


def truncate(messages: DataFrame, budget: int, needed: int) -> DataFrame:
    """Drop each conversation's oldest messages but system ones until `needed` more tokens fit into `budget`: one that is
    not a system message goes if all but those dropped before it still don't fit. Running sums, which Spark may spill."""
    cost, talk = estimate_tokens("text").cast("long"), ~F.col("role").eqNullSafe(F.lit("system"))
    w = Window.partitionBy("conv_id")
    before = w.orderBy(F.asc_nulls_last("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    costs = messages.withColumns({"_cost": cost, "_talk": talk})
    left = F.sum("_cost").over(w) - F.coalesce(F.sum(F.when(F.col("_talk"), F.col("_cost"))).over(before), F.lit(0))
    return costs.withColumn("_left", left).filter(~F.col("_talk") | (F.col("_left") + needed <= budget)).select(messages.columns)


def requests(messages: DataFrame, model: str, temperature: float = 0.7) -> DataFrame:
    """(conv_id, request): JSON with the first system text apart and the other messages in order. A request is one value
    that holds its whole conversation, so that has to fit a row."""
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    talk = F.transform(F.filter("m", lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    system = F.get(F.filter("m", lambda m: m["role"] == "system"), F.lit(0))["text"]
    return rows.select("conv_id", F.to_json(F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), system.alias("system"), talk.alias("messages"))).alias("request"))


def message_text(parts: Column) -> Column:
    """The text parts of a multimodal message, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def cache_key(model: Column, request: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), request), 256)


def cached(requests_: DataFrame, cache: DataFrame, now: int, ttl: int) -> DataFrame:
    """Requests (key, ...) with `response` from the cache (key, response, stored), null where missing, bad or older than ttl seconds."""
    good = cache.filter((F.lit(now) - F.col("stored") <= ttl) & F.try_parse_json("response").isNotNull()).groupBy("key").agg(F.max_by("response", "stored").alias("response"))
    return requests_.join(good, "key", "left")


def promote(content: Column, reasoning: Column) -> Column:
    """Reasoning takes the place of empty content."""
    return F.when(F.coalesce(content, F.lit("")) == "", F.coalesce(reasoning, F.lit(""))).otherwise(content)


EVENT = "struct<kind:string,content:string,prompt_tokens:int,completion_tokens:int,total_tokens:int,reasoning_tokens:int>"
_USAGE = "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,completion_tokens_details:struct<reasoning_tokens:int>>"


def event_data(line: Column) -> Column:
    """What follows `data: `; null for other lines and for [DONE]."""
    data = F.regexp_replace(F.substring(line, F.lit(7), F.length(line)), r"\s+$", "")
    return F.when(line.startswith("data: ") & (data != "[DONE]"), data)


def _event(kind: str | Column, content: Column | None = None, usage: Column | None = None) -> Column:
    part = lambda n: (usage[n] if usage is not None else F.lit(None)).cast("int").alias(n)
    reasoning = usage["completion_tokens_details"]["reasoning_tokens"] if usage is not None else F.lit(None)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (content if content is not None else F.lit(None)).cast("string").alias("content"), part("prompt_tokens"), part("completion_tokens"), part("total_tokens"), reasoning.cast("int").alias("reasoning_tokens"))


def openai_event(data: Column) -> Column:
    """delta, reasoning, usage or done; null for what says nothing. Reasoning comes before content, usage before the end."""
    parsed = F.from_json(data, f"choices array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>, {_USAGE}")

    def of(v: Column) -> Column:
        first, u = F.get(v["choices"], F.lit(0)), v["usage"]
        thought, said = first["delta"]["reasoning_content"], first["delta"]["content"]
        whole = u["prompt_tokens"].isNotNull() & u["completion_tokens"].isNotNull() & u["total_tokens"].isNotNull()
        return (
            F.when(F.length(thought) > 0, _event("reasoning", thought)).when(F.length(said) > 0, _event("delta", said)).when(first["delta"].isNotNull() & whole, _event("usage", usage=u)).when(first["finish_reason"].isNotNull(), _event("done"))
        )

    return F.get(F.transform(F.array(parsed), of), F.lit(0))  # parsed once, however many branches look at it


def anthropic_event(event: Column, data: Column) -> Column:
    v = F.from_json(data, "delta struct<type:string,text:string,thinking:string>, usage struct<output_tokens:int>")
    d, n = v["delta"], v["usage"]["output_tokens"]
    use = F.struct(F.lit("usage").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("prompt_tokens"), n.alias("completion_tokens"), F.lit(0).alias("total_tokens"), F.lit(None).cast("int").alias("reasoning_tokens"))
    block = F.when((d["type"] == "thinking_delta") & (F.length(d["thinking"]) > 0), _event("reasoning", d["thinking"])).when(~d["type"].eqNullSafe(F.lit("thinking_delta")) & (F.length(d["text"]) > 0), _event("delta", d["text"]))
    return F.when(event == "content_block_delta", block).when((event == "message_delta") & n.isNotNull(), use).when(event.isin("message_delta", "message_stop"), _event("done"))


def assemble(events: DataFrame) -> DataFrame:
    """(stream_id, content, reasoning, total_tokens, done) of events (stream_id, seq, kind, content, total_tokens)."""
    rows = events.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "content", "total_tokens"))).alias("e"))
    text = lambda kind: F.array_join(F.transform(F.filter("e", lambda x: x["kind"] == kind), lambda x: x["content"]), "")
    return rows.select("stream_id", text("delta").alias("content"), text("reasoning").alias("reasoning"), F.array_max(F.transform("e", lambda x: x["total_tokens"])).alias("total_tokens"), F.exists("e", lambda x: x["kind"] == "done").alias("done"))


def arguments_ok(arguments: Column, required: list[str]) -> Column:
    """Is it a JSON object that has all the required keys?"""
    keys = F.json_object_keys(arguments)
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), keys)) == 0, F.lit(False))
