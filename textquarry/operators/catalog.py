"""Provider and model catalogues: look-ups, costs, merging with an upstream payload, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST = "struct<input:double,output:double,cache_read:double,cache_write:double>"
MODEL = (
    f"struct<id:string,name:string,family:string,release_date:string,knowledge:string,cost:{COST},limit:struct<context:bigint,output:bigint>,"
    "modalities:struct<input:array<string>,output:array<string>>,capabilities:struct<attachment:boolean,reasoning:boolean,temperature:boolean,tool_call:boolean,streaming:boolean>>"
)
PROVIDERS = f"pos int, id string, display_name string, category string, family string, auth_mode string, key_var string, base_url string, default_model string, models array<{MODEL}>"
_UPSTREAM_MODEL = (
    f"struct<id:string,name:string,family:string,release_date:string,knowledge:string,cost:{COST},limit:struct<context:bigint,output:bigint>,"
    "modalities:struct<input:array<string>,output:array<string>>,attachment:boolean,reasoning:boolean,temperature:boolean,tool_call:boolean>"
)
PAYLOAD = f"map<string,struct<api:string,npm:string,doc:string,models:map<string,{_UPSTREAM_MODEL}>>>"

# Catalogue ids that are upstream's own, and those that upstream names otherwise.
EXACT = ["openai", "zai", "minimax", "minimax-cn", "deepseek", "alibaba", "alibaba-cn", "lmstudio"]
ALIASED = {"gemini": "google", "zai-cn": "zai", "zai-coding": "zai-coding-plan", "zai-cn-coding": "zai-coding-plan", "kimi": "kimi-for-coding", "moonshot": "moonshotai", "alibaba-us": "alibaba"}


def models(providers: DataFrame) -> DataFrame:
    """A row a model: provider, pos, nth (place in the catalogue) and the model's fields."""
    return providers.select(F.col("id").alias("provider"), "pos", F.posexplode("models").alias("nth", "m")).select("provider", "pos", "nth", "m.*")


def by_category(providers: DataFrame, category: str) -> DataFrame:
    return providers.filter(F.col("category") == category).orderBy("pos")


def categories(providers: DataFrame) -> DataFrame:
    """In the order in which they first appear."""
    return providers.groupBy("category").agg(F.min("pos").alias("pos")).orderBy("pos")


def key_vars(providers: DataFrame) -> DataFrame:
    return providers.filter(F.col("key_var") != "").select("key_var").distinct()


def find_model(providers: DataFrame, ids: DataFrame) -> DataFrame:
    """For each wanted model id the first provider of the catalogue that has it."""
    m = models(providers)
    return m.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("provider", "name", "family", "cost", "limit"), F.struct("pos", "nth")).alias("m")).select("id", "m.*")


def estimate_cost(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Add `cost` in units of the price list to (model, input_tokens, output_tokens); null for unknown models and prices."""
    prices = find_model(providers, usage.select(F.col("model").alias("id"))).select(F.col("id").alias("model"), "cost.input", "cost.output")
    return usage.join(prices, "model", "left").withColumn("cost", F.col("input_tokens") * F.col("input") / 1e6 + F.col("output_tokens") * F.col("output") / 1e6).drop("input", "output")


def resolve(provider: Column) -> Column:
    """struct<kind, upstream>: exact, aliased or manual."""
    alias = F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASED.items() for x in kv)), provider)
    kind = F.when(provider.isin(EXACT), "exact").when(alias.isNotNull(), "aliased").otherwise("manual")
    return F.struct(kind.alias("kind"), F.when(kind == "exact", provider).otherwise(alias).alias("upstream"))


def payload_models(payload: DataFrame, column: str = "payload") -> DataFrame:
    """(upstream, api, npm, doc, model...) of a discovery payload (JSON text), by upstream and model id; streaming is on."""
    top = payload.select(F.explode(F.from_json(column, PAYLOAD)).alias("upstream", "p"))
    m = top.select("upstream", "p.api", "p.npm", "p.doc", F.explode_outer("p.models").alias("key", "m"))
    caps = F.struct("m.attachment", "m.reasoning", "m.temperature", "m.tool_call", F.lit(True).alias("streaming"))
    return m.select(
        "upstream", "api", "npm", "doc", F.coalesce("m.id", "key").alias("id"), "m.name", "m.family", "m.release_date", "m.knowledge", "m.cost", "m.limit", "m.modalities", caps.alias("capabilities")
    ).orderBy("upstream", "id")


def _met(providers: DataFrame, upstream: DataFrame) -> DataFrame:
    """Providers with `_up`: their upstream's entry (api, npm, doc, models by id), null where they have none."""
    entry = upstream.groupBy("upstream").agg(
        F.max("api").alias("api"), F.max("npm").alias("npm"), F.max("doc").alias("doc"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct(*_MODEL_FIELDS)).cast(MODEL))).alias("models")
    )
    entry = entry.select(F.col("upstream").alias("_key"), F.struct("api", "npm", "doc", "models").alias("_up"))
    return providers.withColumn("_key", resolve(F.col("id"))["upstream"]).join(entry, "_key", "left")


_MODEL_FIELDS = ["id", "name", "family", "release_date", "knowledge", "cost", "limit", "modalities", "capabilities"]
_NO_MODELS = f"array<{MODEL}>"


def _theirs() -> Column:
    return F.coalesce(F.col("_up.models"), F.array().cast(_NO_MODELS))


def merge_catalog(providers: DataFrame, upstream: DataFrame) -> DataFrame:
    """The merged catalogue, in the columns of `providers`. Upstream (payload_models) wins on a model's fields; a catalogue's
    models stay in their order, those that only it has among them, and those that only upstream has follow by id.
    base_url, npm and doc (where providers has them) are filled from upstream only where they are empty."""
    here = lambda ms, m: F.exists(ms, lambda x: x["id"] == m["id"])
    kept = F.transform("models", lambda m: F.coalesce(F.get(F.filter(_theirs(), lambda u: u["id"] == m["id"]), F.lit(0)), m))
    fill = lambda c, u: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(F.col(f"_up.{u}"), F.col(c))).otherwise(F.col(c))
    filled = {c: fill(c, u) for c, u in (("base_url", "api"), ("npm", "npm"), ("doc", "doc")) if c in providers.columns}
    merged = F.when(F.col("_key").isNull(), F.col("models")).otherwise(F.concat(kept, F.filter(_theirs(), lambda u: ~here(F.col("models"), u))))
    return _met(providers, upstream).withColumns({"models": merged, **filled}).select(providers.columns)


def merge(providers: DataFrame, upstream: DataFrame) -> DataFrame:
    """What merge_catalog() does to each model: provider, id, state (same, updated, added, kept: not upstream), both prices
    and whether the input or output price changed."""
    met = _met(providers, upstream)
    both = F.transform("models", lambda m: F.struct(m.alias("m"), F.get(F.filter(_theirs(), lambda u: u["id"] == m["id"]), F.lit(0)).alias("u")))
    ours = met.select(F.col("id").alias("provider"), F.explode(both).alias("p")).select("provider", "p.m", "p.u")
    new = met.filter("_key is not null").select(F.col("id").alias("provider"), F.explode(F.filter(_theirs(), lambda u: ~F.exists("models", lambda m: m["id"] == u["id"]))).alias("u"))
    price = lambda c: F.struct(F.col(f"{c}.cost.input"), F.col(f"{c}.cost.output"))
    state = F.when(F.col("u").isNull(), "kept").when(F.to_json("m") == F.to_json("u"), "same").otherwise("updated")
    changed = F.col("u").isNotNull() & ~price("m").eqNullSafe(price("u"))
    a = ours.select("provider", F.col("m.id").alias("id"), state.alias("state"), F.col("m.cost").alias("before"), F.col("u.cost").alias("after"), changed.alias("price_changed"))
    b = new.select("provider", F.col("u.id").alias("id"), F.lit("added").alias("state"), F.lit(None).cast(COST).alias("before"), F.col("u.cost").alias("after"), F.lit(False).alias("price_changed"))
    return a.unionByName(b)


def diff(merged: DataFrame) -> DataFrame:
    """One row: added, updated, kept, price_changes, and clean where nothing differs."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = merged.agg(*(n(F.col("state") == s).alias(s) for s in ("added", "updated", "kept")), n(F.col("price_changed")).alias("price_changes"))
    return out.withColumn("clean", (F.col("added") == 0) & (F.col("updated") == 0) & (F.col("price_changes") == 0))


def with_discovered(providers: DataFrame, found: DataFrame) -> DataFrame:
    """The catalogue with models found at run time (provider, pos, and the fields of a model; missing ones are null): each
    takes the place of its provider's model of that id or follows the others by pos; of several with one id the last
    counts. Those of unknown providers stand in a provider `discovered` behind all others, as they come."""
    model = F.struct(*(F.col(c) if c in found.columns else F.lit(None).alias(c) for c in _MODEL_FIELDS)).cast(MODEL)
    known = found.select("provider", "pos", F.col("id").alias("model_id"), model.alias("m")).join(providers.select(F.col("id").alias("provider"), F.lit(True).alias("_k")), "provider", "left")
    mine = known.filter("_k").groupBy("provider", "model_id").agg(F.min("pos").alias("pos"), F.max_by("m", "pos").alias("m"))
    mine = mine.groupBy(F.col("provider").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "model_id", "m"))), lambda x: x["m"]).alias("_new"))
    new = F.coalesce("_new", F.array().cast(_NO_MODELS))
    replaced = F.transform("models", lambda m: F.coalesce(F.get(F.filter(new, lambda u: u["id"] == m["id"]), F.lit(0)), m))
    fresh = F.filter(new, lambda u: ~F.exists("models", lambda m: m["id"] == u["id"]))
    old = providers.join(mine, providers.id == F.col("_p"), "left").withColumn("models", F.concat(replaced, fresh)).select(providers.columns)
    rest = known.filter("_k is null").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "model_id", "m"))), lambda x: x["m"]).alias("models")).filter(F.size("models") > 0)
    made = {"pos": F.lit(2**31 - 1), "models": F.col("models"), "display_name": F.lit("Discovered"), "auth_mode": F.lit("secret")} | {c: F.lit("discovered") for c in ("id", "category", "family")}
    return old.unionByName(rest.select(*(made.get(c, F.lit("")).cast(t).alias(c) for c, t in providers.dtypes)))


def capabilities(providers: DataFrame) -> DataFrame:
    """(id, auth, clears_key, tiers, needs_key, context, vision, tools, reasoning, streaming): how a provider is called, what any
    of its models can, and the largest context. A model without capabilities streams."""
    any_ = lambda f: F.coalesce(F.exists("models", f), F.lit(False))
    return providers.select(
        "id", F.when(F.col("auth_mode").isin("none", "literal", "secret"), F.col("auth_mode")).otherwise("unknown").alias("auth"),
        F.coalesce(F.col("family").isin("openrouter", "local", "custom_unknown"), F.lit(False)).alias("clears_key"), (~F.col("family").eqNullSafe(F.lit("claude_strict"))).alias("tiers"),
        (F.col("key_var") != "").alias("needs_key"), F.coalesce(F.array_max(F.transform("models", lambda m: m["limit"]["context"])), F.lit(0)).alias("context"),
        any_(lambda m: F.array_contains(m["modalities"]["input"], "image")).alias("vision"), any_(lambda m: m["capabilities"]["tool_call"]).alias("tools"), any_(lambda m: m["capabilities"]["reasoning"]).alias("reasoning"),
        any_(lambda m: F.coalesce(m["capabilities"]["streaming"], m["capabilities"].isNull())).alias("streaming"),
    )


def _trial(strategy: str) -> Column:
    if strategy not in ("fallback", "lowest_cost"):
        raise ValueError(strategy)
    mean = (F.col("input") + F.col("output")) / 2
    return F.col("priority") if strategy == "fallback" else F.when(mean.isNull() | F.isnan(mean), float("inf")).otherwise(mean)


def route(backends: DataFrame, strategy: str = "fallback") -> DataFrame:
    """Backends in the order of trial: by priority, or by mean price with unknown prices last; ties in given order (pos)."""
    return backends.orderBy(_trial(strategy), "pos")


def trials(backends: DataFrame, by: list[str], strategy: str = "fallback") -> DataFrame:
    """route() within each group of the columns `by`, as a column `nth` (from 1)."""
    return backends.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(_trial(strategy), "pos")))


def is_permanent(status: Column) -> Column:
    """Client errors that a retry won't mend: 4xx but 408 and 429."""
    return (status >= 400) & (status < 500) & ~status.isin(408, 429)


def retry_bounds(kind: Column, attempt: Column, retry_after: Column, base: float = 0.5) -> Column:
    """struct<low, high> seconds: base*2^n (n at most 6) up to 60, +-50 %; after a rate limit at least its own wait, 300 at most; null for what isn't retried."""
    backoff = F.least(base * F.pow(2.0, F.least(attempt, F.lit(6))), F.lit(60.0))
    floor = F.when(kind == "rate_limited", F.least(F.coalesce(retry_after, F.lit(0)), F.lit(300)).cast("double")).otherwise(0.0)
    return F.when(kind.isin("rate_limited", "server"), F.struct(F.greatest(floor, backoff * 0.5).alias("low"), F.greatest(floor, backoff * 1.5).alias("high")))
