"""Inputs from several tables by key, prompts, token estimates and costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .selection import parse_input

# Lookups.


def first_match(table: DataFrame, key: str, columns: list[str], model: str | None = None) -> DataFrame:
    """One row per key: of several, the smallest (model, id), whichever of these columns exist."""
    if model is not None and "model_used" in table.columns:
        table = table.where(F.col("model_used") == model)
    order = [c for c in ("model_used", "id", "enrichment_id") if c in table.columns] or columns
    return table.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(*order)).alias("_first"))


def assemble(keys: DataFrame, tables: dict[str, DataFrame], inputs: list[str], key: str = "sha1", default: str | None = None, model: str | None = None) -> DataFrame:
    """Key rows widened by ``table.column`` inputs; left joins, so a missing row, column or table gives null.

    Columns are named ``table.column``; bare names stay in the ``default`` table, which is ``keys`` itself. Each table
    is reduced to its first row per key before the exchange. A limit cuts the text.
    """
    wanted: dict[str, list[str]] = {}
    for spec in inputs:
        name, _ = parse_input(spec)
        table, dot, column = name.rpartition(".")
        if dot and table != default:
            wanted.setdefault(table, []).append(column)
    out = keys
    for t, columns in wanted.items():
        if t not in tables:
            continue
        there = [c for c in dict.fromkeys(columns) if c in tables[t].columns]
        if not there:
            continue
        side = first_match(tables[t], key, there, model).withColumnsRenamed({key: "_key", "_first": f"_in_{t}"})
        out = out.join(side, out[key] == side["_key"], "left").drop("_key")
    chosen = []
    for spec in inputs:
        name, limit = parse_input(spec)
        table, dot, column = name.rpartition(".")
        if dot and table != default:
            has = table in tables and column in tables[table].columns
            value = F.col(f"`_in_{table}`.`{column}`") if has else F.lit(None).cast("string")
        else:
            value = F.col(f"`{column}`") if column in keys.columns else F.lit(None).cast("string")
        chosen.append((F.substring(value.cast("string"), 1, limit) if limit else value).alias(name))
    return out.select(F.col(key), *[c for c in chosen])


# Prompts.


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by each value in turn (later names see earlier values); ``table.column`` also by its bare name."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        if name in ("rowid", "sha1"):
            continue
        text = F.coalesce(value.cast("string"), F.lit(""))
        out = F.replace(out, F.lit("{" + name + "}"), text)
        if "." in name:
            out = F.replace(out, F.lit("{" + name.rpartition(".")[2] + "}"), text)
    return out


def input_block(values: dict[str, Column]) -> Column:
    """``name: value`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.coalesce(v.cast("string"), F.lit(""))) for n, v in values.items() if n not in ("rowid", "sha1")])


def full_prompt(template: Column | str, values: dict[str, Column]) -> Column:
    return F.concat(fill_template(template, values), F.lit("\n\n"), input_block(values))


def flatten_messages(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One prompt per conversation: system turns as instructions, then user and assistant turns."""
    label = F.when(F.col(role) == "system", "Instructions").when(F.col(role) == "assistant", "Assistant").otherwise("User")
    line = F.concat(label, F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn), line.alias("line"))))
    return conversations.groupBy(conversation).agg(parts.alias("p")).select(conversation, F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("prompt"))


# Tokens.

#: Context windows in thousands of tokens, unless a plain number is given.
CONTEXT = {"gpt-3.5-turbo": 16384, "gpt-3.5-turbo-16k": 16384, "gpt-4": 8192, "gpt-4-32k": 32768, "gpt-4o": 128000, "gpt-4o-mini": 128000}
for _name in ("gemini-2.0-flash", "gemini-2.5-flash", "gemini-2.5-flash-preview-05-20"):
    CONTEXT[_name] = CONTEXT["models/" + _name] = 10**6
SMALLEST_CONTEXT, MARGIN = 8192, 2000


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def context_limit(model: Column | str) -> Column:
    if isinstance(model, str):
        return F.lit(CONTEXT.get(model, SMALLEST_CONTEXT))
    table = F.create_map(*[F.lit(x) for pair in CONTEXT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, model), F.lit(SMALLEST_CONTEXT))


def available_tokens(prompt: Column, model: Column | str, margin: int = MARGIN) -> Column:
    return F.greatest(context_limit(model) - estimate_tokens(prompt) - margin, F.lit(0)).cast("long")


def truncate_input(prompt: Column, text: Column, model: Column | str, margin: int = MARGIN) -> Column:
    """The text, cut to the model's window: '' if the prompt leaves no room, and at the last space if one is near the cut."""
    room = context_limit(model) - margin - estimate_tokens(prompt)
    chars = (room * 4).cast("int")
    cut = F.substring(text, F.lit(1), chars)
    tail = F.instr(F.reverse(cut), " ")
    space = F.length(cut) - tail
    at_word = F.when((tail > 0) & (space > chars * 0.8), F.substring(cut, F.lit(1), space.cast("int"))).otherwise(cut)
    return F.when(estimate_tokens(text) <= room, text).when(room <= 0, "").otherwise(F.when(F.length(cut) < F.length(text), at_word).otherwise(cut))


def truncate_in_prompt(prompt: Column, text: Column, model: Column | str, margin: int = MARGIN, mark: str = "... [TRUNCATED]") -> Column:
    """The prompt with the text inside it cut so that the whole fits."""
    room = context_limit(model) - margin - (estimate_tokens(prompt) - estimate_tokens(text))
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(room * 4, F.lit(0)).cast("int")), F.lit(mark))
    return F.when((estimate_tokens(prompt) <= context_limit(model) - margin) | (F.length(text) == 0), prompt).otherwise(F.replace(prompt, text, cut))


# Costs.

#: Dollars per million tokens, input and output, by families: "in out: names".
_PRICES = """
0.10 0.40: gpt-4.1-nano gpt-4.1-nano-2025-04-14
0.15 0.60: gemini-1.5-flash gemini-2.0-flash gemini-2.0-flash-exp gemini-2.5-flash gpt-4o-mini gpt-4o-mini-2024-07-18 gpt-4o-mini-audio-preview gpt-4o-mini-audio-preview-2024-12-17 gpt-4o-mini-search-preview gpt-4o-mini-search-preview-2025-03-11
0.40 1.60: gpt-4.1-mini gpt-4.1-mini-2025-04-14
0.50 1.50: gpt-3.5-turbo gpt-3.5-turbo-0125
0.55 2.20: o4-mini-flex
0.60 2.40: gpt-4o-mini-realtime-preview gpt-4o-mini-realtime-preview-2024-12-17
1.00 2.00: gpt-3.5-turbo-1106
1.00 4.00: o3-flex
1.10 4.40: o1-mini o1-mini-2024-09-12 o3-mini o3-mini-2025-01-31 o4-mini o4-mini-2025-04-16
1.50 6.00: codex-mini-latest
2.00 8.00: gpt-4.1 gpt-4.1-2025-04-14 o3 o3-2025-04-16
2.50 10.00: gemini-1.5-pro gpt-4o gpt-4o-2024-08-06 gpt-4o-2024-11-20 gpt-4o-audio-preview gpt-4o-audio-preview-2024-10-01 gpt-4o-audio-preview-2024-12-17 gpt-4o-audio-preview-2025-06-03 gpt-4o-search-preview gpt-4o-search-preview-2025-03-11
3.00 12.00: computer-use-preview computer-use-preview-2025-03-11
5.00 15.00: gpt-4o-2024-05-13
5.00 20.00: gpt-4o-realtime-preview gpt-4o-realtime-preview-2024-10-01 gpt-4o-realtime-preview-2024-12-17 gpt-4o-realtime-preview-2025-06-03
10.00 30.00: gpt-4-turbo gpt-4-turbo-preview
15.00 60.00: o1 o1-2024-12-17 o1-preview-2024-09-12
20.00 80.00: o3-pro o3-pro-2025-06-10
30.00 60.00: gpt-4 gpt-4-0613
75.00 150.00: gpt-4.5-preview gpt-4.5-preview-2025-02-27
150.00 600.00: o1-pro o1-pro-2025-03-19
"""
PRICES = {name: tuple(map(float, head.split())) for head, names in (line.split(": ") for line in _PRICES.split("\n") if line) for name in names.split()}


def price_of(model: str) -> tuple[float, float]:
    """By exact name, else without the date, else that of gpt-4o."""
    return PRICES.get(model) or PRICES.get(model.split("-20")[0]) or PRICES["gpt-4o"]


def allowed_model(model: str) -> bool:
    return model in PRICES


def estimate_cost(prompts: DataFrame, prompt: str, models: list[str], output_tokens: int, overhead: int = 200) -> DataFrame:
    """Per model: rows, exact input and output tokens, dollars. One aggregation over the prompts."""
    total = prompts.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(estimate_tokens(F.coalesce(F.col(prompt), F.lit(""))) + overhead), F.lit(0)).alias("input_tokens"))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(price_of(m)[0]).alias("in"), F.lit(price_of(m)[1]).alias("out")) for m in models])
    out = total.withColumn("m", F.explode(rows)).withColumn("output_tokens", F.col("n_rows") * output_tokens)
    return out.select(F.col("m.model").alias("model"), "n_rows", "input_tokens", "output_tokens", ((F.col("input_tokens") * F.col("m.in") + F.col("output_tokens") * F.col("m.out")) / 1e6).alias("cost"))


def estimate_cost_by_sample(n_rows: int, sample_prompt: str, model: str, output_tokens: int, overhead: int = 200) -> float:
    """The quick estimate: one sample's tokens times the rows."""
    price = price_of(model)
    return n_rows * ((len(sample_prompt) // 4 + overhead) * price[0] + output_tokens * price[1]) / 1e6


def needs_confirmation(cost: float, threshold: float = 5.0) -> bool:
    return cost > threshold


def fan_out(rows: DataFrame, models: list[str]) -> DataFrame:
    """Each row once per model, by an inline array: no join."""
    return rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def progress(rows: DataFrame, done: DataFrame, models: list[str], key: str = "sha1") -> DataFrame:
    """Rows done and remaining per model."""
    have = done.select(F.col(key).alias("_key"), F.col("model_used").alias("_model")).distinct()
    wide = fan_out(rows.select(key), models)
    joined = wide.join(have, (wide[key] == have["_key"]) & (wide["model"] == have["_model"]), "left")
    return joined.groupBy("model").agg(F.count_if(F.col("_key").isNotNull()).alias("n_done"), F.count_if(F.col("_key").isNull()).alias("n_remaining"))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
